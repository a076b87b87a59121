"""Validation (P1-P6, P12) as DataFrame operators.

Input rows carry ``path`` and the inventory columns (``exists, is_dir,
link_target_exists, readable, length``) after a LEFT JOIN, so a path the
inventory does not know has ``exists`` NULL and is reported, never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.errors import IO_IS_DIRECTORY, IO_PERMISSION_DENIED, lenient_error, null_error, strict_error
from ..functions.route import is_local
from ..profiles import Profile, get_profile


def missing_paths(manifest: DataFrame, inventory: DataFrame, path_col: str = "lookup_path") -> DataFrame:
    """P2, missing only: manifest rows whose path the inventory lacks (anti join)."""
    inv = inventory.where(F.col("exists")).select(F.col("path").alias(path_col))
    return manifest.join(inv, path_col, "left_anti")


def validation_error(profile: Profile | str, path: str = "path", size: str = "length") -> Column:
    """The first failing pre-read check, in the profile's order, or NULL.

    lenient: P1 notFileURL -> P2/P4 fileNotFound (missing or dangling link)
    -> P3 isDirectory -> P5 permissionDenied -> P6 fileTooLarge (on ``size``: pass
    ``entry_length`` from ``probe_inventory`` to judge a symlink by its own
    size, as the library does).
    strict: P2 FileNotFound (a dangling symlink included) only; the rest surface
    when the file is opened (see ``open_error``).
    """
    p = get_profile(profile)
    exists = F.coalesce(F.col("exists"), F.lit(False))
    if p.name == "strict":
        # The tool's existence test follows symlinks: a dangling link does not exist.
        dangling = F.col("link_target_exists") == F.lit(False)
        return F.when(~exists | dangling, strict_error("FileNotFound", path)).otherwise(null_error())
    # The existence test follows symlinks, so a dangling link is not found right away.
    dangling = F.col("link_target_exists") == F.lit(False)
    e = (F.when(~is_local(F.col(path), p.accepted_schemes), lenient_error("notFileURL", path))
         .when(~exists | dangling, lenient_error("fileNotFound", path))
         .when(F.coalesce(F.col("is_dir"), F.lit(False)), lenient_error("isDirectory", path))
         .when(F.col("readable") == F.lit(False), lenient_error("permissionDenied", path)))
    if p.max_file_bytes is not None:
        e = e.when(F.col(size) > F.lit(p.max_file_bytes), lenient_error("fileTooLarge", path, size=F.col(size)))
    return e.otherwise(null_error())


def open_error(profile: Profile | str, path: str = "path", route: str = "text") -> Column:
    """Strict: what opening the file reports before any decoding / parsing.

    Text route: unreadable -> PermissionDenied, directory -> IoError.
    PDF / image routes: the parser's open fails -> ExtractionError with the OS text.
    """
    p = get_profile(profile)
    if p.name != "strict":
        return null_error()
    if route == "text":
        return (F.when(F.col("readable") == F.lit(False), strict_error("PermissionDenied", path))
                .when(F.col("is_dir") == F.lit(True), strict_error("IoError", path, F.lit(IO_IS_DIRECTORY)))
                .otherwise(null_error()))
    return (F.when(F.col("is_dir") == F.lit(True), strict_error("ExtractionError", path, F.lit(IO_IS_DIRECTORY)))
            .when(F.col("readable") == F.lit(False),
                  strict_error("ExtractionError", path, F.lit(IO_PERMISSION_DENIED)))
            .otherwise(null_error()))


def selection_status(df: DataFrame, keys: list[str], selections: DataFrame | None = None) -> DataFrame:
    """0 -> 'No file selected', >1 -> 'Please select only one file', 1 -> NULL.

    ``selections`` (the keys) names all selections, also those without any item."""
    from ..functions.errors import NO_FILE_SELECTED, SELECT_ONE_FILE
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"))
    if selections is not None:
        out = (selections.select(*keys).distinct().join(out, keys, "left")
               .withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("bigint"))))
    return out.withColumn("message", F.when(F.col("n_items") == 0, F.lit(NO_FILE_SELECTED))
                          .when(F.col("n_items") > 1, F.lit(SELECT_ONE_FILE)))


def workflow_notice(path: str = "path", error: str = "error") -> Column:
    """P3 (workflow), F5, F6: what the per-file loop shows for one entry.

    A path that is not a regular file is skipped ('Not a file: p'); otherwise
    the command-line tool runs: success -> 'Copied contents to clipboard', an
    error -> the last line of its stderr ('Error: <message>') without the
    'Error: ' prefix, cut to 100 characters.
    """
    from ..functions.errors import COPIED_CONTENTS, NOT_A_FILE
    from ..functions.text import fmt, last_line_message, notification
    regular = F.coalesce(F.col("exists"), F.lit(False)) & ~F.coalesce(F.col("is_dir"), F.lit(False))
    stderr = F.concat(F.lit("Error: "), F.col(error).getField("message"))
    return (F.when(~regular, notification(fmt(NOT_A_FILE, path=F.col(path))))
            .when(F.col(error).isNull(), F.lit(COPIED_CONTENTS))
            .otherwise(notification(last_line_message(stderr))))
