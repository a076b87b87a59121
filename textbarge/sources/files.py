"""File sources (S2, S4, S5) and the row-preserving scan.

``binaryFile`` drops zero-length files and files named ``_x``/``.x``, and a
single missing path fails a whole ``load([...])``. So the row set always
comes from the manifest (or an inventory), LEFT JOINed to the content scanned
from roots/globs; a known length of 0 becomes ``b''``.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.decode import decode_bytes
from ..functions.errors import lenient_error, strict_error
from ..operators.decode import decode_error
from ..profiles import ENGINE_MAX_FILE_BYTES, Profile, get_profile

# Bytes of file content that a Python reader hands on at a time (one file at least).
FRAME_BYTES = 16 * 1024 * 1024
FILE_OVER_ENGINE_LIMIT = "file larger than the engine's 2 GiB limit"


def normalize_path(c="path"):
    """'file:/a/b' / 'file:///a/b' -> '/a/b' so scanned paths join manifest paths."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(col, r"^file:(//)?", "")


def scan_files(spark: SparkSession, roots: str | list[str], glob: str | None = None,
               max_bytes: int | None = None, with_content: bool = True) -> DataFrame:
    """``path, modificationTime, length[, content]`` under the roots, recursively.

    ``max_bytes`` is a plain filter on ``length``; Catalyst pushes it into the
    scan, so the bytes of larger files are never read. Files over Spark's 2 GiB
    binary limit (they would fail their task) are rows without content: their
    bytes are not read either, and ``attach_decoded`` makes them a typed error.
    """
    r = (spark.read.format("binaryFile").option("recursiveFileLookup", "true"))
    if glob:
        r = r.option("pathGlobFilter", glob)
    all_files = r.load(roots if isinstance(roots, list) else [roots])
    df = all_files if max_bytes is None else all_files.where(F.col("length") <= F.lit(max_bytes))
    cols = ["path", "modificationTime", "length"]
    if not with_content:
        return df.withColumn("path", normalize_path("path")).select(*cols)
    out = df.where(F.col("length") <= F.lit(ENGINE_MAX_FILE_BYTES)).select(*cols, "content")
    if max_bytes is None or max_bytes > ENGINE_MAX_FILE_BYTES:
        over = df.where(F.col("length") > F.lit(ENGINE_MAX_FILE_BYTES)).select(*cols)
        out = out.unionByName(over.withColumn("content", F.lit(None).cast("binary")))
    return out.withColumn("path", normalize_path("path"))


def _read_batches(batches):
    cache: dict = {}
    for pdf in batches:
        out, held = [], 0
        for p in pdf["path"]:
            try:
                if _remote(p):
                    fs, inner = _remote_fs(p, cache)
                    with fs.open_input_stream(inner) as fh:
                        out.append((p, fh.read()))
                else:
                    with open(p[5:] if p.startswith("file:") else p, "rb") as fh:
                        out.append((p, fh.read()))
            except OSError:
                out.append((p, None))
            held += len(out[-1][1] or b"")
            if held >= FRAME_BYTES:
                yield pd.DataFrame(out, columns=["path", "content"])
                out, held = [], 0
        yield pd.DataFrame(out, columns=["path", "content"])


def read_bytes(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Read whole files by path on the executors (``mapInPandas``): the fallback for
    files the binaryFile listing never returns (names starting with '_' or '.',
    or outside the scanned roots). Unreadable paths get NULL content."""
    from ..session import ship_package
    ship_package(paths.sparkSession)
    p = paths.select(F.col(path_col).alias("path")).where(F.col("path").isNotNull()).distinct()
    return p.mapInPandas(_read_batches, "path string, content binary")


def attach_decoded(entries: DataFrame, files: DataFrame, profile: Profile | str, path_col: str = "lookup_path",
                   path: str = "path", fallback: bool = True) -> DataFrame:
    """Adds ``text, encoding, error`` of each entry's file to ``entries`` (one row each).

    Bytes are decoded where they are read; only the texts of wanted files are
    joined to the entries, by path. A zero-length file (absent from the scan)
    is the empty text; with ``fallback`` an existing, non-empty file the scan did
    not return is read directly (only those rows go through Python). ``entries``
    has the inventory's ``exists, is_dir, length``; a file that is too large for
    Spark is an error; one that gave no bytes has neither text nor error.
    """
    p = get_profile(profile)
    wanted = entries.select(path_col).where(F.col(path_col).isNotNull()).distinct()

    def decoded(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("path").alias(path_col), decode_bytes("content", p).alias("_d"))

    found = decoded(files.where(F.col("content").isNotNull())).join(wanted, path_col)
    if fallback:
        readable = (F.coalesce(F.col("exists"), F.lit(False)) & ~F.coalesce(F.col("is_dir"), F.lit(False))
                    & F.coalesce(F.col("length"), F.lit(0)).between(1, ENGINE_MAX_FILE_BYTES))
        unseen = entries.where(readable).select(path_col).distinct().join(
            files.select(F.col("path").alias(path_col)), path_col, "left_anti")
        found = found.unionByName(decoded(read_bytes(unseen, path_col)))
    d = F.coalesce(F.col("_d"), F.when(F.col("length") == 0, decode_bytes(F.lit(bytearray(b"")), p)))
    over = F.when(F.col("length") > F.lit(ENGINE_MAX_FILE_BYTES),
                  strict_error("IoError", path, F.lit(FILE_OVER_ENGINE_LIMIT)) if p.name == "strict"
                  else lenient_error("extractionFailed", path, F.lit(FILE_OVER_ENGINE_LIMIT)))
    return (entries.join(found, path_col, "left").withColumn("_d", d)
            .withColumn("text", F.col("_d.text")).withColumn("encoding", F.col("_d.encoding"))
            .withColumn("error", F.coalesce(over, decode_error(F.col("_d"), p, path))).drop("_d"))


def _remote(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def _remote_fs(path: str, cache: dict):
    """(filesystem, path inside it) for a URI, one filesystem per scheme+authority."""
    from pyarrow import fs as pafs
    key = path.split("/", 3)[:3]
    key = "/".join(key)
    if key not in cache:
        cache[key] = pafs.FileSystem.from_uri(path)[0]
    return cache[key], pafs.FileSystem.from_uri(path)[1]


def _stat_one(p: str, cache: dict):
    if _remote(p):
        from pyarrow import fs as pafs
        fs, inner = _remote_fs(p, cache)
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            return (p, False, None, None, None, None, None)
        is_dir = info.type == pafs.FileType.Directory
        size = None if is_dir else int(info.size)
        # Object stores expose no per-file permission bits: access errors surface on read.
        return (p, True, is_dir, True, True, size, size)
    lp = p[5:] if p.startswith("file:") else p
    try:
        st = os.lstat(lp)
    except OSError:
        return (p, False, None, None, None, None, None)
    is_link = os.path.islink(lp)
    target_ok = os.path.exists(lp) if is_link else True
    full = os.stat(lp) if target_ok else st
    return (p, True, os.path.isdir(lp), target_ok, os.access(lp, os.R_OK), int(full.st_size), int(st.st_size))


INVENTORY_PROBED = "path string, exists boolean, is_dir boolean, link_target_exists boolean, readable boolean, " \
                   "length bigint, entry_length bigint"


def _stat_batches(batches):
    cache: dict = {}
    for pdf in batches:
        rows = [_stat_one(p, cache) for p in pdf["path"]]
        yield pd.DataFrame(rows, columns=["path", "exists", "is_dir", "link_target_exists", "readable", "length",
                                          "entry_length"])


def probe_inventory(paths: DataFrame, path_col: str = "lookup_path") -> DataFrame:
    """Stat each distinct path (exists, directory, link target, readable, size).

    ``length`` is the size of what the path leads to (a link's target);
    ``entry_length`` the size of the directory entry itself (for a link, the
    link), which is what the desktop library's size limit looks at.

    Local and shared-mount paths use ``os``; URIs (hdfs://, s3://, gs://, ...)
    use ``pyarrow.fs``. Distributed with ``mapInPandas``; only the path column
    travels, and ``distinct`` is a partial aggregate, so a path repeated in a
    third of the manifest is stat'ed once.
    """
    from ..session import ship_package
    ship_package(paths.sparkSession)
    p = paths.select(F.col(path_col).alias("path")).where(F.col("path").isNotNull()).distinct()
    return p.mapInPandas(_stat_batches, INVENTORY_PROBED)


def _writer(root: str):
    def write(batches):
        cache: dict = {}
        for pdf in batches:
            n = 0
            for rel, data in zip(pdf["relpath"], pdf["content"]):
                body = bytes(data) if data is not None else b""
                if _remote(root):
                    fs, inner = _remote_fs(root.rstrip("/") + "/" + rel, cache)
                    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    with fs.open_output_stream(inner) as fh:
                        fh.write(body)
                else:
                    full = os.path.join(root, rel)
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    with open(full, "wb") as fh:
                        fh.write(body)
                n += 1
            yield pd.DataFrame({"written": [n]})
    return write


def materialize_files(df: DataFrame, root: str, relpath: str = "relpath", content: str = "content") -> int:
    """Write each row's bytes as one file under ``root``, from the executors.

    ``root`` is a shared mount path or a URI (written through ``pyarrow.fs``).
    Used to turn table rows into a file tree for the binaryFile source.
    Rewriting a file is idempotent, so a retried task leaves the same tree.
    Returns the number of files written.
    """
    from ..session import local_path, ship_package
    ship_package(df.sparkSession)
    r = local_path(root)
    out = df.select(F.col(relpath).alias("relpath"), F.col(content).alias("content")).mapInPandas(
        _writer(r), "written long")
    return int(out.agg(F.sum("written")).first()[0] or 0)
