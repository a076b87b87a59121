"""Payload assembly per run.

Input: one row per manifest entry with ``run_id, ord, path, text, error``. The text of an
entry may come in several rows with a ``part`` from 0 (a document's segments); they follow
each other with nothing in between.
Policies:

* ``fail_fast`` (command-line tool): texts joined with '\\n' in ``ord`` order;
  the first failing entry (by ``ord``) decides the run's error; no payload then.
* ``last_wins`` (workflow loop): every entry is tried, the last success is the
  payload; the run fails only if nothing succeeded (then the last error).
* ``single`` (desktop front end): exactly one entry, blank and output-size
  gates, front-end messages; ``summary`` is the notification shown (success
  text, or the error message cut to 100 characters).

Statistics (counts, first error, byte length) are partial aggregates over light
rows. The payload comes as segments (operators/concat.py): one row per run and
segment, ``seg`` ascending from 0, with the run's other columns repeated; a run
without a payload, or of one segment, is one row. Joining a run's payload
values in ``seg`` order gives its payload, of any size. The run's columns are
expanded to its segment numbers first, as light rows, and meet the texts on
(run, seg), in the partitioning that put the segments together: no text moves
by its run alone. Only the lenient profile's own output limit refuses one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.errors import (COPIED_CONTENTS, FILE_IS_EMPTY, NO_FILE_SELECTED, NOT_LOCAL_NOTICE,
                                SELECT_ONE_FILE, lenient_error, make_error, null_error, strict_error, summary)
from ..functions.text import is_blank, notification
from ..profiles import Profile, get_profile
from ..session import spool
from .concat import joined_bytes, planned_segments, segment_plan

def build_payload(entries: DataFrame, profile: Profile | str = "strict", policy: str = "fail_fast",
                  runs: DataFrame | None = None) -> DataFrame:
    """Returns ``run_id, seg, payload, n_bytes, n_files, n_failed, summary, error``.

    ``runs`` (run_id) names runs that may have no entries at all."""
    p = get_profile(profile)
    if policy == "fail_fast":
        out = _fail_fast(entries, p)
    elif policy == "last_wins":
        out = _last_wins(entries, p)
    elif policy == "single":
        out = _single(entries, p)
    else:
        raise ValueError(policy)
    if runs is not None:
        # A run with no entries at all.
        empty = runs.select("run_id").distinct().join(out.select("run_id"), "run_id", "left_anti")
        none = (strict_error("NoFilesSpecified", F.lit("")) if p.name == "strict"
                else make_error("noSelection", F.lit(""), F.lit(NO_FILE_SELECTED)))
        out = out.unionByName(empty.select(
            "run_id", F.lit(0).cast("bigint").alias("seg"), F.lit(None).cast("string").alias("payload"), F.lit(None).cast("bigint").alias("n_bytes"),
            F.lit(0).cast("bigint").alias("n_files"), F.lit(0).cast("bigint").alias("n_failed"),
            F.lit(None).cast("string").alias("summary"), none.alias("error")))
    return out


def _fail_fast(entries: DataFrame, p: Profile) -> DataFrame:
    # One pass over the texts for their sizes only; then one for the runs that are built.
    order, lead = "ord", F.lit(True)
    if "part" in entries.columns:
        order, lead = "place", F.col("part") == 0
        entries = entries.withColumn("place", F.struct("ord", "part"))
    light = spool(entries.select("run_id", "ord", *{order} - {"ord"}, "path", "error", lead.alias("opens"),
                                 F.octet_length(F.when(F.col("error").isNull(), F.col("text"))).cast("bigint").alias("n_bytes")),
                  "entry_sizes")
    opens = F.col("opens")
    st = spool(light.groupBy("run_id").agg(
        F.count(F.when(opens, 1)).cast("bigint").alias("n_files"),
        F.count(F.when(opens, F.col("error"))).cast("bigint").alias("n_failed"),
        joined_bytes(F.count(F.when(opens, F.col("n_bytes"))), F.coalesce(F.sum("n_bytes"), F.lit(0)), "\n").alias("n_bytes"),
        F.min_by(F.col("error"), F.when(F.col("error").isNotNull(), F.col("ord"))).alias("first_error"),
        F.min_by(F.col("path"), F.col("ord")).alias("first_path")), "runs")
    fits = F.lit(True) if p.max_output_bytes is None else F.col("n_bytes") <= F.lit(p.max_output_bytes)
    st = st.withColumn("built", (F.col("n_failed") == 0) & fits)
    # Failing entries and the entries of runs that are not built have no segment.
    wanted = light.where(F.col("n_bytes").isNotNull()).select("run_id", order, "n_bytes").join(
        st.where("built").select("run_id"), "run_id", "left_semi")
    numbers, slots = segment_plan(wanted, ["run_id"], order, p.segment_bytes)
    segments = planned_segments(entries, numbers, ["run_id"], order, "text", "\n", lead, out="payload")
    # Light rows: the run's columns for each of its segments, the texts by (run, seg).
    heads = st.join(slots, "run_id", "left").withColumn("seg", F.coalesce("seg", F.lit(0).cast("bigint")))
    out = heads.join(segments, ["run_id", "seg"], "left")
    ok = F.col("n_failed") == 0
    err = (F.when(~ok, F.col("first_error"))
           .when(~F.col("built"), lenient_error("outputTooLarge", F.lit(""), size=F.col("n_bytes")))
           .otherwise(null_error()))
    return out.select(
        "run_id", "seg",
        F.when(F.col("built"), F.coalesce(F.col("payload"), F.lit(""))).alias("payload"),
        F.when(ok, F.col("n_bytes")).alias("n_bytes"), "n_files", "n_failed",
        F.when(F.col("built"), summary(F.col("n_bytes"), F.col("n_files"), F.col("first_path"))).alias("summary"),
        err.alias("error"))


def _whole_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """One row an entry with its text (the first part), ``bytes`` of the whole and ``last`` part; and the later parts, if there may be any."""
    if "part" not in entries.columns:
        return entries.withColumns({"bytes": F.octet_length("text").cast("bigint"), "last": F.lit(0).cast("bigint")}), None
    sizes = entries.groupBy("run_id", "ord").agg(F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), F.max("part").alias("last"))
    return (entries.where("part = 0").drop("part").join(sizes, ["run_id", "ord"]),
            entries.where("part > 0").select("run_id", "ord", F.col("part").alias("seg"), F.col("text").alias("payload")))


def _with_later_parts(out: DataFrame, later: DataFrame | None) -> DataFrame:
    """A payload per run, from entry ``ord``, with a row for each later part of its text."""
    if later is not None:
        built = out.where(F.col("payload").isNotNull()).drop("seg", "payload")
        out = out.unionByName(built.join(later, ["run_id", "ord"]))
    return out.drop("ord")


def _last_wins(entries: DataFrame, p: Profile) -> DataFrame:
    entries, later = _whole_entries(entries)
    okc = F.col("error").isNull()
    # One pass: the partial aggregate keeps, per run and map task, only the latest
    # successful entry (its text included), so at most one text per run per task
    # is shuffled, whatever the size of the run.
    out = entries.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_files"),
        F.count(F.col("error")).cast("bigint").alias("n_failed"),
        F.max_by(F.struct("path", "text", "ord", "bytes"), F.when(okc, F.col("ord"))).alias("e"),
        F.max_by(F.col("error"), F.when(~okc, F.col("ord"))).alias("last_error"))
    built = F.col("e.text").isNotNull()
    return _with_later_parts(out.select(
        "run_id", F.lit(0).cast("bigint").alias("seg"), F.col("e.text").alias("payload"), F.col("e.bytes").alias("n_bytes"), "n_files", "n_failed",
        F.when(built, summary(F.col("e.bytes"), F.lit(1), F.col("e.path"))).alias("summary"),
        F.when(~built, F.col("last_error")).otherwise(null_error()).alias("error"), F.col("e.ord").alias("ord")), later)


def _single(entries: DataFrame, p: Profile) -> DataFrame:
    entries, later = _whole_entries(entries)
    agg = entries.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_files"),
        F.count(F.col("error")).cast("bigint").alias("n_failed"),
        # The text goes along only from the first entry of each run and task.
        F.min_by(F.struct("path", "text", "error", "ord", "bytes", "last"), F.col("ord")).alias("e"))
    n = F.col("n_files")
    text, nb = F.col("e.text"), F.col("e.bytes")
    # A text of several parts is not blank: blank ones are refused where they are put together.
    err = (F.when(n > 1, make_error("selection", F.lit(""), F.lit(SELECT_ONE_FILE)))
           .when(F.col("e.error").isNotNull(), F.col("e.error"))
           .when(is_blank(text) & (F.col("e.last") == 0), make_error("empty", F.col("e.path"), F.lit(FILE_IS_EMPTY))))
    if p.max_output_bytes is not None:
        err = err.when(nb > F.lit(p.max_output_bytes), lenient_error("outputTooLarge", F.col("e.path"), size=nb))
    err = err.otherwise(null_error())
    # The front end refuses a non-local item itself, with its own short notice.
    err = F.when(err.getField("kind") == "notFileURL",
                 make_error("notFileURL", F.col("e.path"), F.lit(NOT_LOCAL_NOTICE))).otherwise(err)
    # summary = the notification shown: success text, or the message cut to 100 characters.
    return _with_later_parts(
        agg.withColumn("error", err)
        .select("run_id", F.lit(0).cast("bigint").alias("seg"),
                F.when(F.col("error").isNull(), text).alias("payload"),
                F.when(F.col("error").isNull(), nb).alias("n_bytes"),
                "n_files", "n_failed",
                F.when(F.col("error").isNull(), F.lit(COPIED_CONTENTS))
                .otherwise(notification(F.col("error.message"), graphemes=True)).alias("summary"),
                "error", F.col("e.ord").alias("ord")), later)


def outcome_rollup(decoded: DataFrame, keys=("route",)) -> DataFrame:
    """Success / failure counts by the given keys and error kind."""
    kind = F.coalesce(F.col("error.kind"), F.lit("ok"))
    if "part" in decoded.columns:
        decoded = decoded.where("part = 0")
    return decoded.groupBy(*keys, kind.alias("kind")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
