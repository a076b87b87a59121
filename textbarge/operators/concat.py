"""Ordered concatenation of a group's texts as segments.

A group (a run) may hold any share of all rows, so its text is never gathered
in one task: it becomes ordered segments of about ``segment_bytes``. Which
segment an entry is in follows from its running offset in the group, computed
on light rows (keys, order, bytes): they are dealt by ranges of (keys, order),
summed inside each range, and the ranges before carry in. Only then are the
texts joined to their segment numbers, on (keys, order), and put together.
Joining the segments in order gives the whole, with nothing in between: the
separator that opens a later segment is part of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import sql_str
from ..session import spool

# What an entry costs a segment beyond its text, so that very many empty texts
# do not meet in one task either.
ENTRY_COST = 64


def _offsets(light: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``before``: the weight of the group's earlier entries."""
    dealt = spool(light.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()), "offsets")
    inside = Window.partitionBy("_part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part", *keys).agg(F.sum("weight").alias("_sum"))
    carried = sums.select("_part", *keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    own = dealt.withColumn("_own", F.coalesce(F.sum("weight").over(inside), F.lit(0)))
    return (own.join(carried, ["_part", *keys]).withColumn("before", F.col("_own") + F.col("_carried"))
            .drop("_part", "_own", "_carried"))


def segment_plan(light: DataFrame, keys: Sequence[str], order: str, segment_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``keys, order, seg`` of each entry of ``light(keys, order, n_bytes)``, and the distinct ``keys, seg``.

    Entries of one group with the same order value share a segment. An entry longer
    than a segment is whole in its own, so numbers ascend but may leave gaps; the first
    entry of a group is in segment 0."""
    keys = list(keys)
    first = F.lit(0).cast("bigint").alias("seg")
    entries = light.groupBy(*keys, order).agg(F.sum(F.col("n_bytes") + ENTRY_COST).alias("weight"))
    large = spool(entries.groupBy(*keys).agg(F.sum("weight").alias("_w")).where(F.col("_w") > segment_bytes), "large_groups")
    if large.isEmpty():
        return entries.select(*keys, order, first), entries.select(*keys).distinct().select(*keys, first)
    offsets = _offsets(entries.join(large.select(*keys), keys, "left_semi"), keys, order)
    numbered = spool(offsets.select(*keys, order, F.floor(F.col("before") / segment_bytes).cast("bigint").alias("seg")), "segments")
    small = entries.join(large.select(*keys), keys, "left_anti")
    return (numbered.unionByName(small.select(*keys, order, first)),
            numbered.select(*keys, "seg").distinct().unionByName(small.select(*keys).distinct().select(*keys, first)))


def put_together(body: DataFrame, keys: Sequence[str], order: str, sep: str, out: str = "text") -> DataFrame:
    """``keys, seg, out``: the texts of ``body(keys, order, seg, _t, _lead)`` in order, those with ``_lead``
    behind a separator, but the first of a group; NULL texts are skipped, empty ones keep their separator.
    Texts of one order value are in the order of the texts."""
    piece = F.when(F.col("_lead"), F.concat(F.lit(sep), F.col("_t"))).otherwise(F.col("_t"))
    made = body.withColumn("_p", piece).groupBy(*keys, "seg").agg(
        F.expr(f"listagg(_p, '') WITHIN GROUP (ORDER BY {order}, _p)").alias("_s"))
    whole = F.when(F.col("seg") == 0, F.substring(F.col("_s"), len(sep) + 1, 2147483647)).otherwise(F.col("_s"))
    return made.where(F.col("_s").isNotNull()).select(*keys, "seg", whole.alias(out))


def planned_segments(rows: DataFrame, numbers: DataFrame, keys: Sequence[str], order: str, text: str, sep: str,
                     lead: Column | None = None, out: str = "text") -> DataFrame:
    """``put_together`` for the entries of ``rows`` that ``numbers(keys, order, seg)`` names."""
    keys = list(keys)
    # On (keys, order), so a large group spreads over all tasks of the join as well.
    body = rows.select(*keys, order, F.col(text).alias("_t"), (F.lit(True) if lead is None else lead).alias("_lead"))
    return put_together(body.join(numbers, [*keys, order]), keys, order, sep, out)


def ordered_segments(rows: DataFrame, light: DataFrame, keys: Sequence[str], order: str, text: str, sep: str,
                     segment_bytes: int, out: str = "text") -> DataFrame:
    """``keys, seg, out``: the texts of ``rows(keys, order, text)`` joined by ``sep`` in order,
    for the entries that ``light(keys, order, n_bytes)`` names."""
    numbers, _ = segment_plan(light, keys, order, segment_bytes)
    return planned_segments(rows, numbers, keys, order, text, sep, out=out)


def joined_bytes(n_parts: Column, n_bytes: Column, sep: str) -> Column:
    """UTF-8 bytes of the parts joined by ``sep``."""
    return (n_bytes + F.greatest(n_parts - 1, F.lit(0)) * F.lit(len(sep.encode("utf-8")))).cast("bigint")
