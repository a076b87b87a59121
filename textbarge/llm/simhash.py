"""SimHash near-duplicates: fingerprints, exact tiled linking, connected components.

A document's words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z. Every
shingle of ``shingle`` words (repeats included; a shorter document is one shingle) is
hashed by XXH64 with seed 42; a fingerprint bit is 1 if it is set in over half of the
hashes. Documents whose fingerprints differ in at most ``max_bits`` bits are linked.

Linking is exact. Distinct fingerprints are dealt into tiles by the population counts of
their four 16-bit quarters; two fingerprints within ``max_bits`` bits have quarter counts
within ``max_bits`` in sum, so all other tile pairs are skipped. A tile pair is compared
with numpy exclusive-or and bit counts, and emits a spanning forest of its links: no link
between components is lost, and a group of copies never becomes all its pairs.

Defined results: null and empty texts have no shingle and fingerprint 0, linked like any
other; repeated rows and repeated ids each keep their row; an empty table gives an empty
result; other columns are ignored; null ids take part, but never name a component unless
all of it is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded, column, only, own_name, read, ready, rows_sum, spool, starts_of, texts

SEED = 42
#: Fingerprints in a tile, about (dealt by hash).
TILE = 2048
#: Shingles whose hashes are voted on at a time.
VOTES = 1 << 19
#: A fingerprint with over one in so many of all rows is joined by broadcast; there are fewer than this.
HOT = 256


def _shingle_hashes(text: bytes, shingle: int) -> list[int]:
    words = text.lower().split()     # bytes: A-Z only, and exactly these six white-space bytes
    if not words:
        return []
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(flat, SEED)]
    begins = starts_of([len(w) + 1 for w in words])
    ends = (begins[shingle:] - 1).tolist()
    return [digest(flat[a:b], SEED) for a, b in zip(begins.tolist(), ends)]


def _vote(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose hashes lie between consecutive starts."""
    n, counts = np.diff(starts), np.zeros((len(starts) - 1, 64), np.int64)
    for lo in range(0, len(hashes), VOTES):
        part = hashes[lo:lo + VOTES]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += rows_sum(bits, np.clip(starts - lo, 0, len(part)), np.int32)
    return np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_udf(shingle: int):
    def run(text: pa.Array) -> pa.Array:
        items, out = texts(text), []
        for a, b in bounded(items, 2 << 20):
            hashes = [_shingle_hashes(t, shingle) for t in items[a:b]]
            starts = starts_of([len(h) for h in hashes])
            out.append(_vote(np.fromiter((x for h in hashes for x in h), np.uint64, int(starts[-1])), starts))
        flat = np.concatenate(out) if out else np.empty(0, np.uint64)
        return pa.array(flat.view(np.int64))

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return arrow_udf(run, "bigint")


def fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3) -> Column:
    """The 64-bit fingerprint as a signed long; no words: 0."""
    ready(docs)
    return fingerprint_udf(shingle)(column(docs, text).cast("string"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- linking -----------------------------------------------------------------------------

QUARTERS, QUARTER_BITS = 4, 16


def _quarter(fp: Column, i: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, i * QUARTER_BITS).bitwiseAND(F.lit((1 << QUARTER_BITS) - 1).cast("bigint"))).cast("int")


def _near(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts that two fingerprints within ``radius`` bits can have, each pair once."""
    return [d for d in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, d)) <= radius and d >= (0,) * QUARTERS]


def _forest(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between two tiles (or within one)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    a_out, b_out = [], []
    step = max(1, (1 << 20) // max(1, len(right)))
    for lo in range(0, len(left), step):
        x = left[lo:lo + step]
        i, j = np.nonzero(np.bitwise_count(x[:, None] ^ right[None, :]) <= radius)
        if same:
            keep = i + lo < j
            i, j = i[keep], j[keep]
        for a, b in zip(x[i].view(np.int64).tolist(), right[j].view(np.int64).tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                a_out.append(a)
                b_out.append(b)
    return a_out, b_out


def _list_at(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(batch.schema.get_field_index(name))
    return col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).view(np.uint64)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ao, av), (bo, bv) = _list_at(batch, "left"), _list_at(batch, "right")
            same, a_all, b_all = batch.column(batch.schema.get_field_index("same")).to_pylist(), [], []
            for k in range(batch.num_rows):
                a, b = _forest(av[ao[k]:ao[k + 1]], bv[bo[k]:bo[k + 1]], same[k], radius)
                a_all += a
                b_all += b
            yield pa.RecordBatch.from_arrays([pa.array(a_all, pa.int64()), pa.array(b_all, pa.int64())], names=["a", "b"])
    return run


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fps(fp)`` as all pairs within ``max_bits`` bits do."""
    spark = ready(fps)
    counts = [f"q{i}" for i in range(QUARTERS)]
    cells = fps.select("fp", *[_quarter(F.col("fp"), i).alias(q) for i, q in enumerate(counts)])
    # At most 17^4 = 83,521 cells, whatever the input: small enough to broadcast by construction.
    parts = F.broadcast(cells.groupBy(*counts).agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")))
    tiles = (cells.join(parts, counts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .groupBy(*counts, "part").agg(F.collect_list("fp").alias("fps")))
    near = F.array(*[F.struct(*[F.lit(x).alias(q) for q, x in zip(counts, d)]) for d in _near(max_bits)])
    left = (tiles.select(F.col("part").alias("left_part"), F.col("fps").alias("left"), *[F.col(q).alias(f"l{q}") for q in counts], F.explode(near).alias("d"))
            .select("left_part", "left", *[(F.col(f"l{q}") + F.col(f"d.{q}")).alias(q) for q in counts],
                    reduce(lambda x, y: x & y, [F.col(f"d.{q}") == 0 for q in counts]).alias("home")))
    to = (left.join(parts, counts)
          .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
          .where(~F.col("home") | (F.col("part") >= F.col("left_part"))))
    pairs = to.join(tiles.withColumnRenamed("fps", "right"), [*counts, "part"])
    return (pairs.select("left", "right", (F.col("home") & (F.col("part") == F.col("left_part"))).alias("same"))
            .mapInArrow(_compare(max_bits), "a bigint, b bigint"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the undirected ``edges(a, b)`` with the smallest node it reaches.

    Alternating large-star and small-star rounds on the edge table: every round is two
    aggregates to a minimum and joins, so a star of any size is pre-aggregated, and the
    number of rounds grows with the logarithm of the longest path. Stops when a round
    changes nothing (edge count and checksum)."""
    edges = spool(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        edges = spool(small, "links")
        after = state(edges)
        if tuple(after) == tuple(before):
            break
        before = after
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    ready(docs)
    rows = spool(only(docs, doc_id=column(docs, doc_id).cast("bigint"), fp=fingerprint(docs, text, shingle)), "fingerprints")
    nodes = spool(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), max_bits))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = spool(named.join(least, "root").select("fp", "n", "component_id"), "components")
    # Fingerprints that many rows share are few by construction; those rows do not meet in one task.
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = of.where(F.col("n") * HOT > F.lit(total)).withColumn("hot", F.lit(True))
    marked = rows.join(F.broadcast(hot.select("fp", F.col("component_id").alias("hot_id"), "hot")), "fp", "left")
    cold = marked.where("hot is null").join(of.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
    return (cold.union(marked.where("hot").select("doc_id", "fp", F.col("hot_id")))
            .select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that of the smallest id.

    All columns stay. A repeated id is kept once; rows without an id cannot name a group
    and stay."""
    groups = near_duplicates(docs, doc_id, text, shingle, max_bits)
    key, named, rows = own_name(docs, "kept_id"), own_name(docs, "named"), own_name(docs, "copies")
    # Only ids that go, or that several rows have, take part in joins with the texts.
    odd = spool(groups.where("doc_id is not null").groupBy(F.col("doc_id").alias(key))
                .agg(F.max(F.col("doc_id") == F.col("component_id")).alias(named), F.count("*").alias(rows))
                .where(~F.col(named) | (F.col(rows) > 1)), "odd_ids")
    ids = column(docs, doc_id).cast("bigint")
    kept = docs.join(odd, ids == F.col(key), "left_anti")
    if not odd.where(named).isEmpty():
        kept = kept.unionByName(docs.join(odd.where(named), ids == F.col(key), "left_semi").dropDuplicates([doc_id]))
    return kept


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
