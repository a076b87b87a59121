"""Exact top-k search by integer inner product: norm-bucketed retrieval.

Each component x becomes floor(256 * x). Vectors are sorted by length (their norm) and put
into buckets of ``BUCKET`` neighbours; queries go in blocks. A first bucket, that of the
longest vectors, gives every query the score of its k-th best there, a bound that no answer
can fall below. Then each block meets each bucket that may still hold answers, and for each
query the local cosine threshold t = bound / (|q| * longest of the bucket) decides: over 1,
the bucket is skipped; high, candidates must lie in the feasible range of the query's focus
coordinates (coordinate pruning); otherwise they must be long enough (length pruning).
Candidates are verified by exact products, and the best k of all buckets are merged.

Blocks and buckets are rows of packed vectors; pairs of them are joined by number, so no
task or driver holds all queries or all vectors.

Defined results: a null vector, one with a null or non-finite component, and a null id take
no part; rows are told apart by a key of their own, so repeated ids are rows like any other (a
query's own row alone is left out, and a repeated query id has its ranks once a row); vectors of
different lengths are not compared; components of any size are exact, a score beyond 64 bits is
given as the nearest one that fits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import column, only, read, ready, spool

SCALE = 256
#: Vectors in a bucket, queries in a block.
BUCKET, BLOCK = 2048, 512
#: Coordinate pruning from this local cosine threshold on, over so many focus coordinates.
COORDINATE_FROM, FOCUS = 0.7, 4
_SLACK = 1 + 1e-9


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, col = batch.column(0).to_pylist(), batch.column(1)
        offsets, flat = col.offsets.to_numpy(), col.values
        x = np.floor(SCALE * flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        wide = np.concatenate([[0], np.cumsum(~(np.abs(x) < 2**31))])
        out = []
        for i, (vec_id, valid) in enumerate(zip(ids, col.is_valid().to_pylist())):
            a, b = offsets[i], offsets[i + 1]
            if vec_id is not None and valid and bad[a] == bad[b]:
                v = x[a:b]      # whole numbers: exact as doubles, whatever their size
                out.append((vec_id, b - a, float(v @ v), v.astype("<i4" if wide[a] == wide[b] else "<f8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.float64(), pa.binary()))], names=["vec_id", "dim", "norm2", "v"])


def _packed(most: int):
    """Consecutive rows of equal dimension, ``most`` at a time, as one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held = TaskContext.get().partitionId(), 0, []

        def flush():
            nonlocal number, held
            dim, vectors = held[0][1], [r[3] for r in held]
            if any(len(v) > 4 * dim for v in vectors):
                vectors = [v if len(v) > 4 * dim else np.frombuffer(v, "<i4").astype("<f8").tobytes() for v in vectors]
            ids, keys = (np.array([r[i] for r in held], "<i8").tobytes() for i in (0, 4))
            row = (task, number, dim, np.sqrt(held[0][2]), len(held), ids, keys, b"".join(vectors))
            number, held = number + 1, []
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (len(held) == most or held[0][1] != row[1]):
                    yield flush()
                held.append(row)
        if held:
            yield flush()
    return run


PACKED = "task int, number bigint, dim int, longest double, n int, ids binary, row_keys binary, vectors binary"


def _pack(vectors: DataFrame, most: int, name: str) -> DataFrame:
    """Packs of neighbours in length, numbered from 0 (in ``number``) in that order."""
    order = [F.col("dim"), F.col("norm2").desc(), F.col("vec_id"), F.col("row_key")]
    packs = spool(vectors.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "dim", "norm2", "v", "row_key").mapInArrow(_packed(most), PACKED), name)
    sizes = {r["task"]: r["n"] for r in packs.groupBy("task").agg(F.count("*").alias("n")).collect()}    # one number a task
    at, bases = 0, []
    for task in sorted(sizes):
        bases.append((task, at))
        at += sizes[task]
    bases = F.broadcast(packs.sparkSession.createDataFrame(bases, "task int, before bigint"))
    return packs.join(bases, "task").withColumn("number", F.col("number") + F.col("before")).drop("task", "before")


def _matrix(vectors: bytes, n: int, dim: int) -> np.ndarray:
    """The rows of a pack: 64-bit integers, or doubles where one is beyond 2^31."""
    wide = len(vectors) > 4 * n * dim
    return np.frombuffer(vectors, "<f8" if wide else "<i4").reshape(n, dim).astype(float if wide else np.int64)


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<i8")


_exact = np.frompyfunc(int, 1, 1)


def _products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where every sum stays under 2^53, by whole numbers of any size beyond 2^62."""
    top = float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(rows.shape[-1], 1)
    if top < 2**53:
        return (rows.astype(float) @ q.astype(float)).astype(np.int64)
    if top < 2**62 and rows.dtype == np.int64 and q.dtype == np.int64:
        return rows @ q
    return np.clip(_exact(rows) @ _exact(q), -2**63, 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _thresholds(k: int):
    """Adds each query's k-th best score in the first bucket (minus infinity if it has fewer)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, least, packed = batch.to_pylist(), [], []
            for r in rows:
                q, v, q_keys, keys = _matrix(r["vectors"], r["n"], r["dim"]), _matrix(r["b_vectors"], r["b_n"], r["dim"]), _ids(r["row_keys"]), _ids(r["b_keys"])
                scores = _products(q, v.T).astype(float)
                scores[q_keys[:, None] == keys[None, :]] = -np.inf
                bound = np.full(len(q), -np.inf) if len(keys) < k else np.partition(scores, len(keys) - k, axis=1)[:, len(keys) - k]
                length = np.sqrt((q.astype(float) ** 2).sum(1))
                # What a bucket's longest vector must reach for any query of the block.
                least.append(float(np.min(np.where(bound > 0, bound / np.maximum(length, 1e-12), 0), initial=np.inf)))
                packed.append(bound.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("number", "dim", "n", "ids", "row_keys", "vectors")], pa.array(packed, pa.binary()), pa.array(least, pa.float64())],
                                             names=["number", "dim", "n", "ids", "row_keys", "vectors", "bounds", "needs"])
    return run


def _candidates(t: float, bound: float, q: np.ndarray, length: float, unit: np.ndarray, lengths: np.ndarray, sorted_by: list) -> np.ndarray | slice:
    """Rows of a bucket that can reach ``bound`` with the query."""
    if t >= COORDINATE_FROM:
        cos, focus = min(t, 1.0) / _SLACK, np.argsort(-np.abs(q))[:FOCUS]
        half = np.sqrt(np.maximum(0.0, (1 - (q[focus] / length) ** 2) * (1 - cos * cos)))
        share = q[focus] / length
        # A vector along the coordinate itself is feasible if the query is that near to it.
        low, high = np.where(share <= -cos, -1.0, share * cos - half), np.where(share >= cos, 1.0, share * cos + half)
        low, high = low - 1e-7, high + 1e-7
        ranges = []
        for f, lo, hi in zip(focus, low, high):
            order, values = sorted_by(f)
            ranges.append((np.searchsorted(values, lo, "left"), np.searchsorted(values, hi, "right"), order))
        a, b, order = min(ranges, key=lambda r: r[1] - r[0])
        rows = order[a:b]
        return rows[((unit[rows][:, focus] >= low) & (unit[rows][:, focus] <= high)).all(1)]
    if bound > 0:
        return slice(0, int(np.searchsorted(-lengths, -bound / length / _SLACK, "right")))
    return slice(None)


def _verify(k: int):
    """The best k of each query in each bucket, of at least the query's bound."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, v = _matrix(r["vectors"], r["n"], r["dim"]), _matrix(r["b_vectors"], r["b_n"], r["dim"])
                q_ids, q_keys, ids, keys = (_ids(r[c]) for c in ("ids", "row_keys", "b_ids", "b_keys"))
                lengths = np.sqrt((v.astype(float) ** 2).sum(1))
                unit, columns, out = v / np.maximum(lengths, 1e-12)[:, None], {}, []

                def sorted_by(f):
                    if f not in columns:
                        order = np.argsort(unit[:, f], kind="stable")
                        columns[f] = (order, unit[order, f])
                    return columns[f]

                q_lengths, bounds = np.sqrt((q.astype(float) ** 2).sum(1)), np.frombuffer(r["bounds"])
                ts = np.where(bounds > 0, bounds / np.maximum(q_lengths * r["b_longest"], 1e-12), -1.0)
                for i in np.flatnonzero(ts <= _SLACK):
                    rows = _candidates(ts[i], bounds[i], q[i], q_lengths[i], unit, lengths, sorted_by)
                    names = ids[rows]
                    scores = _products(v[rows], q[i])
                    # A bound is a double: a score as large as its query's bound may round to less.
                    some = np.flatnonzero((scores.astype(float) >= bounds[i]) & (keys[rows] != q_keys[i]))
                    best = some[_best(scores[some], names[some], k)]
                    out.extend(zip([int(q_keys[i])] * len(best), [int(q_ids[i])] * len(best), names[best].tolist(), scores[best].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["row_key", "query_id", "vec_id", "score"])
    return run


def top_k(table: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each row for which ``queries`` (over column vec_id) holds, against all other rows."""
    spark = ready(table)
    rows = only(table, vec_id=column(table, vec_id).cast("bigint"), v=column(table, vector).cast("array<double>"))
    vectors = rows.mapInArrow(_quantise, "vec_id bigint, dim int, norm2 double, v binary")
    vectors = spool(vectors.withColumn("row_key", F.monotonically_increasing_id()), "vectors")
    buckets, blocks = _pack(vectors, BUCKET, "buckets"), _pack(vectors.where(queries), BLOCK, "blocks")
    other = buckets.select("dim", F.col("number").alias("bucket"), F.col("longest").alias("b_longest"), F.col("n").alias("b_n"), F.col("ids").alias("b_ids"), F.col("row_keys").alias("b_keys"), F.col("vectors").alias("b_vectors"))
    # One bucket of each dimension: the longest vectors.
    firsts = F.broadcast(buckets.groupBy("dim").agg(F.min("number").alias("bucket"), F.max("number").alias("last")))
    first = other.join(firsts.select("dim", "bucket"), ["dim", "bucket"], "left_semi")
    bounded = spool(blocks.join(first, "dim").mapInArrow(_thresholds(k), "number bigint, dim int, n int, ids binary, row_keys binary, vectors binary, bounds binary, needs double"), "bounds")
    pairs = (bounded.join(firsts, "dim").select("number", "needs", F.explode(F.sequence("bucket", "last")).alias("bucket"))
             .join(buckets.select(F.col("number").alias("bucket"), "longest"), "bucket").where(F.col("longest") * _SLACK >= F.col("needs")).select("number", "bucket"))
    found = pairs.join(bounded.drop("needs"), "number").join(other.drop("dim"), "bucket").mapInArrow(_verify(k), "row_key bigint, query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("row_key").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH rows AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
           FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
