"""Packing: documents in the order of a space-filling curve, cut into full sequences.

A document's token ids are hashed into a signed vector, which is projected to a few
dimensions; the place of that point on a Hilbert curve is the document's key. Documents are
sorted by key and their ids laid end to end, so neighbours along the curve share sequences;
every sequence but the last is full, and nothing is padded in between.

No task sees the whole order: keys fall into 2^16 ranges whose token counts give units of
about ``UNIT`` tokens (neighbouring ranges together, a heavier range dealt into several by
hash). Each unit's place in the whole is a sum over units, and each unit is cut by streaming.

Defined results: null and empty texts are the end id alone; repeated rows are packed each;
a null id is carried as it is; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import TEXT_BYTES, bounded, column, only, read, ready, spool
from .tokens import pieces

TOKENIZER, END_ID, LENGTH = "word_bpe_49k.json", 2, 4096
#: Dimensions of the hashed vector and of its projection; bits of each coordinate on the curve.
HASHED, DIMENSIONS, BITS = 512, 4, 8
#: Leading bits of the key that make a range, and tokens in a unit of work.
RANGE_BITS, UNIT = 16, 2_000_000
IDS = "doc_id bigint, key bigint, n bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of integer coordinates (Skilling's transposed form)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


@lru_cache(maxsize=1)
def _places() -> tuple[np.ndarray, np.ndarray]:
    """Where each id under 65,536 counts in the hashed vector, and with which sign."""
    mixed = np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) % HASHED, np.where((mixed >> np.uint64(39)) & np.uint64(1), 1.0, -1.0)


def _keys(ids: list[np.ndarray]) -> np.ndarray:
    """Curve keys of documents, from their ids."""
    place, sign = _places()
    flat = np.concatenate(ids)
    at = np.repeat(np.arange(len(ids)) * HASHED, [len(x) for x in ids])
    at += place[flat]
    vectors = np.bincount(at, sign[flat], len(ids) * HASHED).reshape(len(ids), HASHED)
    vectors /= np.maximum(np.sqrt((vectors ** 2).sum(1, keepdims=True)), 1e-9)
    projected = vectors @ np.random.default_rng(7).standard_normal((HASHED, DIMENSIONS))
    cells = np.clip((1 << BITS) / (1 + np.exp(-1.702 * projected)), 0, (1 << BITS) - 1)
    return hilbert(cells.astype(np.int64), BITS)


def _tokenize(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = pieces(tokenizer), np.array([end_id], "<u2").tobytes()
        for batch in batches:
            names, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in bounded(texts, TEXT_BYTES // 4):
                raw = [x + end for x in encoder.ids(texts[a:b])]
                ids = [np.frombuffer(x, "<u2") for x in raw]
                yield pa.RecordBatch.from_arrays([names.slice(a, b - a), pa.array(_keys(ids)), pa.array([len(x) for x in ids], pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "key", "n", "ids"])
        encoder.rest()
    return run


def _units(tokens: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(range, unit, parts, base): which unit a key range is in, into how many parts it is dealt, tokens before the unit."""
    out, unit, held, base = [], 0, 0, 0
    for at in sorted(tokens):
        n = tokens[at]
        if held and held + n > UNIT:
            unit, base, held = unit + 1, base + held, 0
        out.append((at, unit, max(1, n // UNIT), base))     # a range of over UNIT tokens is alone in its unit
        held += n
    return out


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, at = None, 0
        for batch in batches:
            rows = []
            for u, part, base, doc_id, n, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if (u, part) != unit:
                    unit, at = (u, part), base
                wide, begin = memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes()), 0
                while begin < n:
                    size = min(n - begin, length - at % length)
                    rows.append((doc_id, begin, size, zlib.crc32(wide[4 * begin:4 * (begin + size)]), n, at // length, at % length))
                    begin, at = begin + size, at + size
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], names=[c.split()[0] for c in PIECES.split(", ")])
    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` has ids under 65,536."""
    spark = ready(docs)
    rows = spool(only(docs, doc_id=column(docs, doc_id).cast("bigint"), text=column(docs, text).cast("string")).mapInArrow(_tokenize(tokenizer, end_id), IDS), "ids")
    key_range = F.shiftright("key", DIMENSIONS * BITS - RANGE_BITS)
    tokens = {r["range"]: r["n"] for r in rows.groupBy(key_range.alias("range")).agg(F.sum("n").alias("n")).collect()}   # 2^16 rows at most
    units = F.broadcast(spark.createDataFrame(_units(tokens), "range bigint, unit bigint, parts bigint, base bigint"))
    placed = (rows.withColumn("range", key_range).join(units, "range")
              .withColumn("part", F.pmod(F.xxhash64("doc_id", "ids"), F.col("parts"))))
    # A unit dealt into parts is a single range: its parts follow one another.
    parts = placed.groupBy("unit", "part").agg(F.sum("n").alias("n"), F.first("base").alias("base"))
    before = F.sum("n").over(Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    bases = spool(parts.select("unit", "part", (F.col("base") + before).alias("begin")), "units")
    return (placed.select("unit", "part", "key", "doc_id", "n", "ids").join(bases, ["unit", "part"])
            .repartition("unit", "part").sortWithinPartitions("unit", "part", "key", "doc_id", "n", F.crc32("ids"))
            .select("unit", "part", "begin", "doc_id", "n", "ids").mapInArrow(_cut(length), PIECES))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
