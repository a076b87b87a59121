"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. Each
benchmark item gives its windows of ``window`` consecutive words; an item of fewer words,
but not none, is one window. A document word inside any occurrence of a window is hit.

The search is Wu-Manber's, with words as symbols and one search per window length: a shift
table over blocks of two words says how far a cursor may jump, since no window can end
before; where the shift is 0 the hash of the window's suffix and prefix blocks selects a
bucket of windows, and direct comparison of every word confirms an occurrence. Cursors run
over many stretches of a batch at once in numpy.

The benchmark is dealt by hash into chunks of about ``chunk_bytes``; each chunk's items are
broadcast and searched for in turn, and the hits of all chunks are united, so a benchmark
of any size is searched whole while a broadcast stays bounded.

Defined results: null and empty texts have no words; items without words have no window; an
item without an id is searched like any other, its id the empty string; repeated items (id and text) count once; repeated documents each keep their
row; an empty benchmark hits nothing; other columns are untouched.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded, column, only, own_name, read, ready, spool, starts_of, texts

#: Lower-cases A-Z, keeps a-z, 0-9 and all bytes of other characters, and makes the rest spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
SHIFT_BITS = 20
#: Words that one cursor goes through.
STRETCH = 512
#: Chunks searched for before the hits so far are written and read back.
PASSES = 4
RESULT = "n_words bigint, n_hit bigint, hits binary, items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.astype(np.uint64) * np.uint64(0x100000001B3) + b.astype(np.uint64)) * _MIX
    return x ^ (x >> np.uint64(29))


class Windows:
    """Windows of one length, with their shift table and buckets. Word ids start at 1; 0 is any other word."""

    def __init__(self, windows: np.ndarray, items: list[list[int]]):
        self.length, self.items = windows.shape[1], items
        self.block = min(2, self.length)
        most = self.length - self.block + 1
        self.shift = np.full(1 << SHIFT_BITS, most, np.uint8)
        for end in range(self.block, self.length + 1):
            h = self._block(windows[:, end - 1], windows[:, end - self.block])
            np.minimum.at(self.shift, h, self.length - end)
        keys = self._bucket(windows[:, -1], windows[:, -self.block], windows[:, 0], windows[:, self.block - 1])
        order = np.argsort(keys, kind="stable")
        self.keys, self.windows, self.order = keys[order], windows[order], order

    @staticmethod
    def _block(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        return (_mix(first, last) >> np.uint64(20)).astype(np.int64) & ((1 << SHIFT_BITS) - 1)

    @staticmethod
    def _bucket(last, before, first, second) -> np.ndarray:
        return _mix(_mix(before, last), _mix(first, second))

    def _stops(self, ids: np.ndarray) -> np.ndarray:
        """Ends (exclusive) of the places where the shift table cannot rule out a window."""
        n, m = len(ids), self.length
        if n < m:
            return np.empty(0, np.int64)
        begins = np.arange(0, n + 1, STRETCH, dtype=np.int64)
        at, until = np.maximum(begins, m), np.minimum(begins + STRETCH, n + 1)
        live, found = at < until, []
        at, until = at[live], until[live]
        while len(at):
            jump = self.shift[self._block(ids[at - 1], ids[at - self.block])]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < until
            at, until = at[live], until[live]
        return np.concatenate(found)

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, window) of every occurrence."""
        m = self.length
        begin = self._stops(ids) - m
        key = self._bucket(ids[begin + m - 1], ids[begin + m - self.block], ids[begin], ids[begin + self.block - 1])
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        some = hi > lo
        begin, lo, size = begin[some], lo[some], (hi - lo)[some]
        begin, at = np.repeat(begin, size), np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(starts_of(size)[:-1], size)
        same = np.ones(len(begin), bool)
        for k in range(m):
            same &= ids[begin + k] == self.windows[at, k]
        return begin[same], self.order[at[same]]


class Matcher:
    """All windows of some benchmark items, given as (item id, text)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                by_length[size][tuple(ids[i:i + size])].add(number[name])
        self.searches = [Windows(np.array(list(found), np.int32), [sorted(x) for x in found.values()]) for _, found in sorted(by_length.items())]

    def scan(self, items: list[bytes]) -> list[tuple[int, np.ndarray, set[int]]]:
        """For each text: its number of words, which of them are hit, and the numbers of the items found."""
        known, parts, sizes = self.vocabulary, [], []
        for t in items:
            w = words(t)
            sizes.append(len(w))
            parts.append(np.fromiter((known.get(x, 0) for x in w), np.int32, len(w)))
            parts.append(np.zeros(1, np.int32))     # no window runs from one text into the next
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        starts, edges = starts_of(np.array(sizes, np.int64) + 1), np.zeros(len(ids) + 1, np.int32)
        found: dict[int, set[int]] = defaultdict(set)
        for search in self.searches:
            begin, window = search.occurrences(ids)
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + search.length, -1)
            for doc, w in set(zip((np.searchsorted(starts, begin, "right") - 1).tolist(), window.tolist())):
                found[doc].update(search.items[w])
        hit = np.cumsum(edges)[:-1] > 0
        return [(n, hit[starts[i]:starts[i] + n], found.get(i, set())) for i, n in enumerate(sizes)]


@lru_cache(maxsize=PASSES)
def _matcher(key: str, items: tuple, window: int) -> Matcher:
    return Matcher(list(items), window)


def _search_udf(key: str, shared, window: int):
    """Unites the hits of one chunk with those ``before`` it (null at first)."""

    def run(text: pa.Array, before: pa.Array) -> pa.Array:
        matcher, items = _matcher(key, shared.value, window), texts(text)
        old, out = before.to_pylist(), []
        for a, b in bounded(items):
            for (n, hit, found), was in zip(matcher.scan(items[a:b]), old[a:b]):
                names = [matcher.names[i] for i in found]
                if was and was["hits"]:
                    hit = hit | np.unpackbits(np.frombuffer(was["hits"], np.uint8), count=n).astype(bool)
                    names = {*names, *was["items"]}
                n_hit = int(hit.sum())
                out.append((n, n_hit, np.packbits(hit).tobytes() if n_hit else b"", sorted(names)))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["n_words", "n_hit", "hits", "items"])

    run.__annotations__ = {"text": pa.Array, "before": pa.Array, "return": pa.Array}
    return arrow_udf(run, RESULT)


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str, text: str = "text", item_id: str = "item_id", item_text: str = "text",
              window: int = 10, chunk_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with a column ``name``: struct(n_words, n_hit, hits, items) of each text."""
    spark = ready(docs)
    items = only(benchmark, item_id=F.coalesce(column(benchmark, item_id).cast("string"), F.lit("")), text=column(benchmark, item_text).cast("string"))
    items = items.where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    chunks = max(1, -(-size // chunk_bytes))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks))
    out = docs.withColumn(name, F.lit(None).cast(f"struct<{RESULT.replace(' ', ':').replace(',:', ',')}>"))
    for chunk in range(chunks):
        rows = tuple(sorted((r["item_id"], r["text"].encode()) for r in items.where(of == chunk).toLocalIterator()))
        shared = spark.sparkContext.broadcast(rows)
        search = _search_udf(f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}", shared, window)
        out = out.withColumn(name, search(column(docs, text).cast("string") if chunk == 0 else column(out, text).cast("string"), F.col(f"`{name}`")))
        if chunk % PASSES == PASSES - 1 and chunk + 1 < chunks:
            out = spool(out, "hits")
    return out


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 10, chunk_bytes: int = 16 << 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (ids as strings, sorted), items_sha256, contaminated."""
    found = with_hits(only(docs, doc_id=doc_id, text=text), benchmark, "hit", window=window, chunk_bytes=chunk_bytes)
    items = F.array_sort("hit.items")
    return found.select("doc_id", "hit.n_words", "hit.n_hit", F.size("hit.items").cast("bigint").alias("n_items"), items.alias("items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("hit.n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10) -> DataFrame:
    """``docs`` without the contaminated documents; all columns stay."""
    name = own_name(docs, "hit")
    return with_hits(docs, benchmark, name, text=text, window=window).where(F.col(f"{name}.n_hit") == 0).select(*[column(docs, c) for c in docs.columns])


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


#: Words by the same pattern; every window length that occurs is compared at every place.
OP1_SQL = r"""
WITH fixed AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper_case, 'abcdefghijklmnopqrstuvwxyz' AS lower_case),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), upper_case, lower_case), word) AS w FROM documents, fixed),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, upper_case, lower_case), word) AS w FROM benchmark, fixed WHERE text IS NOT NULL),
sized AS (SELECT item, w, least(10, len(w)) AS m FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win
            FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
           FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, lengths WHERE len(w) >= m)),
hits AS (SELECT DISTINCT p.doc_id, p.i, p.m, x.item FROM places p JOIN windows x ON p.m = x.m AND p.win = x.win),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, m)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
