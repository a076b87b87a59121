"""Spelling variant grouping: words at edit distance one, by pivotal grams.

Words come from maximal runs of letters (``[A-Za-z\\u00C0-\\u00FF]``) of whole texts, with A-Z
lower-cased; by the contract, a run whose crc32 with its document's id is divisible by 31 loses
one code point first. Results of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT``
occurrences are the words. Tasks count the runs of their texts, Spark adds the counts up.

Bigrams are ordered from rare to frequent (there are at most 90 x 90 of them, for the letters
are a fixed set, so their ranks are broadcast). A word's prefix is its three rarest bigrams,
with every other occurrence of the third; two disjoint ones of them, of the least total
frequency by dynamic programming, are its pivots. One edit spoils at most one of two disjoint
bigrams, and every bigram as rare as one in a prefix is in the other's prefix: of two near words
the one whose prefix ends first has a pivot in the other's prefix, at the same distance from
the start (the edit is behind the pivot) or from the end (it is before it). The letters on the
pivot's other side are the same in both, and of the side with the edit, cut in two, one part
is. So pivots meet prefixes on a hash of bigram, position and those letters; the pair is
verified by its edit distance inside the join, and only near pairs are ever rows. A hot posting
is split by adaptive skew joins; no posting is gathered in a group.

A word's form is its near word of the largest count (ties: smallest in code-point order) if that
is at least ``RATIO`` times the word's own; the root is reached by pointer doubling (counts grow
tenfold a step, so a chain is short).

Defined results: a null or empty text has no words; a null id counts as an empty one in the crc32;
repeated rows count as often as they are there; an empty table gives an empty result; texts and
words of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil, log2, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import column, only, read, ready, spool

LEAST_LENGTH, LEAST_COUNT, RATIO, SPOILED = 7, 2, 10, 31
#: Edit distance, bigrams, and so the size of a prefix and the number of pivots.
EDITS, Q = 1, 2
PREFIX, PIVOTS = Q * EDITS + 1, EDITS + 1
#: Distinct words that a task counts before it hands them on.
FLUSH = 1 << 18
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
#: Words that a task works on at a time, letters of words of one length, and rows that it hands on at a time.
GROUP_WORDS, GROUP_LETTERS, ROWS = 1 << 14, 1 << 20, 1 << 16
POSTING = "key bigint, word string, last int"
#: A word up to this length goes with each of its postings; a longer one goes by a hash, and is looked up for the verification.
LONG = 64
#: Affixes are compared by polynomial hashes modulo 2^64 (pairs that meet are verified).
_BASE = np.uint64(1_000_003)


def _flushed(counts: Counter, least: int = FLUSH) -> Iterator[pa.RecordBatch]:
    if counts and len(counts) >= least:
        items = list(counts.items())
        counts.clear()
        for a in range(0, len(items), 1 << 15):
            word, n = zip(*items[a:a + (1 << 15)])
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_string()).cast(pa.large_binary())):
            if not text.is_valid:
                continue
            seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
            for run, n in Counter(_RUN.findall(text.as_py().lower().decode())).items():
                h = zlib.crc32(run.encode(), seed)
                if h % SPOILED == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                    if len(run) < LEAST_LENGTH:
                        continue
                counts[run] += n
            yield from _flushed(counts)
    yield from _flushed(counts, 0)


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: all words of the texts with their occurrences."""
    ready(docs)
    rows = only(docs, doc_id=column(docs, doc_id).cast("bigint"), text=column(docs, text).cast("string"))
    return rows.mapInArrow(_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for word in batch.column(0).to_pylist():
            counts.update(word[i:i + Q] for i in range(len(word) - Q + 1))
    yield from _flushed(counts, 0)


def pivots(weight: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """For each row of ``weight`` (infinite outside the prefix), which ``most`` disjoint places have the least total weight."""
    k, places = weight.shape
    # cost[j][:, i]: the least weight of j disjoint grams that start before place i.
    cost = [np.zeros((k, places + 1))]
    for _ in range(most):
        before = np.concatenate([cost[-1][:, :1].repeat(min(Q - 1, places), 1), cost[-1][:, :max(places - Q + 1, 0)]], axis=1)
        if len(cost) > 1:
            before[:, :Q - 1] = np.inf
        row = np.minimum.accumulate(weight + before, axis=1)
        cost.append(np.concatenate([np.full((k, 1), np.inf), row], axis=1))
    chosen, end = np.zeros(weight.shape, bool), np.full(k, places)
    for j in range(most, 0, -1):
        # The first place at which the least cost among those before ``end`` is reached.
        best = cost[j][np.arange(k), end]
        at = (cost[j] == best[:, None]).argmax(1) - 1
        chosen[np.arange(k), at] = True
        end = np.maximum(at - Q + 1, 0)
    return chosen


def _mixed(*parts) -> np.ndarray:
    h = np.zeros(1, np.uint64)
    for part in parts:
        h = (h ^ np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return h


def postings(words: list[str], rank: np.ndarray, weight: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, word numbers and ranks of the prefix's last gram, of the pivots (``own``) or of the whole prefixes of words of one length.

    A key stands for a gram, its distance from one end and the letters that are the same in a
    near word: those from that end to the gram, and on to a cut, or from the cut to the other
    end. The cut is that of the shorter of both words: this word's own length (``more`` 0), or
    one less (``more`` 1), where this word has the letter that the other lacks before the cut.
    """
    length = len(words[0])
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)
    heads, tails = (np.zeros((len(words), length + 1), np.uint64) for _ in range(2))
    for i in range(length):
        heads[:, i + 1] = heads[:, i] * _BASE + letters[:, i]
        tails[:, length - 1 - i] = tails[:, length - i] * _BASE + letters[:, length - 1 - i]
    grams = rank[letters[:, :-1] * np.uint64(256) + letters[:, 1:]]
    last = np.partition(grams, PREFIX - 1, axis=1)[:, PREFIX - 1]
    taken = grams <= last[:, None]
    if own:
        taken = pivots(np.where(taken, weight[grams], np.inf))
    w, p = np.nonzero(taken)
    g, end = grams[w, p], p + Q
    keys, of = [], []

    def post(kind, fits, *parts):
        keys.append(_mixed(kind, *[np.broadcast_to(x, w.shape)[fits] for x in parts]))
        of.append(w[fits])

    past = None
    for more in (0, 1):         # edited behind the gram
        fits = end <= length - more
        cut = np.minimum(end + (length - more - end) // 4 * 2, length - more)
        post(1, fits & (True if past is None else cut != past), g, p, heads[w, cut])
        post(2, fits, g, p, heads[w, end], tails[w, np.minimum(cut + more, length)])
        past = cut if past is None else past
    past = None
    for more in (0, 1):         # edited before the gram
        fits = p >= more
        back = np.maximum(p - more, 0) // 4 * 2
        post(3, fits & (True if past is None else back != past), g, length - p, tails[w, p - back])
        post(4, fits, g, length - p, tails[w, p], heads[w, np.maximum(p - more - back, 0)])
        past = back if past is None else past
    return np.concatenate(keys).view(np.int64), np.concatenate(of), last


def _posted(shared, own: bool):
    def rows(words: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
        rank, weight = shared.value
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, some in by_length.items():
            step = max(1, GROUP_LETTERS // length)
            for a in range(0, len(some), step):
                keys, of, last = postings([words[i] for i in some[a:a + step]], rank, weight, own)
                named = pa.array([names[i] for i in some[a:a + step]], pa.string())
                for b in range(0, len(keys), ROWS):
                    part = of[b:b + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[b:b + ROWS]), named.take(pa.array(part)), pa.array(last[part].astype(np.int32))], names=["key", "word", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = [], []
        for batch in batches:
            words += batch.column(0).to_pylist()
            names += batch.column(1).to_pylist()
            if len(words) >= GROUP_WORDS:
                yield from rows(words, names)
                words, names = [], []
        yield from rows(words, names)
    return run


def near_pairs(found: DataFrame) -> DataFrame:
    """a, b: every two of the words at edit distance one, a before b."""
    sc = ready(found).sparkContext
    # At most 90 x 90 bigrams, whatever the words.
    table = found.select("word").mapInArrow(_bigrams, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    rank, weight = np.full(1 << 16, -1, np.int32), np.array(sorted(r["n"] for r in table), float)
    for i, (_, gram) in enumerate(sorted((r["n"], r["word"]) for r in table)):
        rank[ord(gram[0]) << 8 | ord(gram[1])] = i
    shared, length = sc.broadcast((rank, weight)), F.length("word")
    near = F.levenshtein("a", "b", EDITS) == EDITS

    def met(words: DataFrame, verified: Column) -> DataFrame:
        own, other = (words.mapInArrow(_posted(shared, x), POSTING) for x in (True, False))
        own = own.withColumnsRenamed({"word": "a", "last": "a_last"})
        # Estimates do not see how many postings a word has: neither side is small.
        return (own.hint("merge").join(other.withColumnsRenamed({"word": "b", "last": "b_last"}), "key").where((F.col("a_last") <= F.col("b_last")) & (F.col("a") != F.col("b")) & verified)
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    short = met(found.where(length <= LONG).select("word", F.col("word").alias("name")), near)
    named = found.where(length >= LONG).select("word", F.hex(F.xxhash64("word")).alias("name"))
    long_ = met(named, F.lit(True))
    for x in "ab":
        long_ = long_.join(named.select(F.col("word").alias(f"{x}_word"), F.col("name").alias(x)), x)
    long_ = long_.select(F.least("a_word", "b_word").alias("a"), F.greatest("a_word", "b_word").alias("b")).where(near)
    return short.unionByName(long_).distinct()


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    found = spool(words(docs, doc_id, text), "words")
    pairs = spool(near_pairs(found), "near_words")
    ways = pairs.select(F.inline(F.array(*[F.struct(F.col(x).alias("word"), F.col(y).alias("other")) for x, y in ("ab", "ba")])))
    near = ways.join(found.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    rows = found.join(best, "word", "left").withColumn("near_n", -F.col("best.n"))
    formed = F.col("near_n") >= RATIO * F.col("n")
    rows = spool(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "forms")
    most = rows.agg(F.max("form_n")).first()[0]
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    # Counts grow RATIO-fold a step, so no chain has more steps than the largest count has digits.
    for _ in range(ceil(log2(log10(most) + 1)) if most else 0):
        then = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = spool(roots.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))
