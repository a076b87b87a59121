"""Phrase collocation mining: n-grams counted in counting quotient filters that lose nothing.

Texts, A-Z lower-cased, are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words
``[^\\x20\\x09]+``. Everything is counted per language (null: ``und``). A candidate is a phrase of
2 to ``LONGEST`` words with at least ``least`` occurrences; its score is that of its lowest cut,
floor(1000 * a * n / (l * r)) in whole numbers, where l and r count both sides of the cut.
Candidates that lie in a longer candidate with the same count are dropped.

The corpus goes through in shards of bounded bytes, each with a dictionary of its own words, in
tables bucketed by shard, so that no join moves a shard's text. The number of a table's buckets
grows with the text, whatever the shuffle partitions, so a task holds about ``HELD`` shards and
the lists of their frequent words and entries. The words with ``least``
occurrences (a language's are its own) are dealt by hash into some times as many deals as there
are shards, and numbered without gaps in each; a word's id is that number and the
deal, so ids have few bits, and n-grams few bytes. For each length from 2,
every shard counts the n-grams whose both shorter parts are frequent (no other can be) in a
counting quotient filter: the word ids, ``bits`` bits each, are permuted invertibly; the top bits of
the result are the quotient, which only a slot's place holds, the rest is the full remainder, kept
whole beside its counter. So filters are compact and exact. A filter is sorted, and is cut into
buckets by the first bits of the quotient; Spark brings the shards' parts of a bucket together,
they are merged, counters added up, and frequent entries go back to the shards that have them and,
permuted back, to the phrases. The number of buckets grows with the corpus, so a merge holds
about ``BUCKET`` entries; an entry is there once a shard, however often the phrase occurs.

Defined results: a null or empty text has no words; repeated rows count as often as they are there;
an empty table gives an empty result; a text of any length is taken whole (a shard holds one text
at least); ties in a language's list are in order of the phrase's bytes; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import fresh_dir, remove_dir
from .common import column, only, read, ready, spool, texts

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text in a shard (one text at least), and entries of all shards in a bucket (about).
SHARD_BYTES, BUCKET = 8 << 20, 1 << 20
#: Shards in a bucket of a table (about, at most).
HELD = 4
#: Bytes of rows in an Arrow batch at most: a row is as large as a shard.
BATCH_BYTES, _BATCH_BYTES = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Parts into which a language's candidates are dealt for the first choice of its best.
DEALT = 64
#: Passes of the permutation over the words of an n-gram.
PASSES = 3
SHARD = "shard bigint, codes binary, words array<string>, kinds array<int>, counts array<bigint>, langs array<string>, tokens array<bigint>"
STATE = "shard bigint, seq binary, ids binary, cur binary, bucket bigint, first bigint, payload binary"
MERGED = "shard bigint, at array<bigint>, total array<bigint>"
_NAMES = {k: [c.split()[0] for c in k.split(", ")] for k in (SHARD, STATE, MERGED)}
#: Separators of pieces become points, tabs blanks, A-Z a-z.
_TABLE = bytes(ord(".") if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in bytes(range(256)).lower())
_BREAK = b"."


class _Numbers(dict):
    """Local numbers of a language's words, from 1 and shared with the other languages; the break between pieces is 0."""

    def __init__(self, words: list[bytes], kinds: list[int], kind: int):
        super().__init__({_BREAK: 0})
        self.words, self.kinds, self.kind = words, kinds, kind

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self.kinds.append(self.kind)
        self[word] = n = len(self.words)
        return n


def _row(schema: str, kinds: list[pa.DataType], values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=_NAMES[schema])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds_ = [pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]
    shard = TaskContext.get().partitionId() << 32
    words, kinds, langs, codes, held = [], [], {}, [], 0

    def row():
        flat = np.concatenate(codes)
        counts, of = np.bincount(flat, minlength=len(words) + 1)[1:], np.array(kinds, np.int64)
        tokens = np.bincount(of, counts, len(langs)).astype(np.int64)
        # Frequent words first: their numbers are small, here and as ids. Equal ones by their letters: they are stored and shuffled smaller.
        by_word = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = by_word[np.argsort(-counts[by_word], kind="stable")]
        rank = np.zeros(len(words) + 1, np.int32)
        rank[order + 1] = np.arange(1, len(words) + 1, dtype=np.int32)
        return _row(SHARD, kinds_, (shard, _stored(rank[flat]), [words[i].decode() for i in order], of[order], counts[order], list(langs), tokens))

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            if lang not in langs:
                langs[lang] = _Numbers(words, kinds, len(langs))
            some = text.translate(_TABLE).replace(_BREAK, b" . ").split()
            codes.append(np.fromiter(map(langs[lang].__getitem__, some), np.int32, len(some)))
            codes.append(np.zeros(1, np.int32))
            held += len(text)
            if held >= SHARD_BYTES:
                yield row()
                shard += 1
                words, kinds, langs, codes, held = [], [], {}, [], 0
    if codes:
        yield row()


# --- the filter -------------------------------------------------------------------------------

def _stirred(x: np.ndarray, salt: int, bits: int) -> np.ndarray:
    h = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(64 - bits)


def permuted(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The ids of n-grams (a column for each word), permuted invertibly: each column is changed by the one before it."""
    x = [c.astype(np.uint64) for c in columns]
    for p in range(PASSES):
        for j in range(len(x)):
            x[j] = x[j] ^ _stirred(x[j - 1], 1 + p * len(x) + j, bits)
    return x


def restored(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    x = list(columns)
    for p in reversed(range(PASSES)):
        for j in reversed(range(len(x))):
            x[j] = x[j] ^ _stirred(x[j - 1], 1 + p * len(x) + j, bits)
    return x


def packed(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """As many columns as fit in each of a few 64-bit numbers."""
    each, out = 64 // bits, []
    for a in range(0, len(columns), each):
        limb = columns[a]
        for c in columns[a + 1:a + each]:
            limb = limb << np.uint64(bits) | c
        out.append(limb)
    return out


def unpacked(limbs: list[np.ndarray], bits: int, n: int) -> list[np.ndarray]:
    each, out, mask = 64 // bits, [], np.uint64((1 << bits) - 1)
    for i, limb in enumerate(limbs):
        inside = min(each, n - i * each)
        out += [limb >> np.uint64(bits * (inside - 1 - k)) & mask for k in range(inside)]
    return out


def widths(bits: int, n: int) -> list[int]:
    """Bits of each of the 64-bit numbers of an n-gram."""
    each = 64 // bits
    return [bits * min(each, n - a) for a in range(0, n, each)]


def _order(limbs: list[np.ndarray]) -> np.ndarray:
    return np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])


def _small(values: np.ndarray) -> bytes:
    """A byte a number; those from 255 follow whole."""
    big = values >= 255
    return np.where(big, 255, values).astype(np.uint8).tobytes() + values[big].astype("<u8").tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    big = np.flatnonzero(out == 255)
    out[big] = np.frombuffer(data[n:n + 8 * len(big)], "<u8").astype(np.int64)
    return out


def _squeezed(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + (pa.Codec("zstd", 1).compress(data, asbytes=True) if data else b"")


def _spread(data: memoryview) -> bytes:
    size = struct.unpack_from("<I", data)[0]
    return pa.Codec("zstd").decompress(data[4:], size, asbytes=True) if size else b""


def _bytes(limb: np.ndarray, bits: int) -> bytes:
    size = -(-bits // 8)
    return np.ascontiguousarray(limb.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _limb(data: memoryview, n: int, bits: int) -> tuple[np.ndarray, memoryview]:
    size = -(-bits // 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data[:n * size], np.uint8).reshape(n, size)
    return out.view("<u8").reshape(n).astype(np.uint64), data[n * size:]


def _shift(limb: np.ndarray, by: int) -> np.ndarray:
    return limb >> np.uint64(by) if by < 64 else np.zeros_like(limb)


def encoded(limbs: list[np.ndarray], counts: np.ndarray, width: list[int], quotient: int, deal: int, bucket: int) -> bytes:
    """Sorted entries of one bucket as a filter: how many remainders each quotient's slot has, the remainders, the counters."""
    rest = width[0] - quotient
    slots = (_shift(limbs[0], rest) - np.uint64(bucket << (quotient - deal))).astype(np.int64)
    remainder = limbs[0] & np.uint64((1 << rest) - 1)
    runs, counters = (_squeezed(_small(x)) for x in (np.bincount(slots, minlength=1 << (quotient - deal)), counts))
    return b"".join([struct.pack("<IBI", len(counts), quotient, len(runs)), runs, _bytes(remainder, rest), *[_bytes(limb, w) for limb, w in zip(limbs[1:], width[1:])], counters])


def decoded(data: bytes, width: list[int], deal: int, bucket: int) -> tuple[list[np.ndarray], np.ndarray]:
    n, quotient, size = struct.unpack_from("<IBI", data)
    rest, view = width[0] - quotient, memoryview(data)[9:]
    runs, view = _large(_spread(view[:size]), 1 << (quotient - deal)), view[size:]
    slots = np.repeat(np.arange(len(runs), dtype=np.uint64), runs) + np.uint64(bucket << (quotient - deal))
    first, view = _limb(view, n, rest)
    limbs = [(slots << np.uint64(rest) if rest < 64 else np.zeros_like(slots)) | first]
    for w in width[1:]:
        limb, view = _limb(view, n, w)
        limbs.append(limb)
    return limbs, _large(_spread(view), n)


# --- counting ---------------------------------------------------------------------------------

_STATE_KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]


def _stored(values: np.ndarray) -> bytes:
    """An array as it is shuffled and stored: its numbers' bytes by place (the high ones are mostly 0), compressed."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return struct.pack("<Q", raw.nbytes) + (pa.Codec("zstd", 1).compress(raw, asbytes=True) if raw.nbytes else b"")


def _array(stored: pa.Scalar, dtype) -> np.ndarray:
    buffer = stored.as_buffer()
    size = struct.unpack_from("<Q", buffer)[0]
    if not size:
        return np.empty(0, dtype)
    raw = np.frombuffer(pa.Codec("zstd").decompress(buffer.slice(8), size), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _collapsed(seq: np.ndarray, cur: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that are in no candidate become breaks, runs of breaks one."""
    seq, cur = np.where(live, seq, 0), np.where(live, cur, -1)
    stay = np.ones(len(seq), bool)
    stay[1:] = (seq[1:] != 0) | (seq[:-1] != 0)
    return seq[stay].astype(np.int32), cur[stay].astype(np.int32)


def _begun(codes: pa.Scalar, found: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """From a shard's codes and the ids of its frequent words: the sequence of those words (0: break), and their ids."""
    at, codes = np.asarray(found.values.field("at"), np.int64), _array(codes, np.int32)
    local = np.zeros(int(codes.max(initial=0)) + 1, np.int32)
    local[at + 1] = np.arange(1, len(at) + 1)
    seq = local[codes]
    return _collapsed(seq, seq, seq > 0)[0], np.asarray(found.values.field("id"), np.int64).astype(np.uint64)


def _grams(n: int, bits: int, seq: np.ndarray, ids: np.ndarray, cur: np.ndarray, ok: np.ndarray):
    """Places of the n-grams whose two parts, at ``cur`` by place, are frequent (``ok``), the entry at each, and the sorted entries with their counts."""
    frequent = ok[cur]
    at = np.flatnonzero(frequent[:-1] & frequent[1:])
    at = at[at + n - 1 < len(seq)]
    key = cur[at].astype(np.int64) * (len(ids) + 1) + seq[at + n - 1]
    _, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    limbs = packed(permuted([ids[seq[at[first] + j] - 1] for j in range(n)], bits), bits)
    order = _order(limbs)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return at, place[inverse], [limb[order] for limb in limbs], counts[order]


def _counted(n: int, bits: int, deal: int):
    """From a shard's codes and frequent words, or its state of length n - 1 and its frequent entries: the state of length n, and the filter of its n-grams by bucket."""
    width = widths(bits, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if n == 2:
                    shard, codes, found = (batch.column(c)[i] for c in range(3))
                    seq, ids = _begun(codes, found)
                    cur, ok = seq - 1, np.ones(len(ids) + 1, bool)
                else:
                    shard, seq, ids, cur, found = (batch.column(c)[i] for c in range(5))
                    seq, ids, cur = _array(seq, np.int32), _array(ids, np.uint64), _array(cur, np.int32)
                    if n == 3:      # the places of 2-grams are most of the text: counted again, not stored
                        at, entry, _, _ = _grams(2, bits, seq, ids, seq - 1, np.arange(len(ids) + 1) < len(ids))
                        cur = np.full(len(seq), -1, np.int32)
                        cur[at] = entry
                    ok = np.zeros(int(cur.max(initial=-1)) + 2, bool)
                    for row in found:
                        ok[np.asarray(row.values, np.int64)] = True
                ok[-1] = False      # place -1: no gram
                at, entry, limbs, counts = _grams(n, bits, seq, ids, cur, ok)
                if not len(at):
                    continue
                if n < LONGEST:
                    new, live = np.full(len(seq), -1, np.int32), np.zeros(len(seq), bool)
                    new[at] = entry
                    for j in range(n):
                        live[at + j] = True
                    seq, new = _collapsed(seq, new, live)
                    yield _row(STATE, _STATE_KINDS, (shard.as_py(), _stored(seq), _stored(ids), _stored(new[:0] if n == 2 else new), None, None, None))
                quotient = min(width[0], max(deal, len(counts).bit_length()))
                buckets = _shift(limbs[0], width[0] - deal)
                edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
                for a, b in zip(edges, edges[1:]):
                    bucket = int(buckets[a])
                    payload = encoded([limb[a:b] for limb in limbs], counts[a:b], width, quotient, deal, bucket)
                    yield _row(STATE, _STATE_KINDS, (shard.as_py(), None, None, None, bucket, int(a), payload))
    return run


def merged(parts: list[bytes], width: list[int], deal: int, bucket: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries of filters of one bucket, their summed counters, and for each entry of the parts, one after the other, its distinct one and its part."""
    each = [decoded(p, width, deal, bucket) for p in parts]
    limbs = [np.concatenate(x) for x in zip(*(e[0] for e in each))]
    counts, part = np.concatenate([e[1] for e in each]), np.repeat(np.arange(len(each)), [len(e[1]) for e in each])
    order = _order(limbs)
    limbs = [limb[order] for limb in limbs]
    new = np.ones(len(order), bool)
    new[1:] = np.any([limb[1:] != limb[:-1] for limb in limbs], axis=0)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return [limb[new] for limb in limbs], np.add.reduceat(counts[order], np.flatnonzero(new)), group, part


def _merged(n: int, bits: int, deal: int, least: int):
    width, kinds = widths(bits, n), [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in range(4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, some in groupby(rows(batches), lambda r: r[0]):
            shards, firsts, parts = zip(*(r[1:] for r in some))
            limbs, totals, group, part = merged(list(parts), width, deal, bucket)
            kept = totals >= least
            if not kept.any():
                continue
            columns = restored(unpacked([limb[kept] for limb in limbs], bits, n), bits)
            yield _row(MERGED, kinds, (None, np.stack(columns, 1).ravel().astype(np.int64), totals[kept]))
            if n < LONGEST:
                begins = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=len(parts)))])
                for i, (shard, first) in enumerate(zip(shards, firsts)):
                    at = np.flatnonzero(kept[group[begins[i]:begins[i + 1]]])
                    if len(at):
                        yield _row(MERGED, kinds, (shard, at + first, []))
    return run


def _buckets(rows: DataFrame) -> tuple[int, list[int]]:
    """Buckets of the tables: as many as shuffle partitions, or more if the text's shards need them. Then this number also for exchanges, else nothing: theirs may be coalesced."""
    conf = rows.sparkSession.conf
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    need = min(-(-size // (HELD * SHARD_BYTES)), int(conf.get("spark.sql.sources.bucketing.maxBuckets")))
    partitions = int(conf.get("spark.sql.shuffle.partitions"))
    return max(need, partitions), [need] * (need > partitions)


def _listed(df: DataFrame, value: str, more: list[int]) -> DataFrame:
    """Of each shard, all its values in one row, dealt as the tables are."""
    df = df.select("shard", value)
    return (df.repartition(*more, "shard") if more else df).groupBy("shard").agg(F.collect_list(value).alias("found"))


def _bucketed(df: DataFrame, name: str, tables: list[tuple[str, str]], buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by shard; noted in ``tables``."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets, "shard").saveAsTable(table)
    tables.append((table, path))
    return spark.table(table)


def _done(spark, tables: list[tuple[str, str]], but: int = 0) -> None:
    """Removes the tables, all but the last ones, that no later step reads."""
    while len(tables) > but:
        table, path = tables.pop(0)
        spark.sql(f"drop table {table}")
        remove_dir(spark, path)


def counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n) of every language; (id, lang, word, f) of every frequent word; (ids, f) of every frequent phrase of 1 to LONGEST words."""
    spark = ready(docs)
    if not 0 < int(spark.conf.get(_BATCH_BYTES).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)
    rows = only(docs, lang=F.coalesce(column(docs, lang).cast("string"), F.lit("und")), text=column(docs, text).cast("string"))
    tables: list[tuple[str, str]] = []
    buckets, more = _buckets(rows)
    shards = _bucketed(rows.mapInArrow(_shards, SHARD), "shards", tables, buckets)
    sizes = spool(shards.select(F.explode(F.arrays_zip("langs", "tokens")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.tokens").alias("n")), "sizes")
    part, turn = F.shiftright("shard", 32), F.col("shard").bitwiseAND((1 << 32) - 1)
    turns, most = shards.agg(F.max(turn), F.max(part)).first()
    turns = int(turns or 0).bit_length()
    low = turns + int(most or 0).bit_length()
    # One number for a word's place: its number in the shard's dictionary, and the shard.
    place = F.shiftleft(F.col("at").cast("bigint"), low) + F.shiftleft(part, turns) + turn
    entries = shards.select("shard", "langs", F.posexplode(F.arrays_zip("words", "kinds", "counts")).alias("at", "x"))
    entries = entries.select(place.alias("place"), F.col("langs")[F.col("x.kinds")].alias("lang"), F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    # A word is there once a shard: a window holds as many light rows of it as there are shards, and those of a deal's few words.
    deals = 8 << low
    deal_of = F.pmod(F.xxhash64("lang", "word"), F.lit(deals))
    one, all_of = Window.partitionBy("deal", "lang", "word"), Window.partitionBy("deal").orderBy("lang", "word")
    kept = entries.repartition(*more, deal_of).withColumn("deal", deal_of).withColumns({"f": F.sum("c").over(one), "first": F.min("place").over(one)}).where(F.col("f") >= least)
    number = (F.dense_rank().over(all_of) - 1).cast("bigint") * deals + F.col("deal")
    kept = spool(kept.select("place", "lang", "word", "f", (F.col("place") == F.col("first")).alias("leads"), number.alias("id")), "shard_words")
    words = kept.where("leads").select("id", "lang", "word", "f")
    bits = max(1, int(words.agg(F.max("id")).first()[0] or 0).bit_length())
    alive = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    code = F.col("place").bitwiseAND((1 << low) - 1)
    shard = F.shiftleft(F.shiftright(code, turns), 32) + code.bitwiseAND((1 << turns) - 1)
    found = _listed(kept.select(shard.alias("shard"), F.struct(F.shiftright("place", low).alias("at"), "id").alias("x")), "x", more)
    state, phrases = shards.select("shard", "codes"), words.select(F.array("id").alias("ids"), "f")
    for n in range(2, LONGEST + 1):
        # No length has more entries than the one before it has occurrences.
        deal = min(widths(bits, n)[0], max(0, (int(alive) // BUCKET).bit_length()))
        # Found entries grow with the text: never a broadcast, which the driver would hold.
        if n > 2:
            state = state.where("seq is not null").select("shard", "seq", "ids", "cur")
        state = _bucketed(state.join(found.hint("merge"), "shard").mapInArrow(_counted(n, bits, deal), STATE), f"grams_{n}", tables, buckets)
        parts = state.where("payload is not null").select("bucket", "shard", "first", "payload").repartition(*more, "bucket").sortWithinPartitions("bucket")
        result = spool(parts.mapInArrow(_merged(n, bits, deal, least), MERGED), f"counts_{n}")
        _done(spark, tables, 1)     # what this length was counted from
        grams = (result.where("shard is null").select("at", F.posexplode("total").alias("i", "f"))
                 .select(F.slice("at", F.col("i") * n + 1, n).alias("ids"), "f"))
        phrases = phrases.unionByName(grams)
        found = _listed(result.where("shard is not null"), "at", more)
        alive = grams.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
        if not alive:
            break
    _done(spark, tables)
    return sizes, words, phrases


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    sizes, words, phrases = counts(docs, lang, text, least)
    size = F.size("ids")
    cuts = phrases.where(size > 1).select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    for side, f in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select(F.col("ids").alias(side), F.col("f").alias(f)), side)
    cuts = cuts.join(words.select(F.col("id").alias("first"), "lang"), F.element_at("ids", 1) == F.col("first")).join(sizes, "lang")
    # 4 + 16 + 18 digits above, 36 below; the quotient is at most 1000 * n.
    cuts = cuts.withColumn("score", F.expr("cast(1000 * cast(a as decimal(16,0)) * cast(n as decimal(18,0)) as decimal(38,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    best = cuts.groupBy("ids", "lang", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("ids", "lang", "n", "a", "x.score", "x.l", "x.r")
    # A phrase inside a longer one with its count is inside one that is longer by a word, with that count as well.
    longer = phrases.where(size > 2).select("f", F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"))
    longer = longer.groupBy("ids").agg(F.max("f").alias("more"))
    best = spool(best.join(longer, "ids", "left").where("more is null or more < a").drop("more"), "candidates")
    spelt = best.select("ids", F.posexplode("ids").alias("i", "id")).join(words.select("id", "word"), "id").groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    named = best.join(spelt, "ids").withColumn("phrase", F.array_join("w.word", " ")).drop("ids", "w")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Each part's first `top` before the language's: no task gets all candidates of a language.
    dealt = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP13_SQL = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
lists as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
sizes as (select lang, sum(len(ws)) as n from lists group by lang),
grams as (
  select lang, ws[i:i + k - 1] as ph, k, count(*) as f
  from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from lists, range(1, {LONGEST + 1}) as t(k))
  group by all having count(*) >= {LEAST}),
cuts as (
  select g.lang, g.ph, g.f as a, l.f as l, r.f as r, s.n, c.j,
         (1000::hugeint * g.f * s.n) // (l.f::hugeint * r.f) as score
  from grams g, range(1, {LONGEST}) as c(j), grams l, grams r, sizes s
  where g.k > 1 and c.j < g.k and l.lang = g.lang and l.ph = g.ph[1:c.j] and r.lang = g.lang and r.ph = g.ph[c.j + 1:g.k] and s.lang = g.lang),
best as (select * from cuts qualify row_number() over (partition by lang, ph order by score, j) = 1),
inside as (
  select distinct lang, ph[i:i + m - 1] as ph, f
  from (select lang, ph, f, m, unnest(range(1, k - m + 2)) as i from grams, range(2, {LONGEST}) as t(m) where m < k)),
longer as (select lang, ph, max(f) as f from inside group by all),
kept as (
  select b.lang, array_to_string(b.ph, ' ') as phrase, a, l, r, n, score from best b left join longer o on o.lang = b.lang and o.ph = b.ph
  where o.f is null or 100 * o.f < 100 * a)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= {TOP}
"""
