"""LM scoring: a log-bilinear model trained by noise-contrastive estimation in numpy.

Texts are lower-cased (A-Z) and split into runs of ``[^\\x20\\x09-\\x0D]``; each text ends in
one end token. The ``SHORTLIST`` most frequent tokens of the learnt texts are outputs of the
model; all others are dealt by their last bytes into ``GROUPS`` outputs, inside of which a
token has its add-one share. So the probabilities of all tokens, one never seen in each
group included, sum to 1.

With the two tokens before (or the begin mark), the score of output w is
(C1 * r1 + C2 * r2) . t_w + b_w. Each task trains on the tokens of its chunks by
mini-batches that share their noise samples (matrix products throughout); parameters are
averaged over the tasks after each of ``ROUNDS`` rounds, and every learnt token is used in
one of them. Scores split into a term for each context token, so all log-normalisers are
one product of two matrices of exponentials; a token's log-probability is three look-ups.

The corpus goes through in chunks of bounded bytes, each with a dictionary of its own words:
only dictionaries are joined with the counts of the whole corpus, not tokens.

Defined results: a null or empty text is one end token; rows with a null id are learnt from
and scored; repeated rows count as often as they are there; without any learnt text N and V
are 0 and every token unseen; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, column, held_out, only, read, ready, rows_sum, spool, starts_of, texts

#: Outputs of single tokens, the end token among them; outputs of groups; size of a token's vector.
SHORTLIST, GROUPS, WIDTH = 768, 256, 24
#: Bytes at a word's end that decide its group.
SUFFIX = 3
#: Learnt tokens in a mini-batch, and its noise samples.
BATCH, NOISE = 4096, 32
ROUNDS, RATE = 2, 0.08
#: Bytes of text in a chunk and in a piece of it (mini-batches end with a piece), those that a row counts besides its text, and chunks that a task trains on at most (about).
CHUNK_BYTES, PIECE_BYTES, ROW_BYTES, TASK_CHUNKS = 12 << 20, 9 << 20, 64, 8
END = 0
CHUNK = "chunk bigint, doc_ids array<bigint>, held array<boolean>, sizes array<bigint>, codes binary, words array<binary>, counts array<bigint>, pieces array<bigint>"
OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


class _Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    chunk = TaskContext.get().partitionId() << 32
    ids, helds, sizes, parts, numbers, pieces, size = [], [], [], [], _Numbers(), [], 0

    def row() -> pa.RecordBatch:
        codes = np.concatenate(parts)
        learnt = np.repeat(~np.array(helds, bool), sizes)
        values = (chunk, ids, helds, sizes, _packed(codes), list(numbers), np.bincount(codes[learnt], minlength=len(numbers)).tolist(), pieces)
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], names=[c.split()[0] for c in CHUNK.split(", ")])

    # A chunk has pieces of some batches: a batch ends after some rows, whatever their bytes.
    for batch in batches:
        docs, held, items = batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))
        for a, b in bounded(items, PIECE_BYTES):
            more = sum(map(len, items[a:b])) + ROW_BYTES * (b - a)
            if ids and size + more > CHUNK_BYTES:
                yield row()
                chunk += 1
                ids, helds, sizes, parts, numbers, pieces, size = [], [], [], [], _Numbers(), [], 0
            pieces.append(len(ids))
            for t in items[a:b]:
                words = t.lower().split()
                sizes.append(len(words))
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            ids += docs[a:b]
            helds += held[a:b]
            size += more
    if ids:
        yield row()


def group_of(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % GROUPS


def _packed(codes: np.ndarray) -> bytes:
    """The low halves of all codes, then the high ones, which are mostly 0: small when compressed."""
    return codes.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes()


def _codes(packed: pa.Scalar) -> np.ndarray:
    low, high = np.frombuffer(packed.as_buffer(), "<u2").reshape(2, -1).astype(np.uint32)
    return low | (high << np.uint32(16))


class Shape:
    """What the tasks share: counts of all learnt tokens and the class of each frequent word.

    ``groups`` has the tokens and the distinct words of each group, frequent ones included."""

    def __init__(self, tokens: int, distinct: int, ends: int, frequent: list[tuple[bytes, int]], groups: dict[int, tuple[int, int]]):
        self.tokens, self.distinct, self.ends = tokens, distinct, ends
        self.classes = {word: i for i, (word, _) in enumerate(frequent, 1)}
        self.rare = len(frequent) + 1
        self.begin = self.rare + GROUPS
        inside = np.array([groups.get(g, (0, 0)) for g in range(GROUPS)], np.int64)
        for word, c in frequent:
            inside[group_of(word)] -= (c, 1)
        counts = np.concatenate([[ends], [c for _, c in frequent], inside[:, 0]]).astype(float) + 1
        self.unigram = counts / counts.sum()
        #: Of each output, the sum of (count + 1) over its words and one unseen (1 for single tokens).
        self.sums = np.concatenate([np.ones(self.rare), inside.sum(1) + 1])

    def of(self, words: list[bytes]) -> np.ndarray:
        get, rare = self.classes.get, self.rare
        return np.fromiter((get(w) or rare + group_of(w) for w in words), np.int32, len(words))


def _events(classes: np.ndarray, sizes: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Target, last and last-but-one classes of all tokens (ends included), and where texts start."""
    starts = starts_of(sizes + 1)
    target = np.full(starts[-1], END, np.int32)
    place = np.ones(len(target), bool)
    place[starts[1:] - 1] = False
    target[place] = classes
    one, two = np.full(len(target), begin, np.int32), np.full(len(target), begin, np.int32)
    one[1:], two[2:] = target[:-1], target[:-2]
    one[starts[:-1]] = begin
    two[starts[:-1]] = begin
    after = starts[:-1][sizes > 0] + 1
    two[after] = begin
    return target, one, two, starts


def _initial(shape: Shape) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    outputs = shape.begin
    return {"r": rng.normal(0, 0.1, (outputs + 1, WIDTH)).astype(np.float32), "c": np.ones((2, WIDTH), np.float32) * np.array([[1.0], [0.5]], np.float32),
            "t": rng.normal(0, 0.1, (outputs, WIDTH)).astype(np.float32), "b": np.log(shape.unigram).astype(np.float32)}


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts ``keys`` (under 65,536: two bytes sort faster), the distinct keys, and where each begins."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return order, keys[first], first


class Trainer:
    def __init__(self, start: dict[str, np.ndarray], shape: Shape, seed: int):
        self.p = {k: v.copy() for k, v in start.items()}
        self.seen = {k: np.full(v.shape, 1e-4, np.float32) for k, v in start.items()}
        self.rng, self.noise_p = np.random.default_rng(seed), np.cumsum(shape.unigram)
        self.log_noise = np.log(NOISE * shape.unigram).astype(np.float32)
        self.rows, self.wide = np.empty((6, BATCH, WIDTH), np.float32), np.empty((2, 2 * BATCH + NOISE, WIDTH), np.float32)
        self.false = np.empty((BATCH, NOISE), np.float32)
        self.steps = 0

    def _move(self, name: str, at, gradient: np.ndarray) -> None:
        self.seen[name][at] += gradient * gradient
        self.p[name][at] += RATE * gradient / np.sqrt(self.seen[name][at])

    def step(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p, n, scale = self.p, len(target), 1 / len(target)
        noise = np.minimum(np.searchsorted(self.noise_p, self.rng.random(NOISE)), len(self.noise_p) - 1)
        # Arrays of a row a token are the trainer's own, written over by each step: new ones would be fresh memory each time.
        r1, r2, t, q, dq, some = (x[:n] for x in self.rows)
        (p["r"].take(one, 0, r1, "clip"), p["r"].take(two, 0, r2, "clip"), p["t"].take(target, 0, t, "clip"))
        tn, (c1, c2) = p["t"][noise], p["c"]
        np.add(np.multiply(r1, c1, out=q), np.multiply(r2, c2, out=some), out=q)
        true = np.clip(np.multiply(q, t, out=some).sum(1) + p["b"][target] - self.log_noise[target], -30, 30)
        h = np.matmul(q, tn.T, out=self.false[:n])
        h += p["b"][noise] - self.log_noise[noise]
        np.exp(np.negative(np.clip(h, -30, 30, out=h), out=h), out=h)
        h += 1
        np.divide(-scale, h, out=h)
        g = ((1 / (1 + np.exp(true))) * scale).astype(np.float32)
        np.add(np.multiply(g[:, None], t, out=dq), np.matmul(h, tn, out=some), out=dq)
        order, keys, first = _runs(np.concatenate([target, noise]))
        wide, ordered = (x[:n + NOISE] for x in self.wide)
        np.multiply(g[:, None], q, out=wide[:n])
        np.matmul(h.T, q, out=wide[n:])
        sums = np.add.reduceat(wide.take(order, 0, ordered, "clip"), first, axis=0)
        biases = np.add.reduceat(np.concatenate([g, h.sum(0)])[order], first)
        order, moved, first = _runs(np.concatenate([one, two]))
        wide, ordered = (x[:2 * n] for x in self.wide)
        np.multiply(dq, c1, out=wide[:n])
        np.multiply(dq, c2, out=wide[n:])
        contexts = np.add.reduceat(wide.take(order, 0, ordered, "clip"), first, axis=0)
        self._move("c", slice(None), np.stack([np.multiply(dq, r, out=some).sum(0) for r in (r1, r2)]))
        self._move("t", keys, sums)
        self._move("b", keys, biases)
        self._move("r", moved, contexts)
        self.steps += 1


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in ("r", "c", "t", "b")]).astype(np.float64)


def _unflat(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in ("r", "c", "t", "b"):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _train(start, shape_of, round_no: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, trainer, tokens = shape_of.value, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                # words, sizes, held, codes, pieces: one chunk at a time
                words, sizes, held, codes, pieces = (batch.column(c)[i] for c in range(5))
                sizes, held = np.asarray(sizes.values, np.int64), np.asarray(held.values).astype(bool)
                classes = shape.of(words.as_py())[_codes(codes)]
                target, one, two, starts = _events(classes, sizes, shape.begin)
                learnt = np.flatnonzero(np.repeat(~held, np.diff(starts)))
                trainer = trainer or Trainer(start.value, shape, 101 * round_no + TaskContext.get().partitionId())
                for own in np.split(learnt, np.searchsorted(learnt, starts[np.asarray(pieces.values)[1:]])):
                    for some in (own[a:a + BATCH] for a in range(BATCH * round_no, len(own), BATCH * ROUNDS)):
                        trainer.step(target[some], one[some], two[some])
                        tokens += len(some)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([float(tokens)]), pa.array([(_flat(trainer.p) * tokens).tobytes()], pa.binary())], names=["tokens", "sums"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, sums = 0.0, 0
    for batch in batches:
        for n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens, sums = tokens + n, sums + np.frombuffer(s)
    if tokens:
        yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([sums.tobytes()], pa.binary())], names=["tokens", "sums"])


def train(chunks: DataFrame, shape: Shape) -> dict[str, np.ndarray]:
    """Parameters after ``ROUNDS`` rounds over all learnt tokens: a row of parameters for each task, added up by Spark."""
    sc, params = chunks.sparkSession.sparkContext, _initial(shape)
    tasks = max(sc.defaultParallelism, chunks.select("chunk").count() // TASK_CHUNKS)
    shape_of, kind = sc.broadcast(shape), "tokens double, sums binary"
    for round_no in range(ROUNDS):
        own = chunks.select("words", "sizes", "held", "codes", "pieces").coalesce(tasks).mapInArrow(_train(sc.broadcast(params), shape_of, round_no), kind)
        row = own.repartition(max(1, round(tasks ** 0.5))).mapInArrow(_added, kind).repartition(1).mapInArrow(_added, kind).first()
        if row is None:
            break
        params = _unflat(np.frombuffer(row["sums"]) / row["tokens"], params)
    return params


def tables(params: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores by last token and by the token before it, biases, and the log-normaliser of each pair of both."""
    first = (params["r"] * params["c"][0]).astype(float) @ params["t"].T.astype(float)
    second = (params["r"] * params["c"][1]).astype(float) @ params["t"].T.astype(float)
    bias = params["b"].astype(float)
    top1, top2 = (first + bias).max(1), second.max(1)
    z = np.log(np.exp(first + bias - top1[:, None]) @ np.exp(second - top2[:, None]).T) + top1[:, None] + top2[None, :]
    return first.astype(np.float32), second.astype(np.float32), bias.astype(np.float32), z.astype(np.float32)


def _score(shape_of, tables_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, (first, second, bias, z) = shape_of.value, tables_of.value
        whole = shape.tokens + shape.distinct + 1
        for batch in batches:
            for i in range(batch.num_rows):
                words, sizes, held, doc_ids, codes, at, found = (batch.column(c)[i] for c in range(7))
                sizes, words = np.asarray(sizes.values, np.int64), words.as_py()
                counts = np.zeros(len(words), np.int64)
                if found.is_valid and len(found.values):
                    counts[np.asarray(at.values)] = np.asarray(found.values)
                of, codes = shape.of(words), _codes(codes)
                target, one, two, starts = _events(of[codes], sizes, shape.begin)
                ended = starts[1:] - 1
                inner = np.ones(len(target), bool)
                inner[ended] = False
                base, rare = np.full(len(target), np.log10((shape.ends + 1) / whole)), np.zeros(len(target))
                base[inner] = np.log10((counts + 1) / whole)[codes]
                rare[inner] = np.where(of >= shape.rare, np.log10((counts + 1) / shape.sums[of]), 0.0)[codes]
                known = np.full(len(target), shape.ends > 0)
                known[inner] = (counts > 0)[codes]
                score = (first[one, target] + second[two, target] + bias[target] - z[one, two]) / np.log(10) + rare
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([
                    doc_ids.values, held.values, pa.array(sizes + 1), pa.array(rows_sum(known, starts)), pa.array(np.full(n, shape.tokens)),
                    pa.array(rows_sum(base, starts, np.float64)), pa.array(rows_sum(score, starts, np.float64))], names=[c.split()[0] for c in OUT.split(", ")])
    return run


def score(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``held`` (over column doc_id) says which texts are not learnt from."""
    sc = ready(docs).sparkContext
    rows = only(docs, doc_id=column(docs, doc_id).cast("bigint"), text=column(docs, text).cast("string"))
    chunks = spool(rows.select("doc_id", held.alias("held"), "text").mapInArrow(_chunks, CHUNK), "chunks")
    entries = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("chunk", "at", "x.words", "x.counts")
    counts = spool(entries.groupBy("words").agg(F.sum("counts").alias("c")).where("c > 0"), "word_counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = chunks.select(F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0))).first()[0]
    frequent = [(bytes(r["words"]), r["c"]) for r in counts.orderBy(F.col("c").desc(), "words").limit(SHORTLIST - 1).collect()]
    group = F.crc32(F.expr(f"substring(words, -{SUFFIX}, {SUFFIX})")) % GROUPS
    groups = {r["g"]: (r["c"], r["n"]) for r in counts.groupBy(group.cast("int").alias("g")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}   # GROUPS rows
    shape = Shape(total + ends, distinct + (ends > 0), ends, frequent, groups)
    model = tables(train(chunks, shape))
    # Two lists of plain numbers, filled row by row alike (neither is ever null): a list of pairs takes three times the bytes.
    found = (entries.select("chunk", "at", "words").join(counts, "words").groupBy("chunk")
             .agg(F.collect_list("at").alias("at"), F.collect_list("c").alias("found")))
    return (chunks.join(found, "chunk", "left").select("words", "sizes", "held", "doc_ids", "codes", "at", "found")
            .mapInArrow(_score(sc.broadcast(shape), sc.broadcast(model)), OUT))


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2))
