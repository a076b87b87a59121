"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The lower-cased UTF-8 bytes of a whole text give hashed n-grams of ``ORDERS`` bytes, each
counted once a text. From labelled texts every n-gram gets its log-count ratio
r = log((p + a) / |p|) - log((q + a) / |q|); an L2-regularised logistic regression is
trained on all hashed n-grams of the labelled texts, with features r instead of 1: the ratios
and the penalty hold rare ones small. The fit is dual coordinate ascent inside the tasks: each
goes ``PASSES`` times over its own texts and moves the weights for one text after the other, as if
all tasks did the same; the moves of all tasks are added up, and that is done ``ROUNDS`` times (one
small job a round, which converges to the optimum of all texts).

The fit takes at most ``max_labelled`` labelled documents, those of the smallest id hashes
(a documented bound); scoring covers every whole text. Only text is an input of a score.

Defined results: null and empty texts have no n-grams and the score of the intercept; rows
without a label or id are scored but not learnt from; repeated ids are scored row by row;
with no labelled texts, or of one class only, the score is the share of toxic labels (0.5
if there are none); other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded, column, held_out, only, own_name, read, ready, rows_sum, spool, starts_of, texts

#: Lengths of n-grams in bytes.
ORDERS = (4, 6, 8)
HASH_BITS = 20
MAX_LABELLED = 12_000
#: Labelled texts that a task of the fit takes (about): each gives back a number for every hashed n-gram.
TASK_LABELLED = 3000
#: Labelled texts in a file of their n-grams.
FILE_TEXTS = 100
#: N-grams that a task of the fit works on at a time (a longer single text is taken whole).
TASK_GRAMS = 1 << 20
#: Rounds of the fit, and passes of a task over its texts in a round.
ROUNDS, PASSES = 6, 3
#: Value of the intercept's feature: large, so its penalty is small.
CONSTANT = 4.0
SMOOTHING = 1.0
L2 = 1.0
#: Bytes of text whose n-grams are worked on at a time.
STEP = 256 << 10


def _ngrams(items: list[bytes]):
    """For each order: (text number, hashed n-gram) of every place, in text order."""
    starts = starts_of([len(t) for t in items])
    flat = np.frombuffer(b"".join(items).lower(), np.uint8).astype(np.uint64)
    for order in ORDERS:
        size = len(flat) - order + 1
        if size <= 0:
            continue
        code = np.zeros(size, np.uint64)
        for k in range(order):
            code = (code << np.uint64(8)) | flat[k:k + size]
        code = (code + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        hashed = (code >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        counts = np.clip(np.diff(starts) - (order - 1), 0, None)
        inside = np.ones(size, bool)        # false where an n-gram would run into the next text
        for back in range(1, order):
            edge = starts[1:-1] - back
            inside[edge[(edge >= 0) & (edge < size)]] = False
        yield np.repeat(np.arange(len(items)), counts), hashed[inside]


def _text_grams(items: list[bytes]) -> Iterator[np.ndarray]:
    """The distinct hashed n-grams of each text, in order of their last places."""
    found = [(starts_of(np.bincount(doc, minlength=len(items))), hashed) for doc, hashed in _ngrams(items)]
    place = np.empty(1 << HASH_BITS, np.int32)
    for i in range(len(items)):
        grams = np.concatenate([hashed[at[i]:at[i + 1]] for at, hashed in found]) if found else np.empty(0, np.int64)
        every = np.arange(len(grams), dtype=np.int32)
        place[grams] = every        # the last place of each stands
        yield grams[place[grams] == every]


def _grams_udf():
    def run(text: pa.Array) -> pa.Array:
        items, values, sizes = texts(text), [np.empty(0, np.int32)], []
        for a, b in bounded(items, STEP):
            for grams in _text_grams(items[a:b]):
                values.append(grams.astype(np.int32))
                sizes.append(len(grams))
        return pa.ListArray.from_arrays(pa.array(starts_of(sizes).astype(np.int32)), pa.array(np.concatenate(values)))

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return arrow_udf(run, "array<int>")


class _Texts:
    """The labelled texts of a task: labels, and the n-grams of all texts with their places."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        labels, flats, sizes, numbers = [np.empty(0)], [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for batch in batches:
            lists = batch.column(1)
            places = lists.offsets.to_numpy().astype(np.int64)
            labels.append(batch.column(0).to_numpy(zero_copy_only=False).astype(float))
            flats.append(lists.values.to_numpy()[places[0]:places[-1]])
            sizes.append(np.diff(places))
            numbers.append(batch.column(2).to_numpy(zero_copy_only=False))
        self.y, self.flat, self.places, self.number = np.concatenate(labels), np.concatenate(flats), starts_of(np.concatenate(sizes)), np.concatenate(numbers)

    def parts(self):
        """(labels, n-grams, places) of some texts at a time: the arrays that a step needs stay small."""
        a = 0
        while a < len(self.y):
            b = max(a + 1, int(np.searchsorted(self.places, self.places[a] + TASK_GRAMS, "right")) - 1)
            yield self.y[a:b], self.flat[self.places[a]:self.places[b]], self.places[a:b + 1] - self.places[a]
            a = b

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How many toxic and other texts there are, and how many of them hold each n-gram."""
        sums = np.zeros((2, 1 << HASH_BITS))
        for y, flat, places in self.parts():
            for i, r in enumerate((y, 1 - y)):
                sums[i] += np.bincount(flat, np.repeat(r, np.diff(places)), 1 << HASH_BITS)
        return np.array([self.y.sum(), (1 - self.y).sum()]), sums

    def ascended(self, w: np.ndarray, ratio: np.ndarray, off: np.ndarray, tasks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Residuals (label less probability) of the texts after ``PASSES`` over them from ``off``, and the move of the weights (the intercept's last) that they make."""
        start, w, off = w, w.copy(), off.copy()
        rng, reach = np.random.default_rng(seed), tasks / L2
        for _ in range(PASSES):
            for i in rng.permutation(len(self.y)):
                grams = self.flat[self.places[i]:self.places[i + 1]]
                r = ratio[grams]
                z, norm = w[grams] @ r + w[-1] * CONSTANT, r @ r + CONSTANT * CONSTANT
                new = self.y[i] - _settled(z, reach * norm, self.y[i] - off[i])
                step = reach * (new - off[i])
                w[grams] += step * r
                w[-1] += step * CONSTANT
                off[i] = new
        return off, (w - start) / tasks


def _settled(z: float, pull: float, p: float) -> float:
    """The probability q at which logit(q) = z + pull * (p - q): where a text's weight stops moving."""
    goal = z + pull * p
    low, high = goal - pull, goal
    u = min(max(z, low), high)
    for _ in range(60):
        q = 1 / (1 + exp(-u)) if u > -700 else 0.0
        miss = u + pull * q - goal
        if miss > 0:
            high = u
        else:
            low = u
        step = miss / (1 + pull * q * (1 - q))
        u = u - step if low < u - step < high else (low + high) / 2
        if abs(step) < 1e-9:
            break
    return 1 / (1 + exp(-u)) if u > -700 else 0.0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some = _Texts(batches)
    if len(some.y):
        totals, sums = some.counts()
        yield pa.RecordBatch.from_arrays([pa.array([totals.tolist()]), pa.array([sums.astype(np.int32).tobytes()], pa.binary())], names=["totals", "sums"])


def _moves(model, tasks: int, seed: int):
    """A row a task: the numbers of its texts, their residuals, and the move of the weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, (w, ratio, off) = _Texts(batches), model.value
        if len(some.y):
            before = np.array([off.get(n, 0.0) for n in some.number.tolist()])
            after, move = some.ascended(w, ratio, before, tasks, seed)
            yield pa.RecordBatch.from_arrays([pa.array([some.number.tolist()]), pa.array([after.tolist()]), pa.array([move.astype(np.float32).tobytes()], pa.binary())], names=["numbers", "off", "move"])
    return run


def _fit_linear(grams: DataFrame, tasks: int, ratio: np.ndarray) -> np.ndarray:
    """Weights of ratio-scaled n-grams, the intercept's last. The driver holds them and a residual a labelled text (``max_labelled`` at most)."""
    sc, w, off = grams.sparkSession.sparkContext, np.zeros(len(ratio) + 1), {}
    for round_no in range(ROUNDS):
        model = sc.broadcast((w, ratio, off))
        table = grams.mapInArrow(_moves(model, tasks, round_no), "numbers array<bigint>, off array<double>, move binary").toArrow()
        # A task's share is its weights' move over the number of tasks; all of them together are the step.
        for numbers, after, move in zip(*(table.column(c) for c in ("numbers", "off", "move"))):
            off.update(zip(numbers.as_py(), after.as_py()))
            w = w + np.frombuffer(move.as_buffer(), np.float32)
        model.destroy()
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """(weight of each hashed n-gram, intercept). ``learn`` says which rows of ``labels`` may be used."""
    ready(docs)
    known = labels.where(learn) if learn is not None else labels
    known = only(known, id=column(known, doc_id).cast("bigint"), y=column(known, label).cast("int")).where("id is not null and y in (0, 1)")
    # At most max_labelled ids: bounded, so they can be broadcast.
    sample = F.broadcast(known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    rows = only(docs, id=column(docs, doc_id).cast("bigint"), text=column(docs, text).cast("string")).join(sample, "id")
    tasks = -(-max_labelled // TASK_LABELLED)
    rows = rows.select(F.xxhash64("id", "text").alias("key"), "y", "text").repartition(tasks, "key")
    grams = spool(rows.select("y", _grams_udf()("text").alias("grams"), F.monotonically_increasing_id().alias("number")), "grams", FILE_TEXTS)
    grams = grams.select("y", "grams", "number").coalesce(tasks)
    totals, sums = np.zeros(2), np.zeros((2, 1 << HASH_BITS))
    table = grams.mapInArrow(_counts, "totals array<double>, sums binary").toArrow()     # a row a task
    for total, part in zip(table.column("totals"), table.column("sums")):
        totals, sums = totals + np.array(total.as_py()), sums + np.frombuffer(part.as_buffer(), np.int32).reshape(2, -1)
    n_pos, n_neg = totals
    if n_pos == 0 or n_neg == 0:
        share = n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.5
        return np.zeros(1 << HASH_BITS, np.float32), float(np.clip(np.log(max(share, 1e-3) / max(1 - share, 1e-3)), -7, 7))
    p, q = sums
    there = p + q > 0
    ratio = np.where(there, np.log((p + SMOOTHING) / (p + SMOOTHING)[there].sum()) - np.log((q + SMOOTHING) / (q + SMOOTHING)[there].sum()), 0.0)
    w = _fit_linear(grams, table.num_rows, ratio)
    return (ratio * w[:-1]).astype(np.float32), float(w[-1]) * CONSTANT


def score_texts(items: list[bytes], weights: np.ndarray, intercept: float) -> np.ndarray:
    out = np.full(len(items), intercept)
    for a, b in bounded(items, STEP):
        out[a:b] += [weights[grams].sum(dtype=float) for grams in _text_grams(items[a:b])]
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> Column:
    """The toxicity score (0 to 1) of each text, as a column of ``docs``."""
    shared = ready(docs).sparkContext.broadcast(model)

    def run(text: pa.Array) -> pa.Array:
        return pa.array(score_texts(texts(text), *shared.value))

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return arrow_udf(run, "double")(column(docs, text).cast("string"))


def _fold(labels: DataFrame, doc_id: str = "doc_id") -> Column:
    return held_out(column(labels, doc_id).cast("bigint"), 5, 0)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from labels outside the held-out fold."""
    rows = only(docs, doc_id=column(docs, doc_id).cast("bigint"), text=text)
    scored = rows.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), score(rows, fit(docs, labels, ~_fold(labels), doc_id, text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those scored 0.5 or more; all columns stay."""
    name = own_name(docs, "toxicity")
    return docs.withColumn(name, score(docs, fit(docs, labels, ~_fold(labels), text=text), text)).where(F.col(name) < 0.5).select(*[column(docs, c) for c in docs.columns])


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
