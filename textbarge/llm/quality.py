"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text gives the statistics of ``FEATURES``. The labelled texts' class means and
covariances come from sums over all of them (made by Spark; only 2 x (1 + d + d^2) numbers
reach the driver). Each covariance is shrunk towards the pooled one and a multiple of the
identity; a score is the logistic of the tempered difference of log densities and priors,
with Mahalanobis distances from Cholesky factors made once and kept by the tasks.

Labels, lang, source and ids are never inputs of a score. Defined results: null and empty
texts have the statistics of no words and are scored; rows without a label or id are scored
but not learnt from; repeated ids are scored row by row; with labels of one class or none,
the score is the share of label 1 (0.5 if there are none); other columns are untouched.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded, column, held_out, only, own_name, read, ready, spool, texts

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "exclamations", "symbols", "pipes", "stops", "lines",
            "high_bytes", "distinct_words", "repeated_words", "distinct_pairs", "distinct_lines", "longest_word", "quotes")
#: Weight of the pooled covariance, and of the identity, in each class's covariance.
POOLED, IDENTITY = 0.1, 0.05

# Classes of bytes: fixed values.
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "exclamation": b"!",
            "symbol": b"#$%&*+<=>@\\^_`~/{}[]", "pipe": b"|", "stop": b".,;:?-", "newline": b"\n\r", "quote": b"'\"()"}
_CLASS_OF = np.zeros(256, np.uint8)
for _i, _bytes in enumerate(_CLASSES.values(), 1):
    _CLASS_OF[list(_bytes)] = _i
_CLASS_OF[128:] = len(_CLASSES) + 1


def statistics(text: bytes) -> list[float]:
    count = dict(zip(("rest", *_CLASSES, "high"), np.bincount(_CLASS_OF[np.frombuffer(text, np.uint8)], minlength=len(_CLASSES) + 2).tolist()))
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = len(words)
    per_word, pairs = max(n, 1), max(n - 1, 1)
    share = lambda x: np.log(x + 0.02)
    return [
        np.log1p(len(text)), np.log1p(n), np.log1p(sum(map(len, words)) / per_word),
        share(count["upper"] / (count["upper"] + count["lower"] + 1)), share(count["digit"] / per_word), share(count["exclamation"] / per_word),
        share(count["symbol"] / per_word), share(count["pipe"] / per_word), share(count["stop"] / per_word), share(len(lines) / per_word),
        count["high"] / (len(text) + 1), np.log1p(len(set(words))) - np.log1p(n), share(sum(map(operator.eq, words, words[1:])) / pairs),
        share(1 - len(set(zip(words, words[1:]))) / pairs if n > 1 else 0.0), share(1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0),
        np.log1p(max(map(len, words), default=0)), share(count["quote"] / per_word),
    ]


def _statistics_udf():
    def run(text: pa.Array) -> pa.Array:
        items = texts(text)
        values = np.array([statistics(t) for t in items], float).reshape(len(items), len(FEATURES))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(items) + 1, dtype=np.int32) * len(FEATURES)), pa.array(values.ravel()))

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return arrow_udf(run, "array<double>")


def features(docs: DataFrame, text: str = "text") -> Column:
    ready(docs)
    return _statistics_udf()(column(docs, text).cast("string"))


def _sums(batches):
    """One row for each class and moment of a task's rows: (y, place, value)."""
    d, held = len(FEATURES), {}
    for batch in batches:
        x = np.asarray(batch.column("f").flatten()).reshape(-1, d)
        y = np.asarray(batch.column("y"))
        for label in np.unique(y):
            own = x[y == label]
            held[int(label)] = held.get(int(label), 0) + np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    for label, v in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), label, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["y", "place", "value"])


def fit(rows: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality", doc_id: str = "doc_id") -> dict:
    """The discriminant from ``rows(id, f)`` that ``labels`` mark (all of them that ``learn`` allows)."""
    d, spark = len(FEATURES), rows.sparkSession
    known = labels.where(learn) if learn is not None else labels
    known = (only(known, id=column(known, doc_id).cast("bigint"), y=column(known, label).cast("int"))
             .where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y")))
    sums = rows.join(known, "id").select("y", "f").mapInArrow(_sums, "y int, place int, value double").groupBy("y", "place").agg(F.sum("value").alias("value"))
    moments = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():        # 2 x (1 + d + d^2) rows at most
        moments[r["y"], r["place"]] = r["value"]
    n = moments[:, 0]
    if not n.all():
        return {"share": float(n[1] / n.sum()) if n.sum() else 0.5}
    mean = moments[:, 1:1 + d] / n[:, None]
    second = moments[:, 1 + d:].reshape(2, d, d)
    centre = (mean * n[:, None]).sum(0) / n.sum()
    scale = np.sqrt(np.maximum(np.einsum("kii->i", second) / n.sum() - centre ** 2, 1e-8))
    cov = second / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    cov = cov / scale[:, None] / scale[None, :]
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    model = {"centre": centre, "scale": scale, "mean": (mean - centre) / scale, "prior": np.log(n / n.sum()), "inverse": [], "log_det": []}
    for k in range(2):
        weight = max(POOLED, d / (d + n[k]))
        c = (1 - weight - IDENTITY) * cov[k] + weight * pooled + IDENTITY * np.eye(d)
        factor = np.linalg.cholesky(c)
        model["inverse"].append(np.linalg.inv(factor))
        model["log_det"].append(2 * np.log(np.diag(factor)).sum())
    return model


def score_rows(x: np.ndarray, model: dict) -> np.ndarray:
    if "share" in model:
        return np.full(len(x), model["share"])
    z = (x - model["centre"]) / model["scale"]
    density = [model["prior"][k] - 0.5 * (model["log_det"][k] + (((z - model["mean"][k]) @ model["inverse"][k].T) ** 2).sum(1)) for k in range(2)]
    return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / len(FEATURES), -500, 500)))


def score(rows: DataFrame, model: dict, f: str = "f") -> Column:
    shared = ready(rows).sparkContext.broadcast(model)

    def run(f: pa.Array) -> pa.Array:
        return pa.array(score_rows(np.asarray(f.flatten()).reshape(-1, len(FEATURES)), shared.value))

    run.__annotations__ = {"f": pa.Array, "return": pa.Array}
    return arrow_udf(run, "double")(column(rows, f))


def _fold(labels: DataFrame, doc_id: str = "doc_id") -> Column:
    return held_out(column(labels, doc_id).cast("bigint"), 3, 1)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from labels outside the held-out fold."""
    rows = spool(only(docs, id=column(docs, doc_id).cast("bigint"), f=features(docs, text)), "statistics")
    model = fit(rows, labels, ~_fold(labels), doc_id=doc_id)
    scored = rows.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 3, 1).alias("held_out"), score(rows, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those scored under 0.5; all columns stay."""
    f, name = own_name(docs, "statistics"), own_name(docs, "quality_score")
    rows = spool(docs.withColumn(f, features(docs, text)), "scored")
    model = fit(only(rows, id=column(rows, doc_id).cast("bigint"), f=f), labels, ~_fold(labels), doc_id=doc_id)
    return rows.withColumn(name, score(rows, model, f)).where(F.col(name) >= 0.5).select(*[column(rows, c) for c in docs.columns])


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
