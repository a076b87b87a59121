import random
import zlib

import numpy as np
import pyarrow as pa

from textbarge.llm import quality, toxicity

from .helpers import awkward, documents, prose


def labelled(n=900):
    rng, docs, labels = random.Random(4), [], []
    for i in range(n):
        text, toxic, good = prose(i, rng.randint(20, 200)), int(rng.random() < 0.2), int(rng.random() > 0.25)
        if toxic:
            w = text.split()
            for bad in rng.sample(["vilename", "meanword", "rudething"], 2):
                w.insert(rng.randrange(len(w)), bad)
            text = " ".join(w)
        if not good:
            text = rng.choice([text.upper() + "!!", text.replace(" ", "%%% "), " | ".join(text.split())])
        docs.append((i, text))
        labels.append((i, good, toxic))
    return docs, labels


def table(spark, labels):
    return spark.createDataFrame([(*x, "clash") for x in labels], "doc_id bigint, quality int, toxic int, text string")


AWKWARD_LABELS = [(None, 1, 0), (0, None, None), (-8, 1, 0), (99999, 0, 1), (5, 1, 0), (5, 1, 0)]


def accuracy(rows, truth, fold):
    own = [r for r in rows if r["doc_id"] in truth and fold(r["doc_id"])]
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in own]), own


def test_toxicity_held_out(spark):
    docs, labels = labelled()
    rows = toxicity.classify(documents(spark, docs + [(d and d + 5000, t) for d, t in awkward()]), table(spark, labels + AWKWARD_LABELS)).collect()
    assert len(rows) == len(docs) + len(awkward())
    share, own = accuracy(rows, {i: t for i, _, t in labels}, lambda d: zlib.crc32(str(d).encode()) % 5 == 0)
    assert share > 0.98 and all(r["held_out"] for r in own)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)


def test_quality_held_out(spark):
    docs, labels = labelled()
    rows = quality.classify(documents(spark, docs + [(d and d + 5000, t) for d, t in awkward()]), table(spark, labels + AWKWARD_LABELS)).collect()
    assert len(rows) == len(docs) + len(awkward())
    share, own = accuracy(rows, {i: q for i, q, _ in labels}, lambda d: zlib.crc32(str(d).encode()) % 3 == 1)
    assert share > 0.97 and all(r["held_out"] for r in own)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = labelled(300)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    for op in (toxicity, quality):
        a, b = ({r["doc_id"]: r["score"] for r in op.classify(documents(spark, docs), table(spark, x)).collect()} for x in (labels, flipped))
        assert all(abs(a[d] - b[d]) < 1e-9 for d in a)


def test_one_class_none_and_empty(spark):
    docs, labels = labelled(60)
    frame = documents(spark, docs + awkward())
    for op in (toxicity, quality):
        none = op.classify(frame, table(spark, [])).collect()
        assert len(none) == len(docs) + len(awkward()) and all(abs(r["score"] - 0.5) < 1e-6 for r in none)
        ones = op.classify(frame, table(spark, [(i, 1, 1) for i, _, _ in labels])).collect()
        assert all(r["predicted"] == 1 for r in ones)
        assert op.classify(documents(spark, []), table(spark, labels)).count() == 0


def test_filters_keep_columns_and_clean_rows(spark):
    docs, labels = labelled(600)
    frame, known = documents(spark, docs), table(spark, labels)
    for op, bad in ((toxicity, {i for i, _, t in labels if t}), (quality, {i for i, q, _ in labels if not q})):
        kept = op.clean(frame, known)
        assert kept.columns == frame.columns
        ids = {r["doc_id"] for r in kept.collect()}
        clean = {i for i, _ in docs} - bad
        assert len(ids & clean) > 0.97 * len(clean) and len(ids & bad) < 0.06 * len(bad) + 2


def test_ngrams_stay_inside_a_text():
    for texts in ([b"abcdefgh", b"", b"ab", b"abcdefghi"], [b"", b""], []):
        got = {}
        for doc, hashed in toxicity._ngrams(texts):
            for d, h in zip(doc.tolist(), hashed.tolist()):
                got.setdefault(d, []).append(h)
        alone = {i: [h for _, hs in toxicity._ngrams([t]) for h in hs.tolist()] for i, t in enumerate(texts)}
        assert got == {i: h for i, h in alone.items() if h}


def test_rare_toxic_words_count(spark):
    # Four hundred toxic words, each in three toxic texts of which half of all are: too rare to stand out one by one.
    rng, docs, labels = random.Random(5), [], []
    words = ["".join(rng.choice("qxzjkvw") for _ in range(9)) for _ in range(400)]
    for i in range(2400):
        w = prose(i, 40).split()
        if i % 2:
            w.insert(rng.randrange(len(w)), words[i // 2 % 400])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, i % 2))
    rows = toxicity.classify(documents(spark, docs), table(spark, labels)).collect()
    share, _ = accuracy(rows, {i: t for i, _, t in labels}, lambda d: zlib.crc32(str(d).encode()) % 5 == 0)
    assert share > 0.9


def test_sums_of_a_task(monkeypatch):
    monkeypatch.setattr(toxicity, "TASK_GRAMS", 3)
    grams, y = [[1, 2], [], [2, 5, 7, 9], [1], [1, 9]], [1, 0, 0, 1, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(grams, pa.list_(pa.int32())), pa.array(range(5))], names=["y", "grams", "number"])
    want = np.zeros((2, 1 << toxicity.HASH_BITS))
    for label, g in zip(y, grams):
        want[1 - label, g] += 1
    for part in (batch, batch.slice(1)):
        out, = toxicity._counts([part])
        assert out.column("totals")[0].as_py() == [sum(y[-len(part):]), len(part) - sum(y[-len(part):])]
    out, = toxicity._counts([batch])
    assert np.array_equal(np.frombuffer(out.column("sums")[0].as_py(), np.int32).reshape(2, -1), want)
    assert not list(toxicity._counts([batch.slice(0, 0)]))


def test_fit_reaches_the_optimum_of_all_texts(spark, monkeypatch):
    """The averaged fit of several tasks against the exact optimum of the loss of all texts, found with Newton's steps in the span of the texts."""
    monkeypatch.setattr(toxicity, "TASK_LABELLED", 60)
    docs, labels = labelled(300)
    weights, intercept = toxicity.fit(documents(spark, docs), table(spark, labels), max_labelled=300)
    y, size = np.array([t for _, _, t in labels], float), 1 << toxicity.HASH_BITS
    grams = [np.unique(np.concatenate([h for _, h in toxicity._ngrams([text.encode()])])) for _, text in docs]
    p, q = (sum(np.bincount(g, minlength=size) * w for g, w in zip(grams, part)) for part in (y, 1 - y))
    there = p + q > 0
    ratio = np.where(there, np.log((p + 1) / (p + 1)[there].sum()) - np.log((q + 1) / (q + 1)[there].sum()), 0.0)
    kernel = np.array([[(ratio[np.intersect1d(a, b, assume_unique=True)] ** 2).sum() for b in grams] for a in grams])

    def loss(z, penalty):
        return np.logaddexp(0, z).sum() - z @ y + 0.5 * toxicity.L2 * penalty

    n = len(y)
    beta, bias = np.zeros(n), np.log(y.sum() / (1 - y).sum())
    start = loss(kernel @ beta + bias, 0)
    for _ in range(30):
        z = kernel @ beta + bias
        s = 1 / (1 + np.exp(-z))
        h = np.block([[s[:, None] * (1 - s)[:, None] * kernel + np.eye(n), (s * (1 - s))[:, None]], [np.ones((1, n)) @ ((s * (1 - s))[:, None] * kernel), np.array([[(s * (1 - s)).sum()]])]])
        step = np.linalg.solve(h, np.append(s - y + beta, (s - y).sum()))
        beta, bias = beta - step[:-1], bias - step[-1]
    best = loss(kernel @ beta + bias, beta @ kernel @ beta)
    w = np.divide(weights, ratio, out=np.zeros(size), where=there & (ratio != 0))
    z = np.array([weights[g].sum() for g in grams]) + intercept
    got = loss(z, w @ w)
    assert best <= got + 1e-6 and got - best < 0.05 * (start - best), (start, got, best)
    assert np.mean((z > 0) == (kernel @ beta + bias > 0)) > 0.99
