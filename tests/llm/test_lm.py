import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from textbarge.llm import lm
from textbarge.llm.common import held_out

from .helpers import awkward, documents, prose


def run(spark, docs):
    return lm.score(documents(spark, docs), held_out(F.col("doc_id"), 7, 2)).collect()


def cases():
    return awkward() + [(1000 + i, prose(i, 120)) for i in range(300)]


def test_counts_and_base(spark):
    docs = cases()
    rows = run(spark, docs)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    end, seen = "", Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), end]
    for d, t in docs:
        if not held(d):
            seen.update(tokens(t))
    n, v = sum(seen.values()), len(seen)
    want = Counter((d, held(d), len(tokens(t)), sum(w in seen for w in tokens(t)), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for d, t in docs)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want


def test_beats_the_base_on_held_out_texts(spark):
    # Words in a fixed cycle: the two before decide the next.
    docs = [(i, " ".join(["red", "green", "blue", "white"][(i + k) % 4] for k in range(200))) for i in range(200)]
    rows = [r for r in run(spark, docs) if r["held_out"]]
    assert rows and sum(r["score"] for r in rows) > 0.8 * sum(r["base_score"] for r in rows)


def test_probabilities_sum_to_one(spark):
    counts = Counter(w for _, t in cases() for w in (t or "").encode().lower().split())
    frequent = counts.most_common(20)
    groups = {}
    for w, c in counts.items():
        g = groups.get(lm.group_of(w), (0, 0))
        groups[lm.group_of(w)] = (g[0] + c, g[1] + 1)
    shape = lm.Shape(sum(counts.values()) + 10, len(counts) + 1, 10, frequent, groups)
    first, second, bias, z = lm.tables(lm._initial(shape))
    for a, b in ((0, 0), (3, shape.begin), (shape.begin, shape.begin)):
        p = np.exp(first[a].astype(float) + second[b] + bias - z[a, b])
        assert abs(p.sum() - 1) < 1e-4
    # Inside a group, its words and one unseen word share everything.
    rare = [w for w in counts if w not in shape.classes]
    of = shape.of(rare)
    for c in set(of.tolist()):
        assert abs(sum((counts[w] + 1) / shape.sums[c] for w, x in zip(rare, of.tolist()) if x == c) + 1 / shape.sums[c] - 1) < 1e-9


def test_nothing_learnt_and_empty(spark):
    only_held = [(d, "some words") for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2]
    rows = run(spark, only_held)
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["n_tokens"] == 3 and math.isfinite(r["score"]) for r in rows)
    assert run(spark, []) == []


def test_codes_beyond_two_bytes_come_back():
    import pyarrow as pa
    for codes in ([], [0], [65535, 65536, 3, 2 ** 31 + 5, 2 ** 32 - 1]):
        assert lm._codes(pa.scalar(lm._packed(np.array(codes, np.uint32)), pa.binary())).tolist() == codes
    few = np.arange(60000, dtype=np.uint32)
    assert not any(lm._packed(few)[120000:])


def test_counts_go_back_as_plain_numbers(spark):
    # The plan that returns the corpus counts to their chunks gathers no pairs; many chunks share words.
    docs = [(i, prose(i % 40, 60) + f" own{i}") for i in range(400)]
    out = lm.score(documents(spark, docs).repartition(8), held_out(F.col("doc_id"), 7, 2))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(" in plan and "collect_list(struct" not in plan and "collect_list(named_struct" not in plan
    seen = Counter(w for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2 for w in t.lower().split())
    seen[""] = sum(zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in docs)
    n, v = sum(seen.values()), len(seen)
    want = {d: round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in [*t.lower().split(), ""]), 4) for d, t in docs}
    assert {r["doc_id"]: round(r["base_score"], 4) for r in out.collect()} == want


def test_a_chunk_goes_on_over_batches(spark):
    # Batches end after 1,000 rows at most; few bytes make one chunk, many still several.
    for rows, chunks in ((2500, 1), (2 * lm.CHUNK_BYTES // 10_000, 3)):
        wide = 1 if chunks == 1 else 9_000 // 6
        docs = spark.range(0, rows, 1, 1).select("id", F.lit(False).alias("held"), F.repeat(F.lit("words "), wide).alias("text"))
        got = docs.mapInArrow(lm._chunks, lm.CHUNK).select("chunk", F.size("doc_ids").alias("n"), "words", "counts", "pieces").collect()
        assert len(got) == chunks and sum(r["n"] for r in got) == rows and len({r["chunk"] for r in got}) == chunks
        # Mini-batches still end with each batch.
        assert [p for r in got for p in r["pieces"]] == ([0, 1000, 2000] if chunks == 1 else [0] * chunks)
        assert sum(r["counts"][0] for r in got) == rows * wide and all([bytes(w) for w in r["words"]] == [b"words"] for r in got)


def test_a_step_moves_by_the_gradient():
    # The trainer's own arrays are written over by each step: a shorter one after a longer one is as if alone.
    groups = {g: (20, 4) for g in range(lm.GROUPS)}
    shape = lm.Shape(20 * lm.GROUPS + 10, 100, 10, [], groups)
    rng = np.random.default_rng(3)
    events = [rng.integers(0, shape.begin, (3, n)).astype(np.int32) for n in (lm.BATCH, 37)]
    trainer, p = lm.Trainer(lm._initial(shape), shape, 5), {k: v.astype(float) for k, v in lm._initial(shape).items()}
    noises, seen = np.random.default_rng(5), {k: np.full(v.shape, 1e-4) for k, v in p.items()}
    for target, one, two in events:
        trainer.step(target, one, two)
        noise = np.minimum(np.searchsorted(np.cumsum(shape.unigram), noises.random(lm.NOISE)), len(shape.unigram) - 1)
        q = p["r"][one] * p["c"][0] + p["r"][two] * p["c"][1]
        log_noise = np.log(lm.NOISE * shape.unigram)
        g = 1 / (1 + np.exp((q * p["t"][target]).sum(1) + p["b"][target] - log_noise[target])) / len(target)
        h = -1 / (1 + np.exp(-(q @ p["t"][noise].T + p["b"][noise] - log_noise[noise]))) / len(target)
        dq, grad = g[:, None] * p["t"][target] + h @ p["t"][noise], {k: np.zeros(v.shape) for k, v in p.items()}
        np.add.at(grad["t"], target, g[:, None] * q)
        np.add.at(grad["t"], noise, h.T @ q)
        np.add.at(grad["b"], target, g)
        np.add.at(grad["b"], noise, h.sum(0))
        for i, ctx in enumerate((one, two)):
            np.add.at(grad["r"], ctx, dq * p["c"][i])
            grad["c"][i] = (dq * p["r"][ctx]).sum(0)
        for k in p:
            seen[k] += grad[k] ** 2
            p[k] = p[k] + lm.RATE * grad[k] / np.sqrt(seen[k])
    assert all(np.allclose(trainer.p[k], p[k], atol=1e-3) for k in p)
