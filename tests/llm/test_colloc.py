import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textbarge.llm import colloc as C

from .helpers import EXTRA, N_EXTRA, awkward

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, l, *["x", 0.5], *["z"] * (N_EXTRA - 2)) for i, (t, l) in enumerate(rows)], f"doc_id bigint, text string, lang string, {EXTRA}")


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            s, _, l, r = min(((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]])), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def run(spark, rows, least, top=2000):
    got = C.collocations(table(spark, rows), least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


def corpus(seed, docs, vocabulary):
    rng = random.Random(seed)
    words = [w for i, w in enumerate(vocabulary) for _ in range(max(1, 30 // (i + 1)))]
    rows = []
    for _ in range(docs):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " !"]) for _ in range(rng.randint(0, 120)))
        if rng.random() < 0.3:
            text += " New  York city hall, the New york City hall;new york city HALL of It"
        rows.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    return rows


@pytest.mark.parametrize("seed,least", [(1, 5), (2, 12)])
def test_equals_brute_force(spark, monkeypatch, seed, least):
    """Many shards of one document or some, and many buckets."""
    monkeypatch.setattr(C, "BUCKET", 50)
    rows = corpus(seed, 150, "the of a it is new york city in É Ünder x.y z'q 日本 end less".split(" ") + [f"w{i}" for i in range(40)])
    want = brute(rows, least, 2000)
    assert run(spark, rows, least) == want and len(want) > 30


def test_top_and_ties(spark):
    rows = [("aa bb. cc dd. ee ff. gg hh. é z. zz y.", "x")] * 7 + [("aa bb cc " * 6, "y")] * 3
    assert run(spark, rows, 5, 4) == brute(rows, 5, 4)


def test_awkward_rows(spark):
    rows = [(t, "en") for _, t in awkward()] + [(None, None), ("", None), ("\u0000 a \u0000 a \u0000 a", None), (". . .", "fr"), ("word " * 200_000, "en"), ("same thing here " * 30, "und")]
    assert run(spark, rows, 20) == brute(rows, 20, 2000)
    assert run(spark, [], 2) == []
    assert run(spark, [(None, None)], 2) == []
    assert run(spark, [("one two three", "en")], 2) == []


@pytest.mark.parametrize("bits,n", [(1, 2), (3, 5), (17, 2), (17, 5), (25, 5), (31, 4), (33, 3), (64, 2), (64, 5)])
def test_the_filter_loses_nothing(bits, n):
    rng = np.random.default_rng(bits * n)
    top = 1 << min(bits, 63)
    parts, all_counts = [], Counter()
    width = C.widths(bits, n)
    deal = min(width[0], 3)
    blocks = defaultdict(list)
    for _ in range(4):
        grams = np.unique(rng.integers(0, min(top, 50) if rng.random() < 0.5 else top, (300, n)).astype(np.uint64), axis=0)
        counts = rng.choice([1, 2, 3, 254, 255, 256, 10**12], len(grams))
        columns = C.permuted(list(grams.T), bits)
        assert all((a == b).all() for a, b in zip(C.restored(columns, bits), grams.T))
        limbs = C.packed(columns, bits)
        assert all((a == b).all() for a, b in zip(C.unpacked(limbs, bits, n), columns))
        order = C._order(limbs)
        limbs, counts, grams = [x[order] for x in limbs], counts[order], grams[order]
        all_counts.update({tuple(map(int, g)): int(c) for g, c in zip(grams, counts)})
        buckets = C._shift(limbs[0], width[0] - deal)
        for b in np.unique(buckets):
            mine = buckets == b
            data = C.encoded([x[mine] for x in limbs], counts[mine], width, min(width[0], max(deal, 9)), deal, int(b))
            back, again = C.decoded(data, width, deal, int(b))
            assert (again == counts[mine]).all() and all((x == y[mine]).all() for x, y in zip(back, limbs))
            blocks[int(b)].append(data)
    got = {}
    for b, some in blocks.items():
        limbs, totals, group, part = C.merged(some, width, deal, b)
        assert len(group) == len(part) and group.max() == len(totals) - 1
        columns = C.restored(C.unpacked(limbs, bits, n), bits)
        got.update({tuple(int(c[i]) for c in columns): int(t) for i, t in enumerate(totals)})
    assert got == all_counts


def test_scores_beyond_64_bits(spark):
    """a * n passes 64 bits: the score is exact."""
    a, n, l, r = 3_000_000_000_001, 9_000_000_000_000_007, 3_000_000_000_123, 4_000_000_000_019
    got = spark.createDataFrame([(a, n, l, r)], "a bigint, n bigint, l bigint, r bigint").selectExpr(
        "cast(1000 * cast(a as decimal(16,0)) * cast(n as decimal(18,0)) as decimal(38,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as s").first()[0]
    assert got == 1000 * a * n // (l * r)


def test_ids_have_few_bits_however_many_shards(spark):
    # 500 words, each in every one of 64 shards: an id has no room for a shard.
    words = [f"w{i}" for i in range(500)]
    rows = [(" ".join(random.Random(s).sample(words, len(words))), "en") for s in range(64)]
    _, named, phrases = C.counts(table(spark, rows).repartition(64), least=64)
    got = named.collect()
    assert Counter((r["lang"], r["word"], r["f"]) for r in got) == Counter(("en", w, 64) for w in words)
    assert len({r["id"] for r in got}) == len(words) and max(r["id"] for r in got) < 8 * len(words)
    assert phrases.where("size(ids) = 1").count() == len(words)


def test_a_task_holds_few_shards_however_few_partitions(spark, monkeypatch):
    """A table's files are those of single tasks, each with the shards of a bucket: more text has more buckets, not more shards in each."""
    monkeypatch.setattr(C, "SHARD_BYTES", 1000)     # in the driver; tasks take partitions whole
    rng, most, bucketed = random.Random(3), {}, C._bucketed
    rows = [(" ".join(rng.choice("abcd") for _ in range(501)), "en") for _ in range(128)]

    def kept(df, name, *rest):
        out = bucketed(df, name, *rest)
        files = Counter(r[0] for r in out.select(F.input_file_name(), "shard").distinct().collect())
        assert sum(files.values()) > 64
        most[name] = max(files.values())
        return out

    monkeypatch.setattr(C, "_bucketed", kept)
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 4
    got = C.collocations(table(spark, rows).repartition(128), least=40)
    assert sorted(map(tuple, got.collect())) == brute(rows, 40, 2000)
    assert set(most) == {"shards", *(f"grams_{n}" for n in range(2, 6))} and max(most.values()) <= 3 * C.HELD
