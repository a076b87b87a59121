import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from textbarge.llm import spelling as S

from .helpers import awkward, documents


def edit_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    form, near = {}, {}
    for w in words:
        near[w] = [v for v in words if edit_one(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, rows):
    got = S.variants(documents(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, got.collect()))


def edited(rng, word, letters):
    at, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:at] + ("" if kind == 0 else rng.choice(letters) + (word[at] if kind == 1 else "")) + word[at + 1:]


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "abcdefghijklmnopqrstuvwxyzÀéÿ"])
def test_equals_brute_force(spark, letters):
    rng = random.Random(len(letters))
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(40)]
    words = base + [edited(rng, rng.choice(base), letters) for _ in range(250)]
    words += [edited(rng, w, letters) for w in words[40:120]]
    text = [w for w in words for _ in range(rng.choice([1, 2, 3, 2, 30, 400] if w in base else [1, 2, 3, 25]))]
    rng.shuffle(text)
    rows = [(i, " ".join(text[i * 40:(i + 1) * 40])) for i in range(len(text) // 40 + 1)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert sum(r[1] is not None for r in want) > 10 and max(r[4] for r in want) > 1


def test_chains_of_forms(spark):
    doc = next(i for i in range(99) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in ("wanderer", "wanderes", "wandexes", "wandexxs")))
    rows = [(doc, " ".join(["wanderer"] * 3000 + ["wanderes"] * 250 + ["wandexes"] * 20 + ["wandexxs"] * 2))]
    want = brute(rows)
    assert run(spark, rows) == want and ("wandexxs", "wandexes", "wanderer", 2, 1, 20) in want


def test_awkward_rows(spark):
    long = "x" * 50_000
    rows = awkward() + [(20, f"{long} {long} {long}y {long}y"), (21, "ÀÉÎÕÜß× ÀÉÎÕÜß× ÀÉÎÕÜß÷ ÀÉÎÕÜß÷"), (22, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa AAAAAAAAA aaaaaaaaa"), (23, "İstanbul İstanbul ǅabcdefg")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None), (None, "")]) == []


def test_pivots_are_the_least_disjoint_pair():
    rng = np.random.default_rng(2)
    for places in (3, 6, 9):
        weight = np.where(rng.random((500, places)) < 0.6, rng.integers(1, 9, (500, places)), np.inf)
        weight[:, [0, 2]] = 5.0     # some disjoint pair there is
        chosen = S.pivots(weight)
        for w, c in zip(weight, chosen):
            at = np.flatnonzero(c)
            assert len(at) == 2 and at[1] - at[0] >= 2
            assert w[at].sum() == min(w[i] + w[j] for i in range(places) for j in range(i + 2, places))


def test_near_words_share_a_posting():
    """Every pair at distance one, of words over few letters, meets by the rule of the prefixes."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(7, 10))) for _ in range(700)})
    counts = Counter(w[i:i + 2] for w in words for i in range(len(w) - 1))
    order = sorted((n, g) for g, n in counts.items())
    rank, weight = np.full(1 << 16, -1, np.int32), np.array([n for n, _ in order], float)
    for i, (_, g) in enumerate(order):
        rank[ord(g[0]) << 8 | ord(g[1])] = i
    sides = []
    for own in (True, False):
        keys, last = {}, {}
        for w in words:
            k, _, end = S.postings([w], rank, weight, own)
            keys[w], last[w] = set(k.tolist()), end[0]
        sides.append(keys)
    pairs = [(a, b) for a in words for b in words if edit_one(a, b)]
    assert len(pairs) > 200
    for a, b in pairs:
        if last[a] <= last[b]:
            assert sides[0][a] & sides[1][b], (a, b)


def test_every_word_is_flushed(spark, monkeypatch):
    rows = [(i, " ".join(f"{'abcdefghij'[j]}" * 8 for j in range(10))) for i in range(50)]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["doc_id", "text"])
    monkeypatch.setattr(S, "FLUSH", 3)
    monkeypatch.setattr(S._flushed, "__defaults__", (3,))
    total = sum(sum(b.column(1).to_pylist()) for b in S._words(iter([batch])))
    assert total == 500
