import hashlib
import re

from textbarge.llm import decontam

from .helpers import awkward, documents, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, window):
    windows = {}
    for name, text in items:
        w = WORD.findall(lower(text))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add("" if name is None else str(name))
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for win, names in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= names
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def cases():
    passage = prose(7, 24)
    docs = awkward() + [(20, prose(8, 40) + " " + passage.upper() + "! " + prose(9, 10)), (21, passage), (22, " ".join(passage.split()[5:15])),
                        (23, " ".join(passage.split()[5:14])), (24, "x tiny item y"), (25, (passage + " ") * 3), (26, "É tiny item"), (27, prose(1, 12))]
    items = [(1, passage), (2, passage), (2, passage), (3, "Tiny, item"), (4, None), (5, ""), (None, prose(8, 20)), (6, "..."), (7, prose(1, 50)), (8, "日本"), (10, "tiny item y")]
    return docs, items


def test_equals_brute_force_in_one_chunk_and_in_many(spark):
    docs, items = cases()
    frame = documents(spark, docs)
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id bigint, text string, score double")
    for window, chunk_bytes in ((10, 16 << 20), (10, 150), (3, 300)):
        rows = decontam.report(frame, bench, window=window, chunk_bytes=chunk_bytes).drop("items").collect()
        assert sorted(map(tuple, rows), key=key) == sorted(brute(docs, items, window), key=key)


def test_clean_keeps_whole_rows(spark):
    docs, items = cases()
    frame = documents(spark, docs)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontam.clean(frame, bench)
    assert kept.columns == frame.columns
    bad = {r[0] for r in brute(docs, items, 10) if r[5]}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad)


def test_empty_tables(spark):
    docs, items = cases()
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.report(documents(spark, []), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert not any(r["contaminated"] for r in decontam.report(documents(spark, docs), none).collect())
