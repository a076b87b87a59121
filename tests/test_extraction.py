"""Extractors that fail (U1, G15), and notifications in what a reader sees as characters."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textbarge.functions.text import notification
from textbarge.sources.extraction import run_extractor


def _extractor():
    """Nested, so it is shipped by value."""
    def by_name(batch):
        import os
        import time
        path = batch["path"].iloc[0]
        if "raise" in path:
            raise KeyError("no such font")
        if "die" in path:
            os._exit(9)
        if "hang" in path:
            time.sleep(300)
        yield pd.DataFrame([(path, 0, "first")], columns=["path", "page_idx", "embedded"])
        if "late" in path:
            time.sleep(300)
        if "half" in path:
            raise RuntimeError("page 2 is broken")
        if "none" not in path:
            yield pd.DataFrame([(path, 1, bytes(batch["content"].iloc[0]).decode())], columns=["path", "page_idx", "embedded"])
    return by_name


def test_calls_that_fail_are_their_files_errors(spark):
    names = ["a", "raise1", "b", "die", "c", "hang", "d", "half", "late", "e", "raise2", "none", "f"]
    files = spark.createDataFrame([(f"/{n}", n.encode()) for n in names], "path string, content binary").coalesce(1)
    got = {}
    for r in run_extractor(files, _extractor(), deadline=1.0).collect():
        got.setdefault(r.path[1:], []).append((r.page_idx, r.embedded, r.error, r.elapsed_ms))
    for n in "abcdef":
        assert sorted(got[n]) == [(0, "first", None, None), (1, n, None, None)]
    assert got["raise1"] == [(0, None, "extractor raised KeyError: 'no such font'", None)] and len(got["raise2"]) == 1
    assert got["die"] == [(0, None, "extractor died (exit code 9)", None)]
    assert got["hang"] == [(0, None, "extractor timed out after 1 s", 1001)]
    assert got["half"] == [(0, "first", None, None), (1, None, "extractor raised RuntimeError: page 2 is broken", None)]
    assert got["late"] == [(0, "first", None, None), (1, None, "extractor timed out after 1 s", 1001)]
    assert got["none"] == [(0, "first", None, None)]


def test_hanging_calls_wait_beside_others(spark):
    names = [f"{'hang' if i % 2 else 'fine'}{i}" for i in range(24)]
    files = spark.createDataFrame([(f"/{n}", n.encode()) for n in names], "path string, content binary").coalesce(1)
    run_extractor(files.limit(1), _extractor(), deadline=2.0).count()
    began = time.monotonic()
    rows = run_extractor(files, _extractor(), deadline=2.0).collect()
    assert time.monotonic() - began < 12     # 24 s one after another
    assert sorted(r.path[1:] for r in rows if r.error == "extractor timed out after 2 s") == sorted(n for n in names if "hang" in n)
    assert sorted(r.embedded for r in rows if r.page_idx == 1) == sorted(n for n in names if "fine" in n)


def test_calls_that_compute_have_the_core_alone(spark):
    def computes(batch):
        import subprocess
        import sys
        import time
        began = time.time()
        if "0" in batch["path"].iloc[0]:
            subprocess.run([sys.executable, "-c", "import time\nt = time.process_time()\nwhile time.process_time() - t < 0.4: pass"], check=True)
        else:
            while time.time() - began < 0.4:
                pass
        yield pd.DataFrame([(batch["path"].iloc[0], 0, f"{began} {time.time()}")], columns=["path", "page_idx", "embedded"])

    files = spark.createDataFrame([(f"/{i:02d}", b"x") for i in range(6, 14)], "path string, content binary").coalesce(1)
    spans = sorted(tuple(map(float, r.embedded.split())) for r in run_extractor(files, computes, deadline=20.0).collect())
    assert len(spans) == 8 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_isolated_rows_have_the_types_of_plain_ones(spark):
    def typed(batch):
        for path in batch["path"]:
            yield pd.DataFrame({"path": [path] * 2, "page_idx": [0, 1], "embedded": [None, "t"], "lines": [["a", None], None], "elapsed_ms": [2 ** 60 + 1, 5], "width_pt": [1.5, None]})
            yield pd.DataFrame([], columns=["path", "page_idx"])

    files = spark.createDataFrame([(f"/{i}", None if i == 2 else b"x") for i in range(4)], "path string, content binary").coalesce(1)
    rows = [sorted(run_extractor(files, typed, deadline=d).collect(), key=lambda r: r[:2]) for d in (None, 20.0)]
    assert rows[0] == rows[1] and len(rows[0]) == 8


def test_without_a_deadline_calls_share_frames(spark):
    files = spark.createDataFrame([(f"/{i}", b"x") for i in range(20)], "path string, content binary").coalesce(1)
    sizes = run_extractor(files, lambda f: pd.DataFrame([(p, len(f), "t") for p in f["path"]], columns=["path", "page_idx", "embedded"]))
    assert {r.page_idx for r in sizes.collect()} == {20}


@pytest.mark.parametrize("cluster", ["x", "e\u0301", "a\u0323\u0308", "\U0001F1E9\U0001F1EA", "\U0001F468\u200D\U0001F469\u200D\U0001F467", "\U0001F44D\U0001F3FD",
                                     "\r\n", "\u1100\u1161\u11A8", "1\uFE0F\u20E3"])
def test_notifications_keep_clusters_whole(spark, cluster):
    got = spark.createDataFrame([(n, cluster * n) for n in (0, 1, 97, 100, 101, 400)], "n int, m string").select(
        "n", notification("m", graphemes=True).alias("g")).collect()
    for n, g in got:
        assert g == (cluster * n if n <= 100 else cluster * 97 + "...")


def test_the_workflow_counts_code_points(spark):
    m = "e\u0301" * 60
    got = spark.createDataFrame([(m,)], "m string").select(notification(F.col("m"))).first()[0]
    assert got == m[:97] + "..."
