"""Payload policies (A1-A5, P9, P12, F7) and payloads as segments."""

import pytest

from pyspark.sql import functions as F

from textbarge.operators.concat import ordered_segments
from textbarge.operators.payload import build_payload
from textbarge.profiles import LENIENT, STRICT

from plan_tools import exchanges_by

ERR_T = "struct<kind:string,path:string,message:string>"
ROW_T = f"run_id string, ord int, path string, text string, error {ERR_T}"


def _df(spark, rows):
    return spark.createDataFrame(rows, ROW_T)


def test_fail_fast(spark):
    e = ("FileNotFound", "/b", "File not found: /b")
    rows = [("r1", 0, "/a", "one", None), ("r1", 1, "-", "", None), ("r1", 2, "/c", "three", None),
            ("r2", 0, "/a", "x", None), ("r2", 1, "/b", None, e), ("r2", 2, "/z", None,
                                                                   ("BinaryFile", "/z", "Cannot read binary file: /z")),
            ("r3", 0, "-", "hello from stdin", None), ("r4", 0, "/only.txt", "Test content", None)]
    got = {r.run_id: r for r in build_payload(_df(spark, rows), STRICT, "fail_fast").collect()}
    assert got["r1"].payload == "one\n\nthree" and got["r1"].n_bytes == 10
    assert got["r1"].summary == "Copied 10 bytes from 3 files to clipboard"
    assert got["r2"].payload is None and got["r2"].error.message == "File not found: /b"
    assert got["r3"].summary == "Copied 16 bytes from stdin to clipboard"
    assert got["r4"].n_bytes == 12 and got["r4"].summary == "Copied 12 bytes from /only.txt to clipboard"


def test_no_files(spark):
    runs = spark.createDataFrame([("r1",), ("empty",)], "run_id string")
    rows = [("r1", 0, "/a", "x", None)]
    got = {r.run_id: r for r in build_payload(_df(spark, rows), STRICT, "fail_fast", runs=runs).collect()}
    assert got["empty"].error.message == "No files specified"


def test_last_wins(spark):
    e = ("BinaryFile", "/b", "Cannot read binary file: /b")
    rows = [("r", 0, "/a", "first", None), ("r", 1, "/b", None, e), ("r", 2, "/c", "third", None),
            ("r", 3, "/d", None, e), ("bad", 0, "/b", None, e)]
    got = {r.run_id: r for r in build_payload(_df(spark, rows), STRICT, "last_wins").collect()}
    assert got["r"].payload == "third" and got["r"].n_failed == 2
    assert got["bad"].payload is None and got["bad"].error.kind == "BinaryFile"


def test_single(spark):
    rows = [("one", 0, "/a.txt", "text", None), ("two", 0, "/a", "x", None), ("two", 1, "/b", "y", None),
            ("blank", 0, "/e.txt", " \n　", None)]
    got = {r.run_id: r for r in build_payload(_df(spark, rows), LENIENT, "single").collect()}
    assert got["one"].payload == "text"
    assert got["two"].error.message == "Please select only one file"
    assert got["blank"].error.message == "File is empty"


def test_output_limit_measured_before_concat(spark):
    rows = [("big", i, f"/{i}", "x" * 100, None) for i in range(50)] + [("small", 0, "/s", "ok", None)]
    p = LENIENT.with_(max_output_bytes=1000)
    got = {r.run_id: r for r in build_payload(_df(spark, rows), p, "fail_fast").collect()}
    assert got["big"].payload is None and got["big"].error.kind == "outputTooLarge"
    assert got["big"].n_bytes == 50 * 100 + 49
    assert got["small"].payload == "ok"


def test_segments_join_to_the_whole(spark):
    """Groups of any size against the segment size; empty and repeated entries, one longer than a segment."""
    rows = [("hot", i, f"text {i} " * (i % 4)) for i in range(3000)] + [("hot", 5, "again"), ("hot", 7000, "long " * 400)]
    rows += [("j", 0, "a"), ("j", 1, None), ("j", 2, ""), ("e", 0, ""), ("n", 0, None)] + [(f"g{i % 50}", i, f"t{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, t string")
    light = df.where("t is not null").select("k", "o", F.octet_length("t").cast("bigint").alias("n_bytes"))
    out = ordered_segments(df, light, ["k"], "o", "t", ",", 1000).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.k, r.seg)):
        got.setdefault(r.k, []).append(r.text)
    want = {}
    for k, o, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0], r[1])):
        want.setdefault(k, []).append((o, t))
    assert set(got) == set(want)
    for k, parts in got.items():
        if k == "hot":
            assert len(parts) > 50 and max(map(len, parts)) < 5000
            alike = [t for _, t in want[k]]
            assert sorted("".join(parts).split(",")) == sorted(alike)     # the two entries of one order value in either order
        else:
            assert "".join(parts) == ",".join(t for _, t in want[k])


def test_large_run_in_segments(spark):
    """A run far beyond the segment size is published whole; only a profile's own limit refuses one."""
    rows = [("big", i, f"/{i}", "x" * 100, None) for i in range(500)] + [("small", 0, "/s", "ok", None)]
    out = build_payload(_df(spark, rows), STRICT.with_(segment_bytes=2000), "fail_fast")
    parts = sorted((r for r in out.collect() if r.run_id == "big"), key=lambda r: r.seg)
    assert len(parts) > 20 and all(r.error is None and r.n_bytes == 500 * 101 - 1 and r.n_files == 500 for r in parts)
    assert "".join(r.payload for r in parts) == "\n".join(["x" * 100] * 500)
    assert [r.seg for r in parts] == sorted({r.seg for r in parts})


def test_many_empty_entries(spark):
    rows = [("many", i, f"/{i}", "", None) for i in range(2000)]
    out = build_payload(_df(spark, rows), LENIENT.with_(segment_bytes=1000), "fail_fast").collect()
    assert len(out) > 50 and sum(len(r.payload) for r in out) == 1999


def test_hot_run_is_spread_over_tasks(spark):
    """The segments of one run with most of the rows come from many tasks: no exchange is by run alone
    where texts are (they move by run and order, then by run and segment)."""
    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 10 < 6, F.lit("hot")).otherwise((F.col("id") % 500).cast("string")).alias("run_id"),
        F.col("id").cast("int").alias("ord"), F.lit("/p").alias("path"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
        F.lit(None).cast(ERR_T).alias("error"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = build_payload(df, STRICT.with_(segment_bytes=20_000), "fail_fast")
        rows = [r for r in out.collect() if r.run_id == "hot"]
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]     # the final one
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(rows) > 30
    assert "".join(r.payload for r in sorted(rows, key=lambda r: r.seg)) == "\n".join(f"t{i}" for i in range(20000) if i % 10 < 6)
    assert any("run_id" in x and "ord" in x for x in plan.splitlines() if "hashpartitioning" in x)
    assert any("run_id" in x and "seg" in x for x in plan.splitlines() if "hashpartitioning" in x)
    below = exchanges_by(plan, "run_id")
    assert below and not any("listagg" in x for x in below)


@pytest.mark.parametrize("policy", ["fail_fast", "last_wins", "single"])
def test_entries_in_parts(spark, policy):
    """An entry's text in several parts gives the payload of the whole text."""
    t = "run_id string, ord int, path string, text string, error struct<kind:string,path:string,message:string>"
    whole = [("a", 0, "/a0", "one two three", None), ("b", 0, "/b0", "x" * 50, None), ("b", 1, "/b1", "", None), ("b", 2, "/b2", "yz", None),
             ("c", 0, "/c0", "ok", None), ("c", 1, "/c1", None, ("notFound", "/c1", "gone")), ("d", 0, "/d", None, ("notFound", "/d", "gone"))]
    parts = []
    for run, o, path, text, err in whole:
        cut = [text] if text is None or len(text) < 5 else [text[i:i + 5] for i in range(0, len(text), 5)]
        parts += [(run, o, path, c, err, i) for i, c in enumerate(cut)]
    for segment in (10, 1 << 20):
        profile = LENIENT.with_(segment_bytes=segment, max_output_bytes=60)
        got = {}
        for rows, schema in ((whole, t), (parts, t + ", part bigint")):
            out = build_payload(spark.createDataFrame(rows, schema), profile, policy).collect()
            every = {}
            for r in sorted(out, key=lambda r: r.seg):
                text, _ = every.get(r.run_id, (None, None))
                every[r.run_id] = (r.payload if text is None else text + r.payload, (r.n_bytes, r.n_files, r.n_failed, r.summary, r.error))
            got[schema] = every
        assert got[t] == got[t + ", part bigint"]


def test_single_notices(spark):
    long_err = ("extractionFailed", "/a.png", "x" * 150)
    rows = [("url", 0, "https://example.com/file.txt", None,
             ("notFileURL", "https://example.com/file.txt", "Not a local file: https://example.com/file.txt")),
            ("long", 0, "/a.png", None, long_err)]
    got = {r.run_id: r for r in build_payload(_df(spark, rows), LENIENT, "single").collect()}
    assert got["url"].summary == "Not a local file"
    assert got["long"].summary == "x" * 97 + "..."


def test_selection_of_nothing(spark):
    from textbarge.operators.validate import selection_status
    items = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "s string, p string")
    every = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    got = {r.s: (r.n_items, r.message) for r in selection_status(items, ["s"], every).collect()}
    assert got == {"a": (2, "Please select only one file"), "b": (1, None), "c": (0, "No file selected")}
