"""Row-preserving file scan (S1-S5, T1-T3), sinks (S8-S11), extractor hook (U1), streaming."""

import os

import pandas as pd
from pyspark.sql import functions as F

from textbarge.operators.validate import validation_error
from textbarge.sources.extraction import lookup_extraction, run_extractor
from textbarge.sources.files import attach_decoded, probe_inventory, scan_files
from textbarge.sources.manifest import manifest_from_paths, with_lookup_path
from textbarge.sources.sinks import publish, read_payload


def _write(root, name, data):
    p = os.path.join(root, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_scan_keeps_empty_and_underscore_files(spark, tmpdir_fresh):
    root = tmpdir_fresh
    a = _write(root, "a.txt", b"Hello")
    e = _write(root, "empty.txt", b"")
    u = _write(root, "_under.txt", b"u")
    d = os.path.join(root, "sub")
    os.makedirs(d)
    m = with_lookup_path(manifest_from_paths(spark, "r", [a, e, u, "/nonexistent/file.txt", d, a]))
    inv = probe_inventory(m)
    files = scan_files(spark, root)
    x = m.join(inv.withColumnRenamed("path", "lookup_path"), "lookup_path", "left").withColumn("verr", validation_error("lenient"))
    got = attach_decoded(x, files, "lenient").orderBy("ord").collect()
    assert got[0].text == "Hello" and got[5].text == "Hello"       # duplicates kept, order kept
    assert got[1].text == ""                                       # empty file survives (T1)
    assert got[2].text == "u"                                      # '_' name: read by the fallback (T3)
    assert got[3].verr.kind == "fileNotFound"
    assert got[4].verr.kind == "isDirectory"


def test_scan_pushes_length_filter(spark, tmpdir_fresh):
    _write(tmpdir_fresh, "x.txt", b"abc")
    df = scan_files(spark, tmpdir_fresh, max_bytes=10)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "length" in plan


def test_publish_overwrites(spark, tmpdir_fresh):
    t = os.path.join(tmpdir_fresh, "payload")
    a = spark.createDataFrame([("r", "old", 3, 1, "s", None)],
                              "run_id string, payload string, n_bytes bigint, n_files bigint, summary string, "
                              "error struct<kind:string,path:string,message:string>")
    publish(a, t)
    publish(a.withColumn("payload", F.lit("new")), t)
    assert [r.payload for r in read_payload(spark, t).collect()] == ["new"]


def test_lookup_and_hook(spark):
    e = spark.createDataFrame([("/test/image.png",), ("/test/unknown.png",), ("/test/bad.png",)], "path string")
    res = spark.createDataFrame([("/test/image.png", "Hello, World!", None), ("/test/bad.png", None, "OCR failed")],
                                "path string, text string, error string")
    got = {r.path: r for r in lookup_extraction(e, res, "strict").collect()}
    assert got["/test/image.png"].text == "Hello, World!"
    assert got["/test/bad.png"].error.message == "Failed to extract text from '/test/bad.png': OCR failed"
    assert got["/test/unknown.png"].error.kind == "ExtractionError"

    def ex(b):
        return pd.DataFrame({"path": b["path"], "page_idx": 0, "embedded": [bytes(c).decode() for c in b["content"]]})
    f = spark.createDataFrame([("/a", bytearray(b"hi"))], "path string, content binary")
    assert run_extractor(f, ex).first().embedded == "hi"


def test_stream_equals_batch(spark, tmpdir_fresh):
    from textbarge.plans.queries import stream_ingest
    from textbarge.plans.check import compare
    from textbarge.plans.oracle import ORACLE
    r = compare(spark, stream_ingest, ORACLE["stream_ingest"], "/root/testdata/sf0.001")
    assert r["hash_match"] and r["cols_match"]


def test_publish_file_returns_bytes(spark, tmpdir_fresh):
    from textbarge.sources.sinks import publish_file
    rows = [("r1", 0, "/a.txt", "Test content", None),
            ("r2", 0, "/b", None, ("FileNotFound", "/b", "File not found: /b"))]
    d = spark.createDataFrame(rows, "run_id string, ord int, path string, text string, "
                                    "error struct<kind:string,path:string,message:string>")
    got = {r.run_id: r for r in publish_file(d, os.path.join(tmpdir_fresh, "p")).collect()}
    assert got["r1"].n_bytes == 12 and got["r2"].error.kind == "FileNotFound"
    assert [r.payload for r in read_payload(spark, os.path.join(tmpdir_fresh, "p")).collect()] == ["Test content"]


def test_run_job_lenient_routes(spark, tmpdir_fresh):
    from textbarge.plans.job import JobInputs, run_job
    root = tmpdir_fresh
    t = _write(root, "latin.txt", bytes.fromhex("636166E9"))
    m = spark.createDataFrame(
        [("a", 0, t, None, None), ("b", 0, "https://example.com/x.txt", None, None),
         ("c", 0, os.path.join(root, "nope.txt"), None, None), ("d", 0, "/docs/x.pdf", None, None),
         ("e", 0, "/img/y.png", None, None), ("f", 0, "file://" + t, None, "text/plain")],
        "run_id string, ord int, path string, inline_text string, declared_type string")
    local = with_lookup_path(m, "lenient").where(~F.col("path").isin("/docs/x.pdf", "/img/y.png"))
    inv = probe_inventory(local).unionByName(spark.createDataFrame(
        [("/docs/x.pdf", True, False, True, True, 100), ("/img/y.png", True, False, True, True, 100)],
        "path string, exists boolean, is_dir boolean, link_target_exists boolean, readable boolean, length bigint"),
        allowMissingColumns=True)
    inp = JobInputs(
        manifest=m, inventory=inv, files=scan_files(spark, root),
        pdf_facts=spark.createDataFrame([("/docs/x.pdf", None, False, 2)],
                                        "path string, open_error string, locked boolean, page_count int"),
        pdf_pages=spark.createDataFrame([("/docs/x.pdf", 0, "p1", None), ("/docs/x.pdf", 1, "p2", None)],
                                        "path string, page_idx int, embedded string, error string"),
        ocr_pages=spark.createDataFrame([("/img/y.png", 0, ["Hello, World!"], None, 5, None, None)],
                                        "path string, page_idx int, lines array<string>, error string, "
                                        "elapsed_ms bigint, width_pt double, height_pt double"),
        image_facts=spark.createDataFrame([("/img/y.png", None, 100, 100)],
                                          "path string, open_error string, width_px int, height_px int"))
    _, pay = run_job(inp, "lenient", "single")
    got = {r.run_id: r for r in pay.collect()}
    assert got["a"].payload == "café"
    assert got["b"].summary == "Not a local file"
    assert got["c"].summary == "File not found: nope.txt"
    assert got["d"].payload == "p1\np2"
    assert got["e"].payload == "Hello, World!"
    assert got["f"].payload == "café"


def test_run_job_strict_without_ocr(spark):
    from textbarge.plans.job import JobInputs, run_job
    m = spark.createDataFrame([("a", 0, "/img/y.png", None, None)],
                              "run_id string, ord int, path string, inline_text string, declared_type string")
    inv = spark.createDataFrame([("/img/y.png", True, False, True, True, 100)],
                                "path string, exists boolean, is_dir boolean, link_target_exists boolean, "
                                "readable boolean, length bigint")
    _, pay = run_job(JobInputs(manifest=m, inventory=inv), "strict", "fail_fast", ocr_available=False)
    r = pay.first()
    assert r.error.message == "Failed to extract text from '/img/y.png': OCR is only supported on macOS"


def test_latest_across_micro_batches(spark, tmpdir_fresh):
    from textbarge.streaming.ingest import read_latest, start_latest
    src = os.path.join(tmpdir_fresh, "src")
    schema = "run_id string, ord long, text string, error struct<kind:string,path:string,message:string>"
    spark.createDataFrame([("a", 1, "a1", None), ("b", 1, "b1", None)], schema).coalesce(1) \
        .write.parquet(os.path.join(src, "p1"))
    spark.createDataFrame([("a", 2, "a2", None), ("a", 3, None, ("BinaryFile", "x", "m"))], schema).coalesce(1) \
        .write.parquet(os.path.join(src, "p2"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out, ck = os.path.join(tmpdir_fresh, "out"), os.path.join(tmpdir_fresh, "ck")
    start_latest(stream, "run_id", "ord", out, ck).awaitTermination()
    got = {r.run_id: (r.payload, r.ord, r.n_ok) for r in read_latest(spark, out, "run_id").collect()}
    assert got == {"a": ("a2", 2, 2), "b": ("b1", 1, 1)}
    assert len(os.listdir(out)) >= 2   # more than one micro-batch ran


def test_publish_is_atomic_for_readers(spark, tmpdir_fresh):
    """A half-finished publish (version written, pointer not switched) leaves the old payload readable."""
    t = os.path.join(tmpdir_fresh, "payload")
    schema = ("run_id string, payload string, n_bytes bigint, n_files bigint, summary string, "
              "error struct<kind:string,path:string,message:string>")
    a = spark.createDataFrame([("r", "old", 3, 1, "s", None)], schema)
    publish(a, t)
    a.withColumn("payload", F.lit("orphan")).write.parquet(os.path.join(t, "version=unfinished"))
    assert [r.payload for r in read_payload(spark, t).collect()] == ["old"]
    publish(a.withColumn("payload", F.lit("new")), t)
    assert [r.payload for r in read_payload(spark, t).collect()] == ["new"]


def test_run_job_file_over_engine_limit_is_an_error(spark):
    """A file the binaryFile reader cannot hold becomes a typed error, not a failed job."""
    from textbarge.plans.job import JobInputs, run_job
    m = spark.createDataFrame([("a", 0, "/big.log", None, None), ("a", 1, "/small.txt", None, None)],
                              "run_id string, ord int, path string, inline_text string, declared_type string")
    inv = spark.createDataFrame([("/big.log", True, False, True, True, 3 * 1024 ** 3),
                                 ("/small.txt", True, False, True, True, 2)],
                                "path string, exists boolean, is_dir boolean, link_target_exists boolean, "
                                "readable boolean, length bigint")
    files = spark.createDataFrame([("/small.txt", bytearray(b"hi"))], "path string, content binary")
    dec, pay = run_job(JobInputs(manifest=m, inventory=inv, files=files), "strict", "fail_fast")
    got = {r.path: r for r in dec.collect()}
    assert got["/big.log"].error.message == "Failed to read file '/big.log': file larger than the engine's 2 GiB limit"
    assert got["/small.txt"].text == "hi"
    assert pay.first().error.kind == "IoError"


def test_probe_symlinks(spark, tmpdir_fresh):
    """S4/P4 on a real file system: a valid link reads its target, a dangling one is not found."""
    root = tmpdir_fresh
    target = _write(root, "t.txt", b"linked")
    good = os.path.join(root, "good.txt")
    bad = os.path.join(root, "bad.txt")
    os.symlink(target, good)
    os.symlink(os.path.join(root, "gone.txt"), bad)
    m = with_lookup_path(manifest_from_paths(spark, "r", [good, bad]))
    inv = probe_inventory(m)
    x = attach_decoded(m.join(inv.withColumnRenamed("path", "lookup_path"), "lookup_path", "left"),
                       scan_files(spark, root), "strict")
    got = {r.ord: r for r in x.select("ord", "text", validation_error("strict").alias("s"),
                                      validation_error("lenient").alias("l")).collect()}
    assert got[0].text == "linked" and got[0].s is None and got[0].l is None
    assert got[1].s.kind == "FileNotFound" and got[1].l.kind == "fileNotFound"


def test_lenient_size_gate_reads_the_link_itself(spark, tmpdir_fresh):
    """P6 (lenient) looks at the directory entry: a small link to a large file passes the gate."""
    from textbarge.profiles import LENIENT
    root = tmpdir_fresh
    big = _write(root, "big.txt", b"x" * 2000)
    link = os.path.join(root, "link.txt")
    os.symlink(big, link)
    m = with_lookup_path(manifest_from_paths(spark, "r", [big, link]))
    inv = probe_inventory(m).withColumnRenamed("path", "lookup_path")
    x = m.join(inv, "lookup_path", "left")
    prof = LENIENT.with_(max_file_bytes=1000)
    got = {r.ord: r.e for r in x.select("ord", validation_error(prof, size="entry_length").alias("e")).collect()}
    assert got[0].kind == "fileTooLarge" and got[1] is None


def test_materialize_and_read_bytes(spark, tmpdir_fresh):
    from textbarge.sources.files import materialize_files, read_bytes
    df = spark.createDataFrame([("x/a.txt", bytearray(b"alpha")), ("y/z/b.txt", bytearray(b"")),
                                ("c.txt", bytearray(b"\x00\x01"))], "relpath string, content binary")
    assert materialize_files(df, tmpdir_fresh) == 3
    paths = spark.createDataFrame([(os.path.join(tmpdir_fresh, "x/a.txt"),), (os.path.join(tmpdir_fresh, "y/z/b.txt"),),
                                   (os.path.join(tmpdir_fresh, "nope.txt"),)], "path string")
    got = {os.path.basename(r.path): r.content for r in read_bytes(paths).collect()}
    assert bytes(got["a.txt"]) == b"alpha" and bytes(got["b.txt"]) == b"" and got["nope.txt"] is None


def test_no_exchange_carries_bytes(spark, tmpdir_fresh):
    """The text route decodes where it reads: bytes cross no exchange, with or without broadcasts, and are scanned once."""
    a = _write(tmpdir_fresh, "a.txt", b"Hello")
    m = with_lookup_path(manifest_from_paths(spark, "r", [a, a]))
    inv = probe_inventory(m).withColumnRenamed("path", "lookup_path")
    for threshold in ("-1", "10485760"):
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            x = attach_decoded(m.join(inv, "lookup_path", "left"), scan_files(spark, tmpdir_fresh, max_bytes=1 << 30), "strict")
            plan = x._jdf.queryExecution().sparkPlan().toString()
            assert [r.text for r in x.collect()] == ["Hello", "Hello"]
            executed = x._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert sum("binaryFile" in line and "content" in line for line in plan.splitlines()) == 1
        # Below every exchange the bytes are gone: only a projection to text stands over the scan.
        assert not any("Exchange" in line and "content" in line for line in executed.splitlines())


def test_python_readers_hand_on_bounded_frames(spark, tmpdir_fresh, monkeypatch):
    from textbarge.sources import extraction, files
    paths = [_write(tmpdir_fresh, f"{i}.bin", bytes([i]) * 400) for i in range(10)]
    monkeypatch.setattr(files, "FRAME_BYTES", 1000)
    frames = list(files._read_batches([pd.DataFrame({"path": paths})]))
    assert sum(map(len, frames)) == 10 and len(frames) > 3 and all(len(f) <= 3 for f in frames)
    b = pd.DataFrame({"path": paths, "content": [b"x" * 400] * 9 + [b"y" * 5000]})
    frames = list(extraction._frames([b], 1000))
    assert [len(f) for f in frames] == [2, 2, 2, 2, 1, 1] and sum(map(len, frames)) == 10


def test_extractor_may_give_an_iterator(spark):
    def ex(b):
        for p, c in zip(b["path"], b["content"]):
            yield pd.DataFrame({"path": [p], "page_idx": [0], "embedded": [bytes(c).decode()]})
    f = spark.createDataFrame([("/a", bytearray(b"hi")), ("/b", bytearray(b"ho"))], "path string, content binary")
    assert sorted(r.embedded for r in run_extractor(f, ex, max_bytes=1).collect()) == ["hi", "ho"]


def test_shared_folder_is_required_on_a_cluster():
    import pytest
    from textbarge.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_strict_paths_are_plain_and_lenient_ones_urls(spark, tmpdir_fresh):
    a = _write(tmpdir_fresh, "My Doc+1.txt", b"x")
    url = "file://" + a.replace(" ", "%20")
    rows = [("r", i, p, None, None) for i, p in enumerate(["notes:2024.txt", url, a, "hdfs://nn/data/x.txt", "file:///a%zz"])]
    m = spark.createDataFrame(rows, "run_id string, ord int, path string, inline_text string, declared_type string")
    from textbarge.profiles import LENIENT
    look = lambda p: [r.lookup_path for r in with_lookup_path(m, p).orderBy("ord").collect()]
    assert look("strict") == ["notes:2024.txt", url, a, "hdfs://nn/data/x.txt", "file:///a%zz"]
    assert look("lenient") == [None, a, a, None, "/a%zz"]
    assert look(LENIENT.with_(accepted_schemes=("hdfs",)))[3] == "hdfs://nn/data/x.txt"


def test_latest_survives_compaction(spark, tmpdir_fresh):
    from textbarge.streaming.ingest import compact_latest, read_latest, start_latest
    schema = "run_id string, ord long, text string, error struct<kind:string,path:string,message:string>"
    src, out, ck = (os.path.join(tmpdir_fresh, x) for x in ("src", "out", "ck"))
    for n, rows in enumerate([[("a", 2, "a2", None), ("b", 1, "b1", None)], [("a", 1, "a1", None)], [("a", 3, "a3", None), ("c", 1, "c1", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"p{n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        start_latest(stream, "run_id", "ord", out, ck).awaitTermination()
        compact_latest(spark, out, "run_id")
        assert not [f for f in os.listdir(out) if f.startswith("batch=")]
        got = {r.run_id: (r.payload, r.ord, r.n_ok) for r in read_latest(spark, out, "run_id").collect()}
    assert got == {"a": ("a3", 3, 3), "b": ("b1", 1, 1), "c": ("c1", 1, 1)}


def test_drop_folder_reports_empty_files_once(spark, tmpdir_fresh):
    from textbarge.streaming.ingest import start_drop_folder
    root, out, bad, ck = (os.path.join(tmpdir_fresh, x) for x in ("drop", "out", "bad", "ck"))
    _write(root, "empty.txt", b"")
    for n in range(2):
        _write(root, f"t{n}.txt", b"text %d" % n)
        start_drop_folder(spark, root, "lenient", out, bad, ck).awaitTermination()
    assert sorted(r.payload for r in spark.read.parquet(out).collect()) == ["text 0", "text 1"]
    assert [r.error.message for r in spark.read.parquet(bad).collect()] == ["File is empty"]


def test_drop_folder_takes_every_name_and_later_writes(spark, tmpdir_fresh):
    """Names the file source hides, sub-folders, files moved in with an old date, files written again; a restart repeats nothing."""
    from textbarge.streaming.ingest import start_drop_folder
    root, out, bad, ck = (os.path.join(tmpdir_fresh, x) for x in ("drop", "out", "bad", "ck"))

    def run():
        start_drop_folder(spark, root, "lenient", out, bad, ck, glob="*.txt").awaitTermination()
        return sorted((os.path.relpath(r.path, root), r.payload) for r in spark.read.parquet(out).collect())

    for name in ("_a.txt", ".b.txt", "sub/c.txt", "sub/deep/_er/d.txt", "e.dat"):
        _write(root, name, name.encode())
    first = [(n, n) for n in (".b.txt", "_a.txt", "sub/c.txt", "sub/deep/_er/d.txt")]
    assert run() == first
    assert run() == first
    _write(root, "_a.txt", b"again")
    old = _write(tmpdir_fresh, "old.txt", b"old")
    os.utime(old, (1, 1))
    os.rename(old, os.path.join(root, "sub", "old.txt"))
    assert run() == sorted([*first, ("_a.txt", "again"), ("sub/old.txt", "old")])


def test_drop_folder_shares_cover_a_folder_once(tmpdir_fresh):
    """Whatever the number of shares: every file of the interval once, none outside it, no folder missing."""
    from textbarge.sources.drop_folder import Reader
    names = [f"{d}f{i}.txt" for d in ("", "x/", "x/y/", "z/") for i in range(30)]
    for n in names:
        _write(tmpdir_fresh, n, b"")
    for parts in (1, 3, 8):
        r = Reader({"path": tmpdir_fresh, "parts": str(parts), "settle": "0.1"})
        end = r.latestOffset()
        got = [p for share in r.partitions(r.initialOffset(), end) for b in r.read(share) for p in b.column(0).to_pylist()]
        assert sorted(got) == sorted(os.path.join(tmpdir_fresh, n) for n in names)
        assert not [b for share in r.partitions(end, r.latestOffset()) for b in r.read(share)]
    assert Reader({"path": os.path.join(tmpdir_fresh, "none")}).partitions({"until": 0}, {"until": 1})


def test_old_versions_are_removed(spark, tmpdir_fresh):
    t = os.path.join(tmpdir_fresh, "payload")
    a = spark.createDataFrame([("r", 0, "v", 1, 1, "s", None)], "run_id string, seg bigint, payload string, n_bytes bigint, n_files bigint, "
                              "summary string, error struct<kind:string,path:string,message:string>")
    for i in range(4):
        publish(a.withColumn("payload", F.lit(f"v{i}")), t)
    assert sum(f.startswith("version=") for f in os.listdir(t)) == 2
    assert [r.payload for r in read_payload(spark, t).collect()] == ["v3"]


def test_recognizer_goes_by_the_name(spark):
    """Declared image/* named .pdf is recognized as PDF pages; a declared PDF named .png as an image."""
    from textbarge.plans.job import JobInputs, run_job
    paths = ["/d/x.pdf", "/d/y.png"]
    m = spark.createDataFrame([(p, 0, p, None, t) for p, t in zip(paths, ["image/png", "application/pdf"])],
                              "run_id string, ord int, path string, inline_text string, declared_type string")
    inv = spark.createDataFrame([(p, True, False, True, True, 10) for p in paths],
                                "path string, exists boolean, is_dir boolean, link_target_exists boolean, readable boolean, length bigint")
    pages = [(p, i, [f"{p} {i}"], None, 5, None, None) for p in paths for i in range(2)]
    inp = JobInputs(
        manifest=m, inventory=inv,
        pdf_facts=spark.createDataFrame([(p, None, False, 2) for p in paths], "path string, open_error string, locked boolean, page_count int"),
        pdf_pages=spark.createDataFrame([(p, i, "", None) for p in paths for i in range(2)], "path string, page_idx int, embedded string, error string"),
        ocr_pages=spark.createDataFrame(pages, "path string, page_idx int, lines array<string>, error string, elapsed_ms bigint, width_pt double, height_pt double"),
        image_facts=spark.createDataFrame([(p, None, 10, 10) for p in paths], "path string, open_error string, width_px int, height_px int"),
        runs=spark.createDataFrame([("none",)], "run_id string"))
    got = {r.run_id: (r.payload, r.error and r.error.message) for r in run_job(inp, "lenient", "single")[1].collect()}
    assert got["/d/x.pdf"][0] == "/d/x.pdf 0\n\n══════════ Page 2 ══════════\n\n/d/x.pdf 1"
    assert got["/d/y.png"] == ("/d/y.png 0", None)
    assert got["none"][1] == "No file selected"
