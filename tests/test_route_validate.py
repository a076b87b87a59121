"""Routing (R1-R7), local-file check (P1), validation order (P2-P6), error texts."""

import pytest
from pyspark.sql import functions as F

from textbarge.functions.errors import lenient_error, strict_error
from textbarge.functions.route import extension, is_local, route, scheme
from textbarge.functions.text import basename, is_blank, last_line_message, notification, utrim
from textbarge.operators.validate import validation_error

ROUTES = [
    ("photo.png", "image", "image"), ("photo.JPG", "image", "image"), ("photo.Tiff", "image", "image"),
    ("photo.HEIC", "image", "image"), ("photo.webp", "image", "image"), ("photo.heif", "image", "text"),
    ("document.pdf", "pdf", "pdf"), ("X.PDF", "pdf", "pdf"), ("document.txt", "text", "text"),
    ("script.sh", "text", "text"), ("code.rs", "text", "text"), ("no_extension", "text", "text"),
    (".hidden", "text", "text"), ("../parent/photo.tiff", "image", "image"),
]


@pytest.fixture(scope="module")
def routed(spark):
    df = spark.createDataFrame([(p,) for p, _, _ in ROUTES], "path string")
    return {r.path: r for r in df.select("path", route("path", "strict").alias("s"),
                                         route("path", "lenient").alias("l"),
                                         extension("path").alias("e")).collect()}


@pytest.mark.parametrize("path,strict,lenient", ROUTES, ids=[r[0] for r in ROUTES])
def test_route(routed, path, strict, lenient):
    assert routed[path].s == strict
    assert routed[path].l == lenient


def test_extension_edges(routed):
    assert routed["no_extension"].e is None
    assert routed[".hidden"].e is None
    assert routed["X.PDF"].e == "pdf"


def test_declared_type_first(spark):
    df = spark.createDataFrame([("a.pdf", "text/plain"), ("a.txt", "image/png"), ("a.png", None),
                                ("a.png", "application/octet-stream")], "path string, t string")
    got = [r.r for r in df.select(route("path", "lenient", F.col("t")).alias("r")).collect()]
    assert got == ["text", "image", "image", "image"]
    got = [r.r for r in df.select(route("path", "strict", F.col("t")).alias("r")).collect()]
    assert got == ["pdf", "text", "image", "image"]


def test_local_check(spark):
    df = spark.createDataFrame([("https://example.com/file.txt",), ("/a b/c.txt",), ("file:///x/y",), ("s3://b/k",)],
                               "path string")
    assert [r.l for r in df.select(is_local("path").alias("l")).collect()] == [False, True, True, False]


def inv_row(path, exists=True, is_dir=False, link=True, readable=True, length=10):
    return (path, exists, is_dir, link, readable, length)


def test_validation_order(spark):
    rows = [inv_row("https://example.com/file.txt"), inv_row("/nonexistent/path/to/file.txt", exists=False),
            inv_row("/tmp/dir", is_dir=True), inv_row("/tmp/link", link=False),
            inv_row("/tmp/secret", readable=False), inv_row("/tmp/big", length=50 * 1024 * 1024 + 1),
            inv_row("/tmp/exact", length=50 * 1024 * 1024), inv_row("/tmp/dir_unreadable", is_dir=True, readable=False)]
    df = spark.createDataFrame(rows, "path string, exists boolean, is_dir boolean, link_target_exists boolean, "
                                     "readable boolean, length bigint")
    got = {r.path: r for r in df.select("path", validation_error("lenient").alias("l"),
                                        validation_error("strict").alias("s")).collect()}
    assert got["https://example.com/file.txt"].l.kind == "notFileURL"
    assert got["https://example.com/file.txt"].l.message == "Not a local file: https://example.com/file.txt"
    assert got["/nonexistent/path/to/file.txt"].l.kind == "fileNotFound"
    assert got["/nonexistent/path/to/file.txt"].s.message == "File not found: /nonexistent/path/to/file.txt"
    assert got["/tmp/dir"].l.message == "Cannot copy directory: dir"
    assert got["/tmp/link"].l.kind == "fileNotFound"
    assert got["/tmp/secret"].l.kind == "permissionDenied"
    assert got["/tmp/big"].l.message == "File too large (50MB): big"
    assert got["/tmp/exact"].l is None
    assert got["/tmp/dir_unreadable"].l.kind == "isDirectory"
    assert got["/tmp/dir"].s is None


def test_strict_error_texts(spark):
    df = spark.range(1)
    r = df.select(
        strict_error("FileNotFound", F.lit("/path/to/file.txt")).alias("a"),
        strict_error("PermissionDenied", F.lit("/secret/file.txt")).alias("b"),
        strict_error("BinaryFile", F.lit("image.png")).alias("c"),
        strict_error("ClipboardError", F.lit(""), F.lit("No display available")).alias("d"),
        strict_error("NoFilesSpecified", F.lit("")).alias("e"),
        strict_error("IoError", F.lit("data.txt"), F.lit("disk full")).alias("f"),
        strict_error("ExtractionError", F.lit("document.pdf"), F.lit("Invalid PDF format")).alias("g"),
    ).first()
    assert r.a.message == "File not found: /path/to/file.txt"
    assert r.b.message == "Permission denied: /secret/file.txt"
    assert r.c.message == "Cannot read binary file: image.png"
    assert r.d.message == "Clipboard error: No display available"
    assert r.e.message == "No files specified"
    assert r.f.message == "Failed to read file 'data.txt': disk full"
    assert r.g.message == "Failed to extract text from 'document.pdf': Invalid PDF format"


def test_lenient_error_texts(spark):
    p = F.lit("/test/file.txt")
    r = spark.range(1).select(
        lenient_error("fileTooLarge", p, size=F.lit(100_000_000)).alias("a"),
        lenient_error("outputTooLarge", p, size=F.lit(200_000_000)).alias("b"),
        lenient_error("imageTooLarge", p, width=F.lit(10000), height=F.lit(10000)).alias("c"),
        lenient_error("ocrTimeout", p).alias("d"),
        lenient_error("extractionFailed", p, F.lit("Test error")).alias("e"),
    ).first()
    assert r.a.message == "File too large (95MB): file.txt"
    assert r.b.message == "Output too large (190MB) for clipboard"
    assert r.c.message == "Image too large (100MP): file.txt"
    assert r.d.message == "OCR timed out: file.txt"
    assert r.e.message == "Test error"


def test_text_helpers(spark):
    long = "x" * 120
    r = spark.range(1).select(
        notification(F.lit(long)).alias("n"), notification(F.lit("short")).alias("s"),
        last_line_message(F.lit("Reading file: a\nError: File not found: a")).alias("w"),
        basename(F.lit("/a/b/c.txt")).alias("b"), basename(F.lit("/a/b/")).alias("b2"),
        utrim(F.lit("　  hi \t\n ")).alias("t"),
        is_blank(F.lit(" 　\t")).alias("bl"), is_blank(F.lit(" x ")).alias("nb"),
    ).first()
    assert r.n == "x" * 97 + "..." and r.s == "short"
    assert r.w == "File not found: a"
    assert r.b == "c.txt" and r.b2 == "b"
    assert r.t == "hi" and r.bl is True and r.nb is False


def test_strict_dangling_link_is_not_found(spark):
    df = spark.createDataFrame([inv_row("/tmp/link", link=False)],
                               "path string, exists boolean, is_dir boolean, link_target_exists boolean, "
                               "readable boolean, length bigint")
    r = df.select(validation_error("strict").alias("s"), validation_error("lenient").alias("l")).first()
    assert r.s.kind == "FileNotFound" and r.l.kind == "fileNotFound"


def _model_extension(path: str):
    """The rule, written plainly: last segment (trailing slashes ignored); no extension
    for '..', a leading-dot-only name or a trailing dot; otherwise after the last dot."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if name in ("", "..") or "." not in name:
        return None
    before, after = name.rsplit(".", 1)
    if before == "" or after == "":
        return None
    return after.lower()


def test_extension_matches_model(spark):
    import random
    rnd = random.Random(9)
    parts = ["a", "B", ".", "..", "/", "x.y", "tar.gz", "PDF", "png", " ", "é"]
    paths = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6))) for _ in range(600)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    got = {r.i: r.e for r in df.select("i", extension("p").alias("e")).collect()}
    for i, p in enumerate(paths):
        assert got[i] == _model_extension(p), (p, got[i])


def test_unicode_trim_matches_white_space_set(spark):
    """Exactly the Unicode White_Space set is trimmed; look-alikes stay."""
    import random
    from textbarge.profiles import WHITESPACE_CHARS
    rnd = random.Random(4)
    lookalikes = "\x1c\x1d\x1e\x1f\u180e\u200b\ufeff"
    alphabet = list(WHITESPACE_CHARS) + list(lookalikes) + ["a", "é", "中"]
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 8)))) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, s string")
    got = {r.i: (r.t, r.b) for r in df.select("i", utrim("s").alias("t"), is_blank("s").alias("b")).collect()}
    for i, s in rows:
        want = s.strip(WHITESPACE_CHARS)
        assert got[i] == (want, want == ""), (repr(s), got[i])


def _model_local(p: str):
    import re
    m = re.match(r"^([A-Za-z][A-Za-z0-9+.\-]*):", p)
    sch = m.group(1).lower() if m else ""
    local = sch in ("", "file")
    # The pieces that the test joins hold no escapes; an unescaped "%" does not occur.
    lp = re.sub(r"^[Ff][Ii][Ll][Ee]:(//[^/]*)?", "", p) if local else None
    return sch, local, lp


def test_local_path_rules_match_model(spark):
    import random
    from textbarge.functions.route import to_local_path
    rnd = random.Random(21)
    parts = ["file:", "FILE:", "http:", "s3:", "//", "/", "host", "localhost", "a b", "x.txt", "C:", "1a:", "?q", "#f"]
    paths = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5))) for _ in range(400)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    got = {r.i: (r.s, r.l, r.lp) for r in df.select(
        "i", scheme("p").alias("s"), is_local("p").alias("l"),
        F.when(is_local("p"), to_local_path("p")).alias("lp")).collect()}
    for i, p in enumerate(paths):
        assert got[i] == _model_local(p), (p, got[i])
