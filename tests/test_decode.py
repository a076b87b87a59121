"""Byte fixtures of the source tool, both profiles (FIXTURES.md, text route)."""

import pytest
from pyspark.sql import functions as F

from textbarge.operators.decode import decode_text

CASES = [
    # name, bytes, strict (text or error kind), lenient (text or error kind, encoding)
    ("test.txt", b"Hello, world!\nThis is a test file.", "Hello, world!\nThis is a test file.",
     ("Hello, world!\nThis is a test file.", "utf-8")),
    ("empty.txt", b"", "", ("", "utf-8")),
    ("unicode.txt", "Hello \U0001F600 emoji and 中文 chinese!".encode(),
     "Hello \U0001F600 emoji and 中文 chinese!", ("Hello \U0001F600 emoji and 中文 chinese!", "utf-8")),
    ("binary.bin", bytes.fromhex("48656C006F"), "E:BinaryFile", ("E:binaryFile", "binary")),
    ("quad.bin", bytes.fromhex("00010203"), "E:BinaryFile", ("Ā̂", "utf-16le")),
    ("three.bin", bytes.fromhex("000102"), "E:BinaryFile", ("E:binaryFile", "binary")),
    ("large.txt", b"A" * 10000, "A" * 10000, ("A" * 10000, "utf-8")),
    ("late_null.bin", b"A" * 4000 + b"\x00" + b"A" * 999, "E:BinaryFile", (None, "utf-16le")),
    ("edge_8191", b"A" * 8191 + b"\x00" + b"A" * 808, "E:BinaryFile", (None, "utf-16le")),
    ("edge_8192", b"A" * 8192 + b"\x00" + b"A" * 807, "A" * 8192 + "\x00" + "A" * 807,
     ("A" * 8192 + "\x00" + "A" * 807, "utf-8")),
    ("latin1.txt", bytes.fromhex("636166E9"), "E:IoError", ("café", "iso-8859-1")),
    ("utf16le.txt", bytes.fromhex("FFFE68006900"), "E:BinaryFile", ("hi", "utf-16le")),
    ("utf16be.txt", bytes.fromhex("FEFF00680069"), "E:BinaryFile", ("hi", "utf-16be")),
    ("utf32le.txt", bytes.fromhex("FFFE000068000000"), "E:BinaryFile", ("h", "utf-32le")),
    ("utf32be.txt", bytes.fromhex("0000FEFF00000068"), "E:BinaryFile", ("h", "utf-32be")),
    ("surrogate.bin", bytes.fromhex("00D84100"), "E:BinaryFile", ("Ø䄀", "utf-16be")),
    ("bom8.txt", b"\xef\xbb\xbfhi", "﻿hi", ("﻿hi", "utf-8")),
]


@pytest.fixture(scope="module")
def decoded(spark):
    rows = [(n, bytearray(b)) for n, b, _, _ in CASES]
    df = spark.createDataFrame(rows, "path string, content binary")
    s = {r.path: r for r in decode_text(df, "strict").collect()}
    le = {r.path: r for r in decode_text(df, "lenient").collect()}
    return s, le


@pytest.mark.parametrize("name,raw,strict,lenient", CASES, ids=[c[0] for c in CASES])
def test_fixture(decoded, name, raw, strict, lenient):
    s, le = decoded
    if strict.startswith("E:"):
        assert s[name].text is None and s[name].error.kind == strict[2:]
    else:
        assert s[name].error is None and s[name].text == strict
    text, enc = lenient
    assert le[name].encoding == enc
    if text is not None and text.startswith("E:"):
        assert le[name].error.kind == text[2:] and le[name].text is None
    elif text is not None:
        assert le[name].error is None and le[name].text == text
    else:
        assert le[name].error is None
        assert le[name].text == raw.decode("utf-16-le")


def test_error_texts(decoded):
    s, le = decoded
    assert s["binary.bin"].error.message == "Cannot read binary file: binary.bin"
    assert s["latin1.txt"].error.message == "Failed to read file 'latin1.txt': stream did not contain valid UTF-8"
    assert le["binary.bin"].error.message == "Binary file: binary.bin"


def test_random_utf16_validity_matches_python(spark):
    """U16 validity expressions against Python's strict codec on surrogate-heavy inputs."""
    import random
    from textbarge.functions.decode import utf16_ok
    rnd = random.Random(7)
    units = [0xD800, 0xDBFF, 0xDC00, 0xDFFF, 0x0041, 0x00E9, 0xD83D, 0xDE00, 0x4100]
    rows = []
    for i in range(400):
        u = [rnd.choice(units) for _ in range(rnd.randint(0, 6))]
        le = b"".join(x.to_bytes(2, "little") for x in u)
        if rnd.random() < 0.1:
            le += b"\x41"
        rows.append((i, bytearray(le)))
    df = spark.createDataFrame(rows, "i int, c binary")
    got = {r.i: (r.le, r.be) for r in df.select("i", utf16_ok("c", True).alias("le"),
                                                 utf16_ok("c", False).alias("be")).collect()}

    def ok(b, codec):
        try:
            b.decode(codec)
            return True
        except UnicodeDecodeError:
            return False

    for i, c in rows:
        assert got[i] == (ok(bytes(c), "utf-16-le"), ok(bytes(c), "utf-16-be")), (i, bytes(c).hex())


def test_lossy(spark):
    from textbarge.functions.decode import lossy_utf8
    df = spark.createDataFrame([(bytearray(b"ab\xff"),)], "c binary")
    assert df.select(lossy_utf8(F.col("c")).alias("t")).first().t == "ab�"


def test_random_utf32_validity_matches_python(spark):
    import random
    from textbarge.functions.decode import utf32_ok
    rnd = random.Random(5)
    vals = [0x41, 0xE9, 0xD800, 0xDFFF, 0x10FFFF, 0x110000, 0x1F600, 0xFFFFFFFF, 0x0A, 0x00, 0xDC00, 0x10000]
    rows = []
    for i in range(300):
        v = [rnd.choice(vals) for _ in range(rnd.randint(0, 5))]
        le = b"".join(x.to_bytes(4, "little") for x in v)
        if rnd.random() < 0.1:
            le += b"\x41"
        rows.append((i, bytearray(le), bytearray(b"".join(x.to_bytes(4, "big") for x in v))))
    df = spark.createDataFrame(rows, "i int, le binary, be binary")
    got = {r.i: (r.a, r.b) for r in df.select("i", utf32_ok("le", True).alias("a"),
                                               utf32_ok("be", False).alias("b")).collect()}

    def ok(b, codec):
        try:
            b.decode(codec)
            return True
        except UnicodeDecodeError:
            return False

    for i, le, be in rows:
        assert got[i] == (ok(bytes(le), "utf-32-le"), ok(bytes(be), "utf-32-be")), (i, bytes(le).hex())


def test_utf32_surrogates_beside_question_marks(spark):
    """A surrogate unit is refused, alone, paired, beside real question marks, late in a long text."""
    import struct

    def units(order, *points):
        return struct.pack(f"{order}{len(points)}I", *points)

    pad = [0x3F] + [0x61] * 5000
    cases = [([0x3F], True), ([0xD800], False), ([0x3F, 0xDFFF], False), ([0xD83D, 0xDE00], False), (pad + [0xDC00], False),
             (pad, True), ([0x1F600, 0x3F, 0xFFFD], True), ([0x110000], False), ([0xD7FF, 0xE000, 0x3F], True)]
    rows = [(i, n, bytearray((b"\xff\xfe\x00\x00" if o == "<" else b"\x00\x00\xfe\xff") + units(o, *pts)))
            for i, (pts, _) in enumerate(cases) for n, o in ((0, "<"), (1, ">"))]
    df = spark.createDataFrame(rows, "i int, n int, c binary").withColumn("path", F.lit("f"))
    for r in decode_text(df, "lenient", content="c").collect():
        pts, good = cases[r.i]
        assert (r.encoding == ("utf-32le", "utf-32be")[r.n]) == good, (r.i, r.n, r.encoding)
        if good:
            assert r.text == "".join(map(chr, pts))
