"""Both decode cascades on random byte strings against a plain-Python model of the rules."""

import random

from textbarge.operators.decode import decode_text

SNIFF = 8192


def _try(b, codec):
    try:
        return b.decode(codec)
    except UnicodeDecodeError:
        return None


def model_strict(b):
    if 0 in b[:SNIFF]:
        return None, "binary"
    t = _try(b, "utf-8")
    return (t, "utf-8") if t is not None else (None, "invalid-utf-8")


def model_lenient(b):
    if len(b) == 0:
        return "", "utf-8"
    if len(b) >= 2:
        if len(b) >= 4 and b[:4] == b"\xff\xfe\x00\x00" and _try(b[4:], "utf-32-le") is not None and len(b) % 4 == 0:
            return _try(b[4:], "utf-32-le"), "utf-32le"
        if len(b) >= 4 and b[:4] == b"\x00\x00\xfe\xff" and _try(b[4:], "utf-32-be") is not None and len(b) % 4 == 0:
            return _try(b[4:], "utf-32-be"), "utf-32be"
        if b[:2] == b"\xff\xfe" and _try(b, "utf-16-le") is not None:
            return _try(b[2:], "utf-16-le"), "utf-16le"
        if b[:2] == b"\xfe\xff" and _try(b, "utf-16-be") is not None:
            return _try(b[2:], "utf-16-be"), "utf-16be"
    if 0 in b[:SNIFF]:
        for codec, label in (("utf-16-le", "utf-16le"), ("utf-16-be", "utf-16be")):
            t = _try(b, codec)
            if t is not None:
                return t, label
        return None, "binary"
    t = _try(b, "utf-8")
    if t is not None:
        return t, "utf-8"
    return b.decode("latin-1"), "iso-8859-1"


PIECES = [b"\x00", b"\xff\xfe", b"\xfe\xff", b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff", b"A", b"hi", b"\xe9",
          b"\xc3\xa9", b"\x00\xd8", b"\xd8\x00", b"\x00\xdc", b"\xdc\x00", b"\x3d\xd8\x00\xde", b"\xed\xa0\x80",
          b"\xf0\x9f\x98\x80", b"\n", b" ", b"\x00A", b"A\x00", b"\x10\x00", b"\x11\x00"]


def _samples(seed, n):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        b = b"".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 8)))
        if rnd.random() < 0.05:
            b = b"A" * rnd.choice([8190, 8191, 8192]) + b
        out.append(b)
    return out


def test_cascades_match_model(spark):
    samples = _samples(3, 800)
    df = spark.createDataFrame([(str(i), bytearray(b)) for i, b in enumerate(samples)], "path string, content binary")
    s = {r.path: (r.text, r.encoding) for r in decode_text(df, "strict").collect()}
    le = {r.path: (r.text, r.encoding) for r in decode_text(df, "lenient").collect()}
    for i, b in enumerate(samples):
        assert s[str(i)] == model_strict(b), (b.hex(), s[str(i)])
        assert le[str(i)] == model_lenient(b), (b.hex(), le[str(i)])
