"""Byte -> text decoding (P7, D1-D10) as JVM-side column expressions.

Spark's ``decode`` throws on malformed input and has no ``try_`` form of its own;
``try_to_binary`` gives NULL for whatever fails below it, so the UTF-8 bytes of
``decode`` under it are the text, or NULL where the input is malformed: one linear
pass, no second look at the bytes. The UTF-32 charset takes surrogates for code
points, so these are looked for apart, in the files that can hold one. Both agree
with Python's strict codecs on randomized inputs (tests/test_decode.py,
tests/test_decode_model.py).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..profiles import BINARY_SNIFF_BYTES, Profile, get_profile
from .text import col


def _nul() -> Column:
    return F.lit(bytearray(b"\x00"))


def has_nul_in_window(content) -> Column:
    """A NUL byte among the first 8192 bytes (a later NUL does not count)."""
    return F.contains(F.substring(col(content), 1, BINARY_SNIFF_BYTES), _nul())


def _latin1(content) -> Column:
    """Bytes as a string of code points 0-255 (one char per byte; never fails)."""
    return F.decode(col(content), "ISO-8859-1")


def _try_decode(content, charset: str) -> Column:
    """The text, or NULL where the bytes are malformed (an unpaired surrogate, a cut-off unit)."""
    return F.try_to_binary(F.decode(col(content), charset), F.lit("utf-8")).cast("string")


def try_utf16(content, little_endian: bool) -> Column:
    """UTF-16 text without a byte order mark, or NULL: odd length, an unpaired surrogate."""
    return _try_decode(content, "UTF-16LE" if little_endian else "UTF-16BE")


def utf16_ok(content, little_endian: bool) -> Column:
    """Even length and no unpaired surrogate in the given byte order."""
    return try_utf16(content, little_endian).isNotNull()


def _utf32_text(content) -> Column:
    """UTF-32 text behind its byte order mark, which tells the order; surrogates are not refused yet."""
    return _try_decode(content, "UTF-32")


def utf32_ok(content, little_endian: bool) -> Column:
    """Units of four bytes in the given order, each <= U+10FFFF and no surrogate.

    A lone surrogate is decoded to a question mark, and a pair of them to one character, so
    the text must have one character for each unit, and the bytes are searched for a
    surrogate only where it has a question mark. The search visits every unit once.
    """
    c = col(content)
    text = _utf32_text(F.concat(F.unhex(F.lit("FFFE0000" if little_endian else "0000FEFF")), c))
    surrogate = ".[\\x{D8}-\\x{DF}]\\x00\\x00" if little_endian else "\\x00\\x00[\\x{D8}-\\x{DF}]."
    found = _latin1(c).rlike("(?s)^(?:....)*?" + surrogate)
    return F.coalesce((F.octet_length(c) == 4 * F.char_length(text)) & ~(F.contains(text, F.lit("?")) & found), F.lit(False))


def _bom(content, n: int) -> Column:
    return F.hex(F.substring(col(content), 1, n))


def strict_decode(content) -> Column:
    """STRUCT<text, encoding>: NUL in window -> 'binary'; valid UTF-8 (BOM kept) -> text;
    otherwise 'invalid-utf-8' (the tool's IoError)."""
    c = col(content)
    valid = F.try_validate_utf8(c)
    return (F.when(c.isNull(), F.struct(F.lit(None).cast("string").alias("text"),
                                         F.lit(None).cast("string").alias("encoding")))
            .when(has_nul_in_window(c), F.struct(F.lit(None).cast("string").alias("text"),
                                                 F.lit("binary").alias("encoding")))
            .when(valid.isNotNull(), F.struct(valid.alias("text"), F.lit("utf-8").alias("encoding")))
            .otherwise(F.struct(F.lit(None).cast("string").alias("text"),
                                F.lit("invalid-utf-8").alias("encoding"))))


def lenient_decode(content) -> Column:
    """STRUCT<text, encoding> following the desktop library's cascade:
    empty -> UTF-32LE BOM -> UTF-32BE BOM -> UTF-16LE BOM -> UTF-16BE BOM ->
    (NUL in window: UTF-16LE, UTF-16BE, else binary) -> UTF-8 -> ISO-8859-1.
    A BOM whose decode fails falls through. UTF-16/32 BOMs are not kept."""
    c = col(content)
    b2, b4 = _bom(c, 2), _bom(c, 4)
    n = F.octet_length(c)
    nul = has_nul_in_window(c)
    utf8 = F.try_validate_utf8(c)
    body, body32 = F.substring(c, 3, 2147483647), F.substring(c, 5, 2147483647)

    def out(text, enc):
        return F.struct(text.cast("string").alias("text"), F.lit(enc).alias("encoding"))

    return (F.when(c.isNull(), F.struct(F.lit(None).cast("string").alias("text"),
                                         F.lit(None).cast("string").alias("encoding")))
            .when(n == 0, out(F.lit(""), "utf-8"))
            .when((b4 == "FFFE0000") & utf32_ok(body32, True), out(_utf32_text(c), "utf-32le"))
            .when((b4 == "0000FEFF") & utf32_ok(body32, False), out(_utf32_text(c), "utf-32be"))
            .when((b2 == "FFFE") & utf16_ok(body, True), out(try_utf16(body, True), "utf-16le"))
            .when((b2 == "FEFF") & utf16_ok(body, False), out(try_utf16(body, False), "utf-16be"))
            .when(nul & utf16_ok(c, True), out(try_utf16(c, True), "utf-16le"))
            .when(nul & utf16_ok(c, False), out(try_utf16(c, False), "utf-16be"))
            .when(nul, out(F.lit(None), "binary"))
            .when(utf8.isNotNull(), out(utf8, "utf-8"))
            .otherwise(out(F.decode(c, "ISO-8859-1"), "iso-8859-1")))


def decode_bytes(content, profile: Profile | str) -> Column:
    return strict_decode(content) if get_profile(profile).name == "strict" else lenient_decode(content)


def lossy_utf8(content) -> Column:
    """Invalid sequences become U+FFFD (helper output is read lossily)."""
    return F.make_valid_utf8(col(content))
