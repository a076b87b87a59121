"""Decode operator (S5, D1-D10): bytes column -> text, encoding, typed error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.decode import decode_bytes
from ..functions.errors import IO_INVALID_UTF8, lenient_error, null_error, strict_error
from ..profiles import Profile, get_profile


def decode_error(decoded: Column, profile: Profile | str, path: str = "path") -> Column:
    p = get_profile(profile)
    enc = decoded.getField("encoding")
    if p.name == "strict":
        return (F.when(enc == "binary", strict_error("BinaryFile", path))
                .when(enc == "invalid-utf-8", strict_error("IoError", path, F.lit(IO_INVALID_UTF8)))
                .otherwise(null_error()))
    return F.when(enc == "binary", lenient_error("binaryFile", path)).otherwise(null_error())


def decode_text(df: DataFrame, profile: Profile | str, content: str = "content",
                path: str = "path", drop_content: bool = True) -> DataFrame:
    """Adds ``text``, ``encoding`` and ``error``; drops the bytes so they never reach a shuffle."""
    d = decode_bytes(F.col(content), profile)
    out = (df.withColumn("_d", d)
           .withColumn("text", F.col("_d.text"))
           .withColumn("encoding", F.col("_d.encoding"))
           .withColumn("error", decode_error(F.col("_d"), profile, path))
           .drop("_d"))
    return out.drop(content) if drop_content else out
