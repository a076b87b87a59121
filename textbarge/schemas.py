"""Explicit schemas for every table the engine reads or writes (never inferred)."""

from pyspark.sql import types as T

ERROR = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("message", T.StringType()),
])

MANIFEST = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("path", T.StringType()),
    T.StructField("inline_text", T.StringType()),
    T.StructField("declared_type", T.StringType()),
])

INVENTORY = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("exists", T.BooleanType()),
    T.StructField("is_dir", T.BooleanType()),
    T.StructField("link_target_exists", T.BooleanType()),
    T.StructField("readable", T.BooleanType()),
    T.StructField("length", T.LongType()),
])

FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

DOC_FACTS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("open_error", T.StringType()),
    T.StructField("locked", T.BooleanType()),
    T.StructField("page_count", T.IntegerType()),
    T.StructField("width_px", T.IntegerType()),
    T.StructField("height_px", T.IntegerType()),
])

PAGE_RESULTS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("page_idx", T.IntegerType()),
    T.StructField("embedded", T.StringType()),
    T.StructField("lines", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
    T.StructField("elapsed_ms", T.LongType()),
    T.StructField("width_pt", T.DoubleType()),
    T.StructField("height_pt", T.DoubleType()),
])

EXTRACTION_RESULTS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("error", T.StringType()),
])

DECODED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("route", T.StringType()),
    T.StructField("encoding", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("error", ERROR),
])

PAYLOAD = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("seg", T.LongType()),
    T.StructField("payload", T.StringType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_files", T.LongType()),
    T.StructField("summary", T.StringType()),
    T.StructField("error", ERROR),
])
