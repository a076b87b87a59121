"""Manifest source (S1, S3): the ordered list of inputs of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.route import lookup_path
from ..profiles import Profile


def read_manifest(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A manifest table with the explicit schema (never inferred)."""
    return spark.read.schema(schemas.MANIFEST).format(fmt).load(path)


def manifest_from_paths(spark: SparkSession, run_id: str, paths: list[str]) -> DataFrame:
    """S1 for one small argument list: order kept with ``posexplode``; duplicates kept."""
    df = spark.createDataFrame([(run_id, paths)], "run_id string, paths array<string>")
    return df.select("run_id", F.posexplode("paths").alias("ord", "path")).select(
        "run_id", F.col("ord").cast("int"), "path",
        F.lit(None).cast("string").alias("inline_text"), F.lit(None).cast("string").alias("declared_type"))


def with_lookup_path(manifest: DataFrame, profile: Profile | str = "strict") -> DataFrame:
    """Adds ``is_inline`` ('-' entries) and ``lookup_path`` (see ``functions.route.lookup_path``)."""
    inline = F.col("path") == "-"
    return (manifest.withColumn("is_inline", inline)
            .withColumn("lookup_path", F.when(~inline, lookup_path("path", profile))))


def split_inline(manifest: DataFrame, profile: Profile | str = "strict") -> tuple[DataFrame, DataFrame]:
    """S3: inline ('-') rows bypass routing and the NUL check; the rest are files."""
    m = with_lookup_path(manifest, profile)
    return m.where(F.col("is_inline")), m.where(~F.col("is_inline"))
