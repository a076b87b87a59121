"""Reading the driver tables, and the shared rules that turn them into engine inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_path(ext: str = "txt") -> Column:
    """Rule shared with the SQL oracle: '/data/<source>/<doc_id>.<ext>'."""
    return F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
                    F.lit("." + ext))


def conv_path() -> Column:
    """Rule shared with the SQL oracle: '/conv/<conv_id>.pdf'."""
    return F.concat(F.lit("/conv/"), F.col("conv_id").cast("string"), F.lit(".pdf"))
