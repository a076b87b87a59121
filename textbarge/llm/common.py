"""Helpers shared by the operators: reading tables, cutting lineage, batches of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import fresh_dir, ship_package

#: Bytes of text that a Python task works on at a time (a longer single text is taken whole).
TEXT_BYTES = 4 << 20
#: Rows in an Arrow batch at most: rows carry whole texts, and each batch is held by the JVM and by Python.
BATCH_ROWS, _BATCH_ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spool(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read back: lineage is
    cut in storage that every executor sees, and later readers prune columns. A reader holds
    some thousand rows of a file at a time: ``file_rows`` bounds the rows of a file, if they are large."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ready(df: DataFrame) -> SparkSession:
    """The session, with this package importable by the Python workers and Arrow batches of at most BATCH_ROWS rows."""
    spark = df.sparkSession
    ship_package(spark)
    if not 0 < int(spark.conf.get(_BATCH_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_ROWS, BATCH_ROWS)
    return spark


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, whatever other columns are called."""
    return df[f"`{name}`"]


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Just these columns, under the operator's own names: no other column can clash."""
    return df.select(*[(column(df, c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def own_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def texts(values: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b or b"" for b in values.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def bounded(items: list[bytes], most: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of ``items`` of at most ``most`` bytes together, one item at least."""
    a, held = 0, 0
    for i, item in enumerate(items):
        if i > a and held + len(item) > most:
            yield a, i
            a, held = i, 0
        held += len(item)
    if a < len(items):
        yield a, len(items)


def starts_of(lengths) -> np.ndarray:
    """Exclusive prefix sums, with the total at the end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def rows_sum(table: np.ndarray, starts: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sums of ``table``'s rows between consecutive starts (empty ranges give zeros)."""
    n = len(starts) - 1
    out = np.zeros((n, *table.shape[1:]), dtype)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.add.reduceat(table, starts[:-1][full], axis=0, dtype=dtype)
    return out


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, mod ``modulus``, equals ``remainder`` (a null id is never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
