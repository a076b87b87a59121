"""Sinks (S8-S11, U2): publish payloads, read them back, quarantine errors.

The desktop clipboard is one cell replaced atomically; here a payload table is
published as a new version and a one-line pointer is switched to it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas


POINTER = "_LATEST"


def _write_text(uri: str, text: str) -> None:
    if "://" in uri and not uri.startswith("file:"):
        from pyarrow import fs as pafs
        fs, inner = pafs.FileSystem.from_uri(uri)
        with fs.open_output_stream(inner) as fh:
            fh.write(text.encode())
        return
    from ..session import local_path
    lp = local_path(uri)
    tmp = lp + ".tmp"
    with open(tmp, "w") as fh:
        fh.write(text)
    os.replace(tmp, lp)   # atomic on a POSIX file system


def _read_text(uri: str) -> str | None:
    try:
        if "://" in uri and not uri.startswith("file:"):
            from pyarrow import fs as pafs
            fs, inner = pafs.FileSystem.from_uri(uri)
            with fs.open_input_stream(inner) as fh:
                return fh.read().decode()
        from ..session import local_path
        with open(local_path(uri)) as fh:
            return fh.read()
    except (OSError, FileNotFoundError):
        return None


def _remove_folder(uri: str) -> None:
    from pyarrow import fs as pafs
    fs, inner = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")
    if fs.get_file_info(inner).type == pafs.FileType.Directory:
        fs.delete_dir(inner)


def publish(payload: DataFrame, path: str, writer: Callable[[DataFrame, str], None] | None = None,
            keep_previous: bool = True) -> str:
    """Replace what was published at ``path``, atomically for readers.

    The payload is written to a new ``version=<id>`` folder; only when that
    write has committed is the small ``_LATEST`` pointer switched to it. A job
    that dies half-way leaves the previous payload readable (a plain overwrite
    would already have deleted it). ``writer(payload, target)`` swaps the store
    (``reader`` of ``read_payload`` is its counterpart). After the switch the
    version before the last is removed, with ``keep_previous=False`` the last one
    too; readers that began on it should have ended. Returns the new version.
    """
    path = path.rstrip("/")
    before = (_read_text(f"{path}/{POINTER}") or "").split()
    version = uuid.uuid4().hex
    target = f"{path}/version={version}"
    if writer is not None:
        writer(payload, target)
    else:
        payload.write.mode("errorifexists").parquet(target)
    from ..session import ensure_local_dir
    ensure_local_dir(path)
    # The pointer names the published version, and after it the one it replaced.
    _write_text(f"{path}/{POINTER}", " ".join([version, *before[:1]] if keep_previous else [version]))
    for old in before[1 if keep_previous else 0:]:
        _remove_folder(f"{path}/version={old}")
    return version


def read_payload(spark: SparkSession, path: str, reader: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """Read the latest published payload table (through ``reader(spark, target)`` if given)."""
    path = path.rstrip("/")
    version = (_read_text(f"{path}/{POINTER}") or "").split()
    if not version:
        return spark.createDataFrame([], schemas.PAYLOAD)
    target = f"{path}/version={version[0]}"
    return reader(spark, target) if reader is not None else spark.read.schema(schemas.PAYLOAD).parquet(target)


def quarantine(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Failed rows only, partitioned by error kind."""
    (rows.where(F.col("error").isNotNull())
     .withColumn("kind", F.col("error.kind"))
     .write.mode(mode).partitionBy("kind").parquet(path))


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def publish_file(decoded: DataFrame, path: str) -> DataFrame:
    """Publish one decoded file's text per run and return its UTF-8 byte length.

    ``decoded`` has ``run_id, ord, path, text, error``; the run's single entry
    (lowest ``ord``) is published; runs whose entry failed keep their error.
    """
    from ..operators.payload import build_payload
    from ..session import spool
    p = spool(build_payload(decoded, "strict", "fail_fast").select("run_id", "seg", "payload", "n_bytes", "n_files",
                                                                   "summary", "error"), "published")
    publish(p.where(F.col("error").isNull()), path)
    return p.where("seg = 0").select("run_id", "n_bytes", "error")
