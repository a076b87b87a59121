"""Structured Streaming ingestion.

``start_ingest`` decodes a stream of rows that carry their bytes with the batch
expressions. ``start_drop_folder`` is the whole lifecycle over a folder: each
micro-batch of new files is validated, routed, decoded and gated by the same
functions as a batch job. ``start_latest`` keeps the last successful write of
each target. Every micro-batch writes its own folder with overwrite, so a
replayed batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.decode import decode_text
from ..operators.payload import build_payload
from ..plans.job import JobInputs, decode_entries, single_part
from ..profiles import ENGINE_MAX_FILE_BYTES, Profile, get_profile
from ..session import spool
from ..sources.drop_folder import SETTLE, arrivals
from ..sources.files import normalize_path, read_bytes
from ..sources.sinks import publish


def file_stream(spark: SparkSession, root: str, glob: str | None = None,
                max_files_per_trigger: int = 10000, with_content: bool = False) -> DataFrame:
    """X1 source: files appearing under ``root`` (a drop folder): ``path, modificationTime, length[, content]``.

    Micro-batches take at most ``max_files_per_trigger`` files, so a backlog is
    consumed in bounded steps. Without content no file is read, whatever its size.
    """
    from .. import schemas
    r = (spark.readStream.format("binaryFile").schema(schemas.FILES).option("recursiveFileLookup", "true")
         .option("maxFilesPerTrigger", max_files_per_trigger))
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    if with_content:
        df = df.where(F.col("length") <= F.lit(ENGINE_MAX_FILE_BYTES))
    else:
        df = df.drop("content")
    return df.withColumn("path", normalize_path("path"))


def decode_stream(stream: DataFrame, profile: Profile | str, content: str = "content") -> DataFrame:
    """Decodes each arriving row with the batch expressions (no validation or routing)."""
    return decode_text(stream, get_profile(profile), content=content)


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def _split(batch: DataFrame, batch_id: int, out_dir: str, quarantine_dir: str) -> None:
    """Good rows and failed rows of a micro-batch to their own tables."""
    batch.where(F.col("error").isNull()).drop("error").write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
    (batch.where(F.col("error").isNotNull()).withColumn("kind", F.col("error.kind"))
     .write.mode("overwrite").parquet(f"{quarantine_dir}/batch={batch_id}"))


def start_ingest(decoded: DataFrame, out_dir: str, quarantine_dir: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """X1 + X3: write good rows and failed rows per micro-batch."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        _split(batch, batch_id, out_dir, quarantine_dir)
        batch.unpersist()

    return _start(decoded.writeStream.foreachBatch(sink), checkpoint, available_now)


def start_drop_folder(spark: SparkSession, root: str, profile: Profile | str, out_dir: str, quarantine_dir: str,
                      checkpoint: str, results: JobInputs | None = None, glob: str | None = None,
                      settle: float = SETTLE, available_now: bool = True) -> StreamingQuery:
    """X1 + X3: every new file under ``root``, whatever its name or size, is one selection of the desktop front end.

    The source gives each micro-batch the inventory of its files (sources/drop_folder.py):
    they are validated and routed, texts are decoded (bytes are read only of files that
    pass), page results of PDFs and images are taken from ``results`` (a file without any is
    a typed error), and the blank and output gates applied: rows ``path, route, encoding,
    payload, n_bytes`` go to ``out_dir``, failures with ``error`` and its ``kind`` to
    ``quarantine_dir``. A batch's cost does not depend on earlier batches' results; a file
    written again is a new selection.
    """
    p = get_profile(profile)

    def sink(batch: DataFrame, batch_id: int) -> None:
        inventory = spool(batch.drop("arrival"), "inventory")
        manifest = inventory.select(F.col("path").alias("run_id"), F.lit(0).alias("ord"), "path",
                                    F.lit(None).cast("string").alias("inline_text"), F.lit(None).cast("string").alias("declared_type"))
        most = ENGINE_MAX_FILE_BYTES if p.max_file_bytes is None else min(p.max_file_bytes, ENGINE_MAX_FILE_BYTES)
        from ..functions.route import route
        texts = inventory.where(F.col("length").between(1, most) & (route("path", p) == "text")).select("path")
        given = results or JobInputs(manifest, inventory)
        decoded = spool(decode_entries(JobInputs(
            manifest, inventory, files=read_bytes(texts), files_whole=True, pdf_facts=given.pdf_facts, pdf_pages=given.pdf_pages,
            ocr_pages=given.ocr_pages, image_facts=given.image_facts), p), "decoded")
        gated = build_payload(single_part(decoded), p, "single")
        rows = decoded.where("part = 0").select("path", "route", "encoding").join(
            gated.select(F.col("run_id").alias("path"), "seg", "payload", "n_bytes", "error"), "path")
        _split(spool(rows, "gated"), batch_id, out_dir, quarantine_dir)

    stream = arrivals(spark, root, glob, settle)
    return _start(stream.writeStream.foreachBatch(sink), checkpoint, available_now)


def _batches(path: str) -> list[int]:
    """Numbers of the micro-batch folders under ``path``."""
    import os

    from pyarrow import fs as pafs
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    return sorted(int(f.base_name[6:]) for f in found if f.base_name.startswith("batch="))


def start_latest(decoded: DataFrame, target: str, seq: str, out_dir: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Last successful write wins per target.

    Nothing is kept in streaming state: each micro-batch writes, per target, its
    own latest successful text with its ``seq`` and the number of successes (one
    partial aggregate), under ``batch=<id>``. ``read_latest`` resolves the newest
    across batches, and ``compact_latest`` folds old batches into one table.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.where(F.col("error").isNull()).groupBy(target).agg(
            F.max_by(F.col("text"), F.col(seq)).alias("payload"), F.max(F.col(seq)).alias(seq),
            F.count(F.lit(1)).alias("n_ok"))
         .write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}"))

    return _start(decoded.writeStream.foreachBatch(sink), checkpoint, available_now)


BASE = "base"


def _resolved(parts: list[DataFrame], target: str, seq: str) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(target).agg(F.max_by(F.struct("payload", seq), F.col(seq)).alias("_l"),
                                    F.sum("n_ok").alias("n_ok")).select(target, "_l.*", "n_ok")


def _parts(spark: SparkSession, out_dir: str) -> tuple[list[DataFrame], list[int]]:
    """The compacted table, if any, and the batches it does not hold; their numbers."""
    from ..sources.sinks import POINTER, _read_text
    base = (_read_text(f"{out_dir}/{BASE}/{POINTER}") or "").split()
    parts, upto = [], -1
    if base:
        table = spark.read.parquet(f"{out_dir}/{BASE}/version={base[0]}")
        upto = table.agg(F.max("upto")).first()[0]
        upto = -1 if upto is None else upto
        parts.append(table.drop("upto"))
    numbers = [n for n in _batches(out_dir) if n > upto]
    parts += [spark.read.parquet(f"{out_dir}/batch={n}") for n in numbers]
    return parts, numbers


def read_latest(spark: SparkSession, out_dir: str, target: str, seq: str = "ord") -> DataFrame:
    """X2 read side: per target, the text of the largest ``seq`` and the number of successes."""
    parts, _ = _parts(spark, out_dir.rstrip("/"))
    return _resolved(parts, target, seq)


def compact_latest(spark: SparkSession, out_dir: str, target: str, seq: str = "ord") -> None:
    """Folds all batches so far into one table (switched to atomically), then removes their folders."""
    from ..sources.sinks import _remove_folder
    out_dir = out_dir.rstrip("/")
    parts, numbers = _parts(spark, out_dir)
    if numbers:
        publish(_resolved(parts, target, seq).withColumn("upto", F.lit(numbers[-1])), f"{out_dir}/{BASE}")
        for n in numbers:
            _remove_folder(f"{out_dir}/batch={n}")
