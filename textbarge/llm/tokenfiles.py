"""Token ids of all documents in binary files, and back.

Documents are sorted by id over range partitions (ties by a hash of the text); each task
writes its part as files of about ``FILE_IDS`` ids, named by task and number, so the files'
order is the documents' order. A file (all numbers little-endian):

* 8 bytes ``TBTOK001``; crc32 of what follows up to the blocks (uint32); bytes of it (uint32);
* documents (uint32), ids (uint64), ids of the task's files before (uint64), ids in a block
  (uint32), blocks (uint32);
* the documents' ids (int64) and whether they are null (uint8), their numbers of ids (uint64);
* each block's coded bytes (uint32) and crc32 of its ids as unsigned 32-bit integers (uint32);
* the blocks, each coded on its own by the range coder of ``coder``.

A file is written under another name and renamed, and a task that runs again writes the same
files. Reading checks every checksum and raises an error if one does not hold.

Defined results: null and empty texts are the end id alone; a null id comes first and stays
null; repeated rows are written each; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import fresh_dir
from .coder import decode, encode
from .common import TEXT_BYTES, column, only, read, ready, spool, starts_of
from .tokens import pieces

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
#: Ids in a block, and in a file (a longer document is whole in one file).
BLOCK, FILE_IDS = 1024, 4_000_000
#: Characters tokenised at a time.
CHUNK = 2 * TEXT_BYTES
MAGIC = b"TBTOK001"
_HEAD = struct.Struct("<IQQII")
WRITTEN = "task int, file string, n_docs bigint, n_ids bigint"
ROWS = "task bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"


def pack_file(doc_ids: list[int | None], ids: list[np.ndarray], before: int, block: int) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint16)
    n, blocks = len(flat), -(-len(flat) // block)
    sizes = np.full(blocks, block)
    if blocks:
        sizes[-1] = n - block * (blocks - 1)
    square = np.zeros(blocks * block, np.int32)
    square[:n] = flat
    codes = encode(square.reshape(blocks, block), sizes) if blocks else []
    wide = memoryview(flat.astype("<u4").tobytes())
    sums = [zlib.crc32(wide[4 * block * i:4 * block * (i + 1)]) for i in range(blocks)]
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = b"".join([_HEAD.pack(len(doc_ids), n, before, block, blocks), names.tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
                     np.array([len(x) for x in ids], "<u8").tobytes(), np.array([[len(c), s] for c, s in zip(codes, sums)], "<u4").tobytes()])
    return b"".join([MAGIC, struct.pack("<II", zlib.crc32(head), len(head)), head, *codes])


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """(document ids, number of ids of each, all ids, ids of the task's files before)."""
    view = memoryview(data)
    crc, size = struct.unpack_from("<II", view, 8)
    head = view[16:16 + size]
    if view[:8] != MAGIC or zlib.crc32(head) != crc:
        raise ValueError("not a token file, or its head is damaged")
    docs, n, before, block, blocks = _HEAD.unpack_from(head)
    at = _HEAD.size
    names = np.frombuffer(head, "<i8", docs, at)
    nulls = np.frombuffer(head, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(head, "<u8", docs, at + 9 * docs).astype(np.int64)
    table = np.frombuffer(head, "<u4", 2 * blocks, at + 17 * docs).reshape(blocks, 2)
    ends = 16 + size + starts_of(table[:, 0].astype(np.int64))
    if ends[-1] != len(data) or lengths.sum() != n:
        raise ValueError("a token file has another length than its head says")
    sizes = np.full(blocks, block)
    if blocks:
        sizes[-1] = n - block * (blocks - 1)
    ids = decode([bytes(view[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())], sizes).astype("<u4").ravel()[:n] if blocks else np.empty(0, "<u4")
    wide = memoryview(np.ascontiguousarray(ids).tobytes())
    for i, crc in enumerate(table[:, 1].tolist()):
        if zlib.crc32(wide[4 * block * i:4 * block * (i + 1)]) != crc:
            raise ValueError(f"block {i} of a token file is damaged")
    return [None if z else d for d, z in zip(names.tolist(), nulls.tolist())], lengths, ids, before


def _store(path: str, data: bytes) -> None:
    from pyarrow import fs
    store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    temporary = f"{inner}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    store.move(temporary, inner)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of documents that are tokenised together: about ``CHUNK`` characters, over several batches, a longer single text whole."""
    doc_ids: list = []
    strings: list = []
    held = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            if held and held + len(text) > CHUNK:
                yield doc_ids, strings
                doc_ids, strings, held = [], [], 0
            doc_ids.append(doc)
            strings.append(text)
            held += len(text) + 1
    if doc_ids:
        yield doc_ids, strings


def _write(path: str, tokenizer: str, end_id: int, block: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, task = pieces(tokenizer), np.array([end_id], "<u2").tobytes(), TaskContext.get().partitionId()
        names: list = []
        ids: list = []
        held = before = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, ids, held, before, number
            name = f"{task:07d}-{number:05d}.tok"
            _store(f"{path}/{name}", pack_file(names, ids, before, block))
            row = (task, name, len(names), held)
            names, ids, held, before, number = [], [], 0, before + held, number + 1
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in WRITTEN.split(", ")])

        for doc_ids, strings in _chunks(batches):
            for doc, raw in zip(doc_ids, encoder.ids(strings)):
                names.append(doc)
                ids.append(np.frombuffer(raw + end, "<u2"))
                held += len(ids[-1])
                if held >= file_ids:
                    yield flush()
        encoder.rest()
        if names:
            yield flush()
    return run


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files under ``path`` (a shared folder) and returns a row for each: task, file, n_docs, n_ids. ``tokenizer`` has ids under 65,536."""
    from pyarrow import fs
    ready(docs)
    store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    store.create_dir(inner, recursive=True)
    rows = only(docs, doc_id=column(docs, doc_id).cast("bigint"), text=column(docs, text).cast("string")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return spool(ordered.mapInArrow(_write(path, tokenizer, end_id, block, file_ids), WRITTEN), "written")


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, lengths, ids, before = unpack_file(batch.column(1)[i].as_buffer())
                starts, wide = starts_of(lengths), memoryview(np.ascontiguousarray(ids).tobytes())
                parts = [wide[4 * a:4 * b] for a, b in zip(starts.tolist(), starts[1:].tolist())]
                task = int(batch.column(0)[i].as_py())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(docs), task)), pa.array(docs, pa.int64()), pa.array(starts[:-1] + before), pa.array(lengths), pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                    pa.array([bytes(x) for x in parts] if with_ids else [None] * len(docs), pa.binary())], names=[c.split()[0] for c in ROWS.split(", ")])
    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """From the files under ``path``: doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids (unsigned 32-bit, or null)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path)
    rows = files.select(F.regexp_extract("path", r"(\d+)-\d+\.tok$", 1).alias("task"), "content").mapInArrow(_read(with_ids), ROWS)
    rows = spool(rows, "tokens_read")
    sizes = {r["task"]: r["n"] for r in rows.groupBy("task").agg(F.sum("n_tokens").alias("n")).collect()}     # one number a task
    at, bases = 0, []
    for task in sorted(sizes):
        bases.append((task, at))
        at += sizes[task]
    bases = F.broadcast(spark.createDataFrame(bases, "task bigint, before bigint"))
    return rows.join(bases, "task").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    path = fresh_dir(ready(docs), "token_files")
    write_tokens(docs, path)
    return read_tokens(spark, path, with_ids=False).drop("ids")
