"""Extraction sources.

PDF parsing and text recognition are not done here; their results arrive as
tables (``page_results``, ``extraction_results``), produced by any extractor.
``run_extractor`` plugs a user extractor in with ``mapInPandas``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.errors import lenient_error, null_error, strict_error
from ..profiles import Profile, get_profile

NO_RESULT = "No extraction result for this path"


def read_page_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGE_RESULTS).parquet(path)


def lookup_extraction(entries: DataFrame, results: DataFrame, profile: Profile | str,
                      path_col: str = "path") -> DataFrame:
    """LEFT JOIN results by path; a recorded error or a missing row is an extraction error."""
    p = get_profile(profile)
    r = results.select(F.col("path").alias(path_col), F.col("text").alias("_x_text"),
                       F.col("error").alias("_x_error"), F.lit(True).alias("_x_seen"))
    j = entries.join(r, path_col, "left")
    msg = F.when(F.col("_x_seen").isNull(), F.lit(NO_RESULT)).otherwise(F.col("_x_error"))
    bad = F.col("_x_seen").isNull() | F.col("_x_error").isNotNull()
    err = (strict_error("ExtractionError", path_col, msg) if p.name == "strict"
           else lenient_error("extractionFailed", path_col, msg))
    return (j.withColumn("text", F.when(~bad, F.col("_x_text")))
            .withColumn("error", F.when(bad, err).otherwise(null_error()))
            .drop("_x_text", "_x_error", "_x_seen"))


# Bytes of file content that an extractor is handed at a time (one file at least).
EXTRACT_BYTES = 64 * 1024 * 1024


def _frames(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The batches' rows in frames of at most ``most`` bytes of content."""
    for b in batches:
        first = held = 0
        for i, content in enumerate(b["content"]):
            n = len(content) if content is not None else 0
            if i > first and held + n > most:
                yield b.iloc[first:i]
                first, held = i, 0
            held += n
        if first < len(b):
            yield b.iloc[first:]


# Texts of the rows that stand for a failed call.
EXTRACTOR_RAISED = "extractor raised {error}"
EXTRACTOR_DIED = "extractor died (exit code {code})"
EXTRACTOR_LATE = "extractor timed out after {seconds:g} s"


# Calls of one task at a time at most: another starts only while those that run use no CPU.
BESIDE = 12
# Seconds after which a call is looked at, and the share of them below which its CPU time counts as waiting.
LOOK, WAITING = 0.03, 0.1


PAGE_COLUMNS = [f.name for f in schemas.PAGE_RESULTS.fields]
# Rows and bytes of pages that a task hands on at a time (one frame of an extractor at least).
HANDED_ROWS, HANDED_BYTES = 4096, 4 * 1024 * 1024


def _serve(extractor, pipe, deadline: float, others: list) -> None:
    """The child: calls the extractor for one frame after the other and sends its frames back."""
    import gc
    import signal
    from math import ceil
    # What the worker has is shared with it as long as it is not touched.
    gc.freeze()
    for other in others:
        other.close()
    signal.signal(signal.SIGALRM, signal.SIG_DFL)
    while True:
        try:
            path, content = pipe.recv()
        except EOFError:
            return
        frame = pd.DataFrame([(path, content)], columns=["path", "content"], dtype=object)
        # Ends a call that hangs even where the worker that waits for it is gone.
        signal.alarm(ceil(deadline) + 30)
        try:
            out = extractor(frame)
            for rows in ([out] if isinstance(out, pd.DataFrame) else out):
                if len(rows):
                    pipe.send(("rows", (len(rows), int(rows["page_idx"].max()), {c: rows[c].tolist() for c in PAGE_COLUMNS if c in rows.columns})))
                signal.alarm(ceil(deadline) + 30)
            pipe.send(("done", None))
        except Exception as e:  # noqa: BLE001 - whatever a user's extractor raises is that file's error
            pipe.send(("raised", f"{type(e).__name__}: {e}"))
        signal.alarm(0)


def _cpu(pid: int) -> float | None:
    """CPU seconds of a process and of those it started; None where the system does not tell."""
    import glob
    import os
    try:
        with open(f"/proc/{pid}/schedstat") as f:
            ran = 0.0 if len(os.listdir(f"/proc/{pid}/task")) > 1 else int(f.read().split()[0]) / 1e9
        if not ran:
            for path in glob.glob(f"/proc/{pid}/task/*/schedstat"):
                with open(path) as f:
                    ran += int(f.read().split()[0]) / 1e9
        for path in glob.glob(f"/proc/{pid}/task/*/children"):
            with open(path) as f:
                ran += sum(_cpu(int(child)) or 0.0 for child in f.read().split())
        return ran
    except (OSError, ValueError, IndexError):
        return None


class _Pages:
    """Rows that wait to be handed on together."""

    def __init__(self):
        self.rows, self.bytes, self.columns = 0, 0, {c: [] for c in PAGE_COLUMNS}

    def add(self, n: int, columns: dict, size: int) -> None:
        for c, held in self.columns.items():
            held.extend(columns.get(c) or [None] * n)
        self.rows, self.bytes = self.rows + n, self.bytes + size

    def full(self) -> bool:
        return self.rows >= HANDED_ROWS or self.bytes >= HANDED_BYTES

    def taken(self) -> pd.DataFrame:
        out = pd.DataFrame({c: pd.Series(held, dtype=object) for c, held in self.columns.items()})
        self.__init__()
        return out


class _Call:
    """A child process and the call that it runs."""

    def __init__(self, extractor, deadline: float, others: list):
        import multiprocessing
        fork = multiprocessing.get_context("fork")
        self.deadline = deadline
        self.pipe, far = fork.Pipe()
        self.child = fork.Process(target=_serve, args=(extractor, far, deadline, [*others, self.pipe]), daemon=True)
        self.child.start()
        far.close()

    def stop(self) -> int | None:
        """Ends the child; its exit code."""
        self.pipe.close()
        self.child.join(0.2)
        if self.child.is_alive():
            self.child.kill()
            self.child.join()
        return self.child.exitcode

    def begin(self, path: str, content: bytes | None) -> str | None:
        """Hands a file to the child; the error of a child that is gone."""
        self.path, self.page, self.waits = path, 0, False
        try:
            self.pipe.send((path, content))
        except (BrokenPipeError, ConnectionResetError):
            return EXTRACTOR_DIED.format(code=self.stop())
        self._heard()
        return None

    def _heard(self) -> None:
        from time import monotonic
        self.looked, self.ran, self.waits = monotonic(), None, False
        self.until = self.looked + self.deadline

    def look(self, now: float) -> None:
        """Whether the call has only waited since the last look."""
        if now - self.looked < LOOK:
            return
        ran = _cpu(self.child.pid)
        if self.ran is not None and ran is not None:
            self.waits = ran - self.ran < WAITING * (now - self.looked)
        self.looked, self.ran = now, ran

    def late(self) -> tuple[str, int]:
        self.child.kill()
        self.stop()
        return EXTRACTOR_LATE.format(seconds=self.deadline), int(self.deadline * 1000) + 1

    def hear(self, pages: _Pages) -> str:
        """Keeps what the child has sent: rows, the end of the call (done), or its error (raised, died)."""
        try:
            message = self.pipe.recv_bytes()
        except (EOFError, ConnectionResetError):
            self.failed(pages, EXTRACTOR_DIED.format(code=self.stop()))
            return "died"
        self._heard()
        kind, value = pickle.loads(message)
        if kind == "rows":
            n, last, columns = value
            self.page = max(self.page, last + 1)
            pages.add(n, columns, len(message))
        elif kind == "raised":
            self.failed(pages, EXTRACTOR_RAISED.format(error=value))
        return kind

    def failed(self, pages: _Pages, error: str, elapsed: int | None = None) -> None:
        """The row of a failed call, behind the pages it gave."""
        pages.add(1, {"path": [self.path], "page_idx": [self.page], "error": [error], "elapsed_ms": [elapsed]}, 0)


def _isolated(files: Iterator[tuple], extractor, deadline: float, beside: int) -> Iterator[pd.DataFrame]:
    """The pages of each file; a call that raises, dies or gives no frame in time ends in a row with its error, behind the pages it gave.

    One call at a time has the task's core: the next file is begun when it is done, or while
    all calls that run wait (a hanging one until its deadline), up to ``beside`` at a time."""
    from multiprocessing.connection import wait
    from time import monotonic
    idle: list[_Call] = []
    busy: dict = {}
    pages, more = _Pages(), True
    try:
        while more or busy:
            now = monotonic()
            for call in busy.values():
                call.look(now)
            while more and len(busy) < beside and all(call.waits for call in busy.values()):
                file = next(files, None)
                if file is None:
                    more = False
                    break
                call = idle.pop() if idle else _Call(extractor, deadline, list(busy))
                gone = call.begin(*file)
                if gone is None:
                    busy[call.pipe] = call
                else:
                    call.failed(pages, gone)
            if busy:
                nearest = min(call.until for call in busy.values()) - monotonic()
                heard = wait(list(busy), max(0.0, min(nearest, LOOK) if more and len(busy) < beside else nearest))
                now = monotonic()
                # Those that are over time and have sent nothing: what was sent is read first.
                for pipe in [p for p, call in busy.items() if p not in heard and now >= call.until]:
                    call = busy.pop(pipe)
                    call.failed(pages, *call.late())
                for pipe in heard:
                    kind = busy[pipe].hear(pages)
                    if kind != "rows":
                        call = busy.pop(pipe)
                        if kind != "died":
                            idle.append(call)
            if pages.full():
                yield pages.taken()
        if pages.rows:
            yield pages.taken()
    finally:
        for call in [*idle, *busy.values()]:
            if call.pipe in busy:
                call.child.kill()
            call.stop()


def run_extractor(files: DataFrame, extractor: Callable[[pd.DataFrame], pd.DataFrame | Iterator[pd.DataFrame]],
                  max_bytes: int = EXTRACT_BYTES, materialize: bool = True, deadline: float | None = None,
                  beside: int = BESIDE) -> DataFrame:
    """Apply ``extractor(frame) -> page rows`` to frames of ``(path, content)``.

    A frame holds at most ``max_bytes`` of content (one file at least); the extractor
    returns rows in the ``page_results`` schema, or an iterator of such frames.
    Spark partitions and schedules the work. Page results usually feed several
    consumers (page counts, the text itself), so with ``materialize`` they are
    written once in the shared folder: the extractor, typically the expensive
    step, runs once per file, and a lost executor does not re-run it for others.

    With a ``deadline`` (seconds) every call is for one file, in a child process of the
    worker: a call that raises, dies or gives no frame for that long is that file's error,
    a row behind the pages it gave (over-time rows with their ``elapsed_ms``, so G15 sees
    them as time-outs), and all other files are as without it. While the calls of a task
    use no CPU (one that hangs until its deadline), up to ``beside`` run at a time; with 1
    each waits for the one before.
    """
    from ..session import ship_package, spool
    ship_package(files.sparkSession)
    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        for c in PAGE_COLUMNS:
            if c not in rows.columns:
                rows[c] = None
        return rows[PAGE_COLUMNS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if deadline is not None:
            one_by_one = (file for batch in batches for file in zip(batch["path"], batch["content"]))
            yield from _isolated(one_by_one, extractor, deadline, max(1, beside))
            return
        for frame in _frames(batches, max_bytes):
            out = extractor(frame)
            for rows in ([out] if isinstance(out, pd.DataFrame) else out):
                yield whole(rows)

    out = files.select("path", "content").mapInPandas(run, schemas.PAGE_RESULTS)
    return spool(out, "page_results") if materialize else out
