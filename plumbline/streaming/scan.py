"""Scans that go on where they ended: by files with Spark's own source, and by rows within budgets."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plumbline.runtime import qualified, with_scheme
from plumbline.sources.store import open_input
from plumbline.streaming.rows import RowSource, after, n_rows, parquet_files


def advance_scan(
    spark: SparkSession, source: str, schema: StructType, scan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_trigger: int = 100
) -> None:
    """Scan the files of source that no earlier call has scanned, and append the results to sink.

    The checkpoint is the cursor: a call that is stopped goes on where the last committed trigger ended, and one that
    finds nothing new does nothing. scan is a function of a row, not of the stream.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    query = scan(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class Busy(RuntimeError):
    """Another call holds the cursor."""


@dataclass(frozen=True)
class Budgets:
    """What one call may take: rows, seconds, bytes of results. A batch is never cut short, so that the seconds and bytes
    of the last one may go beyond; batch_rows says how large it is."""

    rows: int | None = None
    seconds: float | None = None
    disk: int | None = None
    batch_rows: int = 1_000_000


class Cursor:
    """What is done of a source: the file and row up to which it was scanned, the batches whose results count, how many
    files lie at or before the cursor, and the end of a batch that is planned and not done. Each state is written beside
    the last, which goes once the new one is whole; the last one counts where a call stopped between the two, and then
    the stream's checkpoint knows that its planned batch is done."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = qualified(spark, folder.rstrip("/"))
        self.jvm = spark.sparkContext._jvm
        self.system = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def state(self) -> dict:
        name = next((n for n in ("cursor.json", "cursor.old") if self.system.exists(self._path(n))), None)
        if name is None:
            return {"path": "", "row": 0, "batches": 0, "files": 0, "planned": None}
        with open_input(f"{self.folder}/{name}") as f:
            return json.loads(f.read())

    def put(self, state: dict) -> None:
        part = self._path(f"cursor-{uuid.uuid4().hex}")
        self._write(part, json.dumps(state))
        old = self._path("cursor.old")
        self.system.delete(old, False)
        if self.system.exists(self._path("cursor.json")):
            self.system.rename(self._path("cursor.json"), old)
        self.system.rename(part, self._path("cursor.json"))

    def _write(self, path, text: str) -> None:
        out = self.system.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()

    def lock(self, steal: bool) -> None:
        if steal:
            self.system.delete(self._path("lock"), False)
        try:
            self._write(self._path("lock"), str(time.time()))
        except Exception as e:
            if self.system.exists(self._path("lock")):
                raise Busy(f"{self.folder} is in use; steal=True takes it over from a call that has died") from e
            raise

    def unlock(self) -> None:
        self.system.delete(self._path("lock"), False)

    def size(self, folder: str) -> int:
        path = self.jvm.org.apache.hadoop.fs.Path(folder)
        return self.system.getContentSummary(path).getLength() if self.system.exists(path) else 0


def advance_rows(spark: SparkSession, source: str, scan: Callable[[DataFrame], DataFrame], folder: str, budgets: Budgets = Budgets(), steal: bool = False) -> dict:
    """Scan the rows of source's Parquet files behind the cursor in folder, until they or a budget end.

    Returns {reason, rows, path, row}: why it stopped (complete, rows, seconds or disk), the rows of this call, and the
    cursor. scan is a function of a row; it gets the columns of the files with file_path and row_index. Results lie
    under folder/results in a folder for each batch, so that a batch that is run again replaces what it wrote before,
    and scanned() reads those that count. Every row is scanned once, whatever the budgets of the calls, and an error in
    scan leaves the cursor where it was. A batch that an earlier call planned is done first, whatever the budget.

    Files are taken in the order of their names and may not change; new ones have to sort behind the cursor, else an
    error tells. An empty source is complete. Two calls at a time on one folder are an error.
    """
    spark.dataSource.register(RowSource)
    cursor, source = Cursor(spark, folder), with_scheme(spark, source)
    results = f"{cursor.folder}/results"
    cursor.lock(steal)
    try:
        began, done, state = time.monotonic(), 0, cursor.state()
        files = parquet_files(source)
        behind = [f for f in files if f <= state["path"]]
        if len(behind) != state["files"]:
            raise ValueError("files before the cursor came or went")
        if not files:
            return {"reason": "complete", "rows": 0, "path": "", "row": 0}
        schema = spark.read.parquet(source).schema
        schema = StructType([StructField("file_path", StringType()), StructField("row_index", LongType()), *schema.fields])
        size = cursor.size(results) if budgets.disk is not None else 0
        while True:
            at = (state["path"], state["row"])
            left = None if budgets.rows is None else budgets.rows - done
            reason = None
            if state["planned"]:
                end = tuple(state["planned"])
            elif at == (files[-1], n_rows(files[-1])):
                reason = "complete"
            elif left is not None and left <= 0:
                reason = "rows"
            elif budgets.seconds is not None and time.monotonic() - began >= budgets.seconds:
                reason = "seconds"
            elif budgets.disk is not None and cursor.size(results) - size >= budgets.disk:
                reason = "disk"
            else:
                end = after(files, at, budgets.batch_rows if left is None else min(left, budgets.batch_rows))
                # said before it is begun: a call that stops within a batch is followed by one that ends the same batch
                state["planned"] = end
                cursor.put(state)
            if reason:
                return {"reason": reason, "rows": done, "path": at[0], "row": at[1]}

            def batch(df: DataFrame, number: int, nth: int = state["batches"]) -> None:
                if number != nth:
                    raise ValueError(f"batch {number} of the stream is not batch {nth} of the cursor")
                scan(df).write.mode("overwrite").parquet(f"{results}/batch={number}")

            stream = spark.readStream.format("plumbline_rows").schema(schema).options(path=source, target=json.dumps({"path": end[0], "row": end[1]})).load()
            stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{cursor.folder}/stream").trigger(availableNow=True).start().awaitTermination()
            done += between(files, at, end)
            state = {"path": end[0], "row": end[1], "batches": state["batches"] + 1, "files": sum(f <= end[0] for f in files), "planned": None}
            cursor.put(state)
    finally:
        cursor.unlock()


def between(files: list[str], a: tuple[str, int], b: tuple[str, int]) -> int:
    """Rows from offset a to offset b."""
    inner = sum(n_rows(f) for f in files if a[0] <= f < b[0])
    return inner - (a[1] if a[0] in files else 0) + b[1]


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    """The results of all finished batches of advance_rows, with their batch."""
    cursor = Cursor(spark, folder)
    return spark.read.option("basePath", f"{cursor.folder}/results").parquet(f"{cursor.folder}/results").where(f"batch < {cursor.state()['batches']}")
