"""A streaming source of Parquet rows whose offsets are (file, row), so that a batch may end in the middle of a file."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from plumbline.sources.store import open_input, opened

#: Rows of a partition at most.
SPLIT = 100_000


def parquet_files(folder: str) -> list[str]:
    """The Parquet files of a folder, or the file itself, in the order of their names. Names that begin with _ or . don't
    count."""
    system, path = opened(folder)
    scheme = folder[: folder.index(path)] if path in folder else ""
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [folder]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    names = (x.path for x in found if x.type == fs.FileType.File and x.path.endswith(".parquet"))
    return sorted(scheme + n for n in names if not any(part[0] in "_." for part in n[len(path) :].split("/") if part))


def n_rows(path: str) -> int:
    with open_input(path) as f:
        return pq.ParquetFile(f).metadata.num_rows


def after(files: list[str], start: tuple[str, int], rows: int) -> tuple[str, int]:
    """The offset that lies `rows` rows behind start, or the end of the last file. A file's footer says what it holds."""
    path, row = start
    for f in files:
        if f < path:
            continue
        first = row if f == path else 0
        held = n_rows(f)
        path, row = f, min(held, first + rows)
        rows -= row - first
        if rows <= 0:
            break
    return path, row


class Piece(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))


class RowStream(DataSourceStreamReader):
    """Offsets are {path, row}: all rows of files before path, and of path those before row. The option `target` says up
    to where; a batch that was planned and not finished before is read as it was planned."""

    def __init__(self, schema, options):
        self.columns = [n for n in schema.names if n not in ("file_path", "row_index")]
        self.folder, self.target, self.planned = options["path"], json.loads(options["target"]), {"path": "", "row": 0}

    def initialOffset(self) -> dict:
        return {"path": "", "row": 0}

    def latestOffset(self) -> dict:
        return max(self.target, self.planned, key=lambda o: (o["path"], o["row"]))

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.planned = max(self.planned, end, key=lambda o: (o["path"], o["row"]))
        out = []
        for f in parquet_files(self.folder):
            if start["path"] <= f <= end["path"]:
                first = start["row"] if f == start["path"] else 0
                last = end["row"] if f == end["path"] else n_rows(f)
                out += [Piece(f, i, min(last, i + SPLIT)) for i in range(first, last, SPLIT)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        path, begin, end = partition.value
        with open_input(path) as f:
            file = pq.ParquetFile(f)
            at = 0
            for g in range(file.metadata.num_row_groups):
                held = file.metadata.row_group(g).num_rows
                if at < end and at + held > begin:
                    place = at
                    for batch in file.iter_batches(4096, [g], self.columns):
                        lo, hi = max(begin - place, 0), min(end - place, batch.num_rows)
                        if lo < hi:
                            part = batch.slice(lo, hi - lo)
                            own = [pa.array([path] * (hi - lo)), pa.array(range(place + lo, place + hi), pa.int64())]
                            cols = [part.column(part.schema.get_field_index(c)) for c in self.columns]
                            yield pa.RecordBatch.from_arrays([*own, *cols], names=["file_path", "row_index", *self.columns])
                        place += batch.num_rows
                at += held


class RowSource(DataSource):
    """Options path and target; the schema is that of the files with file_path and row_index before it."""

    @classmethod
    def name(cls) -> str:
        return "plumbline_rows"

    def streamReader(self, schema) -> RowStream:
        return RowStream(schema, self.options)
