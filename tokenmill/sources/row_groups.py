"""Parquet row groups as input partitions: the share of a rank, and a resumable stream over epochs.

The plan comes from the files' footers. A rank reads the row groups r, r + world, ... of every
file, in the order of the files; each is one partition, up to ``TASKS`` of them, and nothing is shuffled. Files are read by
Arrow, so their paths must belong to a file system that Arrow knows.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Footers read at once, and rows that a task hands on at once.
FOOTERS, ROWS = 16, 1024
#: Partitions of a read, or of a stream's batch; where there are more row groups, neighbours share one.
TASKS = 256
PLACE = "epoch int, file_no int, row_group int, row_no bigint"


def _open(path: str) -> pq.ParquetFile:
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return pq.ParquetFile(system.open_input_file(name))


def count_row_groups(files: Sequence[str], on_corrupt: str = "fail") -> list[int]:
    """Row groups of each file by its footer; with ``on_corrupt="skip"`` a file without a readable footer has none."""

    def one(path: str) -> int:
        try:
            with _open(path) as file:
                return file.num_row_groups
        except (pa.ArrowException, OSError) as broken:
            if on_corrupt != "skip":
                raise
            warnings.warn(f"left out {path}: {broken}", RuntimeWarning, stacklevel=2)
            return 0

    with ThreadPoolExecutor(FOOTERS) as pool:
        return list(pool.map(one, files))


class RowGroups(InputPartition):
    """Neighbouring row groups of the reading order, as (epoch, file_no, path, row group)."""

    def __init__(self, groups: list[tuple[int, int, str, int]]):
        self.groups = groups


def bundled(groups: list[tuple[int, int, str, int]]) -> list[RowGroups]:
    """A partition for each row group, or ``TASKS`` partitions of about as many neighbours each where there are more."""
    n = min(len(groups), TASKS)
    return [RowGroups(groups[len(groups) * i // n : len(groups) * (i + 1) // n]) for i in range(n)]


def read_row_groups(part: RowGroups, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows in order; neighbours of one file are read from one opened file."""
    for (epoch, file_no, path), groups in groupby(part.groups, key=lambda g: g[:3]):
        with _open(path) as file:
            for *_, group in groups:
                at = 0
                for batch in file.iter_batches(ROWS, row_groups=[group], columns=columns):
                    n = batch.num_rows
                    place = [pa.array([v] * n, pa.int32()) for v in (epoch, file_no, group)]
                    own = [batch.column(c) for c in columns]
                    yield pa.RecordBatch.from_arrays([*own, *place, pa.array(range(at, at + n), pa.int64())], names=[*columns, "epoch", "file_no", "row_group", "row_no"])
                    at += n


class _Plan:
    """What the options say, and the row groups of the files."""

    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["files"])
        self.rank, self.world = int(options.get("rank", 0)), int(options.get("world", 1))
        self.epochs, self.on_corrupt = int(options.get("epochs", 1)), options.get("on_corrupt", "fail")
        self.until = json.loads(options["until"]) if "until" in options else None
        if not 0 <= self.rank < self.world or self.epochs < 1:
            raise ValueError(f"bad rank {self.rank} of {self.world} or number of epochs {self.epochs}")

    def groups(self) -> list[tuple[int, int]]:
        """(file, row group) of the rank in reading order."""
        counts = count_row_groups(self.files, self.on_corrupt)
        if not any(counts):
            raise RuntimeError("No valid parquet files remain.")
        return [(f, g) for f, n in enumerate(counts) for g in range(self.rank, n, self.world)]


class _Reader(DataSourceReader):
    def __init__(self, plan: _Plan, columns: list[str]):
        self.plan, self.columns = plan, columns

    def partitions(self) -> list[RowGroups]:
        groups = self.plan.groups()
        return bundled([(e, f, self.plan.files[f], g) for e in range(1, self.plan.epochs + 1) for f, g in groups])

    def read(self, partition: RowGroups) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else read_row_groups(partition, self.columns)


class _StreamReader(DataSourceStreamReader):
    """An offset is the place of the next row group: epoch, file, group."""

    def __init__(self, plan: _Plan, columns: list[str]):
        self.plan, self.columns = plan, columns

    def initialOffset(self) -> dict:
        return {"epoch": 1, "file": 0, "group": 0}

    def latestOffset(self) -> dict:
        end = {"epoch": self.plan.epochs + 1, "file": 0, "group": 0}
        return end if self.plan.until is None else min(end, self.plan.until, key=_place)

    def partitions(self, start: dict, end: dict) -> list[RowGroups]:
        groups = self.plan.groups()
        return bundled([
            (e, f, self.plan.files[f], g) for e in range(start["epoch"], end["epoch"] + 1) for f, g in groups
            if _place(start) <= (e, f, g) < _place(end)
        ])

    def read(self, partition: RowGroups) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else read_row_groups(partition, self.columns)


def _place(offset: dict) -> tuple[int, int, int]:
    return offset["epoch"], offset["file"], offset["group"]


class RowGroupSource(DataSource):
    """Format ``row_groups``; options files (JSON list), columns (DDL), rank, world, epochs, on_corrupt, until (JSON offset)."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def schema(self) -> str:
        return f"{self.options['columns']}, {PLACE}"

    def _columns(self, schema: StructType) -> list[str]:
        return schema.names[: -len(PLACE.split(","))]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Plan(self.options), self._columns(schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(_Plan(self.options), self._columns(schema))


def _options(files: Sequence[str], columns: str, rank: int, world: int, epochs: int, on_corrupt: str) -> dict[str, str]:
    return {
        "files": json.dumps(list(files)), "columns": columns, "rank": str(rank), "world": str(world), "epochs": str(epochs), "on_corrupt": on_corrupt,
    }


def read_rank(
    spark: SparkSession, files: Sequence[str], columns: str = "text string", rank: int = 0, world: int = 1, epochs: int = 1,
    on_corrupt: str = "fail",
) -> DataFrame:
    """The row groups that a rank of ``world`` reads, ``epochs`` times over, one partition for each or for neighbours (``TASKS``).

    ``files`` are in reading order (``corpus.reading_order``). Adds epoch (from 1), file_no, row_group and row_no.
    """
    spark.dataSource.register(RowGroupSource)
    return spark.read.format("row_groups").options(**_options(files, columns, rank, world, epochs, on_corrupt)).load()


def stream_rank(
    spark: SparkSession, files: Sequence[str], columns: str = "text string", rank: int = 0, world: int = 1, epochs: int = 1,
    until: tuple[int, int, int] | None = None, on_corrupt: str = "fail",
) -> DataFrame:
    """The same rows as a stream whose checkpoint holds the place of the next row group.

    A run goes on to ``until`` (epoch, file, row group), not included, or to the end of the last epoch.
    A query started again on its checkpoint goes on with the row group after the last one it has
    finished, also in the middle of a file; more epochs, or files added at the end of the list, continue it.
    """
    spark.dataSource.register(RowGroupSource)
    options = _options(files, columns, rank, world, epochs, on_corrupt)
    if until is not None:
        options["until"] = json.dumps(dict(zip(("epoch", "file", "group"), until)))
    return spark.readStream.format("row_groups").options(**options).load()
