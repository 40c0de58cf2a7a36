"""Helpers that the operators share: bounded text groups, distinct-string tables, id checks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that a Python task turns over at once; a longer document is a group of its own.
GROUP_CHARS = 1 << 20
#: Entries of a task's table of distinct strings; a full table is emptied, which costs time only.
TABLE_ROWS = 1 << 19


def take(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Only the id and the whole text, under fixed names; a null text becomes empty.

    Other columns, whatever their names, are left behind, or carried inside the struct ``row``
    with all given columns as they are, so none can clash.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *row
    )


def out_schema(docs: DataFrame, fields: str) -> T.StructType:
    """Schema of an operator's rows: doc_id as given, the fields, and row where it is carried."""
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(fields)])
    return out.add("row", docs.schema["row"].dataType) if "row" in docs.columns else out


def out_batch(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The rows of ``out_schema``, one for each document of the batch."""
    own = {"doc_id": batch.column("doc_id"), **columns}
    if "row" in batch.schema.names:
        own["row"] = batch.column("row")
    return pa.RecordBatch.from_arrays(list(own.values()), names=list(own))


def crc_bucket(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % mod


def text_groups(batches: Iterator[pa.RecordBatch], size: int = GROUP_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has about ``size`` bytes of text, or one document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        group = (np.cumsum(lengths) - lengths) // size
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(lo), int(hi - lo))


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so that its tasks share it."""
    module = sys.modules.setdefault("_tokenmill_cache", types.ModuleType("_tokenmill_cache"))
    return module.__dict__.setdefault(name, {})


def lists_in_a_row(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array and their lengths."""
    length = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(length.sum())), length


class DistinctTable:
    """Ids of distinct strings: each string is encoded once and found by position afterwards.

    ``encode`` takes strings and returns all their ids in a row and the number of ids of each.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], rows: int = TABLE_ROWS):
        self.encode, self.rows = encode, rows
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each word has."""
        new = list(set(words).difference(self.at))
        if len(self.at) + len(new) > self.rows and self.at:
            self._clear()
            new = list(set(words))
        if new:
            ids, length = self.encode(new)
            start = len(self.flat) + np.cumsum(length) - length
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        row = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        n = self.length[row]
        skip = np.repeat(self.start[row] - (np.cumsum(n) - n), n)
        return self.flat[skip + np.arange(len(skip))], n
