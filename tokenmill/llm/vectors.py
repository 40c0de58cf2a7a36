"""Embedding rows: which vectors take part, as whole numbers or doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usual_length(df: DataFrame, vector: str) -> int:
    """The most frequent length of a vector column (of several, the longest); 0 without vectors of any length."""
    sizes = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("rows"))
    top = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    return top["n"] if top else 0


def scaled(df: DataFrame, vector_col: str, factor: int, shift: int, limit: float, **columns: Column) -> tuple[DataFrame, int]:
    """Rows with ``x`` = floor(factor * c) + shift of every component c, and the vectors' length.

    Left out are null vectors, vectors with a null or non-finite component or one beyond ``limit``
    (its whole number could not be counted with exactly), and vectors of another length than the
    most frequent one. ``columns`` are carried under their names.
    """
    c = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x * F.lit(float(factor)))
    rows = df.select(*[v.alias(k) for k, v in columns.items()], c.alias("__c"))
    fits = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= F.lit(limit * factor)), F.lit(False))
    rows = rows.where(F.coalesce(F.forall("__c", fits), F.lit(False)))
    size = usual_length(rows, "__c")
    x = F.transform("__c", lambda v: F.floor(v).cast("long") + F.lit(shift).cast("long"))
    return rows.where(F.size("__c") == size).where(F.lit(size > 0)).select(*columns, x.alias("x")), size


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A list column of equal lengths as rows of an array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def list_column(values: np.ndarray) -> pa.ListArray:
    """The rows of an array as a list column."""
    n, size = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(np.ascontiguousarray(values).ravel()))
