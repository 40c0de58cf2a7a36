"""Embedding whitening by a covariance over distinct vectors and their multiplicities.

1. Equal whole-number vectors become one row with their count.
2. Each task adds up its rows' exact sums, then its part of the weighted covariance: a matrix
   product of centred rows, each scaled by its weight. Parts are added by a plain aggregation;
   only a matrix of the vectors' length reaches the driver.
3. Every distinct vector is centred, projected and scaled once; all rows get their vector's
   result by a join that spreads vectors with very many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.salting import join_counted
from tokenmill.llm.vectors import list_column, matrix, scaled
from tokenmill.plans.session import cut_lineage

#: The longest vectors: their covariance (8 MB at most) is held by the driver and by each task.
MAX_SIZE = 1024
#: Components beyond this would leave no room for exact counting.
LIMIT = float(1 << 40)
WHOLE = 1 << 62


def offsets(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums without rounding: as 64-bit numbers, or as Python's where those could overflow."""
    top = int(np.abs(x).max(initial=0))
    if n * top < WHOLE and max(map(abs, map(int, sums)), default=0) < WHOLE:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def squares(offset: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row; None where a 64-bit number cannot hold it."""
    top = max(map(abs, map(int, (offset.max(initial=0), offset.min(initial=0)))))
    if top * top * offset.shape[1] < WHOLE:
        return (offset * offset).sum(axis=1).tolist()
    exact = (offset.astype(object) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def weighted_product(rows: DataFrame, centred: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of weight * c * c', with c from ``centred``; rows have a column ``weight``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            c = centred(batch)
            total += (c * batch.column("weight").to_numpy()[:, None]).T @ c
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), list_column(total)], names=["i", "part"])

    parts = rows.mapInArrow(run, "i int, part array<double>").select("i", F.posexplode("part").alias("j", "v"))
    out = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["i"], r["j"]] = r["v"]
    return out


def whiten(
    vectors: DataFrame, components: int = 32, factor: int = 64, shift: int = 1_000_000, weights: str = "counts",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Whitened vectors: vec_id, n, deviation, whitened, explained, identity_error; one row for each given one.

    A component c counts as the whole number floor(factor * c) + shift. Covariances are over all
    vectors (``weights="counts"``) or over the distinct ones (``"one"``), divisor the weights' sum
    ``n``. ``whitened`` and ``explained`` are arrays over the first ``components`` principal
    components, by falling eigenvalue; of an eigenvector's two signs that is taken which makes its
    largest entry positive. ``deviation`` is n**2 times the squared distance from the mean, exact, or
    null where it needs more than 64 bits. ``identity_error`` is the largest entry, without
    its sign, of the whitened vectors' covariance minus the identity; it is measured on the vectors.

    Left out are null vectors, vectors with a null or non-finite component or one beyond 2**40, empty
    ones and those of another length than the most frequent one. Rows with a null id and rows
    that share an id stay, each for itself. Where the vectors vary in fewer directions than
    ``components``, the entries of the others are null in ``whitened``, and take no part in
    ``identity_error`` (0 if none has a variance, as for a single vector). An empty table gives no
    rows. Other columns are not read. Vectors longer than MAX_SIZE are an error.
    """
    if weights not in ("counts", "one"):
        raise ValueError(f"weights must be 'counts' or 'one', not {weights!r}")
    rows, size = scaled(vectors, vector_col, factor, shift, LIMIT, vec_id=F.col(f"`{id_col}`"))
    if size > MAX_SIZE:
        raise ValueError(f"vectors of {size} components; at most {MAX_SIZE} can be whitened")
    distinct = rows.groupBy("x").agg(F.count("*").alias("rows"))
    distinct = cut_lineage(distinct.withColumn("weight", F.col("rows") if weights == "counts" else F.lit(1).cast("long")), "distinct")
    kept = min(components, size)
    schema = "x array<long>, rows long, weight long, deviation long, whitened array<double>"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, object), 0
        for batch in batches:
            w = batch.column("weight").to_numpy()
            total, n = total + (matrix(batch.column("x"), size).astype(object) * w[:, None]).sum(axis=0), n + int(w.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size + 1), pa.int32()), pa.array([Decimal(int(v)) for v in [*total, n]], pa.decimal128(38, 0))], names=["i", "v"]
        )

    totals = dict(distinct.mapInArrow(sums, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()) if size else {}
    n, total = int(totals.get(size, 0)), np.array([int(totals.get(i, 0)) for i in range(size)], object)
    if not n:
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("n", "long"), ("deviation", "long"), ("whitened", "array<double>"), ("explained", "array<double>"), ("identity_error", "double")
        )]).limit(0)

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return (offsets(matrix(batch.column("x"), size), n, total) / n).astype(float)

    covariance = weighted_product(distinct, centred, size) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.sign(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], axis=0))
    trace = float(np.trace(covariance))
    # rounding leaves about this much in a direction without variance
    varied = [k for k in range(kept) if values[k] > 4 * size * np.finfo(float).eps * values[0]]
    scale = axes[:, varied] / np.sqrt(values[varied])
    shared = distinct.sparkSession.sparkContext.broadcast(scale)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offset = offsets(matrix(batch.column("x"), size), n, total)
            found = np.full((len(offset), kept), np.nan)
            found[:, varied] = (offset / n).astype(float) @ shared.value
            flat = pa.array(found.ravel(), mask=np.isnan(found.ravel()))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in ("x", "rows", "weight")], pa.array(squares(offset), pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * kept), flat),
            ], names=["x", "rows", "weight", "deviation", "whitened"])

    white = cut_lineage(distinct.mapInArrow(project, schema), "whitened")

    def again(batch: pa.RecordBatch) -> np.ndarray:
        return matrix(batch.column("whitened"), kept)[:, varied]

    error = 0.0
    if varied:
        # the mean of what was centred exactly is zero but for rounding
        error = float(np.abs(weighted_product(white, again, len(varied)) / n - np.eye(len(varied))).max())
    share = [float(max(values[k], 0.0) / trace) if trace > 0 else 0.0 for k in range(kept)]
    return join_counted(rows, white, "x", "rows", n).select(
        "vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(v) for v in share]).alias("explained"), F.lit(error).alias("identity_error"),
    )
