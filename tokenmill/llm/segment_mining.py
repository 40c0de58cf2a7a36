"""Hard-negative mining with segment summaries.

Every vector is stored with the sum and the deviation of each of its segments, at several
levels of ever shorter segments. For one segment the inner product of two vectors is their sums'
product over its length, plus or minus at most the product of their deviations. Added over the
segments this bounds the score from both sides. A pair is taken to the next level only while its
bounds allow it to matter, and only pairs that pass all levels are scored in full.

The table is never shuffled: the anchors, cut into lots of a bounded size, go to the tasks that read it. A
task keeps the few best of its rows for each anchor, so what is merged is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.llm.vectors import list_column, matrix, scaled
from tokenmill.plans.session import cut_lineage

#: Segments of a vector at each level.
LEVELS = (1, 4, 16)
#: Rows and anchors that are compared at once, and bytes of anchors that go to all tasks in one lot.
ROWS, ANCHORS, LOT_BYTES = 2048, 256, 1 << 25
#: Rows whose scores give a first bound for every anchor.
SEED_ROWS = 2048
#: Scores stay below this, so that products with a percentage fit 64 bits; sums below EXACT are exact in doubles.
TOP_SCORE, EXACT = 1 << 56, 1 << 53
#: Beyond all scores.
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def summaries(x: np.ndarray, levels: tuple[int, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sum over root of length, and deviation, of the segments of each level.

    The inner product of two rows' first values is their means' product, that of the second values
    the most by which the score can differ from it.
    """
    scaled_sums, deviations = [], []
    for n in levels:
        cuts = np.unique(np.linspace(0, x.shape[1], n + 1).astype(int))
        length = np.diff(cuts)
        total = np.add.reduceat(x, cuts[:-1], axis=1)
        square = np.add.reduceat(x * x, cuts[:-1], axis=1)
        scaled_sums.append(total / np.sqrt(length))
        deviations.append(np.sqrt(np.maximum(square - total * total / length, 0)))
    return scaled_sums, deviations


def index(rows: DataFrame, size: int, levels: tuple[int, ...]) -> DataFrame:
    """The rows with their segments' summaries, all levels one after another: sums, deviations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, deviations = (np.concatenate(p, axis=1) for p in summaries(matrix(batch.column("x"), size).astype(float), levels))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, list_column(sums), list_column(deviations)], names=[*batch.schema.names, "sums", "deviations"]
            )

    return rows.mapInArrow(run, T.StructType([*rows.schema, *T.StructType.fromDDL("sums array<double>, deviations array<double>")]))


@dataclass
class Side:
    """Vectors of one side of a comparison; sums and deviations hold all levels side by side."""

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    sums: np.ndarray
    deviations: np.ndarray

    def __getitem__(self, at) -> Side:
        return Side(*[getattr(self, f)[at] for f in self.__dataclass_fields__])


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, as whole numbers."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if top < EXACT:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def passing(anchors: Side, rows: Side, low: np.ndarray, high: np.ndarray, ends: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (place of anchor, place of row, score) with scores from low to high of the anchor, and few others.

    Bounds are refined level by level. An anchor or row without a pair left is dropped before the next.
    """
    a, r = np.arange(len(anchors.row)), np.arange(len(rows.row))
    start = 0
    for end in ends:
        one, two = anchors[a], rows[r]
        middle = one.sums[:, start:end] @ two.sums[:, start:end].T
        reach = one.deviations[:, start:end] @ two.deviations[:, start:end].T
        # bounds are doubles: allow for their rounding
        reach += 1e-9 * (np.abs(middle) + reach) + 1e-6
        open_ = (middle + reach >= low[a, None]) & (middle - reach <= high[a, None])
        keep_a, keep_r = open_.any(axis=1), open_.any(axis=0)
        a, r, open_ = a[keep_a], r[keep_r], open_[np.ix_(keep_a, keep_r)]
        if not len(a):
            return
        start = end
    at, other = np.nonzero(open_)
    if len(at) * 8 < open_.size:
        score = np.concatenate([
            (anchors.x[a[at[i : i + 8192]]] * rows.x[r[other[i : i + 8192]]]).sum(axis=1) for i in range(0, len(at), 8192)
        ])
    else:
        score = exact_scores(anchors.x[a], rows.x[r])[at, other]
    at, other = a[at], r[other]
    fits = (score >= low[at]) & (score <= high[at])
    yield at[fits], other[fits], score[fits]


class Best:
    """The best rows of each target so far: highest scores, ties by smaller id, then by row number."""

    def __init__(self, targets: int, keep: int):
        self.targets, self.keep = targets, keep
        self.found = [np.empty(0, np.int64) for _ in range(4)]
        self.floor = np.full(targets, LOWEST)

    def add(self, target: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if not len(target):
            return
        found = [np.concatenate(p) for p in zip(self.found, (target, score, vec_id, row))]
        order = np.lexsort((found[3], found[2], -found[1], found[0]))
        found = [f[order] for f in found]
        first = np.searchsorted(found[0], found[0])
        stays = np.arange(len(order)) - first < self.keep
        self.found = [f[stays] for f in found]
        last = np.flatnonzero(np.arange(len(order)) - first == self.keep - 1)
        self.floor[found[0][last]] = found[1][last]


def nearest_positives(anchors: Side, batches: Iterator[Side], keep: int, floor: np.ndarray, ends: list[int]) -> Best:
    """For each anchor the best other rows of its label; those below ``floor`` are not needed."""
    best = Best(len(anchors.row), keep)
    high = np.full(len(anchors.row), HIGHEST)
    for rows in batches:
        for label in np.intersect1d(anchors.label, rows.label):
            own, of = np.flatnonzero(anchors.label == label), rows[rows.label == label]
            for i in range(0, len(own), ANCHORS):
                lot = own[i : i + ANCHORS]
                low = np.maximum(floor, best.floor)
                for at, other, score in passing(anchors[lot], of, low[lot], high[lot], ends):
                    other_row = of.row[other] != anchors.row[lot[at]]
                    at, other, score = at[other_row], other[other_row], score[other_row]
                    best.add(lot[at], score, of.vec_id[other], of.row[other])
    return best


def hardest_negatives(
    anchors: Side, positive: np.ndarray, band: tuple[int, int, int], batches: Iterator[Side], keep: int, floor: np.ndarray, ends: list[int]
) -> Best:
    """For each anchor and positive (a row and column of ``positive``, scores or the lowest number) the best of other labels inside the band.

    Targets are numbered anchor by anchor; scores below a target's ``floor`` are not needed.
    """
    least, most, of = band
    per = positive.shape[1]
    none = positive == LOWEST
    low = np.where(none, HIGHEST, -(-least * np.where(none, 0, positive) // of))
    high = np.where(none, LOWEST, most * np.where(none, 0, positive) // of)
    best = Best(positive.size, keep)
    widest = high.max(axis=1, initial=LOWEST)
    for rows in batches:
        for i in range(0, len(anchors.row), ANCHORS):
            lot = np.arange(i, min(i + ANCHORS, len(anchors.row)))
            need = np.maximum(low, np.maximum(floor, best.floor).reshape(-1, per))
            for at, other, score in passing(anchors[lot], rows, need[lot].min(axis=1, initial=HIGHEST), widest[lot], ends):
                differs = rows.label[other] != anchors.label[lot[at]]
                at, other, score = lot[at[differs]], other[differs], score[differs]
                for j in range(per):
                    fits = (score >= need[at, j]) & (score <= high[at, j])
                    best.add(at[fits] * per + j, score[fits], rows.vec_id[other[fits]], rows.row[other[fits]])
    return best


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, band: tuple[int, int, int] = (80, 100, 100),
    factor: int = 256, levels: tuple[int, ...] = LEVELS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    lot_bytes: int = LOT_BYTES, seed_rows: int = SEED_ROWS,
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A component c counts as the whole number floor(factor * c); a score is the inner product with the
    anchor, so it is exact. Higher scores come first, ties by smaller id. ``is_anchor`` is a condition on
    ``vec_id`` and ``label``. An anchor's positives are its first ``positives`` other rows of its label;
    for each of them the first ``negatives`` rows of other labels are given that satisfy
    band[0] * positive_score <= band[2] * negative_score <= band[1] * positive_score. All rows are
    searched; ``levels``, ``lot_bytes`` and ``seed_rows`` change the cost only.

    Rows with a null id, label or vector take no part, nor do vectors with a null or non-finite
    component or one so large that scores would not fit (2**28 over the root of the length, as whole
    numbers), nor vectors of another length than the most frequent one. A row stands for itself: rows
    that share an id can be each other's positives or negatives, and an anchor's id that occurs in
    several rows gives a result for each. Ids and labels are whole numbers. An anchor without
    positives, or without rows in the band, gives no rows, and so does an empty table. Other columns are not read.
    """
    rows, size = scaled(
        vectors, vector_col, factor, 0, float(1 << 40), vec_id=F.col(f"`{id_col}`").cast("long"), label=F.col(f"`{label_col}`").cast("long")
    )
    if not size:
        return rows.sparkSession.createDataFrame([], MINED)
    most = int((TOP_SCORE / max(size, 1)) ** 0.5)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("x", lambda v: F.abs(v) <= F.lit(most)))
    # the number of a row is fixed by writing it
    rows = cut_lineage(index(rows.withColumn("row", F.monotonically_increasing_id()), size, levels), "index")
    spark = rows.sparkSession
    ends = list(np.cumsum([len(np.unique(np.linspace(0, size, n + 1).astype(int))) - 1 for n in levels]).tolist())
    names = ["row", "vec_id", "label", "x", "sums", "deviations"]

    def side(batch: pa.RecordBatch | pa.Table) -> Side:
        numbers = [batch.column(c).to_numpy() for c in names[:3]]
        lists = [batch.column(c) for c in names[3:]]
        lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in lists]
        return Side(*numbers, *[matrix(c, n) for c, n in zip(lists, (size, ends[-1], ends[-1]))])

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[Side]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                yield side(batch.slice(lo, ROWS))

    seed = side(rows.orderBy(F.xxhash64("row"), "row").limit(seed_rows).select(*names).toArrow())
    asking = cut_lineage(rows.where(is_anchor).select(*names), "anchors")
    per_lot = max(1, lot_bytes // (8 * (size + 2 * ends[-1] + 3)) if size else 1)
    lots = -(-asking.count() // per_lot)
    out = None
    for lot in range(lots):
        own = asking if lots == 1 else asking.where(F.pmod(F.xxhash64("row"), F.lit(lots)) == lot)
        anchors = side(own.toArrow())
        if not len(anchors.row):
            continue
        floor = nearest_positives(anchors, iter([seed]), positives, np.full(len(anchors.row), LOWEST), ends).floor
        shared = spark.sparkContext.broadcast((anchors, floor))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _rows_of(nearest_positives(shared.value[0], sides(batches), positives, shared.value[1], ends))

        best = _merge(rows.select(*names).mapInArrow(near, FOUND), positives)
        chosen = best.toArrow()
        if not chosen.num_rows:
            continue
        target, rank = chosen.column("target").to_numpy(), chosen.column("rank").to_numpy() - 1
        scores = np.full((len(anchors.row), positives), LOWEST)
        ids = np.zeros((len(anchors.row), positives), np.int64)
        scores[target, rank], ids[target, rank] = chosen.column("score").to_numpy(), chosen.column("vec_id").to_numpy()
        start = np.full(scores.size, LOWEST)
        floor = hardest_negatives(anchors, scores, band, iter([seed]), negatives, start, ends).floor
        given = spark.sparkContext.broadcast((anchors, scores, floor))

        def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            anchors, scores, floor = given.value
            yield _rows_of(hardest_negatives(anchors, scores, band, sides(batches), negatives, floor, ends))

        found = _merge(rows.select(*names).mapInArrow(hard, FOUND), negatives)
        place = np.arange(scores.size)
        named = spark.createDataFrame(pa.table({
            "target": place, "anchor_id": anchors.vec_id[place // positives], "positive_id": ids.ravel(), "positive_score": scores.ravel(),
        }))
        part = cut_lineage(found.join(named, "target").select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ), "mined")
        shared.unpersist(), given.unpersist()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], MINED)


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "target long, score long, vec_id long, row long"


def _rows_of(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in best.found], names=["target", "score", "vec_id", "row"])


def _merge(found: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` rows of each target among those of all tasks."""
    order = Window.partitionBy("target").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
