"""Nearest neighbours by a permutation index.

Every vector is represented by its pivots in order of nearness. The positions are posted in one
inverted file for each pivot; a query reads the files of its own nearest pivots, adds up how far
each vector's positions are from its own (Spearman's footrule), and the vectors with the
smallest sums are compared in full. They give a score that the nearest reach at least; every other
vector that is long enough to reach it is compared, too, so the answer is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.plans.session import cut_lineage

#: Distinct vectors of an index block, and queries that meet a block in one task.
BLOCK_ROWS, QUERY_ROWS = 16384, 1024
#: Queries whose products with a block are taken at once, and their rounding relative to the lengths.
LOT, ROUNDING = 64, 1e-10


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part.

    Left out are null vectors, null ids, zero vectors and vectors with a null or non-finite
    component, and vectors of another length than the most frequent one (of several, the longest).
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(fine(x), F.lit(False)))
        & F.exists("v", lambda x: x != 0.0)
    )
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def choose_pivots(distinct: DataFrame, pivots: int) -> np.ndarray:
    """Pivots spread over a bounded sample: of the 8 * pivots vectors with the smallest hashes,
    each next one is the farthest from those chosen so far."""
    rows = distinct.orderBy(F.xxhash64("v"), "v").limit(8 * pivots).select("v").collect()
    if not rows:
        return np.empty((0, 0))
    x = np.array([r["v"] for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(pivots, len(x)):
        near[chosen] = np.inf
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return x[chosen]


def positions(x: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """For each pivot the position it has in each vector's order; ``posted`` for any beyond that many."""
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :posted]
    out = np.full((len(x), len(pivots)), posted, np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None], axis=1)
    return np.ascontiguousarray(out.T)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = 256, posted: int = 128, asked: int = 64,
    share: float = 0.08, least: int = 1000, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The k nearest other vectors (largest inner product) of each query among all vectors.

    Returns query_id, rank (from 1), vec_id and score; ties go to the smaller vec_id. ``is_query``
    is a condition on ``vec_id``. ``pivots`` are fitted on a bounded sample; every vector is
    indexed. Of each block the ``share`` with the smallest footrule sums (but not below ``least``
    and k + 1 vectors) are compared first, in double precision, and then every vector whose length times
    the query's reaches the last score found, so these parameters change the cost and not the answer.
    ``posted`` is how many pivots of a vector are posted, ``asked`` how many a query reads.

    Equal vectors are indexed once with their k + 1 smallest ids: with one of them the query's
    own, k remain, so no other can be among the k nearest. Blocks are dealt by hash, so any share
    of the vectors on one spot is spread; every block answers for itself, and the answers are merged.

    See ``usable`` for the vectors that take no part. A repeated id counts as one row for each of
    its vectors, and a query never finds its own id. An empty table gives no rows. Other columns
    are not read.
    """
    rows = cut_lineage(usable(vectors, id_col, vector_col), "vectors")
    same = Window.partitionBy("v").orderBy("vec_id")
    first = rows.dropDuplicates(["vec_id", "v"]).withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    distinct = cut_lineage(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct")
    asking = rows.where(is_query).dropDuplicates(["vec_id", "v"])
    counts = distinct.count(), asking.count()
    blocks, lots = max(1, math.ceil(counts[0] / block_rows)), max(1, math.ceil(counts[1] / query_rows))
    pivot_rows = choose_pivots(distinct, pivots)
    posted, asked = min(posted, len(pivot_rows)), min(asked, len(pivot_rows))
    shared = rows.sparkSession.sparkContext.broadcast(pivot_rows)
    kind = rows.schema["vec_id"].dataType.simpleString()

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    left = asking.select("vec_id", "v", deal(lots, "vec_id").alias("lot"), every(blocks).alias("block"))
    right = distinct.select("ids", "v", deal(blocks, "v").alias("block"), every(lots).alias("lot"))

    def answer(queries: pa.Table, index: pa.Table) -> pa.Table:
        out_query, out_id, out_score = [], [], []
        if queries.num_rows and index.num_rows:
            # sorted by smallest id, so that a stable order breaks ties by id
            index = index.take(pa.array(np.argsort([i[0] for i in index.column("ids").to_pylist()], kind="stable")))
            x, q, ids = _matrix(index.column("v")), _matrix(queries.column("v")), index.column("ids").to_pylist()
            files = positions(x, shared.value, posted)
            orders = np.argsort(-(q @ shared.value.T), axis=1, kind="stable")[:, :asked]
            keep = min(len(x), max(k + 1, least, math.ceil(share * len(x))))
            length, own_length = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
            # longest first, so that those long enough for a query come first
            by_length = np.argsort(-length, kind="stable")
            falling, sorted_x = -length[by_length], x[by_length]
            names = queries.column("vec_id").to_pylist()

            def nearest_of(rows: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
                score = np.einsum("ij,j->i", x[rows], q[row])
                best = np.lexsort((rows, -score))[: k + 1]
                return rows[best], score[best]

            for lo in range(0, len(q), LOT):
                lot = range(lo, min(lo + LOT, len(q)))
                first = []
                for row in lot:
                    footrule = np.zeros(len(x), np.int32)
                    for place, pivot in enumerate(orders[row]):
                        footrule += np.abs(files[pivot] - np.int16(place))
                    # distances are small numbers; adding the row number makes the order total
                    total = footrule.astype(np.int64) * len(x) + np.arange(len(x))
                    near = np.sort(np.argpartition(total, keep - 1)[:keep]) if keep < len(x) else np.arange(len(x))
                    first.append(nearest_of(near, row))
                if keep < len(x):
                    floor = np.array([score[-1] for _, score in first]) - ROUNDING * length.max() * own_length[lo : lot.stop]
                    reach = np.where(floor > 0, np.searchsorted(falling, -floor / own_length[lo : lot.stop], side="right"), len(x))
                    products = q[lo : lot.stop] @ sorted_x[: reach.max()].T
                    for i, row in enumerate(lot):
                        more = by_length[np.flatnonzero(products[i, : reach[i]] >= floor[i])]
                        first[i] = nearest_of(np.union1d(first[i][0], more), row)
                for row, (near, score) in zip(lot, first):
                    own = names[row]
                    found = sorted((-float(s), i) for b, s in zip(near, score) for i in ids[b] if i != own)[:k]
                    out_query += [own] * len(found)
                    out_id += [i for _, i in found]
                    out_score += [-s for s, _ in found]
        id_type = queries.schema.field("vec_id").type
        return pa.table({
            "query_id": pa.array(out_query, id_type), "vec_id": pa.array(out_id, id_type), "score": pa.array(out_score, pa.float64()),
        })

    answers = left.groupBy("lot", "block").cogroup(right.groupBy("lot", "block")).applyInArrow(
        answer, f"query_id {kind}, vec_id {kind}, score double"
    )
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a query whose id stands for several vectors may find a vector twice
    best = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
