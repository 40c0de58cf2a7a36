"""Running totals and dense positions over a globally ordered table.

A window without a partition pulls all rows into one task, and a window partitioned by a hot
key pulls a third of them there. Here the order is cut into blocks of about equal row count,
each block is totalled by a plain aggregation, the few block totals are chained, and every row
adds its block's offset to a window that never leaves the block. A block is a fixed function
of the order key, so recomputed tasks see the same blocks. Many groups without a large one need
no blocks: there a window over each group is spread well.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.plans.joins import hot_keys
from tokenmill.plans.session import cut_lineage

MAX_BLOCKS = 2048
SAMPLE_PER_BLOCK = 24

BLOCK = "__block"


def block_bounds(df: DataFrame, order: Sequence[Column], blocks: int | None = None) -> list:
    """Cut points of the order, from the keys with the smallest hashes.

    The driver sees at most ``blocks * SAMPLE_PER_BLOCK`` keys.
    """
    spark = df.sparkSession
    blocks = min(blocks or int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_BLOCKS)
    if blocks < 2:
        return []
    names = [f"k{i}" for i in range(len(order))]
    keys = df.select(*[c.alias(n) for n, c in zip(names, order)])
    sample = keys.orderBy(F.xxhash64(*names)).limit(blocks * SAMPLE_PER_BLOCK)
    rows = [tuple(r) for r in sample.collect()]
    if any(v is None for r in rows for v in r):
        raise ValueError("order keys must not be null; replace or drop them first")
    rows.sort()
    cuts = [rows[len(rows) * i // blocks] for i in range(1, blocks)] if rows else []
    return sorted(set(cuts))


def locate(key: Column, bounds: list, types: Sequence) -> Column:
    """Number of bounds at or below the key, by binary search inside one expression."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[
        F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(b, types))])
        for b in bounds
    ])
    n = len(bounds)
    steps = [1 << s for s in range(n.bit_length() - 1, -1, -1)]

    def advance(low, step):
        nxt = low + step
        return F.when((nxt <= n) & (F.get(table, nxt - 1) <= key), nxt).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def with_blocks(df: DataFrame, order: Sequence[Column], blocks: int | None = None) -> DataFrame:
    """Add the block number of each row's order key."""
    bounds = block_bounds(df, order, blocks)
    probe = df.select(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    return df.withColumn(BLOCK, locate(key, bounds, [f.dataType for f in probe.schema]))


def hash_blocks(key_col: str, digits: int = 3) -> Column:
    """Block of a hex hash: its leading digits, evenly filled without sampling."""
    return F.conv(F.left(F.col(key_col), F.lit(digits)), 16, 10).cast("int")


_LOCAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _scan_groups(df: DataFrame, order: Sequence[Column], outputs: dict[str, tuple], by: Sequence[str]) -> DataFrame:
    """Running aggregates of groups that are dealt out whole."""
    group = Window.partitionBy(*by).orderBy(*order)
    new = []
    for name, (kind, expr, inclusive) in outputs.items():
        value = _LOCAL[kind](expr).over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1))
        new.append((F.coalesce(value, F.lit(0)) if kind in ("sum", "count") else value).alias(name))
    return df.select(*[c for c in df.columns if c not in outputs], *new)


def ordered_scan(
    df: DataFrame,
    order: Sequence[Column | str],
    outputs: dict[str, tuple],
    by: Sequence[str] = (),
    block: Column | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Running aggregates in a total order, per ``by`` group.

    ``outputs`` maps a new column to ``(kind, expression, inclusive)`` with kind sum, count,
    min or max. ``order`` must be unique within a group; group columns must not be null.
    ``block`` may name an expression that is monotone in the order, such as ``hash_blocks``.
    Where no group has a large part of the rows, by a sample of them, a group is one window and there are no blocks.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    by = list(by)
    if by and block is None and blocks is None and not hot_keys(df, by, nulls=True):
        return _scan_groups(df, order, outputs, by)
    if block is not None:
        cut = df.withColumn(BLOCK, block)
    else:
        cut = with_blocks(df, [F.col(c) for c in by] + order, blocks)

    totals = cut.groupBy(BLOCK, *by).agg(*[
        _LOCAL[kind](expr).alias(f"__t_{name}") for name, (kind, expr, _) in outputs.items()
    ])
    # One row per block and group; a group reaches into few blocks, so this window is small.
    chain = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        BLOCK, *by,
        F.count(F.lit(1)).over(chain).alias("__seen"),
        *[
            _LOCAL["sum" if kind == "count" else kind](f"__t_{name}").over(chain).alias(f"__o_{name}")
            for name, (kind, _, _) in outputs.items()
        ],
    ).filter("__seen > 0").drop("__seen")
    # At most one group continues into each block, so there are no more offsets than blocks.
    joined = cut.join(F.broadcast(offsets), [BLOCK, *by], "left")

    local = Window.partitionBy(BLOCK, *by).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    new = []
    for name, (kind, expr, inclusive) in outputs.items():
        here = _LOCAL[kind](expr).over(upto if inclusive else before)
        offset = F.col(f"__o_{name}")
        if kind in ("sum", "count"):
            value = F.coalesce(here, F.lit(0)) + F.coalesce(offset, F.lit(0))
        elif kind == "min":
            value = F.least(here, offset)
        else:
            value = F.greatest(here, offset)
        new.append(value.alias(name))
    keep = [c for c in df.columns if c not in outputs]
    return joined.select(*keep, *new)


def dense_index(
    df: DataFrame,
    order: Sequence[Column | str],
    name: str = "idx",
    by: Sequence[str] = (),
    block: Column | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Position of each row in a total order, from 0, without gaps."""
    return ordered_scan(df, order, {name: ("count", F.lit(1), False)}, by, block, blocks)


def prefix_sum(
    df: DataFrame,
    value: Column | str,
    order: Sequence[Column | str],
    name: str = "start",
    by: Sequence[str] = (),
) -> DataFrame:
    """Sum of ``value`` over all rows before this one."""
    value = F.col(value) if isinstance(value, str) else value
    return ordered_scan(df, order, {name: ("sum", value, False)}, by)


#: Maps of thresholds that one task composes at most.
FAN = 256


def _apply(entries: np.ndarray, needs: np.ndarray, need: float, side: str) -> float:
    """The threshold behind a stretch of rows that is entered with ``need``."""
    at = int(np.searchsorted(entries, need, side=side))
    return needs[at] if at < len(entries) else need


def _compose(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], reach: float, side: str):
    """Two neighbouring stretches as one. A stretch is (entries, needs): entered with a threshold up to
    entries[i], it is left with needs[i]; thresholds beyond its last entry pass through.

    No threshold above ``reach`` can occur, so entries beyond the first one there are left out.
    """
    (ea, na), (eb, nb) = first, second
    at = np.searchsorted(eb, na, side=side)
    through = np.where(at < len(eb), np.append(nb, np.nan)[at], na)
    own = np.searchsorted(eb, ea[-1], side="right")
    return _shorten(np.concatenate([ea, eb[own:]]), np.concatenate([through, nb[own:]]), reach)


def _shorten(entries: np.ndarray, needs: np.ndarray, reach: float):
    """Without entries that lead to the same threshold as the next one, or that no threshold meets."""
    last = min(len(entries) - 1, int(np.searchsorted(entries, reach, side="right")))
    entries, needs = entries[: last + 1], needs[: last + 1]
    ends = np.append(np.flatnonzero(np.diff(needs)), len(needs) - 1)
    return entries[ends], needs[ends]


def greedy_chain(
    df: DataFrame,
    pos: str,
    level: str,
    step: float,
    by: Sequence[str] = (),
    strict: bool = False,
    chunk: int = 8192,
    base: str | None = None,
    fan: int = FAN,
) -> DataFrame:
    """Mark the rows of a greedy chain over a non-decreasing level.

    Row 0 belongs to the chain; after a member the next member is the first later row whose
    level is at least the member's ``base`` + step (above it when ``strict``). The base is the level
    itself, or another non-decreasing column that is at most the level. ``pos`` is the dense position per group.

    A chain looks sequential, but a stretch of rows acts on it only through the threshold it is
    entered with, by a map that is a short list of entries. Chunks are turned into maps in parallel;
    ``fan`` neighbouring maps are composed by a task, level by level, until a group has one; the
    thresholds then go down the same tree, and chunks are marked in parallel. No task reads more
    than a chunk or ``fan`` maps.
    """
    by = list(by)
    base = base or level
    side = "right" if strict else "left"
    columns = list(dict.fromkeys([pos, level, base]))
    slim = df.select(*by, *columns, F.expr(f"{pos} div {chunk}").alias("__chunk"))
    by_ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)

    def jumps(levels: np.ndarray, bases: np.ndarray) -> np.ndarray:
        """The next member after each row, or the number of rows."""
        return np.maximum(np.searchsorted(levels, bases + step, side=side), np.arange(len(levels)) + 1)

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        levels, bases = pdf[level].to_numpy(dtype=float), pdf[base].to_numpy(dtype=float)
        nxt = jumps(levels, bases)
        # the last member of the chunk for each entry row, by doubling strides
        last = np.where(nxt < len(nxt), nxt, np.arange(len(nxt)))
        for _ in range(len(nxt).bit_length()):
            last = last[last]
        reach = levels[0] + step
        entries, needs = _shorten(levels, bases[last] + step, reach)
        head = pdf.iloc[0]
        return pd.DataFrame({
            **{b: [head[b]] for b in by}, "__chunk": [int(head["__chunk"])],
            "entries": [entries.tolist()], "needs": [needs.tolist()], "reach": [float(reach)],
        })

    maps = f"{by_ddl}__chunk bigint, entries array<double>, needs array<double>, reach double"
    levels_up = [slim.groupBy(*by, "__chunk").applyInPandas(summarize, maps)]

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__chunk")
        both, reach = None, float(pdf["reach"].iloc[0])
        for e, n in zip(pdf["entries"], pdf["needs"]):
            own = np.asarray(e), np.asarray(n)
            both = own if both is None else _compose(both, own, reach, side)
        head = pdf.iloc[0]
        return pd.DataFrame({
            **{b: [head[b]] for b in by}, "__chunk": [int(head["__chunk"]) // fan],
            "entries": [both[0].tolist()], "needs": [both[1].tolist()], "reach": [reach],
        })

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        """Thresholds at the start of each of a task's neighbouring stretches, from the one at the first."""
        pdf = pdf.sort_values("__chunk")
        need, found = pdf["need"].iloc[0], []
        need = None if pd.isna(need) else float(need)
        for e, n in zip(pdf["entries"], pdf["needs"]):
            found.append(need)
            # a chain starts at its first row, whatever its level
            need = n[0] if need is None else _apply(np.asarray(e), np.asarray(n), need, side)
        return pd.DataFrame({**{b: pdf[b].to_numpy() for b in by}, "__chunk": pdf["__chunk"].to_numpy(), "need": found})

    most = df.agg(F.max(pos)).first()[0]
    stretches = 1 if most is None else int(most) // chunk + 1
    group = F.expr(f"__chunk div {fan}").alias("__group")
    # maps that go up another level are read twice
    while stretches > 1:
        levels_up[-1] = cut_lineage(levels_up[-1], "maps") if stretches > fan else levels_up[-1]
        stretches = -(-stretches // fan)
        if stretches > 1:
            levels_up.append(levels_up[-1].withColumn("__group", group).groupBy(*by, "__group").applyInPandas(up, maps))
    entered = None
    if most is not None and int(most) >= chunk:
        for maps_at in reversed(levels_up):
            rows = maps_at.withColumn("__group", group)
            if entered is None:
                rows = rows.withColumn("need", F.lit(None).cast("double"))
            else:
                rows = rows.join(entered.select(*by, F.col("__chunk").alias("__group"), "need"), [*by, "__group"])
            entered = rows.groupBy(*by, "__group").applyInPandas(down, f"{by_ddl}__chunk bigint, need double")

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        levels, bases = pdf[level].to_numpy(dtype=float), pdf[base].to_numpy(dtype=float)
        nxt = jumps(levels, bases).tolist()
        need = pdf["need"].iloc[0]
        at = 0 if pd.isna(need) else int(np.searchsorted(levels, need, side=side))
        hits = []
        while at < len(levels):
            hits.append(at)
            at = nxt[at]
        return pdf.iloc[hits][[*by, pos]]

    if entered is None:
        # one chunk for each group: nothing comes in from before
        slim = slim.withColumn("need", F.lit(None).cast("double"))
    else:
        slim = slim.join(entered, [*by, "__chunk"])
    return slim.groupBy(*by, "__chunk").applyInPandas(mark, f"{by_ddl}{pos} bigint")
