"""Sharding by extendible hashing.

A shard is a prefix of hash bits. The directory starts as one bucket; only a bucket over the
byte limit splits on its next bit, until every bucket fits, so crowded prefixes are deep and
the others stay shallow. A histogram over enough leading bits holds every split of one level
at once; prefixes that are still too large are refined with further bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.plans.joins import broadcast_up_to
from tokenmill.plans.session import cut_lineage

#: Bits of the key's hash, and of the row's hash that continues it.
BITS = 60
#: Most bits that one level adds; its histogram has at most 2 ** LEVEL_BITS rows.
LEVEL_BITS = 20
BROADCAST_ROWS = 100_000


def hash_bits(text: Column) -> Column:
    """The first 60 bits of the md5."""
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(15)), 16, 10).cast("long")


def _prefix(base: int, width: int) -> Column:
    """Bits ``base`` to ``base + width`` of the two hashes taken as one string of 120 bits."""
    if base + width <= BITS:
        return F.shiftrightunsigned("h1", BITS - base - width).bitwiseAND(F.lit((1 << width) - 1))
    return F.shiftrightunsigned("h2", 2 * BITS - base - width).bitwiseAND(F.lit((1 << width) - 1))


def assign(
    docs: DataFrame, limit_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text",
    level_bits: int = LEVEL_BITS,
) -> DataFrame:
    """Shard of every document: doc_id, n_bytes, shard (its bits), depth, shard_bytes.

    Every shard has at most ``limit_bytes`` of UTF-8 text, unless it holds one single document
    that is longer by itself. Rows that share an id share all bits of the first hash; the bits
    of a second hash, of the row's position in its task, then split them.

    A null or empty text has 0 bytes; a null id is hashed as the empty text. Repeated rows are
    kept, each with a shard. An empty table gives no rows. Other columns are not read.
    """
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    spark = docs.sparkSession
    narrow = cut_lineage(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n_bytes"),
        hash_bits(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("h1"),
        hash_bits(F.monotonically_increasing_id().cast("string")).alias("h2"),
    ), "rows")
    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    base, rest = 0, narrow
    done: DataFrame | None = None
    while True:
        width = min(level_bits, max(1, math.ceil(math.log2(max(1, total / limit_bytes))) + 2))
        width = min(width, BITS - base if base < BITS else 2 * BITS - base)
        hist = rest.withColumn("p", _prefix(base, width)).groupBy("at", "p") if base else rest.withColumn(
            "p", _prefix(base, width)).groupBy("p")
        hist = hist.agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        keys = ["at"] if base else []
        hist = cut_lineage(hist, "histogram")
        # every ancestor of a histogram row, and the shallowest one that fits
        up = hist.select("*", F.explode(F.sequence(F.lit(0 if not base else 1), F.lit(width))).alias("d")).withColumn(
            "node", F.expr(f"shiftright(p, {width} - d)")
        )
        sums = up.groupBy(*keys, "d", "node").agg(F.sum("b").alias("node_b"), F.sum("n").alias("node_n"))
        fits = up.join(sums, [*keys, "d", "node"]).where((F.col("node_b") <= limit_bytes) | (F.col("node_n") == 1))
        leaf = fits.groupBy(*keys, "p").agg(F.min(F.struct("d", "node", "node_b")).alias("leaf"))
        directory = cut_lineage(hist.join(leaf, [*keys, "p"], "left").select(
            *keys, "p", "b", F.col("leaf.d").alias("d"), F.col("leaf.node").alias("node"),
            F.col("leaf.node_b").alias("shard_bytes"),
        ), "directory")
        found = rest.withColumn("p", _prefix(base, width)).join(
            broadcast_up_to(directory, BROADCAST_ROWS), [*keys, "p"]
        )
        path = F.col("at") if base else F.lit("")
        text = lambda node, d: F.expr(f"if({d} = 0, '', lpad(bin({node}), {d}, '0'))")
        ready = found.where("d is not null").select(
            "doc_id", "n_bytes", F.concat(path, text("node", "d")).alias("shard"),
            (F.lit(base) + F.col("d")).cast("int").alias("depth"), "shard_bytes",
        )
        done = ready if done is None else done.unionByName(ready)
        over = directory.where("d is null").agg(F.count("*"), F.max("b")).first()
        if not over[0]:
            return done
        if base + width >= 2 * BITS:
            raise ValueError("no bits are left to split a shard")
        total = over[1]
        rest = cut_lineage(found.where("d is null").select(
            "doc_id", "n_bytes", "h1", "h2", F.concat(path, text("p", str(width))).alias("at")
        ), "crowded")
        base += width
