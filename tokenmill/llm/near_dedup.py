"""Near-duplicate groups by circulant MinHash, banding and exact verification.

1. Every text becomes its set of word shingles and a signature of two permutations; equal sets
   are one class from here on.
2. Classes that agree on a band of their signatures meet in a bucket. Buckets with the same
   members count once. A large bucket is dealt into blocks, each of which also gets the bucket's
   first member, so the work stays linear in the rows of the buckets.
3. Inside a block all similarities are exact, from full sets; only links that join something
   not joined before are given out.
4. Large buckets that still hold several components after that compare their blocks with each
   other, so no pair that shares a bucket goes unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.batches import take, text_groups
from tokenmill.llm.byte_cnn import text_bytes
from tokenmill.llm.circulant import Circulant, band_hashes, shingles
from tokenmill.llm.components import components
from tokenmill.plans.joins import broadcast_up_to
from tokenmill.plans.session import cut_lineage

#: 40 bands of 6 coordinates miss a pair at similarity 0.8 with probability 5e-6.
BANDS, ROWS = 40, 6
#: Members and shingles of a block.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 300_000
#: Bits of the map of wanted ids (2 MB), and buckets up to which their list goes to every task.
BITMAP_BITS, BROADCAST_ROWS = 1 << 24, 500_000


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set) and bands of every text (from ``take``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = Circulant(bands * rows)
        for batch in text_groups(batches):
            sets = shingles(*text_bytes(batch.column("text")), width)
            keys = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            marks = [band_hashes(minhash.signature(s), bands).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                pa.array(marks, pa.list_(pa.int64())),
            ], names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>")


def exact_links(sets: list[np.ndarray], roots: list, ids: list, parts: list[int], share: tuple[int, int]) -> Iterator[tuple]:
    """Links between sets whose intersection is at least share[0] / share[1] of the union.

    Sets with equal roots are joined already; a link that joins nothing new is left out. With
    parts, only sets of different parts are compared. Intersections are counted on bit rows over
    the shingles that occur in more than one set.
    """
    size = np.array([len(s) for s in sets], np.int64)
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    width = max(1, -(-int(column[-1] + 1) // 64))
    bits = np.zeros((len(sets), width), np.uint64)
    row = np.repeat(np.arange(len(sets)), size)
    shared = times[at] > 1
    place = column[at[shared]]
    np.bitwise_or.at(bits, (row[shared], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    root = {r: r for r in roots}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    part = np.array(parts)
    step = max(1, (1 << 21) // width)
    for i in range(len(sets) - 1):
        for lo in range(i + 1, len(sets), step):
            other = slice(lo, lo + step)
            both = np.bitwise_count(bits[other] & bits[i]).sum(axis=1, dtype=np.int64)
            near = share[1] * both >= share[0] * (size[i] + size[other] - both)
            near &= (part[other] != part[i]) | (part[i] < 0)
            for j in np.flatnonzero(near) + lo:
                a, b = find(roots[i]), find(roots[j])
                if a != b:
                    root[a] = b
                    yield ids[i], ids[j]


def _verify(cells: DataFrame, texts: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """Links found inside cells. ``cells``: cell, doc_id, root, part (below 0: compare with all)."""
    kind = cells.schema["doc_id"].dataType.simpleString()
    rows = cells.join(texts, "doc_id").repartition("cell").sortWithinPartitions("cell", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(cell):
            out = list(exact_links(*cell, share)) if len(cell[0]) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], id_type) for k in (0, 1)], names=["a", "b"]
            )

        key, cell = None, ([], [], [], [])
        for batch in text_groups(batches):
            id_type = batch.schema.field("doc_id").type
            sets = shingles(*text_bytes(batch.column("text")), width)
            for k, *row in zip(batch.column("cell").to_pylist(), sets, *[batch.column(c).to_pylist() for c in ("root", "doc_id", "part")]):
                if k != key:
                    if len(cell[0]) > 1:
                        yield close(cell)
                    key, cell = k, ([], [], [], [])
                for own, x in zip(cell, row):
                    own.append(x)
        if len(cell[0]) > 1:
            yield close(cell)

    return rows.select("cell", "doc_id", "root", "part", "text").mapInArrow(run, f"a {kind}, b {kind}")


def _texts_of(docs: DataFrame, seats: DataFrame) -> DataFrame:
    """The texts of the seated documents, and few others, without a shuffle of all texts.

    The ids are put into a bitmap of a fixed number of bits, which every task gets; a row passes
    where its bit is set. With very many ids more rows pass than needed, never fewer.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS))
    maps = seats.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")
    ).collect()
    # parts count from 1; a part is 4096 bytes
    bitmap = np.zeros((BITMAP_BITS // 32768 + 2, 4096), np.uint8)
    for r in maps:
        bitmap[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    rows = docs.withColumns({"part": F.bitmap_bucket_number(bit).cast("int"), "place": F.bitmap_bit_position(bit).cast("int")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "place"))
            passes = shared.value[part, place >> 3] >> (place & 7) & 1
            yield batch.select(["doc_id", "text"]).filter(pa.array(passes.astype(bool)))

    return rows.where("doc_id is not null").mapInArrow(run, docs.schema)


def groups(
    docs: DataFrame, width: int = 5, share: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text",
    bands: int = BANDS, rows: int = ROWS, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Near-duplicate group of every document: doc_id, n_shingles, component_id, kept.

    Documents are linked when the intersection of their shingle sets is at least ``share`` of the
    union; component_id is the smallest id reachable over links, kept marks it. ``bands`` of
    ``rows`` coordinates decide which pairs are looked at; every link is confirmed on full sets.

    A null or empty text, or one without words, has an empty set and is linked with nothing.
    Rows that share an id are one document: a link of one is a link of all. A row with a null id
    belongs to a group only by an equal set, is never its name, and is kept where no row with an
    id has its set. An empty table gives no rows. Other columns are not read.
    """
    docs = take(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    marks = cut_lineage(signatures(docs, width, bands, rows), "signatures")
    first = marks.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    member = marks.select("doc_id", "n_shingles", "set_key").join(first, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")
    )
    # one row for each class; classes of one id (repeated ids) stay apart here
    reps = cut_lineage(
        marks.join(first, "set_key").where("doc_id = rep").dropDuplicates(["set_key"]).select("doc_id", "n_shingles", "bands"), "classes"
    )
    placed = reps.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    met = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = cut_lineage(met, "buckets")
    met = cut_lineage(placed.join(broadcast_up_to(met, BROADCAST_ROWS), "bucket"), "buckets")
    buckets = met.groupBy("bucket", "n").agg(
        F.sum("n_shingles").alias("size"), F.min("doc_id").alias("first"),
        F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.sum(F.xxhash64("doc_id", F.lit(1)) % (1 << 31)).alias("y"),
    )
    # buckets with the same members are looked at once
    buckets = buckets.groupBy("n", "size", "first", "x", "y").agg(F.min("bucket").alias("bucket"))
    blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("size") / block_shingles)).cast("int")
    seats = cut_lineage(
        met.join(buckets.select("bucket", "first", blocks.alias("blocks")), "bucket").select(
            "bucket", "doc_id", "first", "blocks",
            F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).cast("int").alias("block"),
        ), "seats",
    )
    texts = cut_lineage(_texts_of(docs, seats), "texts")

    # within blocks; a first member of a split bucket sits in all of them
    stay = F.when(F.col("doc_id") == F.col("first"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    within = seats.select("bucket", "doc_id", F.explode(stay).alias("block")).select(
        F.xxhash64("bucket", "block").alias("cell"), "doc_id", F.col("doc_id").alias("root"), F.lit(-1).alias("part")
    )
    links = cut_lineage(_verify(within, texts, width, share), "links")
    label = components(links)

    # across blocks of buckets that still hold several components
    split = seats.where("blocks > 1")
    if not split.isEmpty():
        rooted = split.join(label, split["doc_id"] == label["node"], "left").select(
            "bucket", "doc_id", "blocks", "block", F.coalesce("component", "doc_id").alias("root")
        )
        mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        rooted = rooted.join(mixed.select("bucket"), "bucket", "left_semi")
        pairs = F.transform(
            F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("block")),
            lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")),
        )
        across = rooted.select("bucket", "doc_id", "root", "block", F.explode(pairs).alias("p")).select(
            F.xxhash64("bucket", "p.i", "p.j").alias("cell"), "doc_id", "root", F.col("block").alias("part")
        )
        more = _verify(across, texts, width, share)
        links = links.unionByName(cut_lineage(more, "links"))
        label = components(links)
    found = member.join(label, member["rep"] == label["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").cast(kind).alias("component_id")
    )
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
