"""N-gram Jaccard join by prefixes of token combinations.

Tokens are the word shingles of a text. In one order of all tokens, rare ones first, two linked
sets share their first k common tokens inside prefixes that are k - 1 tokens longer than the usual
one. So a set is posted under

- each rare token of its prefix (a posting list has FREQUENT sets at most), and
- each combination of k frequent tokens of its extended prefix: where the first common token
  is frequent, all later ones are.

1. Equal sets become one class. Tokens are counted over the classes; which ones occur at all
   in a second class, and which are frequent, goes to all tasks as maps of bits.
2. A class that cannot have enough shared tokens for any link is left out here; the others are posted.
3. Each class is compared in full with one head of its lists, some rounds long. Lists whose classes
   are all connected need nothing more.
4. What is left of a list is compared class by class: short lists pair by pair, and long lists, joined to
   zones, all against those that are not in the zone's largest component.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm import bit_filter
from tokenmill.llm.batches import take, text_groups
from tokenmill.llm.byte_cnn import text_bytes
from tokenmill.llm.circulant import shingles
from tokenmill.llm.components import components
from tokenmill.llm.salting import join_counted
from tokenmill.llm.word_hashes import mix
from tokenmill.plans.joins import broadcast_up_to
from tokenmill.plans.session import cut_lineage

#: Sets that a rare token may have; also the longest list that is compared pair by pair.
FREQUENT = 32
#: Larger sets are posted under single tokens even where these are frequent: combinations would be too many.
LONG_SET = 512
#: Rounds in which sets are compared with one head, and sets of a block in the last comparison.
ROUNDS, BLOCK_ROWS = 3, 512
#: Rows up to which a table of lists goes to every task.
BROADCAST_ROWS = 200_000


def combinations(places: list[int]) -> np.ndarray:
    """All rising tuples of places in which the j-th place is below places[j]."""
    out = np.arange(places[0])[:, None]
    for limit in places[1:]:
        row, nxt = np.nonzero(out[:, -1][:, None] < np.arange(limit)[None])
        out = np.column_stack([out[row], nxt])
    return out


def posting_keys(rare: np.ndarray, frequent: np.ndarray, size: int, share: tuple[int, int], k: int, long_set: int) -> np.ndarray:
    """Keys under which a set of ``size`` tokens is posted; its tokens that no other set has are left out already.

    Sets of sizes that can be linked must use the same scheme for frequent tokens: those near
    the limits of both schemes use both.
    """
    need = -(-share[0] * size // share[1])
    # tokens of no other set come first in the order, and so are spent first
    prefix = [len(rare) + len(frequent) - need + j for j in range(1, k + 1)]
    keys = [rare[: prefix[0]]]
    left = [p - len(rare) for p in prefix]
    if left[0] > 0 and len(frequent):
        left = [min(p, len(frequent)) for p in left]
        if size > long_set or size * share[0] ** 2 <= (k - 1) * share[1] ** 2:
            keys.append(frequent[: left[0]])
        if need >= k and size * share[0] <= long_set * share[1]:
            at = combinations(left)
            key = np.full(len(at), k, np.uint64)
            for j in range(k):
                key = mix(key * np.uint64(0x9E3779B97F4A7C55) + frequent[at[:, j]])
            keys.append(key)
    return np.concatenate(keys)


class Left:
    """Sets of one side of a comparison, looked up by token."""

    def __init__(self, tokens: list[np.ndarray], sizes: list[int]):
        flat, row = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        order = np.argsort(flat, kind="stable")
        self.token, self.row, self.sizes = flat[order], row[order], np.array(sizes)

    def linked(self, tokens: np.ndarray, size: int, share: tuple[int, int]) -> np.ndarray:
        """Rows whose intersection with the set is at least share[0] / share[1] of the union."""
        lo, hi = np.searchsorted(self.token, tokens), np.searchsorted(self.token, tokens, side="right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.row[at], minlength=len(self.sizes))
        return np.flatnonzero(share[1] * both >= share[0] * (self.sizes + size - both))


def _verify(seats: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) between left (side 0) and right (side 1) sets of a cell; ``seats``: cell, side, set_key."""
    rows = seats.join(sets.select("set_key", "n", "tokens"), "set_key").repartition("cell").sortWithinPartitions("cell", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, names, tokens, sizes, left = None, [], [], [], None
        for batch in batches:
            out = []
            lists = batch.column("tokens")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            ends = ends - ends[0]
            for i, (k, side, key, n) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("cell", "side", "set_key", "n")])):
                if k != cell:
                    cell, names, tokens, sizes, left = k, [], [], [], None
                own = flat[ends[i] : ends[i + 1]]
                if side == 0:
                    names.append(key), tokens.append(own.copy()), sizes.append(n)
                elif names:
                    left = left or Left(tokens, sizes)
                    out += [(names[j], key) for j in left.linked(own, n, share) if names[j] != key]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.binary()) for j in (0, 1)], names=["a", "b"])

    return rows.select("cell", "side", "set_key", "n", "tokens").mapInArrow(run, "a binary, b binary")


def _pair_seats(pairs: DataFrame) -> DataFrame:
    """Seats for pairs (head, set_key): a head sits once for each block of its partners."""
    pairs = cut_lineage(pairs, "pairs")
    blocks = pairs.groupBy("head").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    some = blocks.where("blocks > 1")
    many = F.coalesce("blocks", F.lit(1))
    placed = pairs.join(broadcast_up_to(some, BROADCAST_ROWS), "head", "left").select(
        "set_key", "head", F.xxhash64("head", F.pmod(F.xxhash64("set_key"), many)).alias("cell")
    )
    left = placed.select("cell", F.lit(0).alias("side"), F.col("head").alias("set_key")).distinct()
    return left.unionByName(placed.select("cell", F.lit(1).alias("side"), "set_key"))


def _rooted(sets: DataFrame, label: DataFrame | None) -> DataFrame:
    """set_key, n, root and key: one row for each posting."""
    rows = sets.select("set_key", "n", "keys")
    if label is None:
        rows = rows.withColumn("root", F.col("set_key"))
    else:
        rows = rows.join(label.select(F.col("node").alias("set_key"), "component"), "set_key", "left")
        rows = rows.select("set_key", "n", "keys", F.coalesce("component", "set_key").alias("root"))
    return rows.select("set_key", "n", "root", F.explode("keys").alias("key"))


def _mixed(rooted: DataFrame, turn: int) -> DataFrame:
    """Lists that still have several components: key, members, head (a struct); the head changes with the turn."""
    head = F.min_by(F.struct("set_key", "n", "root"), F.xxhash64("set_key", F.lit(turn)))
    lists = rooted.groupBy("key").agg(head.alias("head"), F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high"))
    return cut_lineage(lists.where("low <> high").select("key", "members", "head"), "lists")


def groups(
    docs: DataFrame, width: int = 5, share: tuple[int, int] = (4, 5), k: int = 2, id_col: str = "doc_id", text_col: str = "text",
    frequent: int = FREQUENT, long_set: int = LONG_SET, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Connected documents: doc_id, n_shingles, component_id, one row for each given one.

    Two documents are linked when the intersection of their shingle sets (``width`` words; a shorter
    text is one shingle) is at least share[0] / share[1] of the union; component_id is the smallest id
    reachable over links. The answer is exact but for collisions of 64-bit shingle hashes;
    ``k``, ``frequent``, ``long_set``, ``rounds`` and ``block_rows`` change the cost only.

    A null or empty text, or one without words, has an empty set and is linked with nothing. A
    row stands for itself: rows that share an id are linked by their texts, not by the id. A row with
    a null id takes part in links, but its id is never the smallest; component_id is null where
    no other row is reachable. An empty table gives no rows. Other columns are not read.
    """
    docs = take(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def marks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches):
            sets = shingles(*text_bytes(batch.column("text")), width)
            keys = [_set_key(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([_mark(x) for x in keys], pa.int64())],
                names=["doc_id", "n_shingles", "set_key", "mark"],
            )

    marks = cut_lineage(docs.mapInArrow(marks_of, f"doc_id {kind}, n_shingles long, set_key binary, mark long"), "marks")
    classes = marks.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("mark").alias("mark")
    )
    classes = cut_lineage(classes.withColumn("row", F.xxhash64("first").bitwiseXOR(F.col("mark"))), "classes")

    # one row of each class, and few other copies, by a map of bits
    context = docs.sparkSession.sparkContext
    rows_bits = context.broadcast(bit_filter.build(classes, "row"))
    hashed = docs.withColumn("h", F.xxhash64("doc_id")).select("h", "text")

    def class_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[bytes]]]:
        for batch in text_groups(batches):
            sets = shingles(*text_bytes(batch.column("text")), width)
            keys = [_set_key(s) if len(s) else b"" for s in sets]
            row = batch.column("h").to_numpy().view(np.uint64) ^ np.array([_mark(x) or 0 for x in keys], np.int64).view(np.uint64)
            stay = [i for i in np.flatnonzero(bit_filter.passes(rows_bits.value, row)) if len(sets[i])]
            yield [sets[i] for i in stay], [keys[i] for i in stay]

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, _ in class_sets(batches):
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["token"])

    counted = hashed.mapInArrow(tokens_of, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    counted = cut_lineage(counted, "tokens")
    shared_bits = context.broadcast(bit_filter.build(counted, "token"))
    often_bits = context.broadcast(bit_filter.build(counted.where(F.col("n") > frequent), "token"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, keys in class_sets(batches):
            out = []
            if sets:
                flat = np.concatenate(sets)
                ends = np.cumsum([len(s) for s in sets])
                for s, key, own in zip(sets, keys, np.split(bit_filter.passes(shared_bits.value, flat), ends[:-1])):
                    if own.sum() * share[1] >= share[0] * len(s):
                        tokens = s[own]
                        often = bit_filter.passes(often_bits.value, tokens)
                        posted = posting_keys(tokens[~often], tokens[often], len(s), share, k, long_set)
                        out.append((key, len(s), tokens.view(np.int64), posted.view(np.int64)))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in out], t) for j, t in enumerate((pa.binary(), pa.int64(), lists, lists))], names=["set_key", "n", "tokens", "keys"]
            )

    sets = hashed.mapInArrow(sets_of, "set_key binary, n long, tokens array<long>, keys array<long>")
    sets = cut_lineage(sets.dropDuplicates(["set_key"]), "sets")

    near = lambda a, b: F.least(a, b) * share[1] >= F.greatest(a, b) * share[0]
    label, links = None, None

    def add(found: DataFrame) -> None:
        nonlocal label, links
        found = cut_lineage(found, "links")
        links = found if links is None else links.unionByName(found)
        label = components(links)

    mixed = None
    for turn in range(rounds + 1):
        rooted = _rooted(sets, label)
        if mixed is not None:
            rooted = rooted.join(broadcast_up_to(mixed.select("key"), BROADCAST_ROWS), "key", "left_semi")
        mixed = _mixed(rooted, turn)
        if turn == rounds or mixed.isEmpty():
            break
        met = rooted.join(broadcast_up_to(mixed, BROADCAST_ROWS), "key").where("root <> head.root").where(near(F.col("n"), F.col("head.n")))
        # the head with which a set shares most lists
        best = met.groupBy("set_key", F.col("head.set_key").alias("head")).agg(F.count("*").alias("lists"))
        best = best.groupBy("set_key").agg(F.max_by("head", F.struct("lists", "head")).alias("head"))
        add(_verify(_pair_seats(best), sets, share))

    if not mixed.isEmpty():
        rooted = rooted.join(broadcast_up_to(mixed, BROADCAST_ROWS), "key")
        listed = rooted.where(F.col("members") <= frequent).groupBy("key").agg(
            F.sort_array(F.collect_list(F.struct("set_key", "n", "root"))).alias("own")
        )
        after = listed.select(F.posexplode("own").alias("at", "one"), "own").select("one", F.explode(F.slice("own", F.col("at") + 2, F.size("own"))).alias("other"))
        after = after.where("one.root <> other.root").where(near(F.col("one.n"), F.col("other.n")))
        pairs = after.select(F.col("one.set_key").alias("head"), F.col("other.set_key").alias("set_key")).distinct()
        seats = _pair_seats(pairs)
        long_lists = cut_lineage(rooted.where(F.col("members") > frequent).select("set_key", "n", "root", F.col("head.set_key").alias("head")).distinct(), "zones")
        if not long_lists.isEmpty():
            seats = seats.unionByName(_zone_seats(long_lists, share, block_rows))
        add(_verify(seats, sets, share))

    # classes, then documents, get the smallest id of their component
    found = classes if label is None else classes.join(label.select(F.col("node").alias("set_key"), "component"), "set_key", "left")
    root = F.col("set_key") if label is None else F.coalesce("component", "set_key")
    found = cut_lineage(found.select("set_key", "first", "copies", root.alias("root")), "rooted")
    least = found.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("classes"))
    named = join_counted(found, least, "root", "classes", found.count()).select("set_key", "copies", "component_id")
    out = join_counted(marks.where("set_key is not null").select("doc_id", "n_shingles", "set_key"), cut_lineage(named, "named"), "set_key", "copies", marks.count())
    empty = marks.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id").unionByName(empty)


def _set_key(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def _mark(key: bytes | None) -> int | None:
    return int.from_bytes(key[:8], "little", signed=True) if key else None


def _zone_seats(members: DataFrame, share: tuple[int, int], block_rows: int) -> DataFrame:
    """Seats for all pairs of a zone but those inside its largest component. ``members``: set_key, n, root, head.

    A zone is what long lists with common sets hold together. Sets are dealt by size classes, of
    which linked sets have the same or neighbouring ones.
    """
    zones = components(members.select(F.col("set_key").alias("a"), F.col("head").alias("b")))
    step = F.log(F.lit(share[1] / share[0]))
    rows = members.select("set_key", "n", "root").distinct().join(zones, members["set_key"] == zones["node"]).select(
        F.col("component").alias("zone"), "set_key", "root", F.floor(F.log("n") / step + F.lit(1e-9)).cast("int").alias("class")
    )
    rows = cut_lineage(rows, "zones")
    largest = rows.groupBy("zone", "root").agg(F.count("*").alias("m")).groupBy("zone").agg(F.max_by("root", F.struct("m", "root")).alias("largest"))
    own = rows.join(broadcast_up_to(largest, BROADCAST_ROWS), "zone").where("root <> largest")
    blocks = own.groupBy("zone", "class").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    crowds = rows.groupBy("zone").agg(F.ceil(F.count("*") / (8 * block_rows)).cast("int").alias("parts"))
    blocks = cut_lineage(blocks.join(crowds, "zone"), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = F.xxhash64("zone", "class", "block", "part").alias("cell")
    dealt = lambda n: F.pmod(F.xxhash64("set_key"), F.col(n)).cast("int")
    small = broadcast_up_to(blocks, BROADCAST_ROWS)
    left = own.join(small, ["zone", "class"]).withColumn("block", dealt("blocks")).withColumn("part", every("parts"))
    # a set meets the blocks of its own and of both neighbouring size classes
    right = rows.withColumn("class", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])))
    right = right.join(small, ["zone", "class"]).withColumn("part", dealt("parts")).withColumn("block", every("blocks"))
    return left.select(cell, F.lit(0).alias("side"), "set_key").unionByName(right.select(cell, F.lit(1).alias("side"), "set_key"))
