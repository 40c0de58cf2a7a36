"""Byte-pair merges, many of them for each pass over the words.

A pair that is rare now stays so: counts of given pairs only fall, and a pair that a merge makes
is at most as frequent as the pair of neighbours it comes from. So take all pairs that
count more than a floor, and cut every word between neighbours that are not such a pair. No
merge above the floor can reach over a cut, and every pair above it lies inside the pieces. Equal pieces are
added up over all words by an aggregation, and what is left is few enough to be merged in one place,
with an inverted index from pairs to pieces and counts that follow the pieces a merge touches.
When the best pair has come down to the floor, all tasks replace the pieces in their words by what they have
become, and the pairs are counted again.

The number of pieces that come together is bounded: with too many, fewer pairs are taken.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.plans.session import cut_lineage

#: Most pieces that are merged in one place, and pairs that are taken at first.
MOST_PIECES, FIRST_PAIRS = 100_000, 1024
#: A pair of token ids as one number.
SHIFT = 32

WORDS = "tokens array<int>, n long"


def pair_keys(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all neighbours in a row of words, and which of them lie inside a word."""
    keys = flat[:-1].astype(np.int64) << SHIFT | flat[1:]
    inside = np.ones(len(keys), bool)
    inside[offsets[1:-1] - 1] = False
    return keys, inside


def pieces(flat: np.ndarray, offsets: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest runs of tokens whose neighbours all are taken pairs (sorted numbers)."""
    keys, inside = pair_keys(flat, offsets)
    at = np.minimum(np.searchsorted(taken, keys), len(taken) - 1)
    linked = inside & (taken[at] == keys)
    edge = np.diff(np.concatenate([[0], linked.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1


def add_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("tokens")
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(), offsets - offsets[0], batch.column("n").to_numpy()


def _bytes_as_tokens(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("word").cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(raw) else np.empty(0, np.uint8)
            lists = pa.ListArray.from_arrays(pa.array((offsets - offsets[:1]).astype(np.int32)), pa.array(data.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, batch.column("n")], names=["tokens", "n"])

    return words.filter(F.octet_length("word") > 1).select("word", F.col("n").cast("bigint").alias("n")).mapInArrow(run, WORDS)


def count_pairs(words: DataFrame) -> DataFrame:
    """Occurrences of every pair, overlapping ones too: pair, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets, n = _columns(batch)
            keys, inside = pair_keys(flat, offsets)
            weight = np.repeat(n, np.diff(offsets))[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in add_up(keys[inside], weight[inside])], names=["pair", "n"])

    return words.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def count_pieces(words: DataFrame, taken: np.ndarray) -> DataFrame:
    """How often each piece occurs: piece (token ids of four bytes), n."""
    shared = words.sparkSession.sparkContext.broadcast(taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets, n = _columns(batch)
            start, end = pieces(flat, offsets, shared.value)
            weight, data, found = n[np.searchsorted(offsets, start, side="right") - 1].tolist(), flat.tobytes(), defaultdict(int)
            for s, e, w in zip((4 * start).tolist(), (4 * end).tolist(), weight):
                found[data[s:e]] += w
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["piece", "n"])

    return words.mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def replace_pieces(words: DataFrame, taken: np.ndarray, becomes: dict[bytes, bytes]) -> DataFrame:
    """The words with every piece replaced by what it becomes; words of one token are left out."""
    shared = words.sparkSession.sparkContext.broadcast((taken, becomes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, becomes = shared.value
        for batch in batches:
            flat, offsets, n = _columns(batch)
            start, end = pieces(flat, offsets, taken)
            data, out, at, shorter = flat.tobytes(), [], 0, []
            for s, e in zip((4 * start).tolist(), (4 * end).tolist()):
                new = becomes.get(data[s:e])
                out += (data[at:s], new if new is not None else data[s:e])
                shorter.append(0 if new is None else (e - s - len(new)) // 4)
                at = e
            out.append(data[at:])
            length = np.diff(offsets)
            np.subtract.at(length, np.searchsorted(offsets, start, side="right") - 1, shorter)
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(np.frombuffer(b"".join(out), np.int32))
            )
            yield pa.RecordBatch.from_arrays([lists, batch.column("n")], names=["tokens", "n"]).filter(pa.array(length > 1))

    return words.mapInArrow(run, WORDS)


def neighbours(tokens: list[int]) -> list[tuple[int, int]]:
    return list(zip(tokens, tokens[1:]))


class Pieces:
    """Pieces with their counts, merged pair by pair through an inverted index."""

    def __init__(self, found: list[tuple[bytes, int]], spelled: list[bytes]):
        self.given = [p for p, _ in found]
        self.tokens = [np.frombuffer(p, np.int32).tolist() for p in self.given]
        self.n = [n for _, n in found]
        self.spelled, self.touched = spelled, 0
        self.count: dict[tuple[int, int], int] = defaultdict(int)
        self.having: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, t in enumerate(self.tokens):
            for p in neighbours(t):
                self.count[p] += self.n[i]
                self.having[p].add(i)
        self.heap = [self._entry(p) for p in self.count]
        heapify(self.heap)

    def _entry(self, pair: tuple[int, int]) -> tuple:
        return -self.count[pair], self.spelled[pair[0]], self.spelled[pair[1]], pair

    def best(self) -> tuple[tuple[int, int], int] | None:
        """The most frequent pair, ties by left bytes, then right bytes."""
        while self.heap:
            n, _, _, pair = self.heap[0]
            now = self.count.get(pair, 0)
            if -n == now:
                return pair, now
            # counts that fell are put back where they belong
            heappop(self.heap)
            if now:
                heappush(self.heap, self._entry(pair))
        return None

    def merge(self, pair: tuple[int, int], token: int) -> None:
        changed = set()
        for i in self.having.pop(pair):
            old, new, k = self.tokens[i], [], 0
            while k < len(old):
                if k + 1 < len(old) and (old[k], old[k + 1]) == pair:
                    new.append(token)
                    k += 2
                else:
                    new.append(old[k])
                    k += 1
            before, after = neighbours(old), neighbours(new)
            for p in before:
                self.count[p] -= self.n[i]
            for p in after:
                self.count[p] += self.n[i]
            for p in {*before}.difference(after) - {pair}:
                self.having[p].discard(i)
            for p in {*after}.difference(before):
                self.having[p].add(i)
                changed.add(p)
            self.tokens[i] = new
            self.touched += 1
        self.count.pop(pair, None)
        for p in changed:
            heappush(self.heap, self._entry(p))

    def becomes(self) -> dict[bytes, bytes]:
        """Pieces that changed, and their tokens now."""
        now = (np.array(t, np.int32).tobytes() for t in self.tokens)
        return {given: new for given, new in zip(self.given, now) if new != given}


def _first_pair(pairs: DataFrame, n: int, spelled: list[bytes]) -> int:
    """Of all pairs that occur n times, the one with the smallest bytes."""
    table = F.split(F.lit(",".join(b.hex() for b in spelled)), ",")
    part = lambda x: F.get(table, x.cast("int"))
    order = part(F.shiftright("pair", SHIFT)), part(F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)))
    return pairs.where(F.col("n") == n).orderBy(*order).first()["pair"]


def learn(
    words: DataFrame, n_merges: int, most_pieces: int = MOST_PIECES, first_pairs: int = FIRST_PAIRS,
    report: Callable[[dict], None] | None = None,
) -> list[tuple[int, int, int, int, int]]:
    """Merges (rank, left, right, token_id, n) of ``words(word, n)``, the same as learned one at a time.

    ``report`` is called after each pass with its merges, the pairs and pieces it took, how many pieces
    its merges rewrote, and the Spark jobs of the pass.
    """
    spelled = [bytes([i]) for i in range(256)]
    merges: list[tuple[int, int, int, int, int]] = []
    state = cut_lineage(_bytes_as_tokens(words), "words")
    wanted = first_pairs
    while len(merges) < n_merges:
        pairs = cut_lineage(count_pairs(state), "pairs")
        jobs = 2
        while True:
            top = pairs.orderBy(F.desc("n"), "pair").limit(wanted + 1).collect()
            if not top:
                return merges
            floor = top[-1]["n"] if len(top) > wanted else 0
            taken = [r["pair"] for r in top if r["n"] > floor]
            # more pairs than are wanted occur equally often: only the first of them is sure
            alone = not taken
            if alone:
                taken = [_first_pair(pairs, floor, spelled)]
                floor -= 1
            taken = np.array(sorted(taken), np.int64)
            found = [(bytes(r["piece"]), r["n"]) for r in count_pieces(state, taken).limit(most_pieces + 1).collect()]
            jobs += 2 + alone
            if len(found) <= most_pieces or alone or wanted == 1:
                break
            wanted = max(1, wanted // 4)
        own, before = Pieces(found, spelled), len(merges)
        while len(merges) < n_merges and (best := own.best()) and best[1] > floor:
            pair, n = best
            token = len(spelled)
            spelled.append(spelled[pair[0]] + spelled[pair[1]])
            merges.append((len(merges), *pair, token, int(n)))
            own.merge(pair, token)
            if alone:
                break
        if len(merges) < n_merges:
            state = cut_lineage(replace_pieces(state, taken, own.becomes()), "words")
            jobs += 1
        if report:
            report({"merges": len(merges) - before, "pairs": len(taken), "pieces": len(found), "rewritten": own.touched, "jobs": jobs})
        if len(found) * 4 < most_pieces:
            wanted *= 2
    return merges
