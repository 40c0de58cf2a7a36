"""Language-model scoring with a hashed maximum-entropy model.

A word's probability is that of its class given the history, times that of the word given its
class and, for frequent words, the history:

- the most frequent words fill classes of equal size, every other word belongs to the class of
  its last two bytes (the heaviest endings have a class each, the rest share one);
- both softmax layers sum the weights of hashed features of the history: the word before, the
  two before (an n-gram), the one before the last (a skip), and the classes of the last two and
  of the two before those (a skip);
- a rare word has its discounted share of its class, and what the discount frees belongs to all
  words of the class that were never seen, counted as one word.

Word counts are exact and cover all training texts. Weights are trained by gradient steps in
every task on its own texts; after each round the tasks' changes are averaged row by row,
weighted by use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.batches import take, text_groups
from tokenmill.llm.byte_cnn import text_bytes
from tokenmill.llm.word_hashes import mix, word_ends, words
from tokenmill.plans.session import cut_lineage

#: Classes of frequent words and words in each, classes of endings, all classes.
HEADS, HEAD_WORDS, ENDINGS = 8, 32, 24
CLASSES = HEADS + ENDINGS
#: Hashed rows of the class layer and of the word layer; rows for pairs of classes come behind the former.
CLASS_ROWS, WORD_ROWS = 1 << 14, 1 << 13
PAIRS = (CLASSES + 1) ** 2
#: Words whose counts every task holds; the counts of the others are joined.
TABLE_WORDS = 1 << 19
#: Words that a task counts before it hands the counts on, tokens of a gradient step.
COUNT_ROWS, STEP = 1 << 21, 4096
#: Discount of a rare word's count, and addends of the base score.
DISCOUNT, ADD = 0.6, 0.1
#: Start of a row's sum of squared gradients.
SQUARE = 0.1
END = np.uint64(0x5DEECE66D1234567)
BEGIN = np.uint64(0x2545F4914F6CDD1D)
END_SUFFIX = 0
LOWERED = np.arange(256)
LOWERED[65:91] += 32


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending (last two bytes, A-Z lowered) of every token, and the n + 1 offsets; each text ends with END."""
    data, offsets = text_bytes(texts)
    start, end = word_ends(data, offsets)
    hashes, _, first = words(data, offsets, ends=(start, end))
    last = LOWERED[data[end - 1]] if len(start) else np.empty(0, np.int64)
    before = np.where(end - start > 1, LOWERED[data[np.maximum(end - 2, 0)]], 0) if len(start) else last
    ending = before * 256 + last
    places = first[1:]
    return np.insert(hashes, places, END), np.insert(ending, places, END_SUFFIX), first + np.arange(len(first))


def _merge(hashes: np.ndarray, endings: np.ndarray, counts: np.ndarray):
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    at = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0) if len(h) else np.empty(0, np.int64)
    return h[at], endings[order][at], np.add.reduceat(counts[order], at) if len(h) else counts


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash), ending and n of every distinct token of texts (from ``take``), summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kept):
            for lo in range(0, len(kept[0]), 1 << 16):
                h, e, n = (x[lo : lo + (1 << 16)] for x in kept)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(e.astype(np.int32)), pa.array(n.astype(np.int64))],
                    names=["word", "ending", "n"],
                )

        kept = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        new: list = []
        for batch in text_groups(batches):
            h, e, _ = tokens(batch.column("text"))
            new.append(_merge(h, e, np.ones(len(h), np.int64)))
            if sum(len(x[0]) for x in new) > max(COUNT_ROWS // 4, len(kept[0])):
                kept = _merge(*[np.concatenate(x) for x in zip(kept, *new)])
                new = []
            if len(kept[0]) > COUNT_ROWS:
                yield from rows(kept)
                kept = tuple(x[:0] for x in kept)
        yield from rows(_merge(*[np.concatenate(x) for x in zip(kept, *new)]))

    parts = docs.select("text").mapInArrow(run, "word long, ending int, n long")
    return parts.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What every task knows of the words: counts of the frequent ones, classes, class totals."""

    word: np.ndarray
    count: np.ndarray
    floor: int
    head: np.ndarray
    head_slot: np.ndarray
    ending_class: np.ndarray
    class_tokens: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    tokens: int
    vocabulary: int

    def classes(self, hashes: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token and its place in a head class, or -1."""
        if not len(self.head):
            return self.ending_class[endings], np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
        known = self.head[at] == hashes
        slot = np.where(known, self.head_slot[at], -1)
        return np.where(known, slot // HEAD_WORDS, self.ending_class[endings]), np.where(known, slot % HEAD_WORDS, -1)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Count of each token, or 0 where the table does not have it."""
        if not len(self.word):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.word, hashes), len(self.word) - 1)
        return np.where(self.word[at] == hashes, self.count[at], 0)

    def counts(self, hashes: np.ndarray, cls: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The same with the head words' counts read off their places."""
        own = np.zeros((HEADS, HEAD_WORDS), np.int64)
        own[self.head_slot // HEAD_WORDS, self.head_slot % HEAD_WORDS] = self.lookup(self.head)
        out = np.zeros(len(hashes), np.int64)
        head = slot >= 0
        out[head] = own[cls[head], slot[head]]
        out[~head] = self.lookup(hashes[~head])
        return out

    def rare(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 probability of a word outside the head classes in its class; count 0 stands for all unseen words."""
        freed = DISCOUNT * self.tail_words[cls] + 1
        return np.log10(np.where(count > 0, count - DISCOUNT, freed) / (self.tail_tokens[cls] + 1))

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ADD) / (self.tokens + ADD * (self.vocabulary + 1)))


def lexicon(counts: DataFrame, table_words: int = TABLE_WORDS) -> Lexicon:
    """Collect a bounded part of the counts: at most ``table_words`` words, and sums by ending."""
    by_count = [(r["n"], r["k"]) for r in counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(1 << 20).collect()]
    floor, held = 1, 0
    for n, k in by_count:
        if held + k > table_words:
            floor = n + 1
            break
        held += k
    known = counts.where(F.col("n") >= floor).select("word", "n").toArrow()
    word, count = known.column("word").to_numpy().view(np.uint64), known.column("n").to_numpy()
    order = np.argsort(word)
    word, count = word[order], count[order]
    top = np.lexsort((word, -count))[: HEADS * HEAD_WORDS]
    slots = np.argsort(word[top])
    head, head_slot = word[top][slots], slots.astype(np.int64)
    tail = counts.where(~F.col("word").isin([int(x) for x in head.view(np.int64)]))
    rows = tail.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    rows.sort(key=lambda r: (-r["n"], r["ending"]))
    ending_class = np.full(65536, CLASSES - 1)
    tail_tokens, tail_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for i, r in enumerate(rows):
        c = min(HEADS + i, CLASSES - 1)
        ending_class[r["ending"]] = c
        tail_tokens[c] += r["n"]
        tail_words[c] += r["v"]
    class_tokens = tail_tokens.copy()
    np.add.at(class_tokens, head_slot // HEAD_WORDS, count[top][slots])
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    return Lexicon(word, count, floor, head, head_slot, ending_class, class_tokens, tail_tokens, tail_words, total["n"] or 0, total["v"])


@dataclass
class Weights:
    """Rows of the class layer and of the word layer, and their biases."""

    cls: np.ndarray
    word: np.ndarray
    cls_bias: np.ndarray
    word_bias: np.ndarray


def start(lex: Lexicon) -> Weights:
    bias = np.log(lex.class_tokens + 1.0)
    word_bias = np.full((HEADS, HEAD_WORDS), -30.0)
    if len(lex.head):
        own = lex.lookup(lex.head)
        word_bias[lex.head_slot // HEAD_WORDS, lex.head_slot % HEAD_WORDS] = np.log(own)
    return Weights(
        np.zeros((CLASS_ROWS + 2 * PAIRS, CLASSES), np.float32), np.zeros((WORD_ROWS, HEAD_WORDS), np.float32),
        bias.astype(np.float32), word_bias.astype(np.float32),
    )


def histories(hashes: np.ndarray, cls: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the class layer (n, 5) and of the word layer (n, 3) for every token's history."""
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], np.diff(offsets))

    def back(x, k, begin):
        out = np.full(len(x), begin, x.dtype)
        out[k:] = x[:-k] if len(x) > k else x[:0]
        return np.where(place >= k, out, begin)

    w1, w2 = back(hashes, 1, BEGIN), back(hashes, 2, BEGIN)
    c1, c2, c3, c4 = (back(cls, k, CLASSES) for k in (1, 2, 3, 4))
    near, far = c1 * (CLASSES + 1) + c2, c3 * (CLASSES + 1) + c4
    hashed = lambda x, rows: (mix(x) & np.uint64(rows - 1)).astype(np.int64)
    salt = lambda k: np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    both = mix(w1) * np.uint64(31) + w2
    class_rows = np.stack([
        hashed(w1, CLASS_ROWS), hashed(both + salt(1), CLASS_ROWS), hashed(w2 + salt(2), CLASS_ROWS),
        CLASS_ROWS + near, CLASS_ROWS + PAIRS + far,
    ], axis=1)
    own = cls.astype(np.uint64) + np.uint64(1)
    word_rows = np.stack([
        hashed(w1 + salt(3) * own, WORD_ROWS), hashed(near.astype(np.uint64) + salt(4) * own, WORD_ROWS),
        hashed(far.astype(np.uint64) + salt(5) * own, WORD_ROWS),
    ], axis=1)
    return class_rows, word_rows


def logits(rows: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Sums of the features' weights and the bias, less the largest of each row."""
    z = table[rows[:, 0]] + bias
    for k in range(1, rows.shape[1]):
        z += table[rows[:, k]]
    z -= z.max(axis=1, keepdims=True)
    return z


def log_probability(rows: np.ndarray, table: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log10 of the softmax at the target."""
    z = logits(rows, table, bias)
    own = z[np.arange(len(target)), target]
    return (own - np.log(np.exp(z, out=z).sum(axis=1))) / np.log(10)


def sum_by(values: np.ndarray, source: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values[source]`` over the runs of ``source`` that begin at ``at``.

    Most runs are short, so the first members of all are added at once, then the second ones,
    and so on; the few long runs are summed one by one.
    """
    size = np.diff(at, append=len(source))
    total = values[source[at]]
    done, left = 1, np.flatnonzero(size > 1)
    while len(left) > 24:
        total[left] += values[source[at[left] + done]]
        done += 1
        left = left[size[left] > done]
    for i in left:
        total[i] += values[source[at[i] + done : at[i] + size[i]]].sum(axis=0)
    return total


class Trainer:
    """Gradient steps of one task, with a step length for each row that shrinks with its use."""

    def __init__(self, weights: Weights, rate: float):
        self.w = Weights(*[x.copy() for x in (weights.cls, weights.word, weights.cls_bias, weights.word_bias)])
        self.rate = rate
        self.used = [np.zeros(len(t), np.int64) for t in (self.w.cls, self.w.word)]
        self.square = [np.full(len(t), SQUARE, np.float32) for t in (self.w.cls, self.w.word)]

    def _step(self, layer: int, rows: np.ndarray, bias: np.ndarray, target: np.ndarray) -> None:
        table = (self.w.cls, self.w.word)[layer]
        slope = logits(rows, table, bias)
        np.exp(slope, out=slope)
        slope /= slope.sum(axis=1, keepdims=True)
        slope[np.arange(len(target)), target] -= 1
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        sorted_rows = flat[order]
        at = np.flatnonzero(np.diff(sorted_rows, prepend=-1))
        grad = sum_by(slope, order // rows.shape[1], at)
        touched = sorted_rows[at]
        square = self.square[layer][touched] + np.einsum("ij,ij->i", grad, grad)
        self.square[layer][touched] = square
        grad *= (self.rate / np.sqrt(square))[:, None].astype(np.float32)
        table[touched] -= grad
        self.used[layer][touched] += np.diff(at, append=len(flat))

    def learn(self, cls: np.ndarray, slot: np.ndarray, class_rows: np.ndarray, word_rows: np.ndarray) -> None:
        for lo in range(0, len(cls), STEP):
            part = slice(lo, lo + STEP)
            self._step(0, class_rows[part], self.w.cls_bias, cls[part])
            head = np.flatnonzero(slot[part] >= 0)
            if len(head):
                own = cls[part][head]
                self._step(1, word_rows[part][head], self.w.word_bias[own], slot[part][head])


def _round(docs: DataFrame, lex, weights: Weights, rate: float) -> Weights:
    """One pass of gradient steps over texts; the tasks' changes averaged by use."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, began = None, shared.value
        for batch in text_groups(batches):
            trainer = trainer or Trainer(began, rate)
            hashes, endings, offsets = tokens(batch.column("text"))
            cls, slot = lex.value.classes(hashes, endings)
            trainer.learn(cls, slot, *histories(hashes, cls, offsets))
        if trainer:
            for layer, old, new in ((0, began.cls, trainer.w.cls), (1, began.word, trainer.w.word)):
                rows = np.flatnonzero(trainer.used[layer])
                for lo in range(0, len(rows), 4096):
                    part = rows[lo : lo + 4096]
                    change = (new[part] - old[part]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(part), layer, np.int32)), pa.array(part), pa.array(trainer.used[layer][part]),
                        pa.array([c.tobytes() for c in change], pa.binary()),
                    ], names=["layer", "row", "used", "change"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for layer, row, used, change in zip(*[batch.column(c).to_pylist() for c in ("layer", "row", "used", "change")]):
                own = total.setdefault((layer, row), [0, 0.0])
                own[0] += used
                own[1] = own[1] + used * np.frombuffer(change, np.float16).astype(np.float64)
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()),
            pa.array([(total[k][1] / total[k][0]).astype(np.float32).tobytes() for k in keys], pa.binary()),
        ], names=["layer", "row", "change"])

    changes = docs.mapInArrow(run, "layer int, row long, used long, change binary").repartition("layer", "row")
    new = Weights(weights.cls.copy(), weights.word.copy(), weights.cls_bias, weights.word_bias)
    # as many rows as the two layers have at most
    for r in changes.mapInArrow(mean, "layer int, row long, change binary").collect():
        (new.cls, new.word)[r["layer"]][r["row"]] += np.frombuffer(r["change"], np.float32)
    return new


def score(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, rate: float = 1.0,
    table_words: int = TABLE_WORDS,
) -> DataFrame:
    """log10 probability of every whole text under a model of the texts where ``learn`` holds.

    Returns doc_id, n_tokens (words and one end), n_known (tokens that occur in training texts),
    train_tokens, base_score (unigrams with 0.1 added to every count and one unseen word) and
    score (the model's). Every training text is used in one of ``rounds`` rounds, all are counted.

    The counts of at most ``table_words`` frequent words go to every task; tokens of other words
    are joined with the count table by word. Words are told apart by 64-bit hashes.

    A null or empty text is one end. Without training texts every word is unseen. Repeated rows
    and null ids are kept. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    train = take(docs.where(learn), id_col, text_col)
    counts = cut_lineage(count_words(train), "counts")
    lex_value = lexicon(counts, table_words)
    lex = spark.sparkContext.broadcast(lex_value)
    weights = start(lex_value)
    lanes = 2 * spark.sparkContext.defaultParallelism
    for k in range(rounds if lex_value.tokens else 0):
        slice_ = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k)
        weights = _round(slice_.coalesce(lanes), lex, weights, rate)
    shared = spark.sparkContext.broadcast(weights)
    docs = take(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex_, w = lex.value, shared.value
        for batch in text_groups(batches):
            hashes, endings, offsets = tokens(batch.column("text"))
            cls, slot = lex_.classes(hashes, endings)
            count = lex_.counts(hashes, cls, slot)
            class_rows, word_rows = histories(hashes, cls, offsets)
            model = np.zeros(len(cls))
            for lo in range(0, len(cls), STEP):
                part = slice(lo, lo + STEP)
                own = cls[part]
                model[part] = log_probability(class_rows[part], w.cls, w.cls_bias, own)
                head = np.flatnonzero(slot[part] >= 0)
                if len(head):
                    model[lo + head] += log_probability(word_rows[part][head], w.word, w.word_bias[own[head]], slot[part][head])
            held = count > 0
            rare = held & (slot < 0)
            model[rare] += lex_.rare(count[rare], cls[rare])
            first = offsets[:-1]
            opened = np.append(0, np.cumsum(~held))[offsets]
            names = pa.ListArray.from_arrays(pa.array(opened, pa.int32()), pa.array(hashes[~held].view(np.int64)))
            kinds = pa.ListArray.from_arrays(pa.array(opened, pa.int32()), pa.array(cls[~held].astype(np.int32)))
            base = np.where(held, lex_.base(count), 0.0)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.add.reduceat(held.astype(np.int64), first)),
                pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(model, first)), names, kinds,
            ], names=["doc_id", "n_tokens", "held", "base", "model", "words", "kinds"])

    scored = docs.mapInArrow(
        run, f"doc_id {kind}, n_tokens long, held long, base double, model double, words array<long>, kinds array<int>"
    ).withColumn("row", F.monotonically_increasing_id())
    scored = cut_lineage(scored, "scored")
    open_words = scored.select("row", F.explode(F.arrays_zip("words", "kinds")).alias("x")).groupBy(
        "row", F.col("x.words").alias("word"), F.col("x.kinds").alias("kind")
    ).agg(F.count("*").alias("times"))
    few = counts.where(F.col("n") < lex_value.floor).select("word", "n")
    joined = open_words.join(few, "word", "left")
    log10_total = float(np.log10(lex_value.tokens + ADD * (lex_value.vocabulary + 1)))
    unseen = F.lit([float(DISCOUNT * v + 1) for v in lex_value.tail_words])
    inside = F.lit([float(t + 1) for t in lex_value.tail_tokens])
    n = F.coalesce(F.col("n"), F.lit(0))
    base = F.log10(n + ADD) - log10_total
    rare = F.log10(F.when(n > 0, n - DISCOUNT).otherwise(F.get(unseen, F.col("kind")))) - F.log10(F.get(inside, F.col("kind")))
    rest = joined.groupBy("row").agg(
        F.sum(F.col("times") * base).alias("base_rest"), F.sum(F.col("times") * rare).alias("rest"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("found"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("words", "kinds").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("held") + zero("found")).alias("n_known"),
        F.lit(lex_value.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_rest")).alias("base_score"), (F.col("model") + zero("rest")).alias("score"),
    )
