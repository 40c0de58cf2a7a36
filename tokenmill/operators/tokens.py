"""Vocabulary learning, tokenization and its inverse, compression figures."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions.text import col
from tokenmill.operators.merges import learn

# The pre-token pattern. White space is Unicode white space.
_W = r"\t-\r\x20\x85\p{Z}"
SPLIT_PATTERN = (
    r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^" + _W + r"\p{L}\p{N}]++[\r\n]*|["
    + _W + r"]*[\r\n]|[" + _W + r"]+(?![^" + _W + r"])|[" + _W + r"]+"
)

# Special tokens, appended to the vocabulary in this order.
SPECIAL_TOKENS = (
    "<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>",
    "<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>",
)

MAX_VOCAB = 2**20 - 256


def pretokens(text) -> Column:
    """Pre-tokens of a text, in order."""
    return F.regexp_extract_all(col(text), F.lit(SPLIT_PATTERN), F.lit(0))


def count_pretokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """Frequency of each pre-token; counts are combined before the shuffle."""
    return docs.select(F.explode(pretokens(text)).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )


def train_bpe(
    words: DataFrame, vocab_size: int, specials: int = len(SPECIAL_TOKENS), report: Callable[[dict], None] | None = None
) -> DataFrame:
    """Byte-pair merges learned from ``words(word, n)``: ``(rank, left, right, token_id, n)``.

    Bytes are ids 0-255 and merges follow; ``vocab_size`` includes the special tokens. The most
    frequent pair is merged next, ties by left bytes, then right bytes. A round merges as many of
    the best pairs as give the same result as one at a time, and rewrites only the words that
    hold one of them (see ``merges``); ``report`` is called after each.
    """
    n_merges = vocab_size - specials - 256
    if n_merges < 0:
        raise ValueError(f"vocab_size must be at least {256 + specials}")
    if vocab_size > MAX_VOCAB:
        raise ValueError(f"vocab_size must be at most {MAX_VOCAB}")
    found = learn(words, n_merges, report=report) if n_merges else []
    return words.sparkSession.createDataFrame(found, "rank int, left int, right int, token_id int, n bigint")


def vocab_table(merges: DataFrame, specials: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """``vocab(token_id, bytes, is_special)``: bytes, merges, special tokens.

    A vocabulary is bounded by construction (``MAX_VOCAB``), so it is spelled on the driver.
    """
    spelled = {i: bytes([i]) for i in range(256)}
    for r in merges.orderBy("rank").collect():
        spelled[r["token_id"]] = spelled[r["left"]] + spelled[r["right"]]
    rows = [(i, bytearray(b), False) for i, b in sorted(spelled.items())]
    rows += [(len(spelled) + i, bytearray(s.encode()), True) for i, s in enumerate(specials)]
    return merges.sparkSession.createDataFrame(rows, "token_id int, bytes binary, is_special boolean")


def special_ids(vocab: DataFrame) -> dict[str, int]:
    return {bytes(r["bytes"]).decode(): r["token_id"] for r in vocab.filter("is_special").collect()}


def byte_vocab(spark: SparkSession) -> DataFrame:
    """Vocabulary without merges: one token per byte, then the special tokens."""
    none = spark.createDataFrame([], "rank int, left int, right int, token_id int, n bigint")
    return vocab_table(none)


def token_bytes(vocab: DataFrame, mode: str = "exact") -> DataFrame:
    """Byte length per token, 0 for special tokens.

    ``mode='utf8_replace'`` measures the token's text after decoding, in which bytes that are
    no valid UTF-8 become the three-byte replacement character.
    """
    size = F.octet_length("bytes")
    if mode == "utf8_replace":
        size = F.octet_length(F.encode(F.make_valid_utf8(F.col("bytes").cast("string")), "UTF-8"))
    return vocab.select("token_id", F.when(F.col("is_special"), 0).otherwise(size).alias("n_bytes"))


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Same result for long pre-tokens, with a heap of candidate merges over a linked list."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i):
        j = after[i]
        if j < n:
            rank = ranks.get(word[i:end[j]])
            if rank is not None:
                heappush(heap, (rank, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, mid, stop = heappop(heap)
        j = after[i]
        # Skip candidates whose parts have changed since they were offered.
        if not alive[i] or end[i] != mid or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = after[i]
    return out


def _encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    if len(word) > 100:
        return _encode_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 1:
        joined = [ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
        best = min((r for r in joined if r is not None), default=None)
        if best is None:
            break
        out, i = [], 0
        while i < len(parts):
            if i < len(joined) and joined[i] == best:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return [ranks[p] for p in parts]


#: Bytes of text that a task encodes at once, unless one row has more.
SLICE_BYTES = 1 << 20


def byte_ids(docs: DataFrame, key: Sequence[str], text: str = "text", first: int | None = None) -> DataFrame:
    """The UTF-8 bytes of every text as ``ids``, behind the id ``first``; null for a null text.

    Bytes are gathered by array kernels, ``SLICE_BYTES`` of text at a time, and nothing is shuffled.
    """
    extra = 0 if first is None else 1

    def ids_of(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.large_binary())
        lengths = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(b"".join(raw.drop_null().to_pylist()), np.uint8)
        ends = np.cumsum(lengths + extra)
        ids = np.full(len(data) + extra * len(lengths), first or 0, np.int32)
        own = np.ones(len(ids), bool)
        if extra:
            own[ends - lengths - 1] = False
        ids[own] = data
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids), mask=raw.is_null())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            begins = (np.cumsum(size) - size) // SLICE_BYTES
            at = [0, *(np.flatnonzero(np.diff(begins)) + 1).tolist(), batch.num_rows]
            for low, high in zip(at, at[1:]):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in key), ids_of(part.column(text))], names=[*key, "ids"])

    schema = T.StructType([*docs.select(*key).schema, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(*key, text).mapInArrow(encode, schema)


def slices(batch: pa.RecordBatch, words: str) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of a batch whose lists of words begin within the same ``SLICE_BYTES``.

    A batch is so many rows, whatever their size; its ids and their places take dozens of bytes for one of text.
    """
    lists = batch.column(words)
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False), dtype=np.int64)))
    begins = ends[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()] // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(begins)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        yield batch.slice(low, high - low)


def tokenize(
    docs: DataFrame, vocab: DataFrame, key: Sequence[str], text: str = "text",
    prepend: int | None = None, append: int | None = None,
) -> DataFrame:
    """``(key, ids)``: BPE ids of each text, without a shuffle.

    The JVM splits texts into pre-tokens; each slice of an Arrow batch encodes its distinct pre-tokens
    once, keeps them for later batches of the task, and gathers the ids with array kernels.
    The vocabulary is bounded by ``MAX_VOCAB`` and ships with the tasks.
    """
    rows = vocab.filter("not is_special").limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"a vocabulary may have at most {MAX_VOCAB} tokens")
    ranks = {bytes(r["bytes"]): r["token_id"] for r in rows}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    key = list(key)
    words = docs.select(*key, F.coalesce(pretokens(text), F.array().cast("array<string>")).alias("words"))
    schema = words.drop("words").schema.add("ids", T.ArrayType(T.IntegerType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        known: dict[str, list[int]] = {}
        for batch in (part for whole in batches for part in slices(whole, "words")):
            lists = batch.column("words")
            flat = pc.dictionary_encode(lists.flatten())
            encoded = []
            for w in flat.dictionary.to_pylist():
                ids = known.get(w)
                if ids is None:
                    ids = _encode_word(w.encode("utf-8"), table)
                    if len(known) < 200_000 and len(w) < 100:
                        known[w] = ids
                encoded.append(ids)
            sizes = np.fromiter((len(e) for e in encoded), dtype=np.int64, count=len(encoded))
            starts = np.concatenate(([0], np.cumsum(sizes)))
            pool = np.fromiter((i for e in encoded for i in e), dtype=np.int32, count=int(starts[-1]))
            which = flat.indices.to_numpy(zero_copy_only=False)
            lens = sizes[which] if len(which) else np.zeros(0, dtype=np.int64)
            word_ends = np.concatenate(([0], np.cumsum(lens)))
            # Position of every output id in the pool: its word's start plus the place in the word.
            at = np.repeat(starts[which] - word_ends[:-1], lens) + np.arange(word_ends[-1])
            ids = pool[at]
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            offsets = word_ends[bounds]
            ids, offsets = _with_ends(ids, offsets, prepend, append)
            array = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in key], array], names=[*key, "ids"]
            )

    return words.mapInArrow(encode, schema)


def _with_ends(ids, offsets, prepend, append):
    if prepend is not None:
        ids = np.insert(ids, offsets[:-1], prepend)
        offsets = offsets + np.arange(len(offsets))
    if append is not None:
        ids = np.insert(ids, offsets[1:], append)
        offsets = offsets + np.arange(len(offsets))
    return ids.astype(np.int32), offsets.astype(np.int32)


def detokenize(tokens: DataFrame, vocab: DataFrame, key: Sequence[str], specials: bool = False) -> DataFrame:
    """``(key, text)`` back from ids; special tokens are left out unless asked for.

    Ids are looked up in one constant array (the vocabulary is bounded by ``MAX_VOCAB``), so no
    token is shuffled.
    """
    rows = vocab.orderBy("token_id").limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"a vocabulary may have at most {MAX_VOCAB} tokens")
    hexes = ["" if r["is_special"] and not specials else bytes(r["bytes"]).hex().upper() for r in rows]
    table = F.split(F.lit(",".join(hexes)), ",")
    joined = F.array_join(F.transform("ids", lambda i: F.get(table, i)), "")
    return tokens.select(*key, F.decode(F.unhex(joined), "UTF-8").alias("text"))


def round_trip_errors(docs: DataFrame, vocab: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Documents whose decoded ids differ from their text."""
    back = detokenize(tokenize(docs, vocab, key, text), vocab, key)
    return docs.select(*key, F.col(text).alias("__t")).join(back, list(key)).filter(
        ~F.col("__t").eqNullSafe(F.col("text"))
    ).select(*key)


def compression(tokens: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bytes, tokens and bytes per token; ``tokens(by..., n_bytes, n_tokens)``."""
    return tokens.groupBy(*by).agg(
        F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"),
        F.try_divide(F.sum("n_bytes").cast("double"), F.sum("n_tokens")).alias("ratio"),
    )


def compare_tokenizers(ours: DataFrame, baseline: DataFrame, by: Sequence[str], name: str = "baseline") -> DataFrame:
    """Relative saving in tokens, in percent, and the tokenizer with the better ratio."""
    o = ours.select(*by, F.col("n_tokens").alias("ours_tokens"), F.col("ratio").alias("ours_ratio"))
    b = baseline.select(*by, "n_bytes", F.col("n_tokens").alias("base_tokens"), F.col("ratio").alias("base_ratio"))
    saved = 100.0 * (F.col("base_tokens") - F.col("ours_tokens")) / F.col("base_tokens")
    better = F.when(F.col("base_ratio") > F.col("ours_ratio"), name).when(
        F.col("ours_ratio") > F.col("base_ratio"), "ours").otherwise("tie")
    return b.join(o, list(by)).withColumn("saved_pct", saved).withColumn("better", better)
