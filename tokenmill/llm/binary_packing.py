"""Packing by power-of-two decomposition.

A document of n tokens is cut into full sequences and, for the rest, one piece for each set bit
of its length, longest first. Every piece is a sequence of its own whose length is a power of
two, so no sequence crosses documents and none needs padding; training batches are drawn from
one bucket of equal lengths at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.batches import TABLE_ROWS, DistinctTable, lists_in_a_row, process_cache, take, text_groups

PIECES = "doc_id {id}, piece_no long, start long, length long, bucket int, doc_tokens long, ids binary"
#: A word of its own to the tokenizer, with one id; texts hardly hold it.
MARK = "\x01"
#: White space to ``str.split`` but not to Unicode, nor to the tokenizer, which gives it ids.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Words that are one piece to the tokenizer, so that their last token alone ends a word.
PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
#: Bytes of UTF-8 text as the characters that a byte-level vocabulary is written in; those of plain words are enough.
BYTE_LETTERS = {b: 0x122 + b - 0x80 for b in range(0x80, 0xA1)} | {0xAD: 0x143}
#: Unicode White_Space.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def split_words(text: str) -> list[str]:
    """The text's words, parted by what the tokenizer takes as white space."""
    if SEPARATORS.search(text):
        return [w for w in SPACE.split(text) if w]
    return text.split()


def lowered(text: str, special: list[str]) -> str:
    """The text with ASCII letters lowered as the tokenizer would, so that fewer words are distinct.

    A text that holds a special token in any case stays as it is: the tokenizer looks for these
    tokens before it lowers letters, and must not find one that was not there.
    """
    low = text.encode().lower().decode()
    return text if any(s in low for s in special) else low


def word_encoder(spec: str):
    """Encode white-space separated words with a tokenizer that drops white space.

    Many new words are encoded by one call. Plain words, of lower-case letters only, are what the tokenizer's own rules leave as
    they are but for their bytes' letters, so they go to its model at once, joined with a blank; tokens that end a word tell them apart.
    Others are joined with a mark between them that is a word with one id. Where a word holds the mark or a special
    token, words go one by one.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    tokenizer = Tokenizer.from_str(spec)
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = WhitespaceSplit()
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}

    def alone(word: str) -> list[int]:
        return tokenizer.encode(word, add_special_tokens=False).ids

    between = alone(MARK)
    suffix = json.loads(spec)["model"].get("end_of_word_suffix")
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    if suffix:
        ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def together(words: list[str], by: str, tokenizer: Tokenizer) -> np.ndarray:
        lots = [by.join(words[i : i + 256]) + by for i in range(0, len(words), 256)]
        return lists_in_a_row([x.ids for x in tokenizer.encode_batch_fast(lots, add_special_tokens=False)])[0]

    def plainly(words: list[str]) -> np.ndarray:
        lettered = "\n".join(words).encode().decode("latin-1").translate(BYTE_LETTERS)
        return together(lettered.split("\n"), " ", bare)

    # a tokenizer with other rules for plain words gets none of them this way
    probes = [a + b for a in map(chr, range(0x61, 0x100)) if PLAIN.fullmatch(a) for b in ("", "e", "ß", "ing", "tion")]
    if suffix and plainly(probes).tolist() != [i for w in probes for i in alone(w)]:
        suffix = None

    def marked(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(words)
        if len(between) != 1 or MARK in joined or any(a in joined for a in added):
            return lists_in_a_row([alone(w) for w in words])
        ids = together(words, f" {MARK} ", tokenizer)
        marks = np.flatnonzero(ids == between[0])
        if len(marks) != len(words):
            raise ValueError("the tokenizer does not keep the mark apart")
        return ids[ids != between[0]], np.diff(marks, prepend=-1) - 1

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [PLAIN.fullmatch(w) is not None for w in words] if suffix else [False] * len(words)
        easy = [w for w, p in zip(words, plain) if p]
        ids = plainly(easy) if easy else np.empty(0, np.int64)
        last = np.flatnonzero(ends[ids])
        if len(last) != len(easy):
            return marked(words)
        hard = [w for w, p in zip(words, plain) if not p]
        more, n_more = marked(hard) if hard else (np.empty(0, np.int64), np.empty(0, np.int64))
        # both kinds back in the order of the words
        n = np.zeros(len(words), np.int64)
        at = np.array(plain, bool)
        n[at], n[~at] = np.diff(last, prepend=-1), n_more
        out = np.empty(int(n.sum()), np.int64)
        owner = np.repeat(at, n)
        out[owner], out[~owner] = ids, more
        return out, n

    return encode


def powers(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: full ones, then the set bits of the rest."""
    full, rest = divmod(n, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text", table_rows: int = TABLE_ROWS,
) -> DataFrame:
    """Cut every document into sequences whose lengths are powers of two.

    Returns per piece: doc_id, piece_no (from 0), start and length in tokens, bucket (base-two
    logarithm of the length), doc_tokens, ids (little-endian unsigned 32-bit), sequence_id
    (unique) and offset (always 0: a piece fills its sequence). ``capacity`` must be a power of
    two. The tokenizer file is read by the driver and shipped; it must drop white space.

    Each task encodes a distinct word once; nothing is shuffled. sequence_id holds the task's
    number and a running number within it, so it needs no order over the corpus.

    A null or empty text is the end id alone, one piece of length 1. A null id stays null, and
    repeated rows are packed each for itself. An empty table gives no rows. Other columns are
    not read.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = take(docs, id_col, text_col)
    schema = PIECES.format(id=docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = process_cache("word_tables")
        key = (hash(spec.value), table_rows)
        if key not in cache:
            cache[key] = DistinctTable(word_encoder(spec.value), table_rows)
        table: DistinctTable = cache[key]
        for batch in text_groups(batches):
            words = [split_words(lowered(t, special) if lowers else t) for t in batch.column("text").to_pylist()]
            ids, n = table.lookup([w for x in words for w in x])
            tokens = np.append(0, np.cumsum(n))
            ends = tokens[np.cumsum([len(x) for x in words])]
            doc, piece_no, start, length, data = [], [], [], [], []
            total = []
            lo = 0
            for i, hi in enumerate(ends.tolist()):
                own = np.append(ids[lo:hi], np.int32(end_id)).astype("<u4").tobytes()
                cuts, at = powers(hi - lo + 1, capacity), 0
                for k, size in enumerate(cuts):
                    doc.append(i), piece_no.append(k), start.append(at), length.append(size)
                    data.append(own[4 * at : 4 * (at + size)])
                    at += size
                total += [at] * len(cuts)
                lo = hi
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece_no, pa.int64()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array([x.bit_length() - 1 for x in length], pa.int32()), pa.array(total, pa.int64()),
                    pa.array(data, pa.binary()),
                ],
                names=["doc_id", "piece_no", "start", "length", "bucket", "doc_tokens", "ids"],
            )

    parts = json.loads(spec.value)
    lowers = '"Lowercase"' in json.dumps(parts.get("normalizer"))
    special = [t["content"].lower() for t in parts.get("added_tokens", [])]
    pieces = docs.mapInArrow(run, schema)
    return pieces.select(
        "*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet, one folder for each length, ready for batches of equal length."""
    pieces.write.partitionBy("bucket").parquet(path)
