"""SentencePiece encoding and decoding over a table of distinct marked words.

SentencePiece writes a blank as a marker. When no piece of a model has a marker behind another
character, merges never cross the place where a marker follows a word, so a text falls into
chunks (markers, then a word) that are segmented each on its own. A task segments a distinct
chunk once and joins the ids back by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tokenmill.llm.batches import TABLE_ROWS, DistinctTable, lists_in_a_row, process_cache, take, text_groups

MARKER = "▁"
CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*")


def load(data: bytes):
    """The processor of a model's bytes; an error for models whose pieces may cross a marker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    for i in range(model.vocab_size()):
        if MARKER in model.id_to_piece(i).lstrip(MARKER):
            raise ValueError(f"piece {i} of the model crosses a marker; chunks are not independent")
    if model.encode("a  ", out_type=str)[-1].strip(MARKER) or model.encode("x", out_type=str)[0][:1] != MARKER:
        raise ValueError("the model must keep blanks and put a marker before a text")
    return model


def chunks(text: str) -> list[str]:
    """The text's marked words; an empty text has none."""
    if not text:
        return []
    marked = MARKER + text.replace(" ", MARKER)
    if MARKER * 2 in marked or marked[-1] == MARKER:
        return CHUNK.findall(marked)
    return [MARKER + w for w in marked[1:].split(MARKER)]


def segment(model, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of marked words. The library puts a marker before a text, so a word goes without its first one."""
    ids = model.encode([c[1:] for c in new], num_threads=1)
    if MARKER in new:  # at the end of a text; behind a word, since an empty text has no ids
        ids[new.index(MARKER)] = model.encode("x" + MARKER)[len(model.encode("x")) :]
    return lists_in_a_row(ids)


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False,
    table_rows: int = TABLE_ROWS,
) -> DataFrame:
    """Encode every whole text exactly as the library does, without begin and end ids or sampling.

    Returns doc_id, ids (array of int) and, with ``decoded``, decoded (the library's decode of
    these ids). The model file is read by the driver and shipped. Nothing is shuffled.

    A null or empty text gives an empty array and an empty string. A null id stays null, and
    repeated rows are encoded each for itself. An empty table gives no rows. Other columns are
    not read.
    """
    with open(model_path, "rb") as f:
        proto = f.read()
    load(proto)
    proto = docs.sparkSession.sparkContext.broadcast(proto)
    docs = take(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = process_cache("chunk_tables")
        key = (hash(proto.value), table_rows)
        if key not in cache:
            model = load(proto.value)
            cache[key] = model, DistinctTable(lambda new: segment(model, new), table_rows)
        model, table = cache[key]
        for batch in text_groups(batches):
            parts = [chunks(t) for t in batch.column("text").to_pylist()]
            ids, n = table.lookup([c for p in parts for c in p])
            ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum([len(p) for p in parts]))]
            out = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
            if decoded:
                flat, at = ids.tolist(), ends.tolist()
                out.append(pa.array(model.decode([flat[a:b] for a, b in zip(at, at[1:])], num_threads=1), pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "decoded"][: len(out)])

    return docs.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(coded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The library's decode of every id array: doc_id and text. A null array gives an empty text."""
    with open(model_path, "rb") as f:
        proto = coded.sparkSession.sparkContext.broadcast(f.read())
    coded = coded.select(coded[f"`{id_col}`"].alias("doc_id"), coded[f"`{ids_col}`"].cast("array<int>").alias("ids"))
    kind = coded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(proto.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [[i for i in x or [] if i is not None] for x in part.column("ids").to_pylist()]
                text = pa.array(model.decode(ids, num_threads=1) if ids else [], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), text], names=["doc_id", "text"])

    return coded.mapInArrow(run, f"doc_id {kind}, text string")
