"""Packing and pieces against the libraries on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from tokenmill.llm import binary_packing, chunk_pieces

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def key(rows):
    return sorted(rows, key=str)


def test_pack_gives_the_library_ids_in_powers_of_two(spark, odd):
    library = Tokenizer.from_file(WORDS)
    rows = binary_packing.pack(odd, WORDS, capacity=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    docs, at = [], {}
    for r in sorted(rows, key=lambda r: r.sequence_id):
        assert r.length == 1 << r.bucket <= 64 and r.offset == 0 and len(r.ids) == 4 * r.length
        if r.piece_no == 0:
            docs.append((r.doc_id, []))
        assert r.start == len(docs[-1][1])
        docs[-1][1].extend(np.frombuffer(r.ids, "<u4").tolist())
        assert r.doc_tokens >= len(docs[-1][1])
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in ODD]
    assert key(docs) == key(want)


def test_pack_splits_at_the_tokenizers_white_space_only(spark):
    """Every character that Python or Unicode counts as white space, inside, before and behind words."""
    library = Tokenizer.from_file(WORDS)
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()] + ["\u180e", "\u200b", "\u2060", "\ufeff"]
    texts = [t for c in spaces for t in (f"a{c}b", f"{c}Ab {c} c{c}", f"a{c}\x1cb {c}\x1f")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: [] for i in range(len(texts))}
    for r in sorted(binary_packing.pack(df, WORDS).collect(), key=lambda r: r.sequence_id):
        got[r.doc_id].extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}


@pytest.mark.parametrize("n", [1, 2, 3, 63, 64, 65, 127, 128, 1000])
def test_powers(n):
    sizes = binary_packing.powers(n, 64)
    assert sum(sizes) == n and all(s & (s - 1) == 0 for s in sizes) and sizes == sorted(sizes, reverse=True)
    assert len(set(sizes[n // 64 :])) == len(sizes[n // 64 :])


def test_small_table_is_refilled_without_harm(spark, odd):
    a = binary_packing.pack(odd, WORDS, table_rows=2).select("doc_id", "start", "ids").collect()
    b = binary_packing.pack(odd, WORDS).select("doc_id", "start", "ids").collect()
    assert key(a) == key(b)


def test_buckets_are_written_apart(spark, odd, tmp_path):
    binary_packing.write_buckets(binary_packing.pack(odd, WORDS), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.length for r in back.where("bucket = 1").collect()} == {2}


def test_pieces_equal_the_library(spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = chunk_pieces.encode(odd, PIECES, decoded=True).collect()
    want = []
    for i, t in ODD:
        ids = library.encode(t or "")
        want.append((i, ids, library.decode(ids)))
    assert key(tuple(r) for r in rows) == key(want)
    back = chunk_pieces.decode(chunk_pieces.encode(odd, PIECES), PIECES).collect()
    assert key(tuple(r) for r in back) == key((i, d) for i, _, d in want)


def test_empty_table(spark, empty):
    assert binary_packing.pack(empty, WORDS).count() == 0
    assert chunk_pieces.encode(empty, PIECES).count() == 0


def test_queries_equal_the_library(spark):
    import __spark_entry__ as entry
    from tests.conftest import SF

    library = Tokenizer.from_file(WORDS)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {k: library.encode(t, add_special_tokens=False).ids + [1] for k, t in texts.items()}
    rows = entry.queries()["op7_binary_packing"](spark, SF).collect()
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
