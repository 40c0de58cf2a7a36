"""Language, quality and language-model scores: held-out accuracy, brute force, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF
from tests.llm.conftest import ODD
from tokenmill.llm import byte_cnn, maxent, passages
from tokenmill.llm.word_hashes import words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_on_held_out_rows(spark, docs):
    found = entry.queries()["op2_byte_cnn"](spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)


def test_language_of_odd_rows(spark, odd, docs, empty):
    both = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "row", "n", "label", "bands").unionByName(
        docs.select("doc_id", "text", "lang"), allowMissingColumns=True
    )
    rows = byte_cnn.identify(both, F.col("lang").isNotNull(), carry=True).where("row.n is not null").collect()
    assert len(rows) == len(ODD) and {r.row.label for r in rows} == {"h"}
    for r in rows:
        letters = any(c.isalpha() for c in r.row.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    nothing = byte_cnn.identify(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    one = byte_cnn.identify(odd.withColumn("lang", F.lit("xx")), F.lit(True)).where("doc_id = 9").collect()
    assert {(r.lang_pred, r.score) for r in one} == {("xx", 1.0)}
    assert byte_cnn.identify(empty, F.lit(True)).count() == 0


def test_every_window_counts():
    """A text's probabilities rest on all its windows, so its end matters however long it is."""
    data, offsets = byte_cnn.text_bytes(__import__("pyarrow").array(["a" * 1000, None, "", "b"]))
    doc, start, end = byte_cnn.spans(offsets, byte_cnn.WINDOW)
    assert doc.tolist() == [0, 0, 0, 0, 1, 2, 3]
    rows = byte_cnn.windows(data, start, end)
    assert (rows[:, : byte_cnn.WINDOW] > 0).sum() == 1001
    net = byte_cnn.train(["aaaa", "bbbb"], ["a", "b"], epochs=1)
    taps = sum(np.take(net.taps[j], rows[:, j : j + byte_cnn.WINDOW], axis=0) for j in range(4))
    assert np.allclose(byte_cnn.convolve(rows, net.pairs()), taps)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = entry.queries()["op4_attention_quality"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_quality_of_odd_rows(spark, odd, docs, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    both = odd.unionByName(docs.select("doc_id", "text"), allowMissingColumns=True)
    rows = passages.score(both, labels, F.col("n").isNull(), carry=True).where("row.n is not null").collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.row.text or "")}) == 1
    none = labels.limit(0)
    assert {r.score for r in passages.score(odd, none, F.lit(True)).collect()} == {0.5}
    assert {r.score for r in passages.score(docs, labels.where("quality = 1"), F.lit(True)).collect()} == {1.0}
    assert passages.score(empty, labels, F.lit(True)).count() == 0


def test_attention_gradient():
    """The backward pass agrees with finite differences through one training step's loss."""
    rng = np.random.default_rng(0)
    net = passages.train(["a b c", "d !! e"], [1, 0], epochs=1)
    x, n = rng.normal(size=(5, passages.FEATURES)), np.array([2, 3])
    p, (code, t, g, a, bag, at) = net.forward(x, n)
    assert np.allclose(np.add.reduceat(a, at), 1) and p.shape == (2,)
    near = net.parts()[2]
    before = near[0, 0]
    loss = lambda: -np.log(net.forward(x, n)[0])[0]
    near[0, 0] = before + 1e-5
    up = loss()
    near[0, 0] = before - 1e-5
    down = loss()
    near[0, 0] = before
    own = slice(0, 2)
    d_bag = (p[0] - 1) * net.out[:-1]
    d_a = code[own] @ d_bag
    d_a = a[own] * (d_a - (a[own] * d_a).sum())
    d_g = d_a[:, None] * net.attend * t[own] * g[own] * (1 - g[own])
    assert (up - down) / 2e-5 == pytest.approx((code[own].T @ d_g)[0, 0], rel=1e-3)


def plain_words(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0d]+", low)


def test_words_and_hashes():
    texts = [t for _, t in ODD] + ["Tail ABC\tabc\x0babc\x0c", "\n\n", "É é"]
    data, offsets = byte_cnn.text_bytes(__import__("pyarrow").array(texts))
    hashes, start, first = words(data, offsets)
    by_word = {}
    for t, a, b in zip(texts, first[:-1], first[1:]):
        own = plain_words(t)
        assert len(own) == b - a
        for w, h in zip(own, hashes[a:b].tolist()):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def check_scores(rows, texts, train):
    counts = Counter(w for i in train for w in [*plain_words(texts[i]), b"\n"])
    total, kinds = sum(counts.values()), len(counts)
    for r in rows:
        own = [*plain_words(texts[r.doc_id]), b"\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_scores_against_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    rows = entry.queries()["op6_maxent_scores"](spark, SF).collect()
    assert len(rows) == len(texts) and all(r.held_out == out(r.doc_id) for r in rows)
    check_scores(rows, texts, [i for i in texts if not out(i)])
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_joined_counts_equal_the_table(spark, docs):
    """With room for few words in the tasks the join answers for the rest, with the same result."""
    learn = F.col("doc_id") % 3 != 0
    big = {r.doc_id: r for r in maxent.score(docs, learn, rounds=0).collect()}
    small = {r.doc_id: r for r in maxent.score(docs, learn, rounds=0, table_words=600).collect()}
    for i, r in big.items():
        assert small[i].n_known == r.n_known
        assert small[i].base_score == pytest.approx(r.base_score, rel=1e-9)
        assert small[i].score == pytest.approx(r.score, rel=1e-6)


def test_model_is_a_distribution():
    """Class and word probabilities sum to one: over all classes, head words, rare words and the unseen one."""
    lex = maxent.Lexicon(
        np.array([1, 2], np.uint64), np.array([5, 3]), 1, np.array([1], np.uint64), np.array([0]), np.full(65536, maxent.HEADS),
        np.zeros(maxent.CLASSES), np.bincount([maxent.HEADS], [3], maxent.CLASSES), np.bincount([maxent.HEADS], [1], maxent.CLASSES), 8, 2,
    )
    cls = np.array([maxent.HEADS])
    assert 10 ** lex.rare(np.array([3]), cls)[0] + 10 ** lex.rare(np.array([0]), cls)[0] == pytest.approx(1)
    rows = np.zeros((1, 5), int)
    w = maxent.start(lex)
    every = [10 ** maxent.log_probability(rows, w.cls, w.cls_bias, np.array([c]))[0] for c in range(maxent.CLASSES)]
    assert sum(every) == pytest.approx(1, abs=1e-5)


def test_scores_of_odd_rows(spark, odd, empty):
    rows = maxent.score(odd, F.lit(True)).collect()
    assert len(rows) == len(ODD)
    by_text = Counter(len(plain_words(t)) + 1 for _, t in ODD)
    assert Counter(r.n_tokens for r in rows) == by_text
    assert all(r.n_known == r.n_tokens for r in rows)
    untrained = maxent.score(odd, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens) for r in untrained} == {(0, 0)} and all(r.score <= 0 for r in untrained)
    assert maxent.score(empty, F.lit(True)).count() == 0
