"""Near-duplicates, fingerprints, shards and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SF
from tests.llm.conftest import ODD, prose
from tests.llm.test_models import plain_words
from tokenmill.llm import extendible, merkle, near_dedup
from tokenmill.llm.circulant import SPACE, Circulant
from tokenmill.llm.components import components


def shingle_set(text, width):
    own = plain_words(text)
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1)))


def brute_groups(rows, width):
    """Smallest reachable id of every row, from all pairs."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingle_set(t, width)) for i, t in rows]
    for k, (a, s) in enumerate(sets):
        for b, o in sets[:k]:
            if s and o and 5 * len(s & o) >= 4 * len(s | o):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), len(s)) for i, s in sets}


def variants(seed, n, words=60, edits=4):
    """Copies of one text with some words changed, so that some pairs are linked and some are not."""
    rng = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = prose(rng.random(), 1)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block_rows", [8, 512])
def test_groups_against_all_pairs(spark, block_rows):
    """Also with blocks so small that the large buckets are compared across blocks."""
    texts = [t for s in range(6) for t in variants(s, 25, edits=6)] + [prose(99, 40)] * 30 + ["one two", "ONE two", "one", "", " "]
    rows = list(enumerate(texts, 5))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows, 5)
    got = near_dedup.groups(df, block_rows=block_rows).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = entry.queries()["op1_circulant_minhash"](spark, SF).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == brute_groups(rows, 4)


def test_groups_of_odd_rows(spark, odd, empty):
    got = near_dedup.groups(odd).collect()
    assert len(got) == len(ODD)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    # equal single words: the row without an id belongs to no other document here
    assert all(r.component_id == i for i, own in by_id.items() if i is not None for r in own)
    assert all(r.kept for r in got)
    twin = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "z z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup.groups(twin).collect()} == {(None, 4, False), (4, 4, True), (None, None, True)}
    assert near_dedup.groups(empty).count() == 0


def test_circulant_signature():
    """Coordinate k is the smallest value of the second permutation shifted by k."""
    c = Circulant(5)
    second = np.append(c.shifted[:, 0], [])
    values = np.array([3, 77, 1 << 40, SPACE - 1], np.uint64)
    at = c.first[values % SPACE]
    assert sorted(c.first.tolist()) == list(range(SPACE))
    for k in range(5):
        assert c.signature(values, lot=2)[k] == min(second[(at + k) % SPACE])


def test_signature_estimates_similarity():
    c = Circulant(512)
    a = np.arange(0, 1000, dtype=np.uint64) * np.uint64(2654435761)
    assert np.mean(c.signature(a[:800]) == c.signature(a)) == pytest.approx(0.8, abs=0.08)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 400)]
    random.Random(2).shuffle(path)
    star = [(50, 1000 + i) for i in range(200)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 401)} | {i: 50 for i in [50, *range(1000, 1200)]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merkle_tree():
    text = "# Head\nOne sentence. Another one! " + "x" * 300 + "\n\nLast paragraph.\n"
    a = merkle.tree(text)
    assert a.root == merkle.tree(text).root and merkle.likeness(a, a) == 1 and merkle.differences(a, a) == []
    leaves = list(merkle._leaves(a))
    assert sum(n for _, n in leaves) == len(text) == a.n_chars
    b = merkle.tree(text.replace("Another", "Other"))
    assert b.root != a.root and 0.5 < merkle.likeness(a, b) < 1 and merkle.likeness(a, b) == merkle.likeness(b, a)
    ((lo, hi),) = merkle.differences(a, b)
    assert text[lo:hi] == "Another one! "
    empty = merkle.tree("")
    assert merkle.likeness(empty, merkle.tree("")) == 1 and merkle.likeness(empty, a) == 0


def test_edited_forms_against_a_loop(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in entry.queries()["op5_merkle_fingerprints"](spark, SF).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        half, after = len(text) // 2, rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == merkle.tree(text).root.hex() and r.edited_fingerprint == merkle.tree(edited).root.hex()
        assert (r.near_edited == 1) == (edited == text) and 0 <= r.near_next <= 1
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.97


def test_fingerprints_of_odd_rows(spark, odd, empty):
    rows = merkle.against_edits(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    same = [r for r in rows if r.n_chars == 0]
    assert len({r.fingerprint for r in same}) == 1
    plain = merkle.fingerprints(odd).collect()
    assert sorted(r.fingerprint for r in plain) == sorted(r.fingerprint for r in rows)
    alone = merkle.against_edits(odd.where("doc_id = 8")).collect()
    text = dict(ODD)[8]
    half = len(text) // 2
    assert alone[0].edited_sha256 == hashlib.sha256((text[: len(text) - half] + text[:half]).encode()).hexdigest()
    assert merkle.against_edits(empty).count() == 0 and merkle.fingerprints(empty).count() == 0


def test_shards_are_the_leaves_of_splitting(spark):
    """A shard fits, its parent does not, and the shards' bits form a complete prefix code."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = extendible.assign(docs, 20_000, level_bits=3).collect()
    assert len(rows) == docs.count()
    total = Counter()
    for r in rows:
        total[r.shard] += r.n_bytes
        assert r.depth == len(r.shard)
    below = lambda p: sum(n for s, n in total.items() if s.startswith(p))
    n = Counter(r.shard for r in rows)
    for s in total:
        assert total[s] <= 20_000 or n[s] == 1
        assert not s or below(s[:-1]) > 20_000
        assert not any(o != s and o.startswith(s) for o in total)
    assert {(r.shard, r.shard_bytes) for r in rows} == set(total.items())
    md5 = lambda i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b")
    assert all(md5(r.doc_id).startswith(r.shard) for r in rows)


def test_shards_of_one_repeated_row(spark, odd, empty):
    """Rows that share all bits of the id's hash are split by the row's hash."""
    same = spark.createDataFrame([(1, "x" * 100)] * 300, "doc_id long, text string")
    rows = extendible.assign(same, 1000).collect()
    total = Counter()
    for r in rows:
        total[r.shard] += r.n_bytes
    assert len(rows) == 300 and max(total.values()) <= 1000
    odd_rows = extendible.assign(odd, 100).collect()
    assert len(odd_rows) == len(ODD)
    big = [r for r in odd_rows if r.shard_bytes > 100]
    assert len(big) == 1 and big[0].doc_id == 9
    assert extendible.assign(empty, 10).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = docs
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == before.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(kept[name])
    assert len(kept["language"]) == 1000
    wrong = [i for i in kept["language"] if i in labels and labels[i] != (i in kept["quality"])]
    assert len(wrong) <= 0.02 * len(labels)
    rows = sorted(kept["quality"].items())
    want = brute_groups(rows, 5)
    assert set(kept["near_duplicates"]) == {i for i, (c, _) in want.items() if i == c}
    pieces = corpus_pipeline.STAGES[3][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(kept["near_duplicates"])
    assert corpus_pipeline.run(spark, sf).count() == pieces.count()


def test_stages_on_odd_rows(spark, odd, tmp_path):
    table = odd.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"), "source": F.lit(None).cast("string")})
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for sheet in (table, table.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, sheet, str(tmp_path))
            assert out.count() <= (100 if sheet is table else 0)


def test_survivors_of_repeated_and_missing_ids(spark):
    """Different texts of one id stay; of copies one stays, with an id if any has one; the smallest id survives."""
    a, b, c = (prose(seed, 60) for seed in (21, 22, 23))
    rows = [(7, a), (7, b), (3, a + " tail"), (None, c), (None, c), (None, b), (5, ""), (5, None), (None, ""), (9, a), (9, a)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "place"}
    left = sorted(rows[r.place] for r in kept if r.text and r.doc_id is not None)
    assert left == [(3, a + " tail"), (7, b)]
    assert [r.text for r in kept if r.text and r.doc_id is None] == [c]
    assert sum(not r.text for r in kept) == 3
