"""The n-gram Jaccard join against all pairs that share a shingle."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import ODD
from tokenmill.llm import bit_filter, jaccard_prefixes


def brute(rows, width, share):
    """Sorted (id, set size, component) of every row, None last."""
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for k, s in enumerate(sets):
        for other, both in Counter(o for g in s for o in having[g]).items():
            if share[1] * both >= share[0] * (len(s) + len(sets[other]) - both):
                root[find(k)] = find(other)
        for g in s:
            having[g].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return ordered((i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


def got(df, **parameters):
    return ordered(tuple(r) for r in jaccard_prefixes.groups(df, **parameters).collect())


@pytest.fixture(scope="module")
def crowd():
    """Near copies and chains of a text, texts of few common passages, long and short texts, exact copies, odd rows."""
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    words = lambda n: rng.choices(vocab, k=n)

    def edit(text, n):
        text = list(text)
        for _ in range(n):
            text[rng.randrange(len(text))] = rng.choice(vocab)
        return text

    passages, base, long = [words(40) for _ in range(6)], words(120), words(900)
    texts = [edit(base, rng.randint(0, 5)) for _ in range(120)]
    chain = base
    for _ in range(50):
        chain = edit(chain, 2)
        texts.append(chain)
    texts += [sum(rng.sample(passages, 2), []) + words(rng.randint(0, 6)) for _ in range(150)]
    texts += [sum(rng.sample(passages, 3), []) + words(rng.randint(0, 12)) for _ in range(60)]
    texts += [words(rng.randint(1, 80)) for _ in range(100)] + [words(rng.randint(1, 8)) for _ in range(40)]
    texts += [edit(long[: rng.randint(850, 900)], rng.randint(0, 14)) for _ in range(40)]
    texts += texts[:80]
    rng.shuffle(texts)
    rows = [(i + 1, " ".join(w)) for i, w in enumerate(texts)]
    return rows + [(None, rows[3][1]), (None, "x y"), (5, "other text of five"), (7, None), (8, ""), (9, " \t "), (None, None)]


@pytest.mark.parametrize("width, share, parameters", [
    (4, (85, 100), {}),
    (4, (85, 100), {"frequent": 3, "rounds": 0, "block_rows": 8}),
    (2, (1, 2), {"frequent": 4, "rounds": 1, "k": 3, "long_set": 50, "block_rows": 8}),
])
def test_join_against_all_pairs(spark, crowd, width, share, parameters):
    df = spark.createDataFrame(crowd, "doc_id long, text string").repartition(4)
    assert got(df, width=width, share=share, **parameters) == brute(crowd, width, share)


def test_join_of_odd_rows(spark, odd, empty):
    assert got(odd, width=1) == brute(ODD, 1, (4, 5))
    assert jaccard_prefixes.groups(empty).count() == 0
    assert got(odd.where("doc_id = 2")) == [(2, 0, 2)]


def test_combinations_are_all_rising_tuples():
    assert jaccard_prefixes.combinations([2, 3]).tolist() == [[0, 1], [0, 2], [1, 2]]
    assert len(jaccard_prefixes.combinations([5, 6, 7])) == sum(1 for a in range(5) for b in range(a + 1, 6) for _ in range(b + 1, 7))
    assert jaccard_prefixes.combinations([1, 1]).shape == (0, 2)


def test_linked_sets_share_a_key():
    """Whatever is rare or frequent, two sets at the limit or above have a key in common."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        n, share = int(rng.integers(1, 60)), ((85, 100), (1, 2), (2, 3))[rng.integers(3)]
        universe = np.unique(rng.integers(0, 1 << 62, 2 * n + 8).astype(np.uint64))
        often = rng.random(len(universe)) < rng.random()
        a = rng.random(len(universe)) < n / len(universe)
        b = a ^ (rng.random(len(universe)) < 0.3 * rng.random())
        both = int((a & b).sum())
        if not both or share[1] * both < share[0] * int((a | b).sum()):
            continue
        keys = []
        for own in (a, b):
            # a token of one set only may be left out, or not, as a map of bits has it
            seen = own & ((a & b) | (rng.random(len(universe)) < 0.5))
            keys.append(set(jaccard_prefixes.posting_keys(universe[seen & ~often], universe[seen & often], int(own.sum()), share, 2, 20).tolist()))
        assert keys[0] & keys[1]


def test_bit_filter_misses_none(spark):
    rng = np.random.default_rng(1)
    inside, outside = (rng.integers(-(1 << 63), 1 << 63, 5000) for _ in range(2))
    inside[:2] = 0, -1
    bits = bit_filter.build(spark.createDataFrame([(int(i),) for i in inside], "h long"), "h")
    assert bit_filter.passes(bits, inside.view(np.uint64)).all() and bit_filter.passes(bits, outside.view(np.uint64)).mean() < 0.05
    none = bit_filter.build(spark.createDataFrame([], "h long"), "h")
    assert not bit_filter.passes(none, inside.view(np.uint64)).any()
