from collections import Counter

import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF
from tokenmill.operators import tokens as tk
from tokenmill.operators.merges import learn

PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
TEXTS = [
    "Hello world! I'm here, you're not.\n\n  Numbers: 123, 4567, 89", "'LL 'Ve  tabs\t\tand   spaces   \n x",
    "Special chars: @#$%^&*()\r\n\r\nUnicode: 你好世界 🌍", "nbsp  x  wide　y", "", " ", "a", "\n\n\n", "ßé é ﬁ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    base = spark.createDataFrame(rows, "doc_id bigint, text string")
    return base.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))


@pytest.fixture(scope="module")
def merges(docs):
    return tk.train_bpe(tk.count_pretokens(docs), 256 + 40 + 9).orderBy("rank").collect()


@pytest.fixture(scope="module")
def vocab(spark, merges):
    return tk.vocab_table(spark.createDataFrame(merges, "rank int, left int, right int, token_id int, n bigint"))


def test_pretokens_equal_the_regex_module(docs):
    for r in docs.select("text", tk.pretokens("text").alias("p")).collect():
        assert r.p == regex.findall(PATTERN, r.text)


def naive_bpe(words, n):
    state = {tuple(w.encode()): c for w, c in words.items()}
    spelled = {i: bytes([i]) for i in range(256)}
    out = []
    for rank in range(n):
        pairs = Counter()
        for w, c in state.items():
            for p in zip(w, w[1:]):
                pairs[p] += c
        (a, b), c = min(pairs.items(), key=lambda x: (-x[1], spelled[x[0][0]], spelled[x[0][1]]))
        new = 256 + rank
        spelled[new] = spelled[a] + spelled[b]
        out.append((a, b, c))
        nxt = {}
        for w, k in state.items():
            m, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and (w[i], w[i + 1]) == (a, b):
                    m.append(new)
                    i += 2
                else:
                    m.append(w[i])
                    i += 1
            nxt[tuple(m)] = nxt.get(tuple(m), 0) + k
        state = nxt
    return out


def test_batched_learning_equals_one_at_a_time(docs, merges):
    words = Counter(w for r in docs.collect() for w in regex.findall(PATTERN, r.text))
    assert [(m.left, m.right, m.n) for m in merges] == naive_bpe(words, 40)


@pytest.mark.parametrize("most_pieces, first_pairs", [(1, 1), (3, 2), (100, 8)])
def test_learning_with_ties_and_few_pieces(spark, most_pieces, first_pairs):
    """Ties, runs of one letter and a vocabulary that runs out, however few pieces come together."""
    words = {"abab": 2, "cdcd": 2, "efef": 2, "aaaa": 3, "xyz": 2, "zyx": 2, "bcde": 1, "q": 9, "é" * 7: 2}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    got = learn(df, 14, most_pieces, first_pairs)
    assert [(m[1], m[2], m[4]) for m in got] == naive_bpe(words, 14)
    every = learn(df, 1000, most_pieces, first_pairs)
    assert every[:14] == got and len(every) < 1000 and [m[0] for m in every] == list(range(len(every)))


def test_learning_nothing(spark):
    none = spark.createDataFrame([], "word string, n bigint")
    assert learn(none, 5) == [] and learn(spark.createDataFrame([("a", 3)], "word string, n bigint"), 5) == []
    assert tk.train_bpe(none, 256 + 9).count() == 0


def indexed_bpe(words, n):
    """One merge at a time; only the words that hold the pair are looked at."""
    tokens, times = [list(w) for w, _ in words], [k for _, k in words]
    spelled = {i: bytes([i]) for i in range(256)}
    count, having, out = Counter(), {}, []
    for i, t in enumerate(tokens):
        for p in zip(t, t[1:]):
            count[p] += times[i]
            having.setdefault(p, set()).add(i)
    for rank in range(n):
        most = max(count.values())
        pair = min((p for p, k in count.items() if k == most), key=lambda p: (spelled[p[0]], spelled[p[1]]))
        spelled[256 + rank] = spelled[pair[0]] + spelled[pair[1]]
        out.append((rank, *pair, 256 + rank, most))
        for i in having[pair]:
            t, new, k = tokens[i], [], 0
            while k < len(t):
                hit = tuple(t[k : k + 2]) == pair
                new.append(256 + rank if hit else t[k])
                k += 1 + hit
            count.subtract({p: c * times[i] for p, c in Counter(zip(t, t[1:])).items()})
            count.update({p: c * times[i] for p, c in Counter(zip(new, new[1:])).items()})
            for p in zip(new, new[1:]):
                having.setdefault(p, set()).add(i)
            tokens[i] = new
    return out


def test_a_vocabulary_in_few_passes(spark):
    """The query's 2000 merges equal one-at-a-time learning; a pass takes hundreds and touches few pieces."""
    words = [(r.word.encode(), r.n) for r in tk.count_pretokens(spark.read.parquet(f"{SF}/documents.parquet")).collect()]
    got = entry.queries()["a10_learn_vocabulary"](spark, SF).orderBy("rank").collect()
    assert [tuple(r) for r in got] == indexed_bpe(words, 2000)
    log = []
    df = spark.createDataFrame([(w.decode(), n) for w, n in words], "word string, n bigint")
    assert len(learn(df, 600, 3000, report=log.append)) == 600
    jobs = sum(x["jobs"] for x in log)
    assert jobs < 120 and all(x["pieces"] <= 3000 for x in log) and log[-1]["rewritten"] < len(words)


def test_ids_equal_tiktoken(docs, vocab):
    rows = vocab.filter("not is_special").collect()
    enc = tiktoken.Encoding("ours", pat_str=PATTERN, mergeable_ranks={bytes(r.bytes): r.token_id for r in rows}, special_tokens={})
    ids = {r.doc_id: r.ids for r in tk.tokenize(docs, vocab, ["doc_id"]).collect()}
    for r in docs.collect():
        assert ids[r.doc_id] == enc.encode_ordinary(r.text)


def test_round_trip_and_ends(docs, vocab):
    assert tk.round_trip_errors(docs, vocab, ["doc_id"]).count() == 0
    sp = tk.special_ids(vocab)
    out = tk.tokenize(docs, vocab, ["doc_id"], prepend=sp["<|bos|>"], append=sp["<|user_end|>"])
    plain = {r.doc_id: r.ids for r in tk.tokenize(docs, vocab, ["doc_id"]).collect()}
    for r in out.collect():
        assert r.ids == [sp["<|bos|>"], *plain[r.doc_id], sp["<|user_end|>"]]


def test_partitioning_does_not_matter(docs, vocab):
    a = sorted(map(str, tk.tokenize(docs.repartition(1), vocab, ["doc_id"]).collect()))
    assert a == sorted(map(str, tk.tokenize(docs.repartition(7), vocab, ["doc_id"]).collect()))


def test_special_tokens_and_byte_lengths(spark, vocab):
    assert list(tk.special_ids(vocab)) == list(tk.SPECIAL_TOKENS)
    exact = {r.token_id: r.n_bytes for r in tk.token_bytes(vocab).collect()}
    assert exact[0x41] == 1 and exact[0xE9] == 1 and exact[256 + 40] == 0
    shown = {r.token_id: r.n_bytes for r in tk.token_bytes(vocab, "utf8_replace").collect()}
    assert shown[0x41] == 1 and shown[0xE9] == 3


def test_vocabulary_limits(spark):
    words = spark.createDataFrame([("ab", 1)], "word string, n bigint")
    with pytest.raises(ValueError):
        tk.train_bpe(words, 100)
    assert tk.train_bpe(words, 256 + 9 + 50).count() == 1


def test_long_words(docs, vocab):
    """Long pre-tokens take another path to the same ids."""
    ranks = {bytes(r.bytes): r.token_id for r in vocab.filter("not is_special").collect()}
    for word in (b"the" * 90, b"t" * 301, b"thethan" * 40, bytes(range(256)) * 2, b"aabaa" * 60):
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                break
            _, i = min(pairs)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert tk._encode_word(word, ranks) == [ranks[p] for p in parts]


def test_a_batch_is_encoded_in_bounded_slices(spark, monkeypatch):
    """Rows lie in one slice each, in order; ids do not depend on the slices."""
    lists = pa.array([["ab", "c"], [], ["d" * 50], None, ["e"], ["f" * 9, "g"]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), lists], names=["k", "words"])
    monkeypatch.setattr(tk, "SLICE_BYTES", 8)
    for whole in (batch, batch.slice(1), batch.slice(2, 0)):
        parts = list(tk.slices(whole, "words"))
        assert [r for p in parts for r in p.to_pylist()] == whole.to_pylist()
    assert [p.num_rows for p in tk.slices(batch, "words")] == [3, 3]


@pytest.mark.parametrize("first", [None, 256])
def test_byte_ids_of_slices(spark, first):
    """Null, empty and wide texts, and texts around the size of a slice; no pattern runs over their bytes."""
    texts = ["", None, "aé\u4e2d\U0001f600", "x" * (tk.SLICE_BYTES + 3), None, "\x00\x7f", "y" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)
    out = tk.byte_ids(df, ["k"], first=first)
    lead = [] if first is None else [first]
    assert {r.k: r.ids for r in out.collect()} == {k: None if x is None else lead + list(x.encode()) for k, x in enumerate(texts)}
    plan = entry.queries()["t5_pack_flat"](spark, SF)._jdf.queryExecution().toString()
    assert "regexp" not in plan and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
