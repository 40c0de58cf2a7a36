"""Queries over ``documents``: vocabularies, tokens, compression."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.catalog.base import query, table
from tokenmill.operators import tokens as tk
from tokenmill.plans.session import spread

# RE2 has neither possessive quantifiers nor lookahead. The possessive ones change nothing
# here, and the lookahead is replaced by a mark before the last blank of a run of blanks.
_W = r"\t-\r\x20\x85\p{Z}"
_SQL_PATTERN = (
    r"''(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}\x01]?\p{L}+|\p{N}{1,2}| ?[^" + _W + r"\p{L}\p{N}\x01]+[\r\n]*|["
    + _W + r"]*[\r\n]|[" + _W + r"]+"
)
WORDS = f"""
    WITH m AS (SELECT doc_id, lang, regexp_replace(text, '([\\t\\x0b\\x0c\\x20\\x85\\p{{Z}}])([\\t\\x0b\\x0c\\x20\\x85\\p{{Z}}][^{_W}])', '\\1' || chr(1) || '\\2', 'g') AS text FROM documents),
    w AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{_SQL_PATTERN}')) AS word FROM m)"""


def _docs(spark, sf):
    return spread(table(spark, sf, "documents"), "doc_id")


@query("a9_count_pretokens", WORDS + " SELECT word, count(*) AS n FROM w GROUP BY word")
def count_pretokens(spark, sf):
    return tk.count_pretokens(_docs(spark, sf))


@query("a9_pretokens_by_language", WORDS + """
    SELECT lang, count(*) AS n_words, count(DISTINCT word) AS n_distinct, CAST(sum(length(word)) AS BIGINT) AS n_chars FROM w GROUP BY lang""")
def pretokens_by_language(spark, sf):
    w = _docs(spark, sf).select("lang", F.explode(tk.pretokens("text")).alias("word"))
    per = w.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("lang").agg(
        F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"),
        F.sum(F.col("n") * F.length("word")).alias("n_chars"))


def _merge_sql(n: int = 24, words: str = WORDS, times: str = "count(*)") -> str:
    """Tables of ``n`` merges, each learned from the words after the one before; ``words`` ends with the table w of words.

    A token is one character; p0, p1, ... hold the merged pairs, the last v spells every token
    and the last w has each word as tokens. Ties go to the smaller left, then right bytes.
    """
    at = 19968
    sql = words + f""",
    w0 AS MATERIALIZED (SELECT word, n, array_to_string(list_transform(regexp_extract_all(hex(encode(word)), '..'),
        lambda x: chr({at} + CAST(('0x' || x) AS INTEGER))), '') AS t FROM (SELECT word, {times} AS n FROM w GROUP BY word)),
    v0 AS (SELECT chr({at} + CAST(i AS INTEGER)) AS c, printf('%02X', i) AS spelled FROM range(256) r(i))"""
    for k in range(n):
        new = at + 256 + k
        sql += f""",
    p{k} AS MATERIALIZED (SELECT l, r, x.n, a.spelled AS sl, b.spelled AS sr FROM (
            SELECT substr(t, i, 1) AS l, substr(t, i + 1, 1) AS r, sum(n) AS n FROM (SELECT t, n, unnest(range(1, length(t))) AS i FROM w{k}) GROUP BY ALL) x
        JOIN v{k} a ON a.c = l JOIN v{k} b ON b.c = r ORDER BY x.n DESC, a.spelled, b.spelled LIMIT 1),
    v{k + 1} AS MATERIALIZED (SELECT * FROM v{k} UNION ALL SELECT chr({new}), sl || sr FROM p{k}),
    w{k + 1} AS MATERIALIZED (SELECT word, w{k}.n, replace(t, l || r, chr({new})) AS t FROM w{k}, p{k})"""
    return sql


# Ids of a document: the start token, then the tokens of its words in order.
_CODED = """,
    q AS (SELECT doc_id, lang, word, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos FROM (
        SELECT doc_id, lang, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (
            SELECT doc_id, lang, regexp_extract_all(text, '{pattern}') AS ws FROM m))),
    d AS (SELECT documents.doc_id, documents.lang, strlen(documents.text) AS size, coalesce(string_agg(t, '' ORDER BY pos), '') AS t
          FROM documents LEFT JOIN (SELECT q.doc_id, q.pos, w24.t FROM q JOIN w24 USING (word)) j ON j.doc_id = documents.doc_id GROUP BY ALL)"""
CODED = _CODED.replace("{pattern}", _SQL_PATTERN)


def _merges(spark, sf, n=24):
    return tk.train_bpe(tk.count_pretokens(_docs(spark, sf)), 256 + n + 9)


@query("a10_train_bpe", _merge_sql() + " " + " UNION ALL ".join(
    f"""SELECT CAST({k} AS INTEGER) AS rank, CAST(unicode(l) - 19968 AS INTEGER) AS "left", CAST(unicode(r) - 19968 AS INTEGER) AS "right",
        CAST({256 + k} AS INTEGER) AS token_id, CAST(n AS BIGINT) AS n FROM p{k}""" for k in range(24)))
def train_bpe(spark, sf):
    return _merges(spark, sf)


# A vocabulary of the usual kind; SQL would need a table for each merge.
@query("a10_learn_vocabulary")
def learn_vocabulary(spark, sf):
    return _merges(spark, sf, 2000)


# The first merge is the most frequent byte pair inside a word.
@query("a10_first_merge", WORDS + """,
    h AS (SELECT hex(encode(word)) AS h, count(*) AS n FROM w GROUP BY word),
    p AS (SELECT substr(h, i, 2) AS l, substr(h, i + 2, 2) AS r, n FROM (SELECT h, n, unnest(range(1, len(h) - 2, 2)) AS i FROM h)),
    c AS (SELECT l, r, sum(n) AS n FROM p GROUP BY ALL ORDER BY n DESC, l, r LIMIT 1)
    SELECT CAST(('0x' || l) AS INTEGER) AS "left", CAST(('0x' || r) AS INTEGER) AS "right", CAST(n AS BIGINT) AS n FROM c""")
def first_merge(spark, sf):
    return _merges(spark, sf, 1).select("left", "right", "n")


@query("a11_token_bytes", """
    SELECT CAST(i AS INTEGER) AS token_id, CAST(1 AS INTEGER) AS n_bytes FROM range(256) t(i)
    UNION ALL SELECT CAST(256 + i AS INTEGER), 0 FROM range(9) t(i) WHERE (SELECT count(*) FROM documents) > 0""")
def token_bytes(spark, sf):
    merges = _merges(spark, sf, 0)
    return tk.token_bytes(tk.vocab_table(merges))


@query("a7_vocab_stats", _merge_sql() + """
    SELECT count(*) AS n_tokens, CAST(min(n) AS BIGINT) AS min_bytes, CAST(max(n) AS BIGINT) AS max_bytes,
           round(avg(n), 6) AS mean_bytes, round(stddev_samp(n), 6) AS std_bytes FROM (SELECT length(spelled) // 2 AS n FROM v24)""")
def vocab_stats(spark, sf):
    from tokenmill.operators.metrics import vocab_stats as stats

    return stats(tk.token_bytes(tk.vocab_table(_merges(spark, sf))))


# Byte lengths of the corpus' own words stand for a vocabulary here.
@query("a7_word_byte_stats", WORDS + """,
    v AS (SELECT DISTINCT word, strlen(word) AS n FROM w)
    SELECT count(*) AS n_tokens, CAST(min(n) AS BIGINT) AS min_bytes, CAST(max(n) AS BIGINT) AS max_bytes,
           round(avg(n), 6) AS mean_bytes, round(stddev_samp(n), 6) AS std_bytes FROM v""")
def word_byte_stats(spark, sf):
    from tokenmill.operators.metrics import vocab_stats as stats

    words = tk.count_pretokens(_docs(spark, sf))
    return stats(words.select(F.octet_length("word").alias("n_bytes")))


@query("t1_tokenize", _merge_sql() + CODED + """
    SELECT doc_id, CAST(length(t) + 1 AS INTEGER) AS n_tokens, md5(array_to_string(['280'] || CASE WHEN t = '' THEN [] ELSE
        list_transform(string_split(t, ''), lambda c: CAST(unicode(c) - 19968 AS VARCHAR)) END, ' ')) AS digest FROM d""")
def tokenize(spark, sf):
    vocab = tk.vocab_table(_merges(spark, sf))
    bos = tk.special_ids(vocab)["<|bos|>"]
    out = tk.tokenize(_docs(spark, sf), vocab, ["doc_id"], prepend=bos)
    return out.select("doc_id", F.size("ids").alias("n_tokens"), F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("digest"))


@query("t1_tokenize_bytes", """
    SELECT doc_id, strlen(text) + 2 AS n_tokens, md5('256 ' || array_to_string(list_transform(
        regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(('0x' || h) AS INTEGER)), ' ') || ' 257') AS digest FROM documents""")
def tokenize_bytes(spark, sf):
    out = tk.tokenize(_docs(spark, sf), tk.byte_vocab(spark), ["doc_id"], prepend=256, append=257)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                      F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("digest"))


@query("t2_round_trip", "SELECT doc_id, md5(text) AS digest FROM documents")
def round_trip(spark, sf):
    vocab = tk.vocab_table(_merges(spark, sf))
    back = tk.detokenize(tk.tokenize(_docs(spark, sf), vocab, ["doc_id"]), vocab, ["doc_id"])
    return back.select("doc_id", F.md5("text").alias("digest"))


@query("a6_compression", """
    SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(sum(strlen(text)) AS BIGINT) AS base_tokens,
           CAST(sum(length(text)) AS BIGINT) AS ours_tokens, round(1.0, 6)::DOUBLE AS base_ratio,
           round(CAST(sum(strlen(text)) AS DOUBLE) / sum(length(text)), 6) AS ours_ratio,
           round(100.0::DOUBLE * CAST(sum(strlen(text)) - sum(length(text)) AS DOUBLE) / sum(strlen(text)), 6) AS saved_pct,
           CASE WHEN sum(strlen(text)) > sum(length(text)) THEN 'ours' ELSE 'tie' END AS better
    FROM documents GROUP BY lang""")
def compression(spark, sf):
    d = _docs(spark, sf)
    size = F.octet_length("text").cast("bigint").alias("n_bytes")
    chars = tk.compression(d.select("lang", size, F.length("text").alias("n_tokens")), ["lang"])
    bytes_ = tk.compression(d.select("lang", size, F.octet_length("text").alias("n_tokens")), ["lang"])
    return tk.compare_tokenizers(chars, bytes_, ["lang"], "bytes")


@query("a6_compression_bpe", _merge_sql() + CODED + """,
    c AS (SELECT lang, CAST(sum(size) AS BIGINT) AS n_bytes, CAST(sum(length(t)) AS BIGINT) AS n FROM d GROUP BY lang)
    SELECT lang, n_bytes, n_bytes AS base_tokens, n AS ours_tokens, round(1.0, 6)::DOUBLE AS base_ratio,
           round(CAST(n_bytes AS DOUBLE) / n, 6) AS ours_ratio, round(100.0::DOUBLE * CAST(n_bytes - n AS DOUBLE) / n_bytes, 6) AS saved_pct,
           CASE WHEN n_bytes > n THEN 'ours' ELSE 'tie' END AS better FROM c""")
def compression_bpe(spark, sf):
    vocab = tk.vocab_table(_merges(spark, sf))
    d = _docs(spark, sf)
    ids = tk.tokenize(d.select("doc_id", "lang", F.octet_length("text").cast("bigint").alias("n_bytes"), "text"),
                      vocab, ["lang", "n_bytes"])
    ours = tk.compression(ids.select("lang", "n_bytes", F.size("ids").alias("n_tokens")), ["lang"])
    base = tk.compression(d.select("lang", F.octet_length("text").cast("bigint").alias("n_bytes"),
                                   F.octet_length("text").alias("n_tokens")), ["lang"])
    return tk.compare_tokenizers(ours, base, ["lang"], "bytes")
