"""Queries over ``conversations``, ``benchmark`` and ``documents``: rendering to ids and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.catalog.base import query, sql_fewshot, table
from tokenmill.catalog.tokens import _SQL_PATTERN, _W, _merge_sql
from tokenmill.operators import mixing as m, render as r, tokens as tk, turns as t
from tokenmill.plans.session import spread


def _answered(spark, sf):
    return t.trim_trailing(table(spark, sf, "conversations"))


def _text(c):
    return F.array_join(F.col(c).cast("array<string>"), " ").alias(c)


# Byte tokens: a turn has its bytes and two marks, a conversation one more.
RENDER = """
    WITH q AS (SELECT * FROM conversations QUALIFY NOT (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AND role <> 'assistant')),
    m AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS pr, lag(text) OVER w AS pt FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    f AS (SELECT conv_id, turn, role, CASE WHEN n = 2 AND pr = 'system' THEN pt || chr(10) || chr(10) || text ELSE text END AS text
          FROM m WHERE NOT (n = 1 AND role = 'system')),
    b AS (SELECT conv_id, turn, role, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(('0x' || h) AS INTEGER)) AS ids FROM f),
    e AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN list_append(list_prepend(257, ids), 258) ELSE list_append(list_prepend(259, ids), 260) END AS ids,
                 CASE WHEN role = 'user' THEN list_transform(range(len(ids) + 2), lambda x: 0)
                      ELSE list_prepend(0, list_transform(range(len(ids) + 1), lambda x: 1)) END AS mask FROM b),
    c AS (SELECT conv_id, list_prepend(256, flatten(list(ids ORDER BY turn))) AS ids, list_prepend(0, flatten(list(mask ORDER BY turn))) AS mask FROM e GROUP BY 1)"""


@query("t3_render_conversations", RENDER + """
    SELECT conv_id, array_to_string(ids, ' ') AS ids, array_to_string(mask, ' ') AS mask FROM c""")
def render_conversations(spark, sf):
    out = r.render_conversations(_answered(spark, sf), tk.byte_vocab(spark), 1_000_000)
    return out.select("conv_id", _text("ids"), _text("mask"))


@query("t3_cut_conversations", RENDER + """
    SELECT conv_id, CAST(least(len(ids), 600) AS INTEGER) AS n_ids, CAST(greatest(len(ids) - 600, 0) AS INTEGER) AS n_cut, md5(array_to_string(ids[1:600], ' ')) AS digest FROM c""")
def cut_conversations(spark, sf):
    """A limit of 600 ids, and how many each conversation loses by it."""
    out = r.render_conversations(_answered(spark, sf), tk.byte_vocab(spark), 600)
    return out.select("conv_id", F.size("ids").alias("n_ids"), "n_cut", F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("digest"))


@query("t3_render_tool_parts", """
    SELECT conv_id, turn, 8 + 2 * strlen(text) + strlen(CAST(length(text) AS VARCHAR)) + 1 AS n_ids,
           2 * strlen(text) + 3 AS n_trained FROM conversations WHERE role = 'assistant'""")
def render_tool_parts(spark, sf):
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    a = table(spark, sf, "conversations").filter("role = 'assistant'")
    key = F.concat_ws("-", "conv_id", "turn")
    size = F.length("text").cast("string")
    none = F.lit(None).cast(r.PART)
    ask = a.select(key.alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("").alias("text"), none.alias("parts"))
    reply = a.select(key.alias("conv_id"), F.lit(1).alias("turn"), "role", F.lit(None).cast("string").alias("text"),
                     F.array(part("text", F.col("text")), part("python", F.col("text")), part("python_output", size)).alias("parts"))
    out = r.render_conversations(ask.unionByName(reply), tk.byte_vocab(spark), 1_000_000)
    ids = F.split("conv_id", "-")
    return out.select(ids[0].cast("bigint").alias("conv_id"), ids[1].cast("bigint").alias("turn"),
                      F.size("ids").cast("bigint").alias("n_ids"),
                      F.aggregate("mask", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_trained"))


@query("t4_render_prompts", """
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rr, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
                      arg_max(role, turn) OVER (PARTITION BY conv_id) AS last_role FROM conversations),
    h AS (SELECT * FROM k WHERE last_role = 'assistant' AND rr > 1)
    SELECT conv_id, CAST(2 + sum(CASE WHEN n = 1 AND role = 'system' THEN strlen(text) + 2 ELSE strlen(text) + 2 END) AS BIGINT) AS n_ids
    FROM h GROUP BY 1""")
def render_prompts(spark, sf):
    out = r.render_prompts(table(spark, sf, "conversations"), tk.byte_vocab(spark), 1_000_000, on_invalid="drop")
    return out.select("conv_id", F.size("ids").cast("bigint").alias("n_ids"))


# Words of all turns count for the merges; the turns as rendered, with the system turn folded in, count nothing but are encoded.
BPE = RENDER[: RENDER.index("    b AS (")].replace(" m AS (", " t AS (").replace("FROM m WHERE", "FROM t WHERE") + f"""
    a AS (SELECT NULL AS conv_id, NULL AS turn, text, 1 AS k FROM conversations UNION ALL SELECT conv_id, turn, text, 0 FROM f),
    m AS (SELECT * REPLACE (regexp_replace(text, '([\\t\\x0b\\x0c\\x20\\x85\\p{{Z}}])([\\t\\x0b\\x0c\\x20\\x85\\p{{Z}}][^{_W}])', '\\1' || chr(1) || '\\2', 'g') AS text) FROM a),
    w AS (SELECT conv_id, turn, k, unnest(regexp_extract_all(text, '{_SQL_PATTERN}')) AS word FROM m)"""


@query("t3_render_bpe", _merge_sql(16, BPE, "sum(k)") + """,
    l AS (SELECT conv_id, turn, sum(length(t)) AS n FROM w JOIN w16 USING (word) WHERE k = 0 GROUP BY ALL),
    s AS (SELECT f.conv_id, role, coalesce(n, 0) AS n, 1 + coalesce(sum(coalesce(n, 0) + 2) OVER (PARTITION BY f.conv_id ORDER BY f.turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM f LEFT JOIN l USING (conv_id, turn))
    SELECT conv_id, CAST(least(2048, 1 + sum(n + 2)) AS INTEGER) AS n_ids,
           CAST(sum(CASE WHEN role = 'assistant' THEN greatest(0, least(2048, first + n + 2) - (first + 1)) ELSE 0 END) AS BIGINT) AS n_trained
    FROM s GROUP BY 1""")
def render_bpe(spark, sf):
    words = tk.count_pretokens(table(spark, sf, "conversations"))
    vocab = tk.vocab_table(tk.train_bpe(words, 256 + 16 + 9))
    out = r.render_conversations(_answered(spark, sf), vocab, 2048)
    return out.select("conv_id", F.size("ids").alias("n_ids"),
                      F.aggregate("mask", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_trained"))


@query("t8_collate", RENDER + """,
    x AS (SELECT conv_id, ids, mask, row_number() OVER (ORDER BY conv_id) - 1 AS idx FROM c),
    y AS (SELECT *, idx // 8 AS batch_no, max(len(ids)) OVER (PARTITION BY idx // 8) - 1 AS w FROM x)
    SELECT idx, batch_no,
        array_to_string(list_concat(ids[1:len(ids) - 1], list_transform(range(w - len(ids) + 1), lambda z: 260)), ' ') AS inputs,
        array_to_string(list_concat(list_transform(range(2, len(ids) + 1), lambda k: CASE WHEN mask[k] = 1 THEN ids[k] ELSE -1 END),
                                    list_transform(range(w - len(ids) + 1), lambda z: -1)), ' ') AS targets FROM y""")
def collate(spark, sf):
    from tokenmill.plans.scan import dense_index

    out = r.render_conversations(_answered(spark, sf), tk.byte_vocab(spark), 1_000_000)
    return r.collate(dense_index(out, ["conv_id"]), 8, 260).select("idx", "batch_no", _text("inputs"), _text("targets"))


ICL = sql_fewshot(1234, 3)


def _shots(items):
    return m.sample_fewshot(items, 3, ["item_id"])


@query("t10_render_mc", ICL + """,
    h AS (SELECT item_id, string_agg(text || ' ' || CASE WHEN other % 2 = 0 THEN 'yes' ELSE 'no ' || other END || chr(10) || chr(10), '' ORDER BY shot) AS head FROM s GROUP BY 1)
    SELECT item_id, CAST(c AS INTEGER) AS choice, head || text || ' ' || CASE WHEN c = 0 THEN 'yes' ELSE 'no ' || item_id END AS prompt
    FROM p JOIN h USING (item_id), unnest([0, 1]) AS t(c)""")
def render_mc(spark, sf):
    items = table(spark, sf, "benchmark").select(
        "item_id", F.col("text").alias("query"),
        F.array(F.lit("yes"), F.concat(F.lit("no "), "item_id")).alias("choices"), (F.col("item_id") % 2).cast("int").alias("gold"))
    return r.render_icl(items, _shots(items), "mc")


@query("t10_render_schema", ICL + """,
    h AS (SELECT item_id, string_agg(CASE WHEN other % 2 = 0 THEN text ELSE (text || 'x') END || '|' || 'end ' || other || chr(10) || chr(10), '' ORDER BY shot) AS head FROM s GROUP BY 1)
    SELECT item_id, CAST(c AS INTEGER) AS choice, head || CASE WHEN c = 0 THEN text ELSE (text || 'x') END || '|end ' || item_id AS prompt
    FROM p JOIN h USING (item_id), unnest([0, 1]) AS t(c)""")
def render_schema(spark, sf):
    items = table(spark, sf, "benchmark").select(
        "item_id", F.array(F.col("text"), F.concat("text", F.lit("x"))).alias("context_options"),
        F.concat(F.lit("end "), "item_id").alias("continuation"), (F.col("item_id") % 2).cast("int").alias("gold"))
    return r.render_icl(items, _shots(items), "schema", "|")


@query("t10_render_lm", ICL + """,
    h AS (SELECT item_id, string_agg(trim(text) || ' ' || replace(text, 'e', 'E') || chr(10) || chr(10), '' ORDER BY shot) AS head FROM s GROUP BY 1)
    SELECT item_id, CAST(c AS INTEGER) AS choice, head || trim(text) || CASE WHEN c = 0 THEN '' ELSE ' ' || replace(text, 'e', 'E') END AS prompt
    FROM p JOIN h USING (item_id), unnest([0, 1]) AS t(c)""")
def render_lm(spark, sf):
    items = table(spark, sf, "benchmark").select(
        "item_id", F.concat(F.lit("  "), F.col("text"), F.lit(" \n")).alias("context"),
        F.replace("text", F.lit("e"), F.lit("E")).alias("continuation"))
    return r.render_icl(items, _shots(items), "lm")


def _choices(spark, sf):
    """Two byte sequences per item that share their start and their end."""
    b = table(spark, sf, "benchmark").select("item_id", F.explode(F.array(
        F.struct(F.lit(0).alias("choice"), F.concat(F.col("text"), F.lit("first, "), F.col("text")).alias("text")),
        F.struct(F.lit(1).alias("choice"), F.concat(F.col("text"), F.lit("another "), F.col("text")).alias("text")),
    )).alias("c")).select("item_id", "c.choice", "c.text")
    return tk.tokenize(b, tk.byte_vocab(spark), ["item_id", "choice"], prepend=256)


PAIRS = """
    WITH p AS (SELECT item_id, text || 'first, ' || text AS a, text || 'another ' || text AS b FROM benchmark),
    k AS (SELECT *, least(strlen(a), strlen(b)) AS n, hex(encode(a)) AS x, hex(encode(b)) AS y FROM p),
    l AS (SELECT *, list_min(list_filter(list_transform(range(1, n + 1), lambda i: CASE WHEN substr(x, 2 * i - 1, 2) <> substr(y, 2 * i - 1, 2) THEN i ELSE n + 1 END), lambda i: i > 0)) - 1 AS lcp,
                 list_min(list_transform(range(1, n + 1), lambda i: CASE WHEN substr(x, len(x) - 2 * i + 1, 2) <> substr(y, len(y) - 2 * i + 1, 2) THEN i ELSE n + 1 END)) - 1 AS lcs FROM k)"""


@query("n8_common_length", PAIRS + " SELECT item_id, CAST(lcp + 1 AS INTEGER) AS prefix, CAST(lcs AS INTEGER) AS suffix FROM l")
def common_length(spark, sf):
    s = _choices(spark, sf)
    left = r.common_length(s, "left").withColumnRenamed("common", "prefix")
    return left.join(r.common_length(s, "right").withColumnRenamed("common", "suffix"), "item_id")


@query("n9_spans_mc", PAIRS + """,
    s AS (SELECT item_id, 0 AS choice, lcp + 1 AS f, strlen(a) + 1 AS e FROM l UNION ALL SELECT item_id, 1, lcp + 1, strlen(b) + 1 FROM l)
    SELECT item_id, CAST(choice AS INTEGER) AS choice, CAST(f - greatest(e - 600, 0) AS INTEGER) AS start, CAST(least(e, 600) AS INTEGER) AS "end" FROM s""")
def spans_mc(spark, sf):
    return r.spans(_choices(spark, sf), "mc", 600).select("item_id", "choice", "start", "end")


@query("n9_spans_schema", PAIRS + """,
    s AS (SELECT item_id, 0 AS choice, lcs, strlen(a) + 1 AS e FROM l UNION ALL SELECT item_id, 1, lcs, strlen(b) + 1 FROM l)
    SELECT item_id, CAST(choice AS INTEGER) AS choice, CAST(e - lcs AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM s""")
def spans_schema(spark, sf):
    return r.spans(_choices(spark, sf), "schema").select("item_id", "choice", "start", "end")


@query("n9_spans_lm", """
    SELECT item_id, CAST(1 AS INTEGER) AS choice, CAST(strlen(text) + 1 AS INTEGER) AS start, CAST(2 * strlen(text) + 1 AS INTEGER) AS "end" FROM benchmark""")
def spans_lm(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.array("text", F.concat("text", "text"))).alias("choice", "text"))
    return r.spans(tk.tokenize(b, tk.byte_vocab(spark), ["item_id", "choice"], prepend=256), "lm").select(
        "item_id", "choice", "start", "end")


@query("n7_rolling_windows", """
    WITH d AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents),
    w AS (SELECT *, unnest(range((n - 1) // 512 + 1)) AS k FROM d),
    e AS (SELECT *, k * 512 AS s, least(n, k * 512 + 512) AS e FROM w)
    SELECT doc_id, CAST(k AS INTEGER) AS "window",
        CASE WHEN k = 0 THEN '0100' ELSE md5(substr(h, 2 * (e - 513) + 1, 2 * (s - (e - 513)))) END AS context,
        md5(substr(h, 2 * s + 1, 2 * (e - s))) AS continuation FROM e""")
def rolling_windows(spark, sf):
    # the tokenizer gives null texts no ids, as it does empty ones; only these have a window
    d = spread(table(spark, sf, "documents"), "doc_id").filter(F.col("text").isNotNull())
    ids = tk.tokenize(d, tk.byte_vocab(spark), ["doc_id"])
    hexed = lambda c: F.array_join(F.transform(c, lambda i: F.lpad(F.hex(i), F.when(i > 255, 4).otherwise(2), F.lit("0"))), "")
    w = r.rolling_windows(ids, 512, 256)
    return w.select("doc_id", "window",
                    F.when(F.col("window") == 0, F.lpad(hexed("context_ids"), 4, "0"))
                    .otherwise(F.md5(hexed("context_ids"))).alias("context"),
                    F.md5(hexed("continuation_ids")).alias("continuation"))


@query("t11_truncate_tokens", """
    SELECT conv_id, turn, right(text, 200) AS "left", left(text, 200) AS "right" FROM conversations""")
def truncate_tokens(spark, sf):
    chars = F.split("text", "")
    c = table(spark, sf, "conversations").select("conv_id", "turn", chars.alias("left"), chars.alias("right"))
    out = r.truncate_tokens(r.truncate_tokens(c, 200, "left", ["left"]), 200, "right", ["right"])
    return out.select("conv_id", "turn", F.array_join("left", "").alias("left"), F.array_join("right", "").alias("right"))


@query("t11_truncate_context", """
    WITH x AS (SELECT conv_id, turn, left(text, 60) AS a, substr(text, 61) AS b FROM conversations),
    y AS (SELECT *, greatest(length(a) + length(b) - 150, 0) AS o FROM x),
    z AS (SELECT *, CASE WHEN length(a) > 1 THEN least(o, length(a) - 1) ELSE 0 END AS t FROM y)
    SELECT conv_id, turn, substr(a, t + 1) AS context, substr(b, o - t + 1) AS continuation FROM z""")
def truncate_context(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.split(F.left("text", F.lit(60)), "").alias("context_ids"),
        F.when(F.length("text") > 60, F.split(F.expr("substr(text, 61)"), "")).otherwise(F.array().cast("array<string>")).alias("continuation_ids"))
    out = r.truncate_context(c, 150)
    return out.select("conv_id", "turn", F.array_join("context_ids", "").alias("context"),
                      F.array_join("continuation_ids", "").alias("continuation"))
