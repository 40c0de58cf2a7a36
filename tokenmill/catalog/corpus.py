"""Queries over ``documents``: scans, shuffles, shards, packing."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.catalog.base import query, sql_shuffle_key, table
from tokenmill.operators import packing as pk
from tokenmill.operators.tokens import byte_ids
from tokenmill.plans.scan import dense_index, prefix_sum
from tokenmill.plans.session import scratch_path, spread
from tokenmill.sources import corpus as c
from tokenmill.sources import row_groups as rg
from tokenmill.streaming import jobs


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _byte_lengths(spark, sf):
    """One token per byte and one for the start of the document."""
    return _docs(spark, sf).select("doc_id", "lang", (F.octet_length("text") + 1).cast("bigint").alias("n"))


def _shard_folder(docs, path):
    """One file per 250 document numbers, in a folder whose name needs escaping."""
    path = f"{path}/my data 100%é"
    shard = F.format_string("%08d", F.expr("doc_id div 250")).alias("shard")
    docs.select("doc_id", "text", shard).repartition("shard").write.partitionBy("shard").parquet(path)
    return path


LAST = "(SELECT max(doc_id) // 250 FROM documents)"


def _split(spark, sf, split):
    path = _shard_folder(_docs(spark, sf), scratch_path(spark, "shards"))
    d = c.read_corpus(spark, {"web": path}, split, names="web,main", aliases={"main": "web"},
                      schema="doc_id bigint, text string")
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


@query("s1_corpus_train", f"SELECT doc_id, length(text) AS n_chars FROM documents WHERE doc_id // 250 < {LAST} OR {LAST} = 0")
def corpus_train(spark, sf):
    return _split(spark, sf, "train")


@query("s1_corpus_val", f"SELECT doc_id, length(text) AS n_chars FROM documents WHERE doc_id // 250 = {LAST} AND {LAST} > 0")
def corpus_val(spark, sf):
    return _split(spark, sf, "val")


@query("s5_skip_broken_files", "SELECT doc_id, length(text) AS n_chars FROM documents")
def skip_broken_files(spark, sf):
    path, broken = scratch_path(spark, "shards"), scratch_path(spark, "broken")
    _shard_folder(_docs(spark, sf), path)
    # Text files stand for parquet files that cannot be read.
    _docs(spark, sf).filter("doc_id % 100 = 0").select("text").write.text(broken)
    listed = c.list_files(spark, path) + c.list_files(spark, broken, ".txt")
    d = c.read_corpus(spark, {"web": listed}, None, schema="doc_id bigint, text string", on_corrupt="skip")
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


@query("s2_interleave_files", """
    WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'web' ELSE 'rest' END AS dataset, doc_id // 250 AS shard FROM documents),
    s AS (SELECT dataset, shard, row_number() OVER (PARTITION BY dataset ORDER BY shard) AS k, count(*) OVER (PARTITION BY dataset) AS n
          FROM (SELECT DISTINCT dataset, shard FROM d)),
    f AS (SELECT dataset, shard, row_number() OVER (ORDER BY k, dataset DESC) - 1 AS file_no FROM s WHERE k < n OR n = 1)
    SELECT doc_id, dataset, file_no FROM d JOIN f USING (dataset, shard)""")
def interleave_files(spark, sf):
    d = _docs(spark, sf)
    specs = {
        "web": _shard_folder(d.filter("lang = 'en'"), scratch_path(spark, "web")),
        "rest": _shard_folder(d.filter("lang <> 'en'"), scratch_path(spark, "rest")),
    }
    return c.read_corpus(spark, specs, "train", schema="doc_id bigint").select("doc_id", "dataset", "file_no")


@query("s2_interleave_rows", """
    WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents)
    SELECT doc_id, lang, pos, row_number() OVER (ORDER BY pos, lang) - 1 AS idx FROM p""")
def interleave_rows(spark, sf):
    return c.interleave_rows(_docs(spark, sf).select("doc_id", "lang"), "lang", ["doc_id"])


def _grouped_files(spark, sf):
    """The documents in files of 256, in row groups of 48; the last one of a file is shorter."""
    path = scratch_path(spark, "grouped")
    docs = _docs(spark, sf).select("doc_id", "text", F.expr("doc_id div 256").alias("part"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id").write.partitionBy("part").option(
        "parquet.block.row.count.limit", "48").parquet(path)
    # the order of the parts, not of their names
    return sorted(c.list_files(spark, path), key=lambda f: int(re.search(r"part=(\d+)", f)[1]))


@query("s4_rank_row_groups", """
    SELECT CAST((doc_id % 256 // 48) % 3 AS INTEGER) AS rank, count(*) AS n_rows,
           CAST(sum(length(text)) AS BIGINT) AS n_chars
    FROM documents GROUP BY 1""")
def rank_row_groups(spark, sf):
    ranked = c.assign_ranks(spark.read.schema("doc_id bigint, text string").parquet(*_grouped_files(spark, sf)), 3)
    return ranked.groupBy("rank").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_chars"))


@query("s4_read_rank", """
    SELECT doc_id, CAST(doc_id // 256 AS INTEGER) AS file_no, CAST(doc_id % 256 // 48 AS INTEGER) AS row_group, doc_id % 256 % 48 AS row_no,
           md5(text) AS digest
    FROM documents WHERE (doc_id % 256 // 48) % 3 = 1""")
def read_rank(spark, sf):
    rows = rg.read_rank(spark, _grouped_files(spark, sf), "doc_id bigint, text string", 1, 3)
    return rows.select("doc_id", "file_no", "row_group", "row_no", F.md5("text").alias("digest"))


@query("st1_row_group_stream", """
    SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, CAST(doc_id // 256 AS INTEGER) AS file_no, CAST(doc_id % 256 // 48 AS INTEGER) AS row_group
    FROM documents, (VALUES (1), (2)) AS e(epoch) WHERE (doc_id % 256 // 48) % 2 = 1""")
def row_group_stream(spark, sf):
    """Rank 1 of 2 over two epochs, stopped inside a file of each and started again."""
    files, out, at = _grouped_files(spark, sf), scratch_path(spark, "out"), scratch_path(spark, "progress")
    for until in ((1, 0, 2), (2, 0, 4), None):
        stream = rg.stream_rank(spark, files, "doc_id bigint, text string", 1, 2, 2, until)
        jobs.run_available(stream.select("doc_id", "epoch", "file_no", "row_group"), out, at)
    return spark.read.parquet(out)


SHARD_SQL = f"""
    WITH RECURSIVE o AS (
        SELECT doc_id, n_chars, row_number() OVER (ORDER BY {sql_shuffle_key(42, 'doc_id')}, doc_id) - 1 AS idx
        FROM documents),
    g AS (SELECT idx // 16 AS g, CAST(sum(n_chars) AS BIGINT) AS c, count(*) AS n FROM o GROUP BY 1),
    w(g, shard, acc) AS (
        SELECT g, CAST(0 AS BIGINT), c FROM g WHERE g = 0
        UNION ALL
        SELECT g.g, CASE WHEN w.acc >= 200000 THEN w.shard + 1 ELSE w.shard END,
               CASE WHEN w.acc >= 200000 THEN g.c ELSE w.acc + g.c END
        FROM w JOIN g ON g.g = w.g + 1),
    s AS (SELECT w.shard, sum(g.c) >= 200000 AND bool_and(g.n = 16) AS is_complete
          FROM w JOIN g USING (g) GROUP BY 1)"""


@query("s11_assign_shards", SHARD_SQL + """
    SELECT o.doc_id, o.idx, w.shard, s.is_complete
    FROM o JOIN w ON w.g = o.idx // 16 JOIN s ON s.shard = w.shard""")
def assign_shards(spark, sf):
    return c.assign_shards(_docs(spark, sf), "doc_id", "n_chars", 200_000, 16)


@query("s11_write_shards", SHARD_SQL + """
    SELECT CAST(w.shard AS INTEGER) AS shard, count(*) AS n_rows, CAST(sum(o.n_chars) AS BIGINT) AS n_chars
    FROM o JOIN w ON w.g = o.idx // 16 JOIN s ON s.shard = w.shard
    WHERE s.is_complete GROUP BY 1""")
def write_shards(spark, sf):
    path = scratch_path(spark, "resharded")
    c.write_shards(_docs(spark, sf), path, "doc_id", chars_per_shard=200_000, rows_per_group=16, tail="drop")
    return spark.read.parquet(path).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_chars"))


@query("n1_prefix_sum", """
    SELECT doc_id, CAST(coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM documents""")
def global_prefix_sum(spark, sf):
    return prefix_sum(_docs(spark, sf).select("doc_id", "n_chars"), "n_chars", ["doc_id"]).select("doc_id", "start")


@query("n1_dense_index_by_language", """
    SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS idx FROM documents""")
def dense_index_by_language(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang", "n_chars")
    return dense_index(d, [-F.col("n_chars"), F.col("doc_id")], by=["lang"]).select("doc_id", "idx")


@query("n2_cap_corpus", """
    WITH d AS (SELECT doc_id, left(text, 1500) AS text FROM documents),
    p AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
    SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM p WHERE before <= 600000""")
def cap_corpus(spark, sf):
    kept = c.cap_corpus(_docs(spark, sf).select("doc_id", "text"), 1500, 600_000, ["doc_id"])
    return kept.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


FLAT_SQL = """
    WITH d AS (SELECT doc_id, lang, CAST(strlen(text) + 1 AS BIGINT) AS n FROM documents),
    p AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM d),
    x AS (SELECT *, unnest(range(greatest(0, (s - 1) // 2048), (s + n - 1) // 2048 + 1)) AS w FROM p),
    y AS (SELECT doc_id, lang, n, w, greatest(s, w * 2048) AS f, least(s + n, w * 2048 + 2049) AS t, s FROM x)"""


@query("t5_flat_pieces", FLAT_SQL + """
    SELECT doc_id, w AS "window", f - s AS "offset", t - f AS take, f - w * 2048 AS "at" FROM y""")
def flat_pieces(spark, sf):
    return pk.flat_pieces(_byte_lengths(spark, sf), 2048, ["doc_id"]).select(
        "doc_id", "window", "offset", "take", "at")


def _byte_tokens(spark, sf):
    """Ids 0-255 for bytes, 256 for the start of a document."""
    return byte_ids(spread(_docs(spark, sf).select("doc_id", "text"), "doc_id"), ["doc_id"], first=256)


@F.pandas_udf(T.StringType())
def _shown_digest(rows: pd.Series) -> pd.Series:
    """md5 of the bytes' hexadecimal digits, with a mark for each document's start."""

    def one(ids):
        parts = np.split(ids, np.flatnonzero(ids == 256))
        return hashlib.md5("<".join(p[p < 256].astype(np.uint8).tobytes().hex().upper() for p in parts).encode()).hexdigest()

    return rows.map(one)


@query("t5_pack_flat", FLAT_SQL + """,
    b AS (SELECT documents.doc_id, hex(encode(text)) AS h FROM documents),
    z AS (SELECT y.w, y.f, CASE WHEN f = s THEN '<' || substr(h, 1, CAST(2 * (t - f - 1) AS BIGINT))
                  ELSE substr(h, CAST(2 * (f - s - 1) + 1 AS BIGINT), CAST(2 * (t - f) AS BIGINT)) END AS part, t - f AS take
          FROM y JOIN b USING (doc_id))
    SELECT w AS row_id, md5(string_agg(part, '' ORDER BY f)) AS digest, count(*) AS n_docs
    FROM z GROUP BY w""")
def pack_flat(spark, sf):
    rows = pk.pack_flat(_byte_tokens(spark, sf), 2048, ["doc_id"])
    return rows.select("row_id", _shown_digest("ids").alias("digest"), "n_docs")


@query("t9_shift_targets", """
    WITH d AS (SELECT doc_id, CAST(length(text) % 7 + 1 AS BIGINT) AS n FROM documents),
    e AS (SELECT doc_id, unnest(range(n)) AS k FROM d),
    p AS (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS pos, doc_id * 10 + k AS id FROM e),
    f AS (SELECT list(id ORDER BY pos) AS ids, count(*) AS total FROM p),
    w AS (SELECT unnest(range((total - 1) // 24)) AS row_id, ids FROM f),
    b AS (SELECT row_id, unnest(range(3)) AS r, ids FROM w)
    SELECT row_id, CAST(r AS INTEGER) AS row_in_window,
        array_to_string(ids[row_id * 24 + r * 8 + 1 : row_id * 24 + r * 8 + 8], ' ') AS inputs,
        array_to_string(ids[row_id * 24 + r * 8 + 2 : row_id * 24 + r * 8 + 9], ' ') AS targets
    FROM b""")
def shift_targets(spark, sf):
    n = F.length("text") % 7
    tokens = _docs(spark, sf).select(
        "doc_id", F.transform(F.sequence(F.lit(0), n), lambda k: F.col("doc_id") * 10 + k).alias("ids"))
    packed = pk.pack_flat(tokens, 24, ["doc_id"], tail="drop")
    return pk.shift_targets(packed, 8, 3).select(
        "row_id", "row_in_window", F.array_join(F.col("inputs").cast("array<string>"), " ").alias("inputs"),
        F.array_join(F.col("targets").cast("array<string>"), " ").alias("targets"))


@query("a14_packing_waste_by_language", FLAT_SQL + """,
    tail AS (SELECT (sum(n) - 1) // 2048 AS w FROM d),
    v AS (SELECT doc_id, lang, any_value(n) AS n, count(*) AS k,
                 coalesce(sum(t - f) FILTER (WHERE w >= (SELECT w FROM tail)), 0) AS cut FROM y GROUP BY ALL)
    SELECT lang, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens,
           CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_split_docs,
           CAST(sum(greatest(n - 2049, 0)) AS BIGINT) AS min_crop_tokens,
           round(100.0 * CAST(sum(greatest(n - 2049, 0)) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS min_crop_pct,
           CAST(sum(cut) AS BIGINT) AS tail_tokens
    FROM v GROUP BY lang""")
def packing_waste_by_language(spark, sf):
    """Flat packing of byte tokens: split documents, unavoidable crop and the lost tail."""
    width = 2048
    docs = _byte_lengths(spark, sf)
    total = docs.agg(F.sum("n")).first()[0]
    tail = (total - 1) // width
    per_doc = pk.piece_counts(docs, width, ["doc_id"], tail)
    over = F.sum(F.greatest(F.col("n") - (width + 1), F.lit(0)))
    return per_doc.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"),
        F.count_if(F.col("k") > 1).alias("n_split_docs"), over.alias("min_crop_tokens"),
        F.round(100.0 * over.cast("double") / F.sum("n").cast("double"), 6).alias("min_crop_pct"),
        F.sum("cut").alias("tail_tokens"))


def _report(spark, sf, strategy):
    docs = _byte_lengths(spark, sf)
    placed = pk.pack(docs, 2048, "doc_id", ["doc_id"], strategy)
    return pk.packing_report(placed, docs, 2048).withColumn("strategy", F.lit(strategy))

# Figures of a packing whose pieces are in f("row", n, take); within one shard.
REPORT_SQL = """,
    u AS (SELECT count(DISTINCT "row") AS n_rows, CAST(sum(take) AS BIGINT) AS placed_tokens,
                 CAST(sum(n - take) AS BIGINT) AS cropped_tokens, count(*) AS placed_docs FROM f WHERE take > 0),
    w AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(greatest(n - 2049, 0)) AS BIGINT) AS min_crop_tokens FROM d)
    SELECT n_docs, n_tokens, n_rows, placed_docs, placed_tokens, cropped_tokens, min_crop_tokens,
        round(100.0 * CAST(placed_tokens AS DOUBLE) / CAST(n_rows * 2049 AS DOUBLE), 4) AS utilization_pct,
        round(100.0 * CAST(n_rows * 2049 - placed_tokens AS DOUBLE) / CAST(n_rows * 2049 AS DOUBLE), 4) AS padded_pct,
        round(100.0 * CAST(cropped_tokens AS DOUBLE) / CAST(placed_tokens + cropped_tokens AS DOUBLE), 4) AS cropped_pct,
        round(100.0 * CAST(min_crop_tokens AS DOUBLE) / CAST(n_tokens AS DOUBLE), 4) AS min_crop_pct,
        n_tokens - placed_tokens - cropped_tokens AS tail_tokens,
"""

LENGTHS_SQL = """
    WITH RECURSIVE d AS (
        SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, CAST(strlen(text) + 1 AS BIGINT) AS n FROM documents)"""

# The waiting documents are a list; every step takes the largest that fits, else the oldest.
BEST_FIT_SQL = LENGTHS_SQL + """,
    f(rest, next_row, room, "row", i, n, take) AS (
        SELECT list({'n': n, 'i': i} ORDER BY i), CAST(0 AS BIGINT), CAST(2049 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT),
               CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM d
        UNION ALL
        SELECT list_filter(rest, lambda x: x.i <> c.i),
            CASE WHEN c.n >= room THEN next_row + 1 ELSE next_row END,
            CASE WHEN c.n >= room THEN 2049 ELSE room - c.n END, next_row, c.i, c.n, least(c.n, room)
        FROM (SELECT rest, next_row, room,
                  CASE WHEN len(fit) > 0 THEN {'n': -fit[1].k, 'i': fit[1].i} ELSE {'n': rest[1].n, 'i': rest[1].i} END AS c
              FROM (SELECT rest, next_row, room, list_sort(list_transform(
                        list_filter(rest[1:1000], lambda x: x.n <= room), lambda x: {'k': -x.n, 'i': x.i})) AS fit
                    FROM f WHERE len(rest) > 0)))"""


@query("t6_pack_best_fit", BEST_FIT_SQL + REPORT_SQL + "'best_fit' AS strategy FROM u, w", digits=4)
def pack_best_fit(spark, sf):
    return _report(spark, sf, "best_fit")


@query("t6_pack_conservation", """
    SELECT shard_docs, count(*) AS n_docs, count(*) AS placed_docs, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_tokens,
           CAST(sum(strlen(text) + 1) AS BIGINT) AS used_and_cropped, true AS one_row_unfilled
    FROM documents, (VALUES (16), (8192)) AS s(shard_docs) GROUP BY 1""")
def pack_conservation(spark, sf):
    """Every token is placed or cropped, and one row at most is unfilled, whatever the shard size."""
    docs = _byte_lengths(spark, sf)
    out = None
    for shard_docs in (16, 8192):
        placed = pk.pack(docs, 2048, "doc_id", ["doc_id"], "best_fit", shard_docs=shard_docs)
        rows = placed.groupBy("shard", "row").agg(
            F.count(F.lit(1)).alias("k"), F.sum("take").alias("t"), F.sum("n").alias("n"))
        one = rows.agg(F.sum("k").alias("placed_docs"), F.sum("n").alias("used_and_cropped"),
                       (F.count_if(F.col("t") < 2049) <= 1).alias("one_row_unfilled"))
        whole = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"))
        both = one.join(whole).withColumn("shard_docs", F.lit(shard_docs))
        out = both if out is None else out.unionByName(both)
    return out


@query("t6_best_fit_rows", BEST_FIT_SQL + """
    SELECT CAST(0 AS BIGINT) AS shard, "row", count(*) AS n_docs, count(*) FILTER (WHERE take < n) AS n_cropped,
           CAST(sum(take) AS INTEGER) AS n_ids, 256 AS first_id FROM f WHERE take > 0 GROUP BY f."row" """)
def best_fit_rows(spark, sf):
    tokens = _byte_tokens(spark, sf)
    docs = tokens.select("doc_id", F.size("ids").cast("bigint").alias("n"))
    placed = pk.pack(docs, 2048, "doc_id", ["doc_id"], "best_fit")
    rows = pk.packed_rows(placed, tokens, "doc_id")
    return rows.select("shard", "row", "n_docs", "n_cropped", F.size("ids").alias("n_ids"),
                       F.get("ids", F.lit(0)).alias("first_id"))


# The two greedy strategies are a running fold that SQL can follow too.
@query("t7_pack_greedy_crop", """
    WITH RECURSIVE d AS (
        SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, CAST(strlen(text) + 1 AS BIGINT) AS n FROM documents),
    f(i, n, "row", "at", take) AS (
        SELECT i, n, CAST(0 AS BIGINT), CAST(0 AS BIGINT), least(n, 2049) FROM d WHERE i = 0
        UNION ALL
        SELECT d.i, d.n,
            CASE WHEN f."at" + f.take = 2049 THEN f."row" + 1 ELSE f."row" END,
            CASE WHEN f."at" + f.take = 2049 THEN 0 ELSE f."at" + f.take END,
            least(d.n, 2049 - CASE WHEN f."at" + f.take = 2049 THEN 0 ELSE f."at" + f.take END)
        FROM f JOIN d ON d.i = f.i + 1),
    r AS (SELECT "row", sum(take) AS t, sum(n - take) AS c, count(*) AS k FROM f GROUP BY ALL),
    u AS (SELECT count(*) AS n_rows, sum(t) AS placed_tokens, sum(c) AS cropped_tokens, sum(k) AS placed_docs FROM r),
    w AS (SELECT count(*) AS n_docs, sum(n) AS n_tokens, sum(greatest(n - 2049, 0)) AS min_crop_tokens FROM d)
    SELECT n_docs, CAST(n_tokens AS BIGINT) AS n_tokens, n_rows, CAST(placed_docs AS BIGINT) AS placed_docs,
        CAST(placed_tokens AS BIGINT) AS placed_tokens, CAST(cropped_tokens AS BIGINT) AS cropped_tokens,
        CAST(min_crop_tokens AS BIGINT) AS min_crop_tokens,
        round(100.0 * CAST(placed_tokens AS DOUBLE) / CAST(n_rows * 2049 AS DOUBLE), 4) AS utilization_pct,
        round(100.0 * CAST(n_rows * 2049 - placed_tokens AS DOUBLE) / CAST(n_rows * 2049 AS DOUBLE), 4) AS padded_pct,
        round(100.0 * CAST(cropped_tokens AS DOUBLE) / CAST(placed_tokens + cropped_tokens AS DOUBLE), 4) AS cropped_pct,
        round(100.0 * CAST(min_crop_tokens AS DOUBLE) / CAST(n_tokens AS DOUBLE), 4) AS min_crop_pct,
        CAST(n_tokens - placed_tokens - cropped_tokens AS BIGINT) AS tail_tokens,
        'greedy_crop' AS strategy
    FROM u, w""", digits=4)
def pack_greedy_crop(spark, sf):
    return _report(spark, sf, "greedy_crop")


@query("t7_pack_greedy_pad", LENGTHS_SQL + """,
    f(i, n, "row", "at", take) AS (
        SELECT i, n, CAST(0 AS BIGINT), CAST(0 AS BIGINT), least(n, 2049) FROM d WHERE i = 0
        UNION ALL
        SELECT d.i, d.n, CASE WHEN f."at" + f.take + least(d.n, 2049) > 2049 THEN f."row" + 1 ELSE f."row" END,
            CASE WHEN f."at" + f.take + least(d.n, 2049) > 2049 THEN 0 ELSE f."at" + f.take END, least(d.n, 2049)
        FROM f JOIN d ON d.i = f.i + 1)""" + REPORT_SQL + "'greedy_pad' AS strategy FROM u, w", digits=4)
def pack_greedy_pad(spark, sf):
    return _report(spark, sf, "greedy_pad")


@query("t7_pack_first_fit_decreasing", LENGTHS_SQL + """,
    e AS (SELECT row_number() OVER (ORDER BY least(n, 2049) DESC, i) AS k, n, least(n, 2049) AS take FROM d),
    f(k, room, "row", n, take) AS (
        SELECT CAST(0 AS BIGINT), list_transform(range(count(*)), lambda x: CAST(2049 AS BIGINT)), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM d
        UNION ALL
        SELECT k, room[1:r - 1] || [room[r] - take] || room[r + 1:], r, n, take
        FROM (SELECT e.k, f.room, e.n, e.take, CAST(list_position(list_transform(f.room, lambda x: x >= e.take), true) AS BIGINT) AS r
              FROM f JOIN e ON e.k = f.k + 1))""" + REPORT_SQL + "'first_fit_decreasing' AS strategy FROM u, w", digits=4)
def pack_first_fit_decreasing(spark, sf):
    return _report(spark, sf, "first_fit_decreasing")


@query("a14_data_budget", """
    SELECT lang, params, params * 20.0::DOUBLE AS tokens, params * 20.0::DOUBLE * 4.8::DOUBLE AS chars,
           CAST(ceil(params * 20.0::DOUBLE * 4.8::DOUBLE / 1e6::DOUBLE / 0.65::DOUBLE) AS BIGINT) AS shards
    FROM (SELECT lang, CAST(sum(n_chars) AS BIGINT) AS params FROM documents GROUP BY lang)""")
def data_budget(spark, sf):
    models = _docs(spark, sf).groupBy("lang").agg(F.sum("n_chars").alias("params"))
    return pk.data_budget(models, chars_per_shard=1e6)
