"""Queries over ``documents`` as task tables: shuffles, slices, mixtures, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.catalog.base import query, sql_draw, sql_fewshot, sql_shuffle_key, table
from tokenmill.operators import mixing as m
from tokenmill.plans.profiles import Part, profile_tasks
from tokenmill.plans.scan import dense_index

SHUFFLED = f"""
    SELECT doc_id, lang, source, row_number() OVER (ORDER BY {sql_shuffle_key(42, 'doc_id')}, doc_id) - 1 AS idx
    FROM documents"""
BY_LANG = """
    SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx FROM documents"""


def _shuffled(spark, sf):
    return m.shuffle(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["doc_id"])


def _task(spark, sf, lang):
    rows = table(spark, sf, "documents").filter(F.col("lang") == lang).select("doc_id", "lang")
    return dense_index(rows, ["doc_id"])


@query("x1_shuffle", f"SELECT doc_id, idx FROM ({SHUFFLED})")
def shuffle(spark, sf):
    return _shuffled(spark, sf).select("doc_id", "idx")


@query("x2_slice", f"SELECT doc_id, (idx - 30) // 4 AS idx FROM ({SHUFFLED}) WHERE idx >= 30 AND idx < 401 AND (idx - 30) % 4 = 0")
def slice_task(spark, sf):
    return m.slice_task(_shuffled(spark, sf), 30, 401, 4).select("doc_id", "idx")


@query("x3_cap", f"SELECT doc_id, idx FROM ({SHUFFLED}) WHERE idx < 250")
def cap(spark, sf):
    return m.cap(_shuffled(spark, sf), 250).select("doc_id", "idx")


@query("x4_holdout", f"""
    SELECT doc_id, CASE WHEN idx < 120 THEN 'val' ELSE 'train' END AS split,
           CASE WHEN idx < 120 THEN idx ELSE idx - 120 END AS idx FROM ({SHUFFLED})""")
def holdout(spark, sf):
    val, train = m.holdout(_shuffled(spark, sf), 120)
    both = val.withColumn("split", F.lit("val")).unionByName(train.withColumn("split", F.lit("train")))
    return both.select("doc_id", "split", "idx")


@query("x5_stride", f"SELECT doc_id, CAST(idx % 6 AS INTEGER) AS rank, idx // 6 AS rank_idx FROM ({SHUFFLED})")
def stride(spark, sf):
    return m.stride(_shuffled(spark, sf), 6).select("doc_id", "rank", "rank_idx")


MIX_SQL = f"""
    WITH b AS ({BY_LANG}),
    u AS (SELECT 0 AS task_no, 'en' AS task, 0 AS copy_no, * FROM b WHERE lang = 'en'
          UNION ALL SELECT 1, 'fr', unnest(range(3)), * FROM b WHERE lang = 'fr'
          UNION ALL SELECT 2, 'es', 0, * FROM b WHERE lang = 'es'
          UNION ALL SELECT 3, 'es', 0, * FROM b WHERE lang = 'es'
          UNION ALL SELECT 4, 'de', 0, * FROM b WHERE lang = 'de')"""


def _tasks(spark, sf):
    return [
        m.Task("en", _task(spark, sf, "en")), m.Task("fr", _task(spark, sf, "fr"), repeats=3),
        m.Task("es", _task(spark, sf, "es")), m.Task("es", _task(spark, sf, "es")), m.Task("de", _task(spark, sf, "de"))]


@query("u1_mixture", MIX_SQL + f"""
    SELECT task, doc_id, CAST(task_no AS INTEGER) AS task_no, CAST(copy_no AS INTEGER) AS copy_no,
           row_number() OVER (ORDER BY {sql_shuffle_key(42, 'task_no', 'copy_no', 'idx')}, task_no, copy_no, idx) - 1 AS idx
    FROM u""")
def mixture(spark, sf):
    tasks = _tasks(spark, sf)
    assert m.eval_type(tasks) == "generative"
    return m.mixture(tasks).select("task", "doc_id", "task_no", "copy_no", "idx")


@query("u2_sequence", MIX_SQL + """
    SELECT task, doc_id, row_number() OVER (ORDER BY task_no, copy_no, idx) - 1 AS idx FROM u""")
def sequence(spark, sf):
    return m.sequence_tasks(_tasks(spark, sf)).select("task", "doc_id", "idx")


@query("a15_mixture_stats", MIX_SQL + """
    SELECT task, count(*) AS n_rows, CAST(sum(count(*)) OVER () AS BIGINT) AS epoch_size,
           round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM u GROUP BY task""")
def mixture_stats(spark, sf):
    return m.mixture_stats(m._union(_tasks(spark, sf)))


@query("u3_repeat", f"""
    SELECT doc_id, CAST(c AS INTEGER) AS copy_no, idx + c * (SELECT count(*) FROM documents) AS idx
    FROM (SELECT *, unnest(range(3)) AS c FROM ({SHUFFLED}))""")
def repeat(spark, sf):
    base = _shuffled(spark, sf)
    size = table(spark, sf, "documents").count()
    return m.repeat(base, m.phase_weight(1, 3, phase2=True), size=size).select("doc_id", "copy_no", "idx")


@query("u3_subject_extras", """
    SELECT doc_id, source, CAST(c AS INTEGER) AS copy_no
    FROM (SELECT doc_id, source, unnest(range(1, CASE source WHEN (SELECT min(source) FROM documents) THEN 4 ELSE 2 END)) AS c
          FROM documents WHERE source IN ((SELECT min(source) FROM documents), (SELECT max(source) FROM documents)))""")
def subject_extras(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    low, high = d.agg(F.min("source"), F.max("source")).first()
    return m.subject_extras(d, {low: 4, high: 2, "none": 1}, "source")


@query("j6_filter_subjects", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'es')")
def filter_subjects(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return m.filter_subjects(d.withColumn("lang", F.lit("")), ["de", "es"], fallback=d, subject="lang")


@query("u4_profile", f"""
    WITH b AS ({BY_LANG}),
    u AS (SELECT 'smoltalk' AS task, doc_id FROM b WHERE lang = 'en' AND idx >= 10 AND idx < 300
          UNION ALL SELECT 'mmlu', doc_id FROM (SELECT doc_id, unnest(range(4)) FROM b WHERE lang = 'fr')
          UNION ALL SELECT 'mmlu_subjects', doc_id FROM (SELECT doc_id, unnest(range(3)) FROM b WHERE lang = 'de'))
    SELECT task, doc_id, count(*) AS n FROM u GROUP BY ALL""")
def profile(spark, sf):
    langs = {"smoltalk": "en", "mmlu": "fr", "mmlu_subjects": "de"}
    parts = [
        Part("smoltalk", {"split": "train"}, start=10, stop=300),
        Part("mmlu", weight="mmlu"),
        Part("mmlu_subjects", {"group": "physics"}, weight="mmlu_physics", optional=True),
        Part("gpqa", weight="gpqa", optional=True)]
    tasks = profile_tasks(
        parts, lambda name, **_: _task(spark, sf, langs[name]),
        {"mmlu": 2, "mmlu_physics": 2}, phase2=True, multiplier=2)
    return m.mixture(tasks).groupBy("task", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("u5_replay_mix", f"""
    WITH b AS ({BY_LANG}),
    s AS (SELECT doc_id AS slot, CASE WHEN {sql_draw(42, 'doc_id')} / 4294967296.0::DOUBLE < 0.3 THEN 'replay' ELSE 'main' END AS side
          FROM documents),
    k AS (SELECT slot, side, row_number() OVER (PARTITION BY side ORDER BY slot) - 1 AS n FROM s),
    z AS (SELECT (SELECT count(*) FROM b WHERE lang = 'fr') AS n_main, (SELECT count(*) FROM b WHERE lang = 'es') AS n_replay)
    SELECT k.slot, k.side, b.doc_id FROM k, z JOIN b
      ON (k.side = 'main' AND b.lang = 'fr' AND b.idx = k.n % z.n_main)
      OR (k.side = 'replay' AND b.lang = 'es' AND b.idx = k.n % z.n_replay)""")
def replay_mix(spark, sf):
    n = table(spark, sf, "documents").count()
    return m.replay_mix(_task(spark, sf, "fr"), _task(spark, sf, "es"), n, 0.3).select("slot", "side", "doc_id")


@query("u6_phase_schedule", f"""
    WITH b AS ({BY_LANG}),
    z AS (SELECT (SELECT count(*) FROM b WHERE lang = 'fr') AS n1, (SELECT count(*) FROM b WHERE lang = 'es') AS n2),
    s AS (SELECT doc_id AS slot, doc_id // n1 + 1 AS epoch, n1, n2 FROM documents, z)
    SELECT slot, epoch, CAST(CASE WHEN epoch >= 3 THEN 2 ELSE 1 END AS INTEGER) AS phase, b.doc_id
    FROM s JOIN b ON (epoch < 3 AND b.lang = 'fr' AND b.idx = slot % n1)
                  OR (epoch >= 3 AND b.lang = 'es' AND b.idx = (slot - 2 * n1) % n2)""")
def phase_schedule(spark, sf):
    n = table(spark, sf, "documents").count()
    first, second = _task(spark, sf, "fr"), _task(spark, sf, "es")
    return m.phase_schedule(n, first, second, first.count(), 3).select("slot", "epoch", "phase", "doc_id")


@query("u7_epochs", "SELECT doc_id, CAST(e AS INTEGER) AS epoch FROM (SELECT doc_id, unnest([1, 2, 3]) AS e FROM documents)")
def epochs(spark, sf):
    return m.epochs(table(spark, sf, "documents").select("doc_id"), 3)


FILL = """
    WITH r AS (SELECT doc_id AS idx, lang, n_chars, (lang IN ('fr', 'de') AND n_chars % 2 = 0) AS ok,
                      (SELECT count(*) FROM documents) AS n FROM documents),
    v AS (SELECT idx FROM r WHERE ok UNION ALL SELECT idx + n FROM r WHERE ok),
    f AS (SELECT r.idx, r.n, min(v.idx) AS nxt FROM r LEFT JOIN v ON v.idx >= r.idx GROUP BY ALL)
    SELECT f.idx, CASE WHEN nxt - f.idx <= 9 THEN nxt % f.n END AS source_idx, t.lang, t.n_chars
    FROM f LEFT JOIN r t ON t.idx = CASE WHEN nxt - f.idx <= 9 THEN nxt % f.n END"""


@query("p23_fill_next", FILL)
def fill_next(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("idx"), "lang", "n_chars",
        (F.col("lang").isin("fr", "de") & (F.col("n_chars") % 2 == 0)).alias("ok"))
    m.apply_valid_policy(d, "ok", "check")
    return m.apply_valid_policy(d, "ok", "fill_next", reach=9).select("idx", "source_idx", "lang", "n_chars")


@query("p23_drop_invalid", "SELECT doc_id AS idx, lang FROM documents WHERE n_chars % 2 = 0")
def drop_invalid(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("idx"), "lang", (F.col("n_chars") % 2 == 0).alias("ok"))
    return m.apply_valid_policy(d, "ok").select("idx", "lang")


@query("j7_fewshot", sql_fewshot(1234, 5) + " SELECT item_id AS item_item_id, shot, other AS item_id FROM s")
def fewshot(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id")
    return m.sample_fewshot(items, 5, ["item_id"])


@query("a8_subject_stats", """
    WITH g AS (SELECT source AS subject, count(*) AS n FROM documents GROUP BY 1)
    SELECT subject, n AS n_rows, round(100.0 * n / CAST(sum(n) OVER () AS DOUBLE), 6) AS percent,
           row_number() OVER (ORDER BY n DESC, subject) AS place
    FROM g QUALIFY row_number() OVER (ORDER BY n DESC, subject) <= 12""")
def subject_stats(spark, sf):
    from tokenmill.operators.metrics import subject_stats as stats

    d = table(spark, sf, "documents").select(F.col("source").alias("subject"))
    return stats(d, top=12)


@query("a8_group_totals", """
    WITH t AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
    g AS (SELECT 'latin' AS grp, coalesce(sum(n), 0) AS n_rows, 3 AS w FROM t WHERE lang IN ('fr', 'es')
          UNION ALL SELECT 'german', coalesce(sum(n), 0), 1 FROM t WHERE lang = 'de'
          UNION ALL SELECT 'none', coalesce(sum(n), 0), 2 FROM t WHERE lang = 'xx')
    SELECT grp AS "group", CAST(n_rows AS BIGINT) AS n_rows, CAST(n_rows * w AS BIGINT) AS effective_rows,
           CAST((SELECT sum(n) FROM t) AS BIGINT) AS total_rows,
           CAST((SELECT sum(n) FROM t) + (SELECT sum(n_rows * (w - 1)) FROM g) AS BIGINT) AS effective_total,
           CAST(0 AS BIGINT) AS missing_rows FROM g""")
def group_totals(spark, sf):
    from tokenmill.operators.metrics import group_totals as totals

    d = table(spark, sf, "documents").select(F.col("lang").alias("subject"))
    return totals(d, {"latin": ["fr", "es"], "german": ["de"], "none": ["xx"]}, {"latin": 3, "none": 2})
