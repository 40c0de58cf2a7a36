"""Queries over ``events``, ``embeddings``, ``lineitem``: scores, step logs and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.catalog.base import query, table
from tokenmill.operators import fits, metrics as mt, training as tr
from tokenmill.plans.scan import dense_index
from tokenmill.plans.session import cut_lineage

OUT = """
    WITH o AS (SELECT user_id AS item_id, 'task' || (user_id % 5) AS task, event_id, value AS reward,
                      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sample_no,
                      event_type = 'purchase' AS is_correct, props AS text, length(props) AS n_tokens,
                      CASE WHEN user_id % 3 = 0 THEN 'ref ' || user_id END AS reference_text
               FROM events)"""


def _outcomes(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("item_id"), "ts", "event_id", F.col("value").alias("reward"),
        (F.col("event_type") == "purchase").alias("is_correct"), F.col("props").alias("text"),
        F.length("props").alias("n_tokens"),
        F.concat(F.lit("task"), F.col("user_id") % 5).alias("task"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("ref "), "user_id")).alias("reference_text"))
    return dense_index(e, ["ts", "event_id"], "sample_no", by=["item_id"]).withColumn(
        "sample_no", F.col("sample_no") + 1)


def _early(spark, sf):
    """All samples; later ones than the third count as wrong, else every item would be solved."""
    return _outcomes(spark, sf).withColumn("is_correct", F.col("is_correct") & (F.col("sample_no") <= 3))


@query("a1_accuracy", OUT + """,
    i AS (SELECT task, item_id, bool_or(is_correct AND sample_no <= 3) AS ok FROM o GROUP BY ALL)
    SELECT task, count(*) AS n_items, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_correct,
           round(avg(CAST(ok AS DOUBLE)), 6) AS accuracy FROM i GROUP BY task""")
def accuracy(spark, sf):
    return mt.accuracy(_early(spark, sf))


@query("a1_accuracy_capped", OUT + """,
    j AS (SELECT task, item_id, bool_or(is_correct AND sample_no <= 3) AS ok FROM o GROUP BY ALL),
    i AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY task ORDER BY item_id) <= 12)
    SELECT task, count(*) AS n_items, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_correct,
           round(avg(CAST(ok AS DOUBLE)), 6) AS accuracy FROM i GROUP BY task""")
def accuracy_capped(spark, sf):
    return mt.accuracy(_early(spark, sf), max_problems=12)


@query("a2_pass_at_k", OUT + """,
    i AS (SELECT task, item_id, min(sample_no) FILTER (WHERE is_correct) AS f FROM o GROUP BY ALL),
    k AS (SELECT *, unnest(range(1, 9)) AS k FROM i)
    SELECT task, CAST(k AS INTEGER) AS k, count(*) AS n_items,
           round(count(*) FILTER (WHERE f <= k) / CAST(count(*) AS DOUBLE), 6) AS pass_at_k FROM k GROUP BY task, k""")
def pass_at_k(spark, sf):
    return mt.pass_at_k(_outcomes(spark, sf), 8, ["task"])


@query("a3_predict_letter", """
    WITH x AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings),
    p AS (SELECT vec_id, label, arg_max(i, (v, -i)) AS i FROM x GROUP BY ALL)
    SELECT vec_id AS item_id, 'L' || label AS gold, 'L' || i AS predicted, i = label AS is_correct FROM p""")
def predict_letter(spark, sf):
    letters = F.array(*[F.lit(f"L{i}") for i in range(64)])
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), letters.alias("letters"),
        F.col("embedding").cast("array<double>").alias("logits"), F.get(letters, F.col("label")).alias("gold"),
        F.transform(letters, lambda _: F.lit(1)).alias("n_tokens"))
    return mt.predict_letter(e)


BPB = """
    WITH l AS (SELECT event_type, CASE WHEN event_id % 11 = 0 THEN -1 ELSE user_id % 40 END AS token_id, value AS loss FROM events),
    b AS (SELECT DISTINCT user_id % 40 AS token_id, CASE WHEN user_id % 40 < 9 THEN 0 ELSE user_id % 40 % 5 + 1 END AS n_bytes FROM events)"""


@query("a4_bits_per_byte", BPB + """,
    s AS (SELECT event_type, sum(loss) AS nats, CAST(sum(n_bytes) AS BIGINT) AS n FROM l JOIN b USING (token_id) WHERE n_bytes > 0 GROUP BY 1)
    SELECT event_type, n AS n_bytes, round(nats / (ln(2) * n), 6) AS bpb FROM s
    UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT), round(sum(nats) / (ln(2) * sum(n)), 6) FROM s""")
def bits_per_byte(spark, sf):
    e = table(spark, sf, "events")
    losses = e.select(
        "event_type", F.when(F.col("event_id") % 11 == 0, -1).otherwise(F.col("user_id") % 40).alias("token_id"),
        F.col("value").alias("loss"))
    vocab = e.select((F.col("user_id") % 40).alias("token_id")).distinct().withColumn(
        "n_bytes", F.when(F.col("token_id") < 9, 0).otherwise(F.col("token_id") % 5 + 1))
    one = mt.bits_per_byte(losses, vocab).withColumn("event_type", F.lit("all"))
    return mt.bits_per_byte(losses, vocab, ["event_type"]).unionByName(one)


@query("a5_centered_score", OUT + """,
    i AS (SELECT task, item_id, bool_or(is_correct AND sample_no <= 3) AS ok FROM o GROUP BY ALL),
    a AS (SELECT task, avg(CAST(ok AS DOUBLE)) AS accuracy FROM i GROUP BY task),
    b AS (SELECT 'task' || quality AS task, 25.0::DOUBLE * avg(CAST(quality AS DOUBLE)) AS baseline FROM labels GROUP BY quality),
    c AS (SELECT a.task, a.accuracy, (a.accuracy - 0.01::DOUBLE * coalesce(b.baseline, 0)) / (1 - 0.01::DOUBLE * coalesce(b.baseline, 0)) AS c
          FROM a LEFT JOIN b USING (task))
    SELECT task, round(accuracy, 6) AS accuracy, round(c, 6) AS centered, round(avg(c) OVER (), 6) AS composite FROM c""")
def centered_score(spark, sf):
    acc = mt.accuracy(_early(spark, sf))
    base = table(spark, sf, "labels").groupBy(F.concat(F.lit("task"), "quality").alias("task")).agg(
        (F.lit(25.0) * F.avg(F.col("quality").cast("double"))).alias("baseline"))
    return mt.centered_score(acc, base, percent=True, required=["task0", "task1"])


@query("a12_advantages", OUT + """
    SELECT event_id, round(reward - avg(reward) OVER (PARTITION BY item_id), 9) AS advantage FROM o""", digits=9)
def advantages(spark, sf):
    r = table(spark, sf, "events").select(F.col("user_id").alias("item_id"), "event_id", F.col("value").alias("reward"))
    return mt.advantages(r).select("event_id", "advantage")


@query("a12_batch_rewards", OUT + """
    SELECT task, count(*) AS n_samples, round(avg(reward), 6) AS mean_reward, round(avg(n_tokens), 6) AS mean_length
    FROM o GROUP BY task""")
def batch_rewards(spark, sf):
    return mt.batch_rewards(_outcomes(spark, sf), ["task"])


@query("j8_select_solutions", OUT + """,
    f AS (SELECT item_id, arg_min(text, sample_no) AS text FROM o WHERE is_correct GROUP BY 1)
    SELECT event_id, coalesce(reference_text, f.text) AS solution_text
    FROM o LEFT JOIN f USING (item_id) WHERE NOT is_correct""")
def select_solutions(spark, sf):
    return mt.select_solutions(_outcomes(spark, sf)).select("event_id", "solution_text")


@query("j8_other_success", OUT + """,
    r AS (SELECT item_id, sample_no, text, row_number() OVER (PARTITION BY item_id ORDER BY sample_no) AS k FROM o WHERE is_correct)
    SELECT event_id, CASE WHEN o.is_correct AND o.sample_no = a.sample_no THEN b.text ELSE a.text END AS solution_text
    FROM o LEFT JOIN r a ON a.item_id = o.item_id AND a.k = 1 LEFT JOIN r b ON b.item_id = o.item_id AND b.k = 2""")
def other_success(spark, sf):
    return mt.select_solutions(_outcomes(spark, sf), "success", failed_only=False).select("event_id", "solution_text")


@query("a13_rollout_stats", OUT + """,
    f AS (SELECT item_id, arg_min(text, sample_no) AS text FROM o WHERE is_correct GROUP BY 1)
    SELECT task, count(*) AS n_samples, CAST(count(*) FILTER (WHERE is_correct) AS BIGINT) AS n_success,
        round(count(*) FILTER (WHERE is_correct) / CAST(count(*) AS DOUBLE), 6) AS success_rate,
        CAST(count(*) FILTER (WHERE NOT is_correct AND (coalesce(reference_text, f.text) IS NOT NULL OR n_tokens > 9)) AS BIGINT) AS n_pairs,
        round(avg(n_tokens), 6) AS mean_length
    FROM o LEFT JOIN f USING (item_id) GROUP BY task""")
def rollout_stats(spark, sf):
    sel = mt.select_solutions(_outcomes(spark, sf), failed_only=False)
    return mt.rollout_stats(
        sel.withColumn("feedback_text", F.when(F.col("n_tokens") > 9, F.col("text"))), ["task"])


SPANS = """
    WITH t AS (SELECT l_orderkey AS item_id, l_linenumber % 3 AS choice, l_extendedprice AS loss, l_quantity,
                      row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS pos
               FROM lineitem)"""


def _losses(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), (F.col("l_linenumber") % 3).cast("bigint").alias("choice"),
        F.col("l_extendedprice").alias("loss"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return dense_index(
        li, ["l_partkey", "l_suppkey", "l_linenumber", "loss"], "pos", by=["item_id", "choice"])


@query("a22_score_choices", SPANS + """,
    m AS (SELECT item_id, choice, avg(loss) AS m FROM t GROUP BY ALL),
    b AS (SELECT item_id, arg_min(choice, (m, choice)) AS predicted FROM m GROUP BY 1)
    SELECT item_id, CAST(predicted AS BIGINT) AS predicted, item_id % 3 AS gold, predicted = item_id % 3 AS is_correct FROM b""")
def score_choices(spark, sf):
    losses = _losses(spark, sf)
    spans = losses.groupBy("item_id", "choice").agg(
        F.lit(1).alias("start"), (F.max("pos") + 2).alias("end"), (F.col("item_id") % 3).alias("gold"))
    return mt.score_choices(losses, spans)


@query("a22_score_continuation", SPANS + """
    SELECT item_id * 3 + choice AS item_id, bool_and((l_quantity > 10) = (loss > 9000)) AS is_correct FROM t GROUP BY 1""")
def score_continuation(spark, sf):
    p = _losses(spark, sf).select(
        (F.col("item_id") * 3 + F.col("choice")).alias("item_id"), "pos", (F.col("l_quantity") > 10).alias("predicted"), (F.col("loss") > 9000).alias("actual"))
    spans = p.groupBy("item_id").agg(F.lit(1).alias("start"), (F.max("pos") + 2).alias("end"))
    return mt.score_continuation(p, spans)


LOG = """
    WITH l AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step,
                      value AS loss, 1.0::DOUBLE + sqrt(value + 1) AS dt FROM events)"""


def step_log(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("run"), "ts", "event_id", F.col("value").alias("loss"),
        (1.0 + F.sqrt(F.col("value") + 1)).alias("dt"))
    # A log is a stored table; written once, it is not numbered anew by every pass over it.
    return cut_lineage(dense_index(e, ["ts", "event_id"], "step", by=["run"]).select("run", "step", "loss", "dt"), "log")


EMA_SQL = LOG + """,
    a AS (SELECT run, list(loss ORDER BY step) AS xs FROM l GROUP BY run),
    f AS (SELECT run, unnest(range(len(xs))) AS step, xs FROM a),
    e AS (SELECT run, step, list_reduce(list_prepend(0.0::DOUBLE, xs[greatest(1, step - 600) : step + 1]),
                                        lambda s, x: 0.93::DOUBLE * s + 0.07::DOUBLE * x) AS s FROM f)
    SELECT run, step, round(s, 6) AS smooth, round(s / (1 - power(0.93::DOUBLE, step + 1)), 6) AS debiased FROM e"""


@query("n3_ema", EMA_SQL)
def ema(spark, sf):
    return tr.ema(step_log(spark, sf), 0.93).select(
        "run", "step", F.round("smooth", 6).alias("smooth"), F.round("debiased", 6).alias("debiased"))


@query("n4_training_progress", LOG + """,
    p AS (SELECT *, sum(CASE WHEN step > 10 THEN dt ELSE 0 END) OVER (PARTITION BY run ORDER BY step) AS tt FROM l)
    SELECT run, step, CAST(floor(524288.0::DOUBLE / dt) AS BIGINT) AS tokens_per_sec,
        round(100.0::DOUBLE * 3e9::DOUBLE * (524288.0::DOUBLE / dt) / 8e15::DOUBLE, 6) AS mfu, round(tt, 6) AS total_time,
        CASE WHEN step > 10 THEN round((5000 - step) * tt / (step - 10), 6) END AS eta
    FROM p""")
def training_progress(spark, sf):
    return tr.training_progress(step_log(spark, sf), 524288, 3e9, 8e15, 5000)


@query("n5_running_best", LOG + """,
    p AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM l)
    SELECT run, step, loss AS value, least(loss, b) AS best, b IS NULL OR loss < b AS is_best FROM p""")
def running_best(spark, sf):
    return tr.running_best(step_log(spark, sf).withColumnRenamed("loss", "value"))


STOP_SQL = """,
    f(run, step, value, improved, best, bad_evals) AS (
        SELECT run, step, value, true, value, CAST(0 AS BIGINT) FROM v WHERE step = 0
        UNION ALL
        SELECT v.run, v.step, v.value, v.value < f.best - {delta}, CASE WHEN v.value < f.best - {delta} THEN v.value ELSE f.best END,
               CASE WHEN v.value < f.best - {delta} THEN 0 ELSE f.bad_evals + 1 END
        FROM f JOIN v ON v.run = f.run AND v.step = f.step + 1)
    SELECT run, step, value, improved, best, bad_evals, bad_evals >= {patience} AS should_stop FROM f"""


@query("n6_early_stop", LOG.replace("WITH", "WITH RECURSIVE") + ", v AS (SELECT run, step, loss AS value FROM l)"
       + STOP_SQL.format(delta="0.05::DOUBLE", patience=40))
def early_stop(spark, sf):
    return tr.early_stop(step_log(spark, sf).withColumnRenamed("loss", "value"), 40, 0.05)


# A slowly falling metric with noise, so that most rows are new minima; one run for each supplier.
FALL = """
    WITH RECURSIVE v AS (SELECT run, step, round(1000.0::DOUBLE - step / 10.0::DOUBLE + l_tax, 6) AS value FROM (
        SELECT l_suppkey AS run, l_tax, row_number() OVER (
            PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS step FROM lineitem))"""


@query("n6_early_stop_falling", FALL + STOP_SQL.format(delta="0.37::DOUBLE", patience=3))
def early_stop_falling(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("run"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_tax")
    at = dense_index(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "step", by=["run"])
    v = at.select("run", "step", F.round(1000.0 - F.col("step") / 10.0 + F.col("l_tax"), 6).alias("value"))
    return tr.early_stop(v, 3, 0.37)


RUNS = """
    WITH r AS (SELECT l_returnflag || l_linestatus AS flops_budget, CAST(1000000 * l_quantity AS BIGINT) AS num_scaling_params,
                      avg(l_discount * 10 + power(log10(1000000 * l_quantity) - 7.2, 2)) AS val_bpb,
                      CAST(avg(l_partkey) AS BIGINT) AS tokens_trained, avg(l_tax) AS param_data_ratio
               FROM lineitem GROUP BY ALL)"""


def _runs(spark, sf):
    p = F.col("l_quantity") * 1000000
    return table(spark, sf, "lineitem").groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("flops_budget"), p.cast("bigint").alias("num_scaling_params")
    ).agg(
        F.avg(F.col("l_discount") * 10 + F.pow(F.log10(p) - 7.2, F.lit(2))).alias("val_bpb"),
        F.round(F.avg("l_partkey")).cast("bigint").alias("tokens_trained"), F.avg("l_tax").alias("param_data_ratio"))


@query("a16_isoflop_fit", RUNS + """,
    p AS (SELECT *, log10(num_scaling_params) AS x, val_bpb AS y FROM r),
    m AS (SELECT flops_budget, avg(x) AS xm FROM p GROUP BY 1),
    s AS (SELECT flops_budget, xm, count(*) AS n, sum(power(x - xm, 2)) AS s2, sum(power(x - xm, 3)) AS s3, sum(power(x - xm, 4)) AS s4,
                 sum(y) AS y0, sum((x - xm) * y) AS y1, sum(power(x - xm, 2) * y) AS y2,
                 arg_min(num_scaling_params, y) AS rp, arg_min(tokens_trained, y) AS rt, arg_min(param_data_ratio, y) AS rr, min(y) AS ry
          FROM p JOIN m USING (flops_budget) GROUP BY ALL),
    a AS (SELECT *, (y2 - s2 * y0 / n - s3 * y1 / s2) / (s4 - s2 * s2 / n - s3 * s3 / s2) AS a FROM s),
    b AS (SELECT *, (y1 - s3 * a) / s2 AS b, (y0 - s2 * a) / n AS c FROM a),
    o AS (SELECT *, CASE WHEN a > 0 THEN xm - b / (2 * a) END AS x0, a * power(b / (2 * a), 2) - b * b / (2 * a) + c AS bpb FROM b),
    l AS (SELECT o.flops_budget, max(x) FILTER (WHERE x <= x0) AS lx, arg_max(tokens_trained, x) FILTER (WHERE x <= x0) AS lt, arg_max(param_data_ratio, x) FILTER (WHERE x <= x0) AS lr,
                 min(x) FILTER (WHERE x >= x0) AS hx, arg_min(tokens_trained, x) FILTER (WHERE x >= x0) AS ht, arg_min(param_data_ratio, x) FILTER (WHERE x >= x0) AS hr
          FROM o JOIN p USING (flops_budget) GROUP BY 1)
    SELECT flops_budget, x0 IS NOT NULL AS fitted,
        round(CASE WHEN x0 IS NULL THEN rp ELSE power(10.0, x0) END, 2) AS params,
        round(CASE WHEN x0 IS NULL THEN rt WHEN lx IS NULL THEN ht WHEN hx IS NULL OR hx = lx THEN lt ELSE lt + (x0 - lx) / (hx - lx) * (ht - lt) END, 4) AS tokens,
        round(CASE WHEN x0 IS NULL THEN rr WHEN lx IS NULL THEN hr WHEN hx IS NULL OR hx = lx THEN lr ELSE lr + (x0 - lx) / (hx - lx) * (hr - lr) END, 6) AS ratio,
        round(CASE WHEN x0 IS NULL THEN ry ELSE bpb END, 6) AS bpb
    FROM o JOIN l USING (flops_budget)""")
def isoflop_fit(spark, sf):
    return fits.isoflop_fit(_runs(spark, sf)).select(
        "flops_budget", "fitted", F.round("params", 2).alias("params"), F.round("tokens", 4).alias("tokens"),
        F.round("ratio", 6).alias("ratio"), F.round("bpb", 6).alias("bpb"))


@query("a17_powerlaw_fit", RUNS + """
    SELECT flops_budget, count(*) AS n, round(regr_slope(log10(val_bpb), log10(num_scaling_params)), 6) AS slope,
        round(regr_intercept(log10(val_bpb), log10(num_scaling_params)), 6) AS intercept,
        round(regr_r2(log10(val_bpb), log10(num_scaling_params)), 6) AS r2 FROM r GROUP BY 1""")
def powerlaw_fit(spark, sf):
    return fits.powerlaw_fit(_runs(spark, sf), "num_scaling_params", "val_bpb", ["flops_budget"]).select(
        "flops_budget", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")])


@query("a18_best_per_group", RUNS + """
    SELECT flops_budget, arg_min(num_scaling_params, (val_bpb, num_scaling_params)) AS num_scaling_params,
           round(min(val_bpb), 6) AS val_bpb FROM r GROUP BY 1""")
def best_per_group(spark, sf):
    return fits.best_per_group(_runs(spark, sf), ["flops_budget"], tie=["num_scaling_params"]).select(
        "flops_budget", "num_scaling_params", F.round("val_bpb", 6).alias("val_bpb"))


@query("a19_linear_fit", """
    SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
        round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
    FROM lineitem GROUP BY 1""")
def linear_fit(spark, sf):
    return fits.fit_linear(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).select(
        "l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"),
        F.round("r2", 6).alias("r2"))


RIDGE = """
    WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(l_quantity) AS a, sum(l_discount) AS b, sum(l_quantity * l_quantity) + 0.1::DOUBLE AS aa,
        sum(l_quantity * l_discount) AS ab, sum(l_discount * l_discount) + 0.1::DOUBLE AS bb, sum(l_extendedprice) AS y,
        sum(l_quantity * l_extendedprice) AS ay, sum(l_discount * l_extendedprice) AS byy FROM lineitem),
    d AS (SELECT *, n * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b) AS det FROM s),
    w AS (SELECT (y * (aa * bb - ab * ab) - a * (ay * bb - ab * byy) + b * (ay * ab - aa * byy)) / det AS w0,
                 (n * (ay * bb - byy * ab) - y * (a * bb - ab * b) + b * (a * byy - ay * b)) / det AS w1,
                 (n * (aa * byy - ab * ay) - a * (a * byy - ay * b) + y * (a * ab - aa * b)) / det AS w2 FROM d)
    SELECT l_returnflag, round(avg(w0 + w1 * l_quantity + w2 * l_discount), 2) AS predicted FROM lineitem, w GROUP BY 1"""


@query("a19_ridge_predict", RIDGE)
def ridge_predict(spark, sf):
    li = table(spark, sf, "lineitem")
    model = fits.fit_ridge(li, ["l_quantity", "l_discount"], "l_extendedprice", 0.1)
    return fits.predict(li, model).groupBy("l_returnflag").agg(F.round(F.avg("predicted"), 2).alias("predicted"))
