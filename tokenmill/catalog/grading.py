"""Queries over ``conversations``, ``events`` and ``documents``: grading of responses."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tokenmill.catalog.base import WS, query, sql_strip, table
from tokenmill.operators import grading as g, instructions as ins
from tokenmill.plans.session import spread

# Responses and references made from the event values: several answer formats by event id.
ANS = """
    WITH a AS (SELECT event_id, user_id, event_type, value, CASE event_id % 6
            WHEN 0 THEN 'so it is ' || printf('%.2f', value) || ' in all'
            WHEN 1 THEN 'first 3, then 1,204.' || chr(10) || '#### ' || printf('%.2f', value)
            WHEN 2 THEN '#### 1,0' || user_id || '.'
            WHEN 3 THEN 'no number here'
            WHEN 4 THEN '-' || user_id || ' or 2,' || user_id || '.50 units'
            ELSE ' ' || user_id || ' ' END AS response,
        CASE WHEN event_id % 6 = 3 THEN CASE WHEN event_id % 4 = 3 THEN 'none' ELSE '7' END
             WHEN event_id % 6 = 2 THEN 'x #### 10' || user_id || CASE WHEN event_id % 4 = 0 THEN '.' ELSE '' END
             WHEN event_id % 6 = 4 THEN '2' || user_id || '.50'
             WHEN event_id % 6 = 5 THEN user_id || '.0'
             ELSE '#### ' || printf('%.2f', value) END AS reference
        FROM events),
    n AS (SELECT *, nullif(replace(regexp_extract(response, '#### (-?[0-9.,]+)', 1), ',', ''), '') AS rm,
                 nullif(replace(regexp_extract(reference, '#### (-?[0-9.,]+)', 1), ',', ''), '') AS fm,
                 replace(regexp_extract_all(response, '-?\\d[\\d,]*(?:\\.\\d+)?')[-1], ',', '') AS rl,
                 replace(regexp_extract_all(reference, '-?\\d[\\d,]*(?:\\.\\d+)?')[-1], ',', '') AS fl FROM a)"""


def _answers(spark, sf):
    e = table(spark, sf, "events")
    at, user, two = F.col("event_id") % 6, F.col("user_id"), F.format_string("%.2f", "value")
    c = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    response = (
        F.when(at == 0, c("so it is ", two, " in all")).when(at == 1, c("first 3, then 1,204.\n#### ", two))
        .when(at == 2, c("#### 1,0", user, ".")).when(at == 3, "no number here")
        .when(at == 4, c("-", user, " or 2,", user, ".50 units")).otherwise(c(" ", user, " ")))
    reference = (
        F.when(at == 3, F.when(F.col("event_id") % 4 == 3, "none").otherwise("7"))
        .when(at == 2, c("x #### 10", user, F.when(F.col("event_id") % 4 == 0, ".").otherwise("")))
        .when(at == 4, c("2", user, ".50")).when(at == 5, c(user, ".0")).otherwise(c("#### ", two)))
    return e.select("event_id", response.alias("response"), reference.alias("reference"))


@query("g1_number_match", ANS + """
    SELECT event_id, coalesce(rm, rl) IS NOT DISTINCT FROM coalesce(fm, fl) AS is_correct,
           rm IS NOT DISTINCT FROM fm AS is_correct_marked FROM n""")
def number_match(spark, sf):
    return _answers(spark, sf).select(
        "event_id", g.number_match("reference", "response").alias("is_correct"),
        g.number_match("reference", "response", fallback=False).alias("is_correct_marked"))


@query("g2_numeric_match", ANS + """,
    v AS (SELECT event_id, coalesce(rm, rl) AS r, coalesce(fm, fl) AS f, TRY_CAST(coalesce(rm, rl) AS DOUBLE) AS x, TRY_CAST(coalesce(fm, fl) AS DOUBLE) AS y FROM n)
    SELECT event_id, coalesce(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x = y ELSE r = f END, false) AS is_equal,
           coalesce(r = f, false) AS is_same FROM v""")
def numeric_match(spark, sf):
    return _answers(spark, sf).select(
        "event_id", g.numeric_match("reference", "response").alias("is_equal"),
        g.number_match_strict("reference", "response").alias("is_same"))


LETTERS = """
    WITH a AS (SELECT doc_id, ['A', 'B', 'C', 'D'][doc_id % 4 + 1] AS gold,
        CASE doc_id % 7 WHEN 0 THEN '(' || lower(['A', 'B', 'C', 'D'][doc_id % 4 + 1]) || ')' WHEN 1 THEN 'The answer is C.'
            WHEN 2 THEN 'Because D' WHEN 3 THEN '' WHEN 4 THEN ' b' WHEN 5 THEN text ELSE ['A', 'B', 'C', 'D'][doc_id % 3 + 1] END AS response
        FROM documents)"""


def _letters(spark, sf):
    d = table(spark, sf, "documents")
    abc = F.array(*[F.lit(x) for x in "ABCD"])
    gold = F.get(abc, (F.col("doc_id") % 4).cast("int"))
    at = F.col("doc_id") % 7
    response = (
        F.when(at == 0, F.concat(F.lit("("), F.lower(gold), F.lit(")"))).when(at == 1, "The answer is C.")
        .when(at == 2, "Because D").when(at == 3, "").when(at == 4, " b").when(at == 5, F.col("text"))
        .otherwise(F.get(abc, (F.col("doc_id") % 3).cast("int"))))
    return d.select("doc_id", gold.alias("gold"), response.alias("response"))


@query("g3_letter_match", LETTERS + f"""
    SELECT doc_id, response <> '' AND (upper(coalesce(list_filter(regexp_extract_all({sql_strip('response')}, '[\\p{{L}}\\p{{N}}_]+'),
               lambda w: regexp_full_match(w, '[A-Za-z]'))[1], '')) = gold OR starts_with(upper({sql_strip('response')}), gold)) AS lenient,
           coalesce(coalesce(list_filter(regexp_extract_all(upper({sql_strip('response')}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]'))[1],
               nullif(regexp_extract(upper({sql_strip('response')}), '^([A-Z])', 1), '')) = gold, false) AS choice
    FROM a""")
def letter_match(spark, sf):
    return _letters(spark, sf).select(
        "doc_id", g.letter_match("gold", "response").alias("lenient"), g.choice_match("gold", "response").alias("choice"))


@query("g3_letter_exact", LETTERS + """
    SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN response ELSE ['A', 'B', 'C', 'D'][length(response) % 4 + 1] END = gold AS is_correct FROM a""")
def letter_exact(spark, sf):
    abc = F.array(*[F.lit(x) for x in "ABCD"])
    # any other text than a letter is an error here, so it becomes one by its length
    letter = F.when(F.col("doc_id") % 7 == 6, F.col("response")).otherwise(F.get(abc, F.length("response") % 4))
    rows = _letters(spark, sf).withColumn("response", letter).withColumn("letters", abc)
    return rows.select("doc_id", g.letter_exact("gold", "response", "letters").alias("is_correct"))


BOX = """
    WITH a AS (SELECT doc_id, n_chars, CASE doc_id % 5 WHEN 0 THEN 'Thus \\boxed{ ' || n_chars || ' }.' WHEN 1 THEN '$\\boxed{x+' || n_chars || '}$'
                   WHEN 2 THEN 'It is ' || n_chars WHEN 3 THEN '\\framebox{0' || n_chars || '}' ELSE ' $ ' || lang || ' u200B ' END AS response,
               CASE doc_id % 5 WHEN 0 THEN 'so \\boxed{' || n_chars || '}' WHEN 1 THEN '\\boxed{x+' || n_chars || '}' WHEN 2 THEN n_chars || '.0'
                   WHEN 3 THEN CAST(n_chars AS VARCHAR) ELSE upper(lang) END AS reference FROM documents)"""


@query("g4_boxed_match", BOX + f""",
    b AS (SELECT *, {sql_strip("regexp_extract(response, '\\\\+boxed\\{([^}]*)\\}', 1)")} AS rb, {sql_strip("regexp_extract(reference, '\\\\+boxed\\{([^}]*)\\}', 1)")} AS fb,
        regexp_extract_all(CASE WHEN regexp_matches(response, '\\\\boxed') THEN regexp_extract(response, '\\\\boxed\\{{([^}}]*)\\}}', 1)
            WHEN regexp_matches(response, '\\\\framebox') THEN regexp_extract(response, '\\\\framebox\\{{([^}}]*)\\}}', 1) ELSE response END, '\\d+')[-1] AS ri,
        regexp_extract_all(CASE WHEN regexp_matches(reference, '\\\\boxed') THEN regexp_extract(reference, '\\\\boxed\\{{([^}}]*)\\}}', 1) ELSE reference END, '\\d+')[-1] AS fi FROM a)
    SELECT doc_id, CASE WHEN rb <> '' AND fb <> '' THEN rb = fb ELSE {sql_strip('response')} = {sql_strip('reference')} END AS boxed,
           coalesce(CAST(ri AS BIGINT) = CAST(fi AS BIGINT), false) AS integer FROM b""")
def boxed_match(spark, sf):
    return _boxes(spark, sf).select(
        "doc_id", g.boxed_match("reference", "response").alias("boxed"),
        g.integer_match("reference", "response").alias("integer"))


def _boxes(spark, sf):
    d = table(spark, sf, "documents")
    at, n = F.col("doc_id") % 5, F.col("n_chars").cast("string")
    c = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    response = (
        F.when(at == 0, c("Thus \\boxed{ ", n, " }.")).when(at == 1, c("$\\boxed{x+", n, "}$"))
        .when(at == 2, c("It is ", n)).when(at == 3, c("\\framebox{0", n, "}")).otherwise(c(" $ ", F.col("lang"), " u200B ")))
    reference = (
        F.when(at == 0, c("so \\boxed{", n, "}")).when(at == 1, c("\\boxed{x+", n, "}")).when(at == 2, c(n, ".0"))
        .when(at == 3, n).otherwise(F.upper("lang")))
    return d.select("doc_id", response.alias("response"), reference.alias("reference"))


@query("g4_flexible_match", BOX + """,
    b AS (SELECT *, replace(regexp_extract_all(response, '-?\\d[\\d,]*(?:\\.\\d+)?')[-1], ',', '') AS rn, replace(regexp_extract_all(reference, '-?\\d[\\d,]*(?:\\.\\d+)?')[-1], ',', '') AS fn FROM a)
    SELECT doc_id, CASE WHEN rn IS NOT NULL AND fn IS NOT NULL THEN CAST(rn AS DOUBLE) = CAST(fn AS DOUBLE)
        ELSE lower(regexp_replace(regexp_replace(replace(response, '$', ''), '(?i)u200b', '', 'g'), '\\s+', '', 'g')) = lower(reference) END AS is_correct FROM b""")
def flexible_match(spark, sf):
    return _boxes(spark, sf).select(
        "doc_id", g.mixed_match("reference", "response", F.array().cast("array<string>")).alias("is_correct"))


@query("g5_exact_and_alias", f"""
    WITH a AS (SELECT conv_id, turn, text AS reference, CASE WHEN turn % 2 = 0 THEN '  ' || replace(text, ' ', '  ') ELSE 'The ' || text || '!' END AS response FROM conversations),
    f AS (SELECT *, {sql_strip("regexp_replace(regexp_replace(regexp_replace(lower(response), '[^0-9a-z\\t-\\r\\x1c-\\x20\\x85\\p{Z}]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '" + WS + "+', ' ', 'g')")} AS fr,
                    {sql_strip("regexp_replace(regexp_replace(regexp_replace(lower(reference), '[^0-9a-z\\t-\\r\\x1c-\\x20\\x85\\p{Z}]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '" + WS + "+', ' ', 'g')")} AS ff FROM a)
    SELECT conv_id, turn, lower(regexp_replace({sql_strip('response')}, '{WS}+', ' ', 'g')) = lower(regexp_replace({sql_strip('reference')}, '{WS}+', ' ', 'g')) AS exact,
           fr = ff OR fr = 'other' AS alias FROM f""")
def exact_and_alias(spark, sf):
    response = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")))).otherwise(
        F.concat(F.lit("The "), "text", F.lit("!")))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("reference"), response.alias("response"))
    return c.select("conv_id", "turn", g.exact_match("reference", "response").alias("exact"),
                    g.alias_match(F.array(F.lit("Other"), "reference"), "response").alias("alias"))


@query("g6_yes_no", """
    WITH a AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE ' No ' END AS reference,
                      CASE user_id % 5 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'That is false' WHEN 2 THEN 'it is TRUE' WHEN 3 THEN ' ' ELSE event_type END AS response FROM events),
    b AS (SELECT event_id, lower(trim(reference)) AS f, lower(trim(response)) AS r FROM a)
    SELECT event_id, r <> '' AND (starts_with(r, f) OR (f = 'yes' AND (contains(r, 'true') OR contains(r, 'yes'))) OR (f = 'no' AND (contains(r, 'false') OR contains(r, 'no')))) AS is_correct FROM b""")
def yes_no(spark, sf):
    u = F.col("user_id") % 5
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 2 == 0, "yes").otherwise(" No ").alias("reference"),
        F.when(u == 0, "Yes.").when(u == 1, "That is false").when(u == 2, "it is TRUE").when(u == 3, " ")
        .otherwise(F.col("event_type")).alias("response"))
    return e.select("event_id", g.yes_no_match("reference", "response").alias("is_correct"))


@query("g7_json_valid", """
    SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN left(props, 5) WHEN event_id % 3 = 1 THEN '[' || props || ', ' || value || ']' ELSE props END) AS is_correct FROM events""")
def json_valid(spark, sf):
    at = F.col("event_id") % 3
    text = F.when(at == 0, F.left("props", F.lit(5))).when(at == 1, F.concat(F.lit("["), "props", F.lit(", "), F.col("value").cast("string"), F.lit("]"))).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", g.json_valid(text).alias("is_correct"))


@query("g8_call_match", """
    WITH a AS (SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN k % 2 = 0 WHEN 3 THEN false ELSE k % 3 <> 0 END AS is_correct FROM a""")
def call_match(spark, sf):
    """Two expected calls: ``f(k, unit)`` with an optional unit, and ``g(name)``."""
    from tokenmill.operators import tools as tl

    at, k = F.col("event_id") % 5, F.get_json_object("props", "$.k")
    c = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    truth = c('[{"f": {"k": [', k, '], "unit": ["", "m"]}}, {"g": {"name": "', F.col("event_type"), '"}}]')
    one = lambda key: c('{"name": "f", "arguments": {"k": "', key, '"}}')
    two = c('{"name": "g", "arguments": {"name": "', F.col("event_type"), '", "more": 1}}')
    response = (
        F.when(at == 0, c("[", two, ", ", one(k), "]"))
        .when(at == 1, c("[", two, ", ", two, "]"))
        .when(at == 2, c("[", one(F.when(k.cast("int") % 2 == 0, c(k, ".0")).otherwise(c(k, "1"))), ", ", two, "]"))
        .when(at == 3, c("calls: [", two, "]"))
        .otherwise(F.when(k.cast("int") % 3 == 0, c("[", one(k), "]")).otherwise(c("[", one(k), ", ", two, "]"))))
    e = spread(table(spark, sf, "events").select("event_id", "event_type", "props"), "event_id").select(
        "event_id", F.parse_json(truth).alias("truth"), response.alias("response"))
    turns = tl.expected_turns(F.col("truth"), F.lit(1))
    expected = F.transform(F.get(turns, F.lit(0)), lambda x: F.struct(
        x["name"].alias("name"),
        F.transform_values(x["arguments"], lambda _, v: F.transform(v, tl.canonical)).alias("arguments"))).cast(tl.EXPECTED)
    return e.withColumn("expected", expected).select("event_id", g.call_match("expected", "response").alias("is_correct"))


KINDS = [
    ("punctuation:no_comma", {}), ("detectable_format:number_highlighted_sections", {"num_highlights": 0}),
    ("length_constraints:number_words", {"relation": "less than", "num_words": 60}),
    ("detectable_content:number_placeholders", {"num_placeholders": 1}), ("combination:repeat_prompt", {}),
    ("detectable_format:title", {}), ("change_case:english_lowercase", {}),
    ("detectable_format:number_bullet_lists", {"num_bullets": 0}), ("change_case:english_capital", {}),
    ("detectable_format:multiple_sections", {"section_spliter": "the", "num_sections": 2}),
    ("change_case:capital_word_frequency", {"capital_relation": "at most", "capital_frequency": 0}),
    ("startend:quotation", {}), ("keywords:existence", {"keywords": ["the", "and"]}),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 1}), ("detectable_format:json_format", {}),
    ("combination:two_responses", {}), ("language:response_language", {"language": "hi"}),
    ("keywords:letter_frequency", {"let_relation": "at least", "letter": "E", "let_frequency": 30}),
    ("startend:end_checker", {"end_phrase": "tion."}), ("keywords:forbidden_words", {"forbidden_words": ["the", "le"]}),
    ("keywords:frequency", {"relation": "exactly", "keyword": "de", "frequency": 2}),
    ("length_constraints:number_sentences", {"relation": "more than", "num_sentences": 4}),
    ("length_constraints:nth_paragraph_first_word", {"first_word": "the", "num_paragraphs": 1, "nth_paragraph": 1}),
    ("detectable_content:postscript", {"postscript_marker": "P.S."}), ("unknown:kind", {}),
]

W = "[\\p{L}\\p{N}_]+"
CHECKS = {
    0: "NOT contains(text, ',')", 1: "len(regexp_extract_all(text, '\\*\\*[^*\\n]+?\\*\\*')) + len(regexp_extract_all(text, '\\*[^*\\n]+?\\*')) = 0",
    2: f"len(regexp_extract_all(text, '{W}')) < 60", 3: "regexp_matches(text, '\\[[^\\[\\]]+\\]')", 4: "false",
    5: "regexp_matches(text, '<<[^<>]+>>')", 6: "regexp_matches(text, '[a-z]') AND NOT regexp_matches(text, '[A-Z]')",
    7: "len(regexp_extract_all(text, '(?m)^\\s*\\* ')) = 0", 8: "regexp_matches(text, '[A-Z]') AND NOT regexp_matches(text, '[a-z]')",
    9: f"len(list_filter(regexp_extract_all(lower(trim(text)), '{W}|[^\\p{{L}}\\p{{N}}_]+'), lambda w, i: w = 'the' AND len(regexp_extract_all(lower(trim(text)), '{W}|[^\\p{{L}}\\p{{N}}_]+')) > i)) = 2",
    10: f"len(list_filter(regexp_extract_all(text, '{W}'), lambda w: regexp_full_match(w, '[A-Z]+'))) <= 0", 11: "false",
    12: f"list_contains(regexp_extract_all(lower(text), '{W}'), 'the') AND list_contains(regexp_extract_all(lower(text), '{W}'), 'and')",
    13: f"len(list_filter(string_split_regex({sql_strip('text')}, '\\n\\s*\\n'), lambda p: trim(p) <> '')) = 1", 14: "false",
    15: "len(string_split(text, '******')) = 2", 16: "false", 17: "len(text) - len(replace(lower(text), 'e', '')) >= 30",
    18: f"ends_with({sql_strip('text')}, 'tion.')",
    19: f"NOT list_has_any(regexp_extract_all(lower(text), '{W}'), ['the', 'le'])",
    20: f"len(list_filter(regexp_extract_all(lower(text), '{W}'), lambda w: w = 'de')) = 2",
    21: f"len(list_filter(string_split_regex(text, '[.!?]+'), lambda p: {sql_strip('p')} <> '')) > 4",
    22: f"len(list_filter(string_split_regex({sql_strip('text')}, '\\n\\s*\\n'), lambda p: trim(p) <> '')) = 1 AND lower(regexp_extract(text, '{W}', 0)) = 'the'",
    23: "regexp_matches(text, '(?im)^\\s*P\\.S\\.')", 24: "false",
}


def _constraint_items(spark, sf):
    rows = table(spark, sf, "conversations").filter("role = 'assistant'")
    item = F.concat_ws("-", "conv_id", "turn")
    ids = F.array(*[F.lit(k) for k, _ in KINDS])
    args = F.array(*[F.lit(json.dumps(a)) for _, a in KINDS])
    items = rows.select(item.alias("item_id"), F.lit("Say it.").alias("prompt"), ids.alias("instruction_ids"), args.alias("kwargs"))
    responses = rows.select(item.alias("item_id"), F.lit(1).alias("sample_no"), "text")
    return responses, items


@query("g9_constraint_results", "WITH a AS (SELECT conv_id || '-' || turn AS item_id, text FROM conversations WHERE role = 'assistant') " + " UNION ALL ".join(
    f"SELECT item_id, '{KINDS[i][0]}' AS instruction_id, {sql} AS is_met FROM a" for i, sql in CHECKS.items()))
def constraint_results(spark, sf):
    return ins.constraint_results(*_constraint_items(spark, sf)).select("item_id", "instruction_id", "is_met")


@query("g9_accuracy_by_kind", "WITH a AS (SELECT text FROM conversations WHERE role = 'assistant'), r AS (" + " UNION ALL ".join(
    f"SELECT '{KINDS[i][0]}' AS instruction_id, {sql} AS is_met FROM a" for i, sql in CHECKS.items()) + """)
    SELECT instruction_id, count(*) AS n, round(avg(CAST(is_met AS DOUBLE)), 6) AS accuracy FROM r GROUP BY 1""")
def accuracy_by_kind(spark, sf):
    return ins.accuracy_by_kind(ins.constraint_results(*_constraint_items(spark, sf)))


@query("g9_grade_instructions", f"""
    SELECT conv_id || '-' || turn AS item_id, CAST(1 AS INTEGER) AS sample_no, ({CHECKS[0]}) AND ({CHECKS[21]}) AS is_correct
    FROM conversations WHERE role = 'assistant'""")
def grade_instructions(spark, sf):
    responses, items = _constraint_items(spark, sf)
    two = items.withColumn("instruction_ids", F.array(F.lit(KINDS[0][0]), F.lit(KINDS[21][0]))).withColumn(
        "kwargs", F.array(F.lit("{}"), F.lit(json.dumps(KINDS[21][1]))))
    return ins.grade_instructions(ins.constraint_results(responses, two))


@query("g10_outcomes", """
    SELECT d.doc_id AS program_id, coalesce(l.quality = 1, false) AS is_correct
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def outcomes(spark, sf):
    programs = table(spark, sf, "documents").select(F.col("doc_id").alias("program_id"))
    results = table(spark, sf, "labels").select(F.col("doc_id").alias("program_id"), (F.col("quality") == 1).alias("success"))
    return g.outcome_match(programs, results)


@query("j3_grade_by_task", ANS + """
    SELECT event_id % 3 AS kind, count(*) AS n, CAST(sum(CASE event_id % 3
        WHEN 0 THEN CAST(coalesce(rm, rl) IS NOT DISTINCT FROM coalesce(fm, fl) AS INTEGER)
        WHEN 1 THEN CAST(coalesce(coalesce(rm, rl) = coalesce(fm, fl), false) AS INTEGER)
        ELSE CAST(trim(response) = trim(reference) AS INTEGER) END) AS BIGINT) AS n_correct FROM n GROUP BY 1""")
def grade_by_task(spark, sf):
    a = _answers(spark, sf).withColumn("kind", F.col("event_id") % 3)
    task = F.when(F.col("kind") == 0, "gsm8k").when(F.col("kind") == 1, "gsm8k_like").otherwise("text")
    items = a.select(task.alias("task"), F.col("event_id").alias("item_id"), "reference", task.alias("grader"))
    responses = a.select(task.alias("task"), F.col("event_id").alias("item_id"), F.lit(1).alias("sample_no"), F.col("response").alias("text"), "kind")
    return g.grade(responses, items, ["gsm8k", "gsm8k_like", "text"]).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("n_correct"))
