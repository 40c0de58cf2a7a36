"""Queries over ``conversations`` and ``documents``: cleaning, checking and rendering turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.catalog.base import query, sql_strip, table
from tokenmill.operators import turns as t


def _long(spark, sf):
    return table(spark, sf, "conversations")


@query("p1_alias_coalesce", """
    SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''),
                            nullif(source, '')) AS picked
    FROM documents""")
def alias_coalesce(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("lang"), "source")
    return d.select("doc_id", t.first_of(d, "language", "lang", "source").alias("picked"))


@query("p2_english_filter", """
    SELECT doc_id, length(text) AS n_chars FROM documents
    WHERE lang IS NULL OR list_bool_or(list_transform(
        string_split_regex(lower(lang || '; ' || source), '[\\s,;/|]+'),
        lambda x: starts_with(x, 'en') OR contains(x, 'english')))""")
def english_filter(spark, sf):
    d = table(spark, sf, "documents")
    d = d.select("doc_id", "text", F.concat("lang", F.lit("; "), "source").alias("language"))
    return t.filter_english(d).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


RAW_ROLE = """CASE role
    WHEN 'assistant' THEN ['gpt', ' Model', 'bot', 'ASSISTANT', 'response'][(conv_id + turn) % 5 + 1]
    WHEN 'user' THEN ['human', 'User ', 'instruction', 'tool', 'function_response', 'narrator'][(conv_id + turn) % 6 + 1]
    ELSE CASE WHEN conv_id % 2 = 0 THEN 'system' ELSE ' SYSTEM' END END"""


def _raw_roles(spark, sf):
    names = {
        "assistant": ["gpt", " Model", "bot", "ASSISTANT", "response"],
        "user": ["human", "User ", "instruction", "tool", "function_response", "narrator"],
    }

    def pick(k):
        at = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(names[k]))).cast("int")
        return F.get(F.array(*[F.lit(n) for n in names[k]]), at)

    raw = (
        F.when(F.col("role") == "assistant", pick("assistant"))
        .when(F.col("role") == "user", pick("user"))
        .otherwise(F.when(F.col("conv_id") % 2 == 0, "system").otherwise(" SYSTEM"))
    )
    return _long(spark, sf).withColumn("role", raw)


@query("p3_map_roles", f"""
    WITH raw AS (
        SELECT conv_id, turn, lower(trim({RAW_ROLE})) AS r,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT conv_id, turn, CASE
        WHEN r = 'system' THEN CASE WHEN n = 1 THEN 'system' ELSE 'user' END
        WHEN r IN ('assistant', 'gpt', 'model', 'bot', 'response') THEN 'assistant'
        ELSE 'user' END AS role FROM raw""")
def map_roles(spark, sf):
    return t.map_roles(_raw_roles(spark, sf)).select("conv_id", "turn", "role")


@query("p4_merge_same_role", """
    WITH kept AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 1 AND role <> 'system' THEN 'user' ELSE role END AS role FROM conversations),
    marked AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS fresh
               FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM marked)
    SELECT conv_id, min(turn) AS turn, min(role) AS role,
           string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text
    FROM runs GROUP BY conv_id, run""")
def merge_same_role(spark, sf):
    role = F.when((F.col("turn") % 3 == 1) & (F.col("role") != "system"), "user").otherwise(F.col("role"))
    return t.merge_same_role(_long(spark, sf).withColumn("role", role))


VALID_SQL = """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations),
    s AS (SELECT *, max(CASE WHEN k = 0 AND role = 'system' THEN 1 ELSE 0 END)
                    OVER (PARTITION BY conv_id) AS sys FROM n),
    f AS (SELECT conv_id, count(*) AS n_messages, max(sys) AS sys,
                 bool_and(k < sys OR role = CASE WHEN (k - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END) AS alt,
                 arg_max(role, turn) AS last_role
          FROM s GROUP BY conv_id),
    r AS (SELECT conv_id, n_messages, CASE
              WHEN n_messages - sys < {dialog} THEN 'too_few_messages'
              WHEN NOT alt THEN 'roles_do_not_alternate'
              WHEN {end} AND last_role <> 'assistant' THEN 'last_not_assistant' END AS reason FROM f)
    SELECT conv_id, n_messages, reason IS NULL AS is_valid, reason FROM r"""


@query("p5_validate_turns", VALID_SQL.format(dialog=0, end="true"))
def validate_turns(spark, sf):
    return t.validate_turns(_long(spark, sf))


@query("p5_validate_dialog", VALID_SQL.format(dialog=2, end="false"))
def validate_dialog(spark, sf):
    return t.validate_turns(_long(spark, sf), end_assistant=False, min_dialog=2)


@query("p6_trim_trailing", """
    SELECT conv_id, turn, role FROM conversations
    QUALIFY NOT (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AND role <> 'assistant')""")
def trim_trailing(spark, sf):
    return t.trim_trailing(_long(spark, sf)).select("conv_id", "turn", "role")


@query("p7_fold_system", """
    WITH m AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS pr, lag(text) OVER w AS pt
               FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, role,
           CASE WHEN n = 2 AND pr = 'system' THEN pt || chr(10) || chr(10) || text ELSE text END AS text
    FROM m WHERE NOT (n = 1 AND role = 'system')""")
def fold_system(spark, sf):
    return t.fold_system(_long(spark, sf))


@query("p8_parse_transcripts", f"""
    WITH x AS (SELECT conv_id, turn, role,
                      regexp_replace(regexp_replace(text, 'Human:|Assistant:', '-', 'g'), '\\n\\n', chr(10), 'g') AS text
               FROM conversations WHERE role <> 'system')
    SELECT conv_id, role, {sql_strip('text')} AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM x""")
def parse_transcripts(spark, sf):
    safe = F.regexp_replace(F.regexp_replace("text", "Human:|Assistant:", "-"), "\\n\\n", "\n")
    line = F.concat(F.when(F.col("role") == "user", "Human: ").otherwise("Assistant: "), safe)
    scripts = _long(spark, sf).filter("role <> 'system'").groupBy("conv_id").agg(
        F.concat(F.lit("\n\n"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda p: p["line"]
        ), "\n\n")).alias("chosen"))
    return t.parse_transcripts(scripts, "chosen")


@query("p25_check_limits", """
    WITH f AS (
        SELECT conv_id, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS total_chars,
               max(length(text)) AS longest, bool_or(length(text) = 0) AS empty,
               bool_or(role NOT IN ('user', 'assistant')) AS bad_role
        FROM conversations GROUP BY conv_id)
    SELECT conv_id, n_messages, total_chars, concat_ws(',',
        CASE WHEN n_messages > 6 THEN 'too_many_messages' END,
        CASE WHEN empty THEN 'empty_content' END,
        CASE WHEN longest > 900 THEN 'message_too_long' END,
        CASE WHEN total_chars > 2500 THEN 'conversation_too_long' END,
        CASE WHEN bad_role THEN 'invalid_role' END) AS reasons,
        NOT (n_messages > 6 OR empty OR longest > 900 OR total_chars > 2500 OR bad_role) AS accepted
    FROM f""")
def check_limits(spark, sf):
    small = {**t.LIMITS, "max_messages": 6, "max_message_chars": 900, "max_total_chars": 2500}
    out = t.check_limits(_long(spark, sf), small)
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("p30_prompt_and_reference", f"""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
    SELECT conv_id,
        {sql_strip("coalesce(string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE r > 1), '')")} AS prompt_text,
        max(CASE WHEN r = 1 AND role = 'assistant' THEN text END) AS reference_text
    FROM n GROUP BY conv_id""")
def prompt_and_reference(spark, sf):
    return t.prompt_and_reference(_long(spark, sf))


@query("p30_content_text", """
    SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def content_text(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return _long(spark, sf).groupBy("conv_id").agg(parts.alias("parts")).select(
        "conv_id", t.content_text("parts").alias("text"))


@query("m6_nested_round_trip", "SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS turn, role, text FROM conversations")
def nested_round_trip(spark, sf):
    return t.to_long(t.to_nested(_long(spark, sf)))


@query("j1_pair_messages", """
    WITH m AS (SELECT conv_id || '-' || turn AS message_id,
                      conv_id || '-' || (turn - 1) AS parent_id, role, text,
                      CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN NULL ELSE 'fr' END AS lang
               FROM conversations)
    SELECT c.message_id, c.parent_id, p.text AS user_text, c.text AS assistant_text
    FROM m c JOIN m p ON c.parent_id = p.message_id
    WHERE c.role = 'assistant' AND p.role = 'user' AND coalesce(c.lang, 'en') = 'en'
      AND coalesce(p.lang, 'en') = 'en' AND c.text <> '' AND p.text <> ''""")
def pair_messages(spark, sf):
    lang = F.when(F.col("conv_id") % 3 == 0, "en").when(F.col("conv_id") % 3 == 2, "fr")
    m = _long(spark, sf).select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("parent_id"),
        "role", "text", lang.alias("lang"))
    return t.pair_messages(m)


@query("p26_build_reprompts", """
    WITH r AS (
        SELECT conv_id, turn, text,
               CASE WHEN (conv_id + turn) % 3 = 0 THEN NULL
                    ELSE '<think>' || role || chr(10) || '</think>  ' || text END AS sol,
               CASE WHEN (conv_id + turn) % 4 < 2 THEN NULL ELSE 'attempt ' || turn END AS fb
        FROM conversations)
    SELECT conv_id, turn, """ + sql_strip("""
        """ + sql_strip("text") + """
        || CASE WHEN sol IS NULL THEN '' ELSE chr(10) || chr(10) || 'Correct solution:' || chr(10) || chr(10)
             || regexp_replace(sol, '(?s)<think>.*?</think>\\s*', '', 'g') END
        || CASE WHEN fb IS NULL THEN '' ELSE chr(10) || chr(10)
             || 'The following is feedback from your unsuccessful earlier attempt:' || chr(10) || chr(10) || fb END
        || chr(10) || chr(10) || 'Correctly solve the original question.'""") + """ AS reprompt
    FROM r WHERE sol IS NOT NULL OR fb IS NOT NULL""")
def build_reprompts(spark, sf):
    at = F.col("conv_id") + F.col("turn")
    r = _long(spark, sf).select(
        "conv_id", "turn", F.col("text").alias("prompt_text"),
        F.when(at % 3 != 0, F.concat(F.lit("<think>"), "role", F.lit("\n</think>  "), "text"))
        .alias("solution_text"),
        F.when(at % 4 >= 2, F.concat(F.lit("attempt "), "turn")).alias("feedback_text"))
    return t.build_reprompts(r, drop_thinking=True).select("conv_id", "turn", "reprompt")


@query("p27_truncate_on_stop", """
    WITH c AS (SELECT conv_id, turn, text, list_filter([strpos(text, '. '), strpos(text, 'tion'), strpos(text, chr(10))],
                                                 lambda x: x > 0) AS hits FROM conversations)
    SELECT conv_id, turn, CASE WHEN len(hits) = 0 THEN text ELSE left(text, list_min(hits) - 1) END AS text FROM c""")
def truncate_on_stop(spark, sf):
    return t.truncate_on_stop(_long(spark, sf), "text", [". ", "tion", "\n"]).select("conv_id", "turn", "text")


@query("p28_assemble_programs", """
    SELECT doc_id AS item_id, 'import a' || chr(10) || chr(10) || 'def f(): return ' || n_chars
        || chr(10) || chr(10) || 'def check(g): assert g() == ' || n_chars || chr(10) || 'check(f)' AS program
    FROM documents""")
def assemble_programs(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "n_chars")
    responses = d.select("item_id", F.concat(
        F.lit("Sure:\n```python\ndef f(): return "), "n_chars", F.lit("\n```\nand\n```\nnot me\n```")).alias("text"))
    tasks = d.select(
        "item_id", F.lit("# head\nimport a\n\ndef f():\n    import b").alias("prompt"),
        F.concat(F.lit("def check(g): assert g() == "), "n_chars").alias("test"),
        F.lit("f").alias("entry_point"))
    return t.assemble_programs(responses, tasks, "check").select("item_id", "program")
