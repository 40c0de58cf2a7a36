"""Instruction-following checks: one native expression per kind of constraint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.text import BOUNDARY, WORD, WS, quote_regex, strict_json, strip
from tokenmill.plans.joins import skew_join

# Fields that constraints take.
ARGUMENTS = (
    "num_highlights int, relation string, num_words int, num_placeholders int, prompt_to_repeat string, "
    "num_bullets int, section_spliter string, num_sections int, capital_relation string, capital_frequency int, "
    "keywords array<string>, num_paragraphs int, language string, let_relation string, letter string, "
    "let_frequency int, end_phrase string, forbidden_words array<string>, keyword string, frequency int, "
    "num_sentences int, first_word string, nth_paragraph int, postscript_marker string"
)

# Scripts by language.
SCRIPTS = {
    "kn": r"\x{0C80}-\x{0CFF}", "hi": r"\x{0900}-\x{097F}",
    "pa": r"\x{0A00}-\x{0A7F}", "ta": r"\x{0B80}-\x{0BFF}",
}

BOLD = r"\*\*[^*\n]+?\*\*"
ITALIC = r"(?<!\*)\*(?!\*)([^*\n]+?)\*(?!\*)"


def _count(text, pattern) -> Column:
    return F.regexp_count(text, pattern if isinstance(pattern, Column) else F.lit(pattern))


def _relation(count: Column, relation: Column, threshold: Column) -> Column:
    """No relation means at least; an unknown one fails."""
    return (
        F.when(threshold.isNull(), False)
        .when(F.coalesce(relation, F.lit("")).isin("", "at least"), count >= threshold)
        .when(relation.isin("less than", "fewer than"), count < threshold)
        .when(relation.isin("at most", "no more than"), count <= threshold)
        .when(relation == "more than", count > threshold)
        .when(relation.isin("equal", "exactly"), count == threshold)
        .otherwise(False)
    )


def keyword_count(text: Column, keyword: Column) -> Column:
    """Whole-word hits; a keyword with a blank is counted as plain text."""
    low = F.lower(keyword)
    whole = _count(F.lower(text), F.concat(F.lit(BOUNDARY), quote_regex(low), F.lit(BOUNDARY)))
    plain = _count(F.lower(text), quote_regex(low))
    return F.when(F.coalesce(keyword, F.lit("")) == "", 0).when(low.rlike(rf"[{WS}]"), plain).otherwise(whole)


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(strip(text), rf"\n[{WS}]*\n"), lambda p: strip(p) != "")


def _filled(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(c.cast("string"), F.lit("")) != "" for c in columns])


def _language(text: Column, language: Column) -> Column:
    checks = F.when(F.coalesce(language, F.lit("")) == "", False).when(language == "en", True)
    for code, script in SCRIPTS.items():
        checks = checks.when(language == code, text.rlike(rf"[{script}&&\p{{L}}]") & ~text.rlike("[A-Za-z]"))
    return checks.otherwise(False)


def check(instruction: Column, a: Column, text: Column, prompt: Column) -> Column:
    """Whether the text meets one constraint; ``a`` is the struct of its arguments."""
    body = strip(text)
    end = a["end_phrase"]
    sections = _count(text, F.concat(
        F.lit(r"(?i)" + BOUNDARY), quote_regex(a["section_spliter"]), F.lit(BOUNDARY + rf"[{WS}]*[^{WS}]+")))
    halves = F.split(text, r"\*{6}")
    paragraphs = _paragraphs(text)
    repeat = F.coalesce(F.nullif(a["prompt_to_repeat"], F.lit("")), prompt)
    letter = a["letter"]
    times = lambda t, x: ((F.length(t) - F.length(F.replace(t, x, F.lit("")))) / F.length(x)).cast("int")
    # a text of several letters is compared with single characters, so it is never found
    letters = F.when(F.coalesce(letter, F.lit("")) == "", 0).when(letter.rlike(r"^\p{L}{2,}$"), 0).when(
        letter.rlike(r"^\p{L}$"), times(F.lower(text), F.lower(letter))
    ).otherwise(times(text, letter))
    nth = F.get(paragraphs, a["nth_paragraph"] - 1)
    first_word = F.get(F.regexp_extract_all(nth, F.lit(rf"[{WORD}]+"), F.lit(0)), F.lit(0))
    rules = {
        "punctuation:no_comma": ~F.contains(text, F.lit(",")),
        "detectable_format:number_highlighted_sections":
            (_count(text, BOLD) + _count(text, ITALIC)) == a["num_highlights"],
        "length_constraints:number_words": _relation(_count(text, rf"[{WORD}]+"), a["relation"], a["num_words"]),
        "detectable_content:number_placeholders": _count(text, r"\[[^\[\]]+\]") >= a["num_placeholders"],
        "combination:repeat_prompt": _filled(repeat) & text.startswith(repeat)
            & (strip(F.substring(text, F.length(repeat) + 1, F.length(text))) != ""),
        "detectable_format:title": text.rlike(r"<<[^<>]+>>"),
        "change_case:english_lowercase": text.rlike("[a-z]") & ~text.rlike("[A-Z]"),
        "detectable_format:number_bullet_lists": _count(text, rf"(?m)^[{WS}]*\* ") == a["num_bullets"],
        "change_case:english_capital": text.rlike("[A-Z]") & ~text.rlike("[a-z]"),
        "detectable_format:multiple_sections":
            _filled(a["section_spliter"], a["num_sections"]) & (sections == a["num_sections"]),
        "change_case:capital_word_frequency": _relation(
            _count(text, rf"(?<![{WORD}])[A-Z]+(?![{WORD}])"), a["capital_relation"], a["capital_frequency"]),
        "startend:quotation": (F.length(body) >= 2) & body.startswith('"') & body.endswith('"'),
        "keywords:existence": (F.size(a["keywords"]) > 0)
            & F.forall(a["keywords"], lambda k: keyword_count(text, k) > 0),
        "length_constraints:number_paragraphs": F.size(paragraphs) == a["num_paragraphs"],
        "detectable_format:json_format": body.rlike(r"^[{\[]") & strict_json(body).isNotNull(),
        "combination:two_responses": (F.size(halves) == 2) & F.forall(halves, lambda h: strip(h) != ""),
        "language:response_language": _language(text, a["language"]),
        "keywords:letter_frequency": _relation(letters, a["let_relation"], a["let_frequency"]),
        "startend:end_checker": _filled(end) & (
            body.endswith(end) | body.endswith(F.concat(end, F.lit('"'))) | body.endswith(F.concat(end, F.lit("'")))),
        "keywords:forbidden_words": F.when(F.coalesce(F.size(a["forbidden_words"]), F.lit(0)) < 1, True).otherwise(
            F.forall(a["forbidden_words"], lambda k: keyword_count(text, k) == 0)),
        "keywords:frequency": _filled(a["keyword"]) & _relation(
            keyword_count(text, a["keyword"]), a["relation"], a["frequency"]),
        "length_constraints:number_sentences": _relation(
            F.size(F.filter(F.split(text, r"[.!?]+"), lambda p: strip(p) != "")), a["relation"], a["num_sentences"]),
        "length_constraints:nth_paragraph_first_word":
            _filled(a["first_word"], a["num_paragraphs"], a["nth_paragraph"])
            & (F.size(paragraphs) == a["num_paragraphs"])
            & (F.lower(first_word) == F.lower(a["first_word"])),
        "detectable_content:postscript": _filled(a["postscript_marker"]) & F.regexp_like(
            text, F.concat(F.lit(rf"(?im)^[{WS}]*"), quote_regex(a["postscript_marker"]))),
    }
    verdict = F.lit(False)
    for name, rule in rules.items():
        verdict = F.when(instruction == name, F.coalesce(rule, F.lit(False))).otherwise(verdict)
    return verdict


def constraint_results(responses: DataFrame, items: DataFrame) -> DataFrame:
    """One row per response and constraint.

    ``responses(item_id, sample_no, text)``, ``items(item_id, prompt, instruction_ids
    ARRAY<STRING>, kwargs ARRAY<STRING of JSON>)``.
    """
    both = skew_join(
        responses.filter("text is not null"), items.select("item_id", "prompt", "instruction_ids", "kwargs"), ["item_id"]
    )
    # a response crosses the shuffle once; its constraints are multiplied out behind the join
    listed = both.select(
        "item_id", "sample_no", "text", "prompt", "kwargs", F.posexplode("instruction_ids").alias("constraint_no", "instruction_id")
    )
    args = F.from_json(F.coalesce(F.get("kwargs", F.col("constraint_no")), F.lit("{}")), ARGUMENTS)
    return listed.withColumn("a", args).select(
        "item_id", "sample_no", "constraint_no", "instruction_id",
        check(F.col("instruction_id"), F.col("a"), F.col("text"), F.col("prompt")).alias("is_met"),
    )


def grade_instructions(results: DataFrame) -> DataFrame:
    """A response is correct when it meets all its constraints."""
    return results.groupBy("item_id", "sample_no").agg(F.bool_and("is_met").alias("is_correct"))


def accuracy_by_kind(results: DataFrame) -> DataFrame:
    return results.groupBy("instruction_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("is_met").cast("double")).alias("accuracy")
    )
