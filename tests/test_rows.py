"""One fixture row per source layout, and the behaviour of the graders on edge cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenmill.operators import choices as ch, grading as g, instructions as ins, mixing as mx, tools as tl, turns as t
from tokenmill.plans import adapters as ad


def one(spark, adapter, ddl, row, **kw):
    df = spark.createDataFrame([row], ddl)
    out = ad.to_conversations(df, adapter, **kw).collect()
    return out[0] if out else None


def texts(conv):
    return [(m.role, m.content) for m in conv.messages]


MC = "struct<text:array<string>,label:array<string>>"
LETTERS = list("ABCD")
CASES = [
    ("hellaswag", "ctx string, endings array<string>, label string", ("A person is cooking pasta.", ["a", "b", "c", "d"], "1"), LETTERS),
    ("gpqa", "Question string, `Correct Answer` string, `Incorrect Answer 1` string, `Incorrect Answer 2` string, `Incorrect Answer 3` string",
     ("2+2", "4", "3", "5", "22"), LETTERS),
    ("hendrycks_math", "problem string, solution string, type string, level string", ("1+1? ", r"so \boxed{2}", "Algebra", "1"), [r"so \boxed{2}"]),
    ("mbpp", "text string, code string", ("add", "def add(a, b): return a + b"), ["def add(a, b): return a + b"]),
    ("alpaca", "instruction string, input string, output string", ("Say hi", "", "Hi!"), ["Hi!"]),
    ("triviaqa", "question string, answer struct<value:string,normalized_value:string,normalized_aliases:array<string>>",
     ("Capital of France?", ("Paris", None, None)), ["Paris"]),
    ("mmlu", "question string, choices array<string>, answer int, subject string", ("q", ["1", "2", "3", "4"], 2, "anatomy"), ["C"]),
    ("mmlu_pro", "question string, options array<string>, answer_index int, category string", ("q", list("xyzuvw"), 5, "law"), ["F"]),
    ("arc", f"question string, choices {MC}, answerKey string", ("q", (["x", "y"], ["1", "2"]), "2"), ["2"]),
    ("sciq", "question string, correct_answer string, distractor1 string, distractor2 string, distractor3 string", ("q", "r", "a", "", None), ["A", "B"]),
    ("openbookqa", "question_stem string, choices array<struct<text:string,label:string>>, answerKey string", ("q", [("two", "B"), ("one", "A")], "2"), ["B"]),
    ("aime", "problem string, answer int, year int", ("p", 42, 2024), ["42"]),
    ("hle", "question string, answer string, answer_type string", ("q", "b", "multipleChoice"), ["b"]),
    ("humaneval", "prompt string, canonical_solution string, entry_point string, test string", ("def f():", " return 1", "f", "t"), ["def f():\n return 1"]),
    ("code_bagel", "instruction string, input string, output string", ("i", "x", "o"), ["o"]),
    ("z1", "question string, response string", ("q", "r"), ["r"]),
    ("open_math_instruct", "problem string, generated_solution string, expected_answer string", ("p", "", "7"), ["7"]),
    ("numina_math", "prompt string, response string, ground_truth string, correct boolean", ("p", "r", "g", False), ["g"]),
    ("natural_reasoning", "question string, reference_answer string, responses array<struct<response:string>>", ("q", "", [("first",), ("second",)]), ["first"]),
    ("skunkworks", "instruction string, reasoning string, output string", ("i", " why ", ""), ["why"]),
    ("magpie", "instruction string, response string", ("i", "r"), ["r"]),
    ("custom_json", "messages array<struct<role:string,content:string>>", ([("user", "u"), ("assistant", "a")],), ["a"]),
    ("smoltalk", "messages array<struct<role:string,content:string>>", ([("system", "s"), ("user", "u"), ("assistant", "a")],), ["a"]),
    ("ifeval", "key int, prompt string, instruction_id_list array<string>, kwargs array<map<string,string>>", (1, "p", ["x"], [{}]), [""]),
    # wider question sets
    ("gsm8k-platinum", "prompt string, solution string", ("q", "#### 3"), ["#### 3"]),
    ("calc-svamp", "Body string, Question string, chain string", (" b ", " q ", "<x/><result> 3 </result>"), ["3"]),
    ("math_qa", "Problem string, options string, correct string", ("p", "a ) 1 , b ) 2", "b"), ["B"]),
    ("commonsense-qa", f"question string, choices {MC}, answerKey string", ("q", (["x", "y"], ["A", "B"]), "B"), ["B"]),
    ("piqa", "goal string, sol1 string, sol2 string, label int", ("g", "x", "y", 1), ["B"]),
    ("winogrande", "sentence string, option1 string, option2 string, answer string", ("s", "x", "y", "2"), ["B"]),
    ("cosmos-qa", "context string, question string, answer0 string, answer1 string, answer2 string, answer3 string, label int", ("c", "q", "a", "b", "c", "d", 3), ["D"]),
    ("boolq", "passage string, question string, answer boolean", ("p", "q", False), ["no"]),
    ("race", "article string, question string, options array<string>, answer string", ("a", "q", ["w", "x", "y", "z"], "D"), ["D"]),
    ("social-iqa", "context string, question string, answerA string, answerB string, answerC string, label string", ("c", "q", "x", "y", "z", "3"), ["C"]),
    ("qasc", f"question string, choices {MC}, answerKey string", ("q", (["x", "y"], ["A", "B"]), "A"), ["A"]),
    ("logiqa", "input string, expected_output string", ("<!--retrieval_context-->ctx<!--/retrieval_context--><!--input-->q? ['one', 'two']<!--/input-->", "two"), ["B"]),
    ("aqua-rat-mcqa", "question string, options array<string>, correct string", ("q", ["A)1", "B)2"], "B"), ["B"]),
    ("dolly-15k", "instruction string, context string, response string", ("i", "c", "r"), ["r"]),
    ("hendrycks-math-benchmark", "problem string, solution string", ("p", "s"), ["s"]),
    ("verifiable-corpus", "problem string, answer string, description string", ("p", "a", "d"), ["a"]),
    ("gpqa-d", "Question string, `Correct Answer` string, `Incorrect Answer 1` string", ("q", "r", "w"), ["A"]),
    ("mmlu-pro", "question string, options array<string>, answer_index int", ("q", ["x", "y"], 1), ["B"]),
    ("aime24", "problem string, solution string, answer string", ("p", r"\boxed{1}", "1"), [r"\boxed{1}"]),
    ("mbpp", "text string, code string", ("t", "c"), ["c"]),
    ("openorca", "system_prompt string, question string, response string", ("s", "q", "r"), ["r"]),
    ("sharegpt-52k", "conversations array<struct<from:string,value:string>>", ([("human", "a"), ("gpt", "b"), ("human", "c")],), ["b"]),
    ("hh-rlhf", "chosen string", ("\n\nHuman: hi\n\nAssistant: yes\n\nHuman: more",), ["yes"]),
    ("json-mermaid", "json string, mermaid string", ("{}", "graph"), ["graph"]),
]


@pytest.mark.parametrize("case", CASES, ids=[c[0] + str(i) for i, c in enumerate(CASES)])
def test_adapter(spark, case):
    name, ddl, row, answers = case
    conv = one(spark, name, ddl, row)
    roles = [m.role for m in conv.messages if m.role != "system"]
    assert roles == ["user", "assistant"] * (len(roles) // 2)
    assert conv.messages[-1].content in answers


def test_every_set_has_an_adapter():
    assert len(ad.SETS) == 37 and "oasst1" not in ad.SETS


def test_bad_rows_are_dropped_or_flagged(spark):
    ddl = "question string, choices array<string>, answer int"
    assert one(spark, "mmlu", ddl, ("q", ["1", "2"], 0)) is None
    assert one(spark, "mmlu", ddl, ("q", ["1", "2"], 0), on_invalid="flag").is_valid is False
    assert one(spark, "open_thoughts", "conversations array<struct<from:string,value:string>>", ([("narrator", "x")],)) is None


def test_alpaca_has_no_empty_input_block(spark):
    conv = one(spark, "alpaca", "instruction string, input string, output string", ("Say hi", " \n", "Hi!"))
    assert texts(conv)[0] == ("user", "Say hi")


def test_gsm8k_parts(spark):
    conv = one(spark, "gsm8k", "question string, answer string", ("q ", "x <<12/60=0.2>>y\n#### 10"))
    assert [(p.type, p.text) for p in conv.parts] == [
        ("text", "x "), ("python", "12/60"), ("python_output", "0.2"), ("text", "y\n#### 10")]
    assert conv.messages[0].content.endswith("#### <number>.")


def test_xlam(spark):
    tools = json.dumps([{"name": "get_time", "description": "d", "parameters": {}}])
    answers = json.dumps([{"name": "get_time", "arguments": {"location": "NYC"}}])
    ddl = "query string, tools string, answers string"
    conv = one(spark, "xlam", ddl, ("time?", tools, answers))
    assert json.loads(conv.messages[-1].content)[0]["name"] == "get_time"
    assert [m.role for m in conv.messages] == ["system", "user", "assistant"]
    assert one(spark, "xlam", ddl, ("time?", tools, "[]")) is None


def test_tool_calls(spark):
    ddl = "query string, tools string, answers string, needs_tool boolean"
    tool = json.dumps({"tools": [{"type": "function", "function": {"name": "f", "parameters": "{\"type\": \"object\"}"}}]})
    conv = one(spark, "apigen", ddl, ("q", tool, '{"name": "f", "arguments": "{\\"a\\": 1}"}', True))
    assert json.loads(conv.messages[-1].content) == [{"name": "f", "arguments": {"a": 1}}]
    assert '"name":"f"' in conv.messages[0].content
    conv = one(spark, "apigen", ddl, ("q", tool, '{"name": "f"}', False))
    assert conv.messages[-1].content == "[]"
    assert one(spark, "apigen", ddl, ("q", "[]", '{"name": "f"}', True)) is None


@pytest.mark.parametrize("raw, want", [
    ('"none"', []), ('"free text"', None), ('[]', []), ('{"x": 1}', None),
    ('[{"name": "f", "input": "y"}, {"no": 1}]', [{"name": "f", "arguments": {"value": "y"}}]),
    ('{"tool_calls": [{"api_name": "f", "params": [1]}]}', [{"name": "f", "arguments": {"args": [1]}}]),
    ('"[{\\"name\\": \\"f\\"}]"', [{"name": "f", "arguments": {}}]),
])
def test_call_list(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "r string").select(F.parse_json("r").alias("v"))
    got = df.select(F.to_json(tl.call_list(F.col("v"))).alias("c")).first().c
    assert (json.loads(got) if got is not None else None) == want


TRUTH = [{"f": {"x": [1, "one"], "unit": ["", "m"]}}, {"g": {"name": "A"}}]


@pytest.mark.parametrize("response, want", [
    ([{"name": "g", "arguments": {"name": "A"}}, {"name": "f", "arguments": {"x": "1.0"}}], True),
    ([{"name": "f", "arguments": {"x": 1, "unit": "m", "more": 3}}, {"function": "g", "arguments": '{"name": "A"}'}], True),
    ([{"name": "f", "arguments": {"x": 2}}, {"name": "g", "arguments": {"name": "A"}}], False),
    ([{"name": "f", "arguments": {}}, {"name": "g", "arguments": {"name": "A"}}], False),
    ([{"name": "f", "arguments": {"x": 1, "unit": "km"}}, {"name": "g", "arguments": {"name": "A"}}], False),
    ([{"name": "g", "arguments": {"name": "A"}}, {"name": "g", "arguments": {"name": "A"}}], False),
    ([{"name": "f", "arguments": {"x": 1}}], False), ([{"arguments": {}}], False), ({"name": "f"}, False),
])
def test_call_match(spark, response, want):
    df = spark.createDataFrame([("i", json.dumps(TRUTH), json.dumps(response))], "id string, gt string, r string")
    items = df.select("id", F.parse_json(F.lit('"q"')).alias("question"), F.parse_json(F.lit("[]")).alias("function"),
                      F.parse_json("gt").alias("ground_truth"), "r")
    built = tl.build_expected_calls(items).join(df, "id")
    assert built.select(g.call_match("expected", "r").alias("ok")).first().ok is want


def test_expected_calls_per_turn(spark):
    q = '[[{"role": "user", "content": "one"}, {"role": "user", "content": "more"}], [{"role": "user", "content": "two"}], [{"role":"user","content":"three"}]]'
    rows = [("nested", q, '[[{"f": {"a": 1}}], [{"g": {}}]]'), ("flat", q, '["mod.f(a=\'x\', b=2)"]'), ("none", q, "null"), ("odd", q, '["f(a=[1])"]'), ("bad", q, '["f(a=g(1))"]')]
    df = spark.createDataFrame(rows, "id string, q string, gt string").select(
        "id", F.parse_json("q").alias("question"), F.parse_json(F.lit("[]")).alias("function"), F.parse_json("gt").alias("ground_truth"))
    out = {r.id: r for r in tl.build_expected_calls(df).collect()}
    answers = lambda i: [m.content for m in out[i].messages if m.role == "assistant"]
    assert [m.content for m in out["nested"].messages if m.role == "user"] == ["one\n\nmore", "two", "three"]
    assert answers("nested") == ['[{"name":"f","arguments":{"a":1}}]', '[{"name":"g","arguments":{}}]', "[]"]
    assert answers("flat") == ["[]", "[]", '[{"name":"mod.f","arguments":{"a":"x","b":2}}]']
    assert out["nested"].expected is None and out["none"].expected is None
    assert out["odd"].expected[0].arguments == {"a": ["j:[1]"]} and answers("odd")[2] == '[{"name":"f","arguments":{"a":[1]}}]'
    assert out["bad"].expected[0].name is None and answers("bad")[2] == "[]"
    assert out["flat"].expected[0].arguments == {"a": ["s:x"], "b": ["n:2"]}


@pytest.mark.parametrize("text, want", [
    ("f()", {"f": {}}), ("f(5)", {"f": {"_args": [[5]]}}), ("a.b(1, 'x', k=2)", {"a.b": {"_args": [[1, "x"]], "k": [2]}}),
    ("f(a=[1, [2.5, 'it\\'s']], b={'k': None, 'l': True})", {"f": {"a": [[1, [2.5, "it's"]]], "b": [{"k": None, "l": True}]}}),
    ("f(a=1e3, b=-.5, c=+2., d='say \"x\"')", {"f": {"a": [1000.0], "b": [-0.5], "c": [2], "d": ['say "x"']}}),
    ("f(a=(1, 2))", {"f": {"a": [[1, 2]]}}), ("f(a=1,)", {"f": {"a": [1]}}), ("f(a=)", None), ("f(a=g(1))", None), ("f(x)", None),
    ("f(a=1, 2)", None), ("f(a=b=1)", None), ("no call", None), ("f(a=1", None),
])
def test_call_text(spark, text, want):
    got = value(spark, tl.parse_call_text(F.col("t")), t=text)
    assert (None if got is None else json.loads(got)) == want


@pytest.mark.parametrize("truth, want", [('["f(a=[1, 2])"]', False), ('["f(5)"]', False), ('["f(a=1e3)"]', False), ('["f(a=g(1))"]', None), ("null", True)])
def test_unread_truth_is_no_success(spark, truth, want):
    df = spark.createDataFrame([("i", truth, '[{"name": "zzz", "arguments": {}}]')], "id string, gt string, r string")
    items = df.select("id", F.parse_json(F.lit('"q"')).alias("question"), F.parse_json(F.lit("[]")).alias("function"), F.parse_json("gt").alias("ground_truth"))
    assert tl.build_expected_calls(items).join(df, "id").select(g.call_match("expected", "r").alias("ok")).first().ok is want


@pytest.mark.parametrize("name", ["p21_expected_calls", "g8_call_match"])
def test_calls_of_a_small_file_are_read_by_many_tasks(spark, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_whole_numbers_compare_exactly(spark):
    c = lambda t: value(spark, tl.canonical(F.parse_json("t")), t=t)
    assert c("12345678901234567") != c("12345678901234568") and c("5") == c("5.0") == c('"5"') == c('" 5.0 "') == c("5e0")
    assert c("true") == c("1") and c('"1e3"') == "s:1e3" and c("1.5") == c('"1.5"') and c("1000") == c("1e3")


def test_flat_tool_columns(spark):
    df = spark.createDataFrame([("t", '{"k": 1}', "text"), (None, "x", None)], "tool_name string, arguments string, schema string")
    rows = df.select(tl.normalize_calls(df).alias("c"), tl.normalize_tools(df.drop("arguments")).alias("t")).collect()
    assert [(c.name, str(c.arguments)) for c in rows[0].c] == [("t", '{"k":1}')] and rows[1].c is None
    assert json.loads(str(rows[0].t[0].parameters)) == {"type": "object", "properties": {"value": {"type": "string"}}} and rows[1].t is None


def test_option_column_is_chosen_for_each_row(spark):
    df = spark.createDataFrame([(["a", "b"], None), (None, (["c", "d"], ["1", "2"]))], "options array<string>, choices struct<text:array<string>,label:array<string>>")
    options, labels = ch.extract_options(df)
    assert [tuple(r) for r in df.select(options, labels).collect()] == [(["a", "b"], None), (["c", "d"], ["1", "2"])]


def test_other_names_of_sets_reach_the_set_rules(spark):
    df = spark.createDataFrame([("two?", "one <<1+1=2>> #### 2")], "question string, answer string")
    content = lambda name, **kw: ad.to_conversations(df, name, **kw).first().messages[0].content
    assert content("openai/gsm8k") == content("gsm8k", registry="sets") == "two?"
    assert content("gsm8k") != "two?"
    code = spark.createDataFrame([("p", "c")], "prompt string, completion string")
    assert ad.to_conversations(code, "google-research-datasets/mbpp").first().messages[1].content == "c"
    names = set(ad.SET_ALIASES.values())
    assert all(ad.SET_ALIASES[a] in ad.SETS or ad.SET_ALIASES[a] == "oasst1" for a in ad.SET_ALIASES) and names

def value(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("fn, ref, res, want", [
    (g.number_match, "none", "nothing", True), (g.number_match, "#### 5", "#### 5.", False),
    (g.number_match, "#### 1,234", "it is 1,234", True), (g.number_match_strict, "none", "nothing", False),
    (lambda a, b: g.number_match(a, b, False), "#### 7", "it is 7", False),
    (g.numeric_match, "3.0", "so 3", True), (g.letter_match, "B", "I think B", False), (g.letter_match, "(b)", "B is right", True),
    (g.letter_match, "AB", "A", False), (g.boxed_match, r"\\boxed{2}", r"Answer: \\boxed{2}", True), (g.boxed_match, r"\boxed{\frac{1}{2}}", r"\boxed{\frac{1}{3}}", True),
    (g.boxed_match, "x", " x ", True), (g.integer_match, "042", r"\framebox{ 42 }", True), (g.integer_match, "42", "none", False),
    (g.flexible_match, "x+y", "$ x + y $", True), (g.flexible_match, "5", "5.0", True),
    (g.exact_match, "Hello  World", " hello world\n", True), (g.yes_no_match, "no", "It is FALSE", True), (g.yes_no_match, "yes", " ", False),
    (g.text_match, "a", "a\n", True), (g.text_upper_match, "b", " B ", True),
])
def test_grader(spark, fn, ref, res, want):
    assert value(spark, fn("ref", "res"), ref=ref, res=res) is want


@pytest.mark.parametrize("text, want", [("{}", True), (" [1, 2] ", True), ("{} x", False), ("1,2", False), ("", False), ("nope", False), ('{"a": 1} {"b": 2}', False)])
def test_json_valid(spark, text, want):
    assert value(spark, g.json_valid("t"), t=text) is want


def test_letter_outside_the_choices_is_an_error(spark):
    df = spark.createDataFrame([("A", "Z", ["A", "B"])], "ref string, res string, letters array<string>")
    with pytest.raises(Exception, match="not among the letters"):
        df.select(g.letter_exact("ref", "res", "letters")).collect()


P3 = "One two.\n\nThe second! Is here?\n \nthird"


@pytest.mark.parametrize("kind, args, text, want", [
    ("detectable_format:number_highlighted_sections", {"num_highlights": 2}, "a **b** and *c*", True),
    ("detectable_content:number_placeholders", {"num_placeholders": 2}, "[a] [b] [c]", True),
    ("detectable_content:number_placeholders", {}, "[a]", False),
    ("combination:repeat_prompt", {"prompt_to_repeat": "Do it."}, "Do it. Done", True),
    ("combination:repeat_prompt", {}, "PROMPT", False), ("combination:repeat_prompt", {}, "PROMPT ok", True),
    ("detectable_format:title", {}, "<<T>> x", True), ("detectable_format:number_bullet_lists", {"num_bullets": 2}, "* a\n  * b\n- c", True),
    ("change_case:english_lowercase", {}, "abc 1", True), ("change_case:english_capital", {}, "ABC é", True), ("change_case:english_capital", {}, "123", False),
    ("detectable_format:multiple_sections", {"section_spliter": "Section", "num_sections": 2}, "section 1 a Section 2 b sections", True),
    ("change_case:capital_word_frequency", {"capital_relation": "less than", "capital_frequency": 2}, "AB c D1 É", True),
    ("startend:quotation", {}, ' "x" ', True), ("startend:quotation", {}, '"', False),
    ("keywords:existence", {"keywords": ["cat", "big dog"]}, "Cat and a BIG DOGs", True), ("keywords:existence", {"keywords": ["cat"]}, "cats", False),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 3}, P3, True), ("length_constraints:number_sentences", {"relation": "exactly", "num_sentences": 4}, P3, True),
    ("length_constraints:nth_paragraph_first_word", {"first_word": "THE", "num_paragraphs": 3, "nth_paragraph": 2}, P3, True),
    ("detectable_format:json_format", {}, ' {"a": [1]} ', True), ("detectable_format:json_format", {}, "{} x", False), ("detectable_format:json_format", {}, "3", False),
    ("combination:two_responses", {}, "a ****** b", True), ("combination:two_responses", {}, "a ******", False),
    ("language:response_language", {"language": "hi"}, "नमस्ते 1", True), ("language:response_language", {"language": "hi"}, "नमस्ते x", False),
    ("language:response_language", {"language": "fr"}, "oui", False), ("language:response_language", {"language": "en"}, "oui", True),
    ("keywords:letter_frequency", {"let_relation": "at least", "letter": "É", "let_frequency": 2}, "éÉ", True),
    ("keywords:letter_frequency", {"let_relation": "fewer than", "letter": "#", "let_frequency": 2}, "# a", True),
    ("startend:end_checker", {"end_phrase": "bye"}, 'so "bye" ', True), ("keywords:forbidden_words", {}, "x", True),
    ("keywords:forbidden_words", {"forbidden_words": ["x"]}, "X", False), ("keywords:frequency", {"keyword": "a.b", "frequency": 1}, "a.b axb", True),
    ("length_constraints:number_words", {"relation": "odd", "num_words": 1}, "a", False), ("detectable_content:postscript", {"postscript_marker": "P.S."}, "x\n p.s. y", True),
    ("punctuation:no_comma", {}, "a, b", False), ("made:up", {}, "x", False),
])
def test_constraint(spark, kind, args, text, want):
    responses = spark.createDataFrame([(1, 1, text)], "item_id int, sample_no int, text string")
    items = spark.createDataFrame([(1, "PROMPT", [kind], [json.dumps(args)])], "item_id int, prompt string, instruction_ids array<string>, kwargs array<string>")
    assert ins.constraint_results(responses, items).first().is_met is want


def test_unknown_role_fails_in_strict_mode(spark):
    turns = spark.createDataFrame([(1, 0, "narrator", "x")], "conv_id int, turn int, role string, text string")
    assert t.map_roles(turns).first().role == "user"
    with pytest.raises(Exception, match="Unknown role"):
        t.map_roles(turns, strict=True).collect()


def test_programs_with_assertions(spark):
    responses = spark.createDataFrame([(1, "```\nx = 1\n```"), (2, "y")], "item_id int, text string")
    tasks = spark.createDataFrame([(1, "import z", [" assert x ", ""], ["assert 1"]), (2, None, [], None)],
                                  "item_id int, test_setup_code string, test_list array<string>, challenge_test_list array<string>")
    out = {r.item_id: r.program for r in t.assemble_programs(responses, tasks, "asserts").collect()}
    assert out == {1: "x = 1\n\nimport z\n\nassert x\nassert 1\n", 2: None}


def test_mixed_eval_types(spark):
    rows = spark.range(2).withColumnRenamed("id", "idx")
    a, b = mx.Task("a", rows), mx.Task("b", rows, "categorical")
    assert mx.eval_type([a, a]) == "generative"
    with pytest.raises(ValueError, match="eval_type"):
        mx.eval_type([a, b])


def test_slice_view(spark):
    base = spark.range(20).select(F.col("id").alias("idx"), (F.col("id") * 3).alias("v"))
    view = {r.idx: r.v for r in mx.slice_task(base, 5, 10).collect()}
    assert len(view) == 5 and view[0] == 15
    with pytest.raises(ValueError):
        mx.slice_task(base, 5, 4)


def test_fewshot_on_small_tables(spark):
    out = mx.sample_fewshot(spark.range(3).withColumnRenamed("id", "k"), 10, ["k"]).collect()
    assert len(out) == 6 and all(r.k != r.item_k for r in out)
    assert mx.sample_fewshot(spark.range(1).withColumnRenamed("id", "k"), 2, ["k"]).count() == 0


def test_fewshot_draws_are_uniform_and_independent(spark):
    """Every item gets k different others; all others are drawn equally often, and neighbours share as many as chance has it."""
    n, k = 60, 5
    drawn = {}
    for seed in range(12):
        for r in mx.sample_fewshot(spark.range(n).withColumnRenamed("id", "k"), k, ["k"], seed).collect():
            drawn.setdefault((seed, r.item_k), []).append(r.k)
    assert len(drawn) == 12 * n and all(len(set(v)) == k and i not in v for (_, i), v in drawn.items())
    times = np.bincount([(x - i) % n for (_, i), v in drawn.items() for x in v], minlength=n)
    expected = 12 * n * k / (n - 1)
    assert times[0] == 0 and ((times[1:] - expected) ** 2 / expected).sum() < 1.6 * n
    shared = np.mean([len(set(v) & set(drawn[s, (i + 1) % n])) for (s, i), v in drawn.items()])
    assert shared < 2.0 * k * k / n


def test_no_valid_row(spark):
    df = spark.createDataFrame([(0, False), (1, False)], "idx bigint, ok boolean")
    with pytest.raises(ValueError):
        mx.apply_valid_policy(df, "ok", "check")
    assert mx.apply_valid_policy(df, "ok", "fill_next").filter("source_idx is not null").count() == 0


def test_registries():
    from tokenmill.plans import profiles as pr

    assert len(pr.SUBJECTS) == 57 and all(s in pr.SUBJECTS for g in pr.SUBJECT_GROUPS.values() for s in g)
    assert len(pr.CALL_COLLECTIONS["all"]) == 23
    assert pr.call_files("non_python") == {
        k: (f"BFCL_v3_{k}.json", f"possible_answer/BFCL_v3_{k}.json") for k in ("java", "javascript")}
    assert set(ad.SET_ALIASES.values()) <= set(ad.SETS) | {"oasst1"}
    for build in pr.PROFILES.values():
        for part in build():
            assert part.name in ad.ADAPTERS or part.name in ad.SETS or part.name in (
                "identity", "simple_spelling", "spelling", "bfcl")


def test_chat_composite(spark):
    from tokenmill.operators import metrics as mt

    rows = [(k, 0.5) for k in mt.CHAT_BASELINES] + [("More", 0.5)]
    df = spark.createDataFrame(rows, "task string, accuracy double")
    out = mt.chat_composite(df).first()
    assert out.composite == pytest.approx((3 * (0.25 / 0.75) + 4 * 0.5) / 7)
    assert mt.chat_composite(df.filter("task <> 'MMLU'")).first().composite is None


def test_subject_of_a_known_name(spark):
    df = spark.createDataFrame([("", "virology"), ("law", "virology"), (None, "nonsense")], "topic string, name string")
    assert [r.s for r in df.select(ad.extract_subject(df).alias("s")).collect()] == ["virology", "law", ""]
