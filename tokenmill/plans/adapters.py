"""Dataset adapters: source rows to the conversation table.

An adapter is a function from a source table to the columns of a conversation. Rows that
cannot be converted get null ``messages``; ``to_conversations`` drops and counts them or hands
them to ``apply_valid_policy``. Column names are matched by ordered aliases, and an alias that
a table lacks costs nothing. Rules that count an empty text as missing take it for a text like
any other with ``keep_empty``, where they have it; then only null is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions import messages as ms
from tokenmill.functions.text import blank, extract, factoid, lone_letter, present, rstrip, strict_json, strip
from tokenmill.operators import choices as ch
from tokenmill.operators import tools as tl
from tokenmill.operators.turns import filter_english, first_of
from tokenmill.plans.profiles import SUBJECTS

PARTS = "array<struct<type:string,text:string>>"
SUBJECT_KEYS = (
    "subject", "subj", "topic", "category", "domain", "field", "task", "task_name", "subject_name",
)

# Prompt texts of the tasks.
GSM_TAIL = "\n\nProvide the final answer on a separate line in the format: #### <number>."
BOX_TAIL = "\n\nProvide the final answer in the form \\boxed{...}."
INTEGER_TAIL = "\n\nProvide the final answer as an integer between 0 and 999."
LETTER_TAIL = "\n\nRespond only with the letter of the correct answer."
EXACT_TAIL = "\n\nRespond with the exact answer only."
PHRASE_TAIL = "\n\nAnswer with a short phrase only. No explanation."
YES_NO_TAIL = "\n\nAnswer yes or no."
CONTINUATION = (
    "Choose the best continuation for the following context.\n\nContext: {0}\n\n"
    "Which option is the most likely next text?"
)


@dataclass
class Row:
    """Columns of a conversation; what an adapter leaves out stays null."""

    messages: Column
    letters: Column | None = None
    parts: Column | None = None
    answer: Column | None = None
    subject: Column | None = None
    meta: dict[str, Column] = field(default_factory=dict)


Adapter = Callable[[DataFrame], Row]


def need(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def text(df: DataFrame, name: str) -> Column:
    """A column as text, '' when the table lacks it or it is null."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in df.columns else F.lit("")


def raw(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def first_text(df: DataFrame, *aliases: str, keep_empty: bool = False) -> Column:
    """``first_of``, or with ``keep_empty`` an empty text where no alias is filled."""
    empty = [raw(df, a) for a in aliases if a in df.columns] if keep_empty else []
    return F.coalesce(first_of(df, *aliases), *empty)


def with_question(context: Column, question: Column) -> Column:
    """Question below its context, when there is one."""
    return F.when(blank(context), question).otherwise(
        F.concat(context, F.lit("\n\nQuestion: "), question)
    )


def multiple_choice(question: Column, options: Column, answer: Column, labels: Column | None = None) -> Row:
    """Prompt with lettered options; the answer is resolved to a letter."""
    plain = ch.letters_for(options)
    given = F.transform(labels, lambda x: F.upper(strip(x))) if labels is not None else plain
    letters = F.when(F.size(given) > 0, given).otherwise(plain) if labels is not None else plain
    letter = ch.resolve_answer(answer, letters, options)
    usable = F.size(options) > 0
    return Row(ms.pair(need(usable, ch.render_mc(question, letters, options)), letter), letters)


def known_letter(question: Column, letters: Column, options: Column, letter: Column) -> Row:
    """Prompt with lettered options whose answer letter is known."""
    return Row(ms.pair(ch.render_mc(question, letters, options), letter), letters)


# ---- benchmark tasks ---------------------------------------------------------------------

def extract_subject(df: DataFrame, known: Sequence[str] = SUBJECTS) -> Column:
    """Subject from the first filled subject column, else from a name column with a known subject."""
    named = [F.nullif(strip(F.col(k)), F.lit("")) for k in SUBJECT_KEYS if k in df.columns]
    listed = [
        F.when(strip(F.col(k)).isin(*known), strip(F.col(k)))
        for k in ("name", "group", "dataset") if known and k in df.columns
    ]
    return F.coalesce(*named, *listed, F.lit(""))


def unwrap_struct(df: DataFrame, struct: str = "train") -> DataFrame:
    """Columns of a wrapping struct; a subject outside it is kept when it has none itself."""
    inner = df.schema[struct].dataType.fieldNames()
    extra = []
    if "subject" not in inner:
        outside = [present(F.col(k)) for k in ("subject", "subj", "topic", "category") if k in df.columns]
        if outside:
            extra = [F.coalesce(*outside).alias("subject")]
    others = [c for c in df.columns if c != struct and c not in inner and c not in ("subject", "subj", "topic", "category")]
    return df.select(*others, f"{struct}.*", *extra)


def mmlu(df: DataFrame) -> Row:
    options = F.col("choices").cast("array<string>")
    letters = ch.letters_for(options)
    row = known_letter(F.col("question"), letters, options, ch.at(letters, F.col("answer")))
    row.messages = need(F.size(options) == 4, row.messages)
    row.subject = extract_subject(df)
    return row


def mmlu_pro(df: DataFrame) -> Row:
    options = F.col("options").cast("array<string>")
    letters = ch.letters_for(options)
    row = known_letter(F.col("question"), letters, options, ch.at(letters, F.col("answer_index").cast("int")))
    row.messages = need(F.size(options).between(2, 26), row.messages)
    row.subject = raw(df, "category")
    return row


def arc(df: DataFrame) -> Row:
    labels = F.col("choices.label").cast("array<string>")
    key = F.col("answerKey")
    return known_letter(F.col("question"), labels, F.col("choices.text").cast("array<string>"),
                        need(F.array_contains(labels, key), key))


def _shuffled(question: Column, options: Column, key: Column, gold) -> Row:
    mixed, place = ch.shuffle_choices(options, key, gold)
    letters = ch.letters_for(mixed)
    row = known_letter(question, letters, mixed, ch.at(letters, place))
    return row


def hellaswag(df: DataFrame) -> Row:
    before, after = CONTINUATION.split("{0}")
    question = F.concat(F.lit(before), F.col("ctx"), F.lit(after))
    options = F.col("endings").cast("array<string>")
    row = _shuffled(question, options, F.col("ctx"), F.col("label").cast("int"))
    row.messages = need((F.size(options) == 4) & F.col("label").cast("int").between(0, 3), row.messages)
    return row


def gpqa(df: DataFrame) -> Row:
    options = F.array("`Correct Answer`", *[f"`Incorrect Answer {i}`" for i in (1, 2, 3)])
    return _shuffled(F.col("Question"), options, F.col("Question"), 0)


def sciq(df: DataFrame) -> Row:
    others = F.filter(F.array(*[raw(df, f"distractor{i}") for i in (1, 2, 3)]),
                      lambda d: F.coalesce(d, F.lit("")) != "")
    options = F.concat(F.array(F.col("correct_answer")), others)
    key = F.concat_ws("||", "question", "correct_answer")
    row = _shuffled(F.col("question"), options, key, 0)
    row.messages = need(present("question").isNotNull() & F.col("correct_answer").isNotNull(), row.messages)
    return row


def openbookqa(df: DataFrame) -> Row:
    question = first_of(df, "question_stem", "question")
    key = first_of(df, "answerKey", "answer", "label")
    kind = df.schema["choices"].dataType
    if isinstance(kind, T.StructType):
        labels, texts = F.col("choices.label"), F.col("choices.text")
    else:
        ordered = F.array_sort(F.transform("choices", lambda c: F.struct(c["label"].alias("l"), c["text"].alias("t"))))
        labels, texts = F.transform(ordered, lambda o: o["l"]), F.transform(ordered, lambda o: o["t"])
    by_number = ch.at(labels, F.when(key.rlike(r"^\d+$"), key.try_cast("int")) - 1)
    letter = F.when(F.array_contains(labels, key), key).otherwise(by_number)
    return known_letter(question, labels, texts, letter)


# ---- math, code, factoid -----------------------------------------------------------------

CALL_MARK = r"<<[^>]+>>"


def split_tool_calls(answer: Column) -> Column:
    """Parts of an answer with ``<<expression=result>>`` marks; the last ``=`` separates."""
    texts = F.split(answer, CALL_MARK)
    calls = F.regexp_extract_all(answer, F.lit(CALL_MARK), F.lit(0))
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))

    def call(c):
        inner = F.substring(c, F.lit(3), F.length(c) - 4)
        split = F.contains(inner, F.lit("="))
        return F.array(
            part("python", F.when(split, F.regexp_extract(inner, r"(?s)^(.*)=", 1)).otherwise(inner)),
            part("python_output", F.when(split, F.regexp_extract(inner, r"(?s)=([^=]*)$", 1)).otherwise("")),
        )

    return F.flatten(F.transform(texts, lambda t, i: F.concat(
        F.array(part("text", t)),
        F.when(i < F.size(calls), call(F.get(calls, i))).otherwise(F.array().cast(PARTS)),
    ))).cast(PARTS)


def gsm8k(df: DataFrame) -> Row:
    parts = split_tool_calls(F.col("answer"))
    flat = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    return Row(ms.pair(F.concat(rstrip("question"), F.lit(GSM_TAIL)), flat), parts=parts)


def hendrycks_math(df: DataFrame) -> Row:
    return Row(ms.pair(F.concat(rstrip("problem"), F.lit(BOX_TAIL)), F.col("solution")), subject=raw(df, "type"))


def aime(df: DataFrame) -> Row:
    solution = F.coalesce(first_of(df, "solution", "answer"), F.lit(""))
    return Row(
        ms.pair(F.concat(rstrip("problem"), F.lit(INTEGER_TAIL)), solution), answer=raw(df, "answer"),
        meta={k: raw(df, k) for k in ("id", "url", "year")},
    )


def hle(df: DataFrame) -> Row:
    choice = F.col("answer_type") == "multipleChoice"
    question = F.concat("question", F.when(choice, LETTER_TAIL).otherwise(EXACT_TAIL))
    return Row(
        ms.pair(question, F.col("answer")), answer=F.when(choice, F.upper(strip("answer"))),
        meta={"answer_type": F.col("answer_type")},
    )


def triviaqa(df: DataFrame) -> Row:
    fields = df.schema["answer"].dataType.fieldNames()
    value = F.coalesce("answer.value", F.lit(""))
    norm = present("answer.normalized_value") if "normalized_value" in fields else F.lit(None).cast("string")
    fallback = F.array(factoid(F.coalesce(norm, value)))
    aliases = F.col("answer.normalized_aliases") if "normalized_aliases" in fields else None
    known = fallback if aliases is None else F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) > 0, aliases).otherwise(fallback)
    return Row(ms.pair(F.concat(rstrip("question"), F.lit(PHRASE_TAIL)), value), meta={"aliases": F.to_json(known)})


def mbpp(df: DataFrame) -> Row:
    meta = {k: F.to_json(k) if k in df.columns else F.lit("[]") for k in ("test_list", "challenge_test_list")}
    return Row(ms.pair(F.col("text"), F.col("code")), meta={"test_setup_code": text(df, "test_setup_code"), **meta})


def humaneval(df: DataFrame) -> Row:
    return Row(
        ms.pair(F.col("prompt"), F.concat("prompt", F.lit("\n"), "canonical_solution")),
        meta={"entry_point": F.col("entry_point"), "test": F.col("test")},
    )


def ifeval(df: DataFrame) -> Row:
    return Row(ms.pair(F.col("prompt"), F.lit("")), meta={
        "key": raw(df, "key"), "instruction_id_list": F.to_json("instruction_id_list"), "kwargs": F.to_json("kwargs")})


# ---- instruction and reasoning sets --------------------------------------------------------

def alpaca(df: DataFrame) -> Row:
    extra = text(df, "input")
    user = F.when(blank(extra), F.col("instruction")).otherwise(
        F.concat("instruction", F.lit("\n\nInput:\n"), extra))
    return Row(ms.pair(user, F.col("output")))


def code_bagel(df: DataFrame) -> Row:
    extra = text(df, "input")
    user = F.when(blank(extra), text(df, "instruction")).otherwise(
        F.concat(text(df, "instruction"), F.lit("\n\nInput:\n"), extra))
    return Row(ms.pair(user, text(df, "output")))


def question_response(df: DataFrame) -> Row:
    return Row(ms.pair(text(df, "question"), text(df, "response")))


def open_math_instruct(df: DataFrame, keep_empty: bool = False) -> Row:
    solution, expected = strip(text(df, "generated_solution")), strip(text(df, "expected_answer"))
    missing = (expected != "") & ~F.contains(solution, expected)
    unsolved = raw(df, "generated_solution").isNull() if keep_empty else solution == ""
    answer = F.when(~missing, solution).when(unsolved, expected).otherwise(
        F.concat(solution, F.lit("\n\nFinal answer: "), expected))
    return Row(ms.pair(F.col("problem"), answer))


def numina_math(df: DataFrame, keep_empty: bool = False) -> Row:
    right = F.coalesce(F.col("correct").cast("boolean"), F.lit(False))
    response = first_text(df, "response", keep_empty=keep_empty)
    answer = F.when(right & response.isNotNull(), response).otherwise(text(df, "ground_truth"))
    return Row(ms.pair(text(df, "prompt"), answer), answer=text(df, "ground_truth"), meta={"correct": right.cast("string")})


def natural_reasoning(df: DataFrame) -> Row:
    first = F.get("responses", F.lit(0))["response"] if "responses" in df.columns else F.lit(None).cast("string")
    return Row(ms.pair(text(df, "question"), F.coalesce(present(text(df, "reference_answer")), first, F.lit(""))))


def skunkworks(df: DataFrame, keep_empty: bool = False) -> Row:
    filled = lambda c: c if keep_empty else present(c)
    answer = F.concat_ws("\n\n", filled(strip(raw(df, "reasoning"))), filled(strip(raw(df, "output"))))
    return Row(ms.pair(F.col("instruction"), answer))


def share_style(df: DataFrame) -> Row:
    """``conversations`` of from / value pairs, neighbours of one role joined."""
    m = ms.merged(ms.mapped("conversations", "from", "value", strict=True))
    return Row(need(ms.alternates(m), m))


def magpie(df: DataFrame) -> Row:
    single = ms.pair(text(df, "instruction"), text(df, "response"))
    if "conversations" not in df.columns:
        return Row(single)
    empty = F.coalesce(F.size("conversations"), F.lit(0)) < 1
    return Row(F.when(empty, single).otherwise(share_style(df).messages))


def smoltalk(df: DataFrame) -> Row:
    m = ms.mapped("messages", "role", "content", strict=True)
    return Row(need(ms.alternates(m, min_dialog=2), m))


def custom_json(df: DataFrame) -> Row:
    m = F.col("messages").cast(ms.MESSAGES)
    return Row(need(ms.alternates(m, min_dialog=2, system=False), m))


def chat_messages(df: DataFrame) -> Row:
    """A message list under one of three names, with role / content or from / value."""
    found = []
    for name in ("messages", "conversation", "conversations"):
        if name not in df.columns:
            continue
        fields = df.schema[name].dataType.elementType.fieldNames()
        if "from" in fields:
            m = ms.merged(ms.mapped(name, "from", "value", strict=True))
        else:
            m = ms.mapped(name, "role", "content", strict=False)
        found.append(F.when(F.col(f"`{name}`").isNotNull(), ms.trimmed(m)))
    if not found:
        return Row(F.lit(None).cast(ms.MESSAGES))
    m = F.coalesce(*found)
    return Row(need(ms.alternates(m, end_assistant=True), m))


def hh_rlhf(df: DataFrame) -> Row:
    """Transcript of ``Human:`` and ``Assistant:`` paragraphs."""
    chunks = F.split(strip(first_of(df, "chosen", "response", "text")), r"\n\n(?=Human:|Assistant:)")
    label = lambda c: F.regexp_extract(c, r"^(Human|Assistant):", 1)
    m = F.transform(F.filter(chunks, lambda c: label(c) != ""), lambda c: F.struct(
        F.when(label(c) == "Human", "user").otherwise("assistant").alias("role"),
        strip(F.regexp_replace(c, r"^(Human|Assistant):", "")).alias("content"))).cast(ms.MESSAGES)
    m = ms.trimmed(m)
    return Row(need(ms.alternates(m, end_assistant=True), m))


def xlam(df: DataFrame) -> Row:
    tools = strict_json("tools").try_cast("array<variant>")
    answers = strict_json("answers").try_cast("array<variant>")
    ok = tools.isNotNull() & (F.size(answers) >= 1)
    listed = F.transform(tools, tl.normalize_tool)
    prompt = F.concat(F.lit(tl.TOOLS_HEAD), F.to_json(tools), F.lit("\n\n" + tl.TOOLS_TAIL))
    return Row(need(ok, ms.pair(F.col("query"), F.to_json(answers), system=prompt)),
               meta={"tool_names": F.array_join(F.transform(listed, lambda t: t["name"]), ",")})


def tool_calls(df: DataFrame, distractors: int = 0, use_system: bool = True, force_no_tool: bool = False) -> Row:
    tools = tl.normalize_tools(df)
    none = F.array().cast(f"array<{tl.CALL}>")
    calls = none if force_no_tool else tl.normalize_calls(df)
    query = tl.query_of(df)
    shown = tl.augment_tools(tools, tl.default_tools(), distractors)
    ok = ~blank(query) & tools.isNotNull() & calls.isNotNull()
    return Row(need(ok, tl.tool_conversation(shown, query, calls, use_system)))


# ---- rows of the wider question sets ---------------------------------------------------------

def gsm8k_like(df: DataFrame) -> Row:
    return Row(ms.pair(first_of(df, "question", "Question", "prompt", "problem", "query"),
                       first_of(df, "answer", "Answer", "solution", "output", "response")))


def svamp(df: DataFrame) -> Row:
    body = first_of(df, "Body", "body", "context")
    question = first_of(df, "Question", "question", "query", "prompt", "problem")
    chain = first_of(df, "chain", "solution", "rationale")
    answer = F.coalesce(first_of(df, "Answer", "answer", "label", "result", "result_float"),
                        strip(extract(chain, r"<result>([^<]+)</result>")))
    user = F.when(body.isNull(), question).otherwise(F.concat(strip(body), F.lit(" "), strip(question)))
    return Row(ms.pair(user, answer))


def math_qa(df: DataFrame) -> Row:
    problem = first_of(df, "Problem", "problem", "question", "query", "prompt")
    answer = first_of(df, "correct", "Correct", "answer", "label")
    options, _ = ch.extract_options(df, ("options", "Options", "choices"))
    if options is None:
        return Row(ms.pair(problem, answer))
    options = F.coalesce(options, F.array().cast("array<string>"))
    letters = ch.letters_for(options)
    lettered = ms.pair(ch.render_mc(problem, letters, options), F.upper(strip(answer)))
    some = F.size(options) > 0
    return Row(F.when(some, lettered).otherwise(ms.pair(problem, answer)), need(some, letters))


def commonsense_qa(df: DataFrame) -> Row:
    options = F.col("choices.text").cast("array<string>")
    names = F.col("choices.label").cast("array<string>")
    labels = F.when(F.size(names) > 0, names).otherwise(ch.letters_for(options))
    row = known_letter(first_of(df, "question", "prompt", "query"), labels, options, lone_letter("answerKey"))
    row.messages = need(F.size(options) > 0, row.messages)
    return row


def _fixed_letters(question: Column, options: Sequence[Column], letter_at: Column) -> Row:
    values = F.array(*options)
    letters = ch.letters_for(values)
    row = known_letter(question, letters, values, ch.at(letters, letter_at))
    row.messages = need(F.forall(values, lambda v: v.isNotNull()), row.messages)
    return row


def piqa(df: DataFrame) -> Row:
    label = first_of(df, "label", "answer").try_cast("int")
    return _fixed_letters(first_of(df, "goal", "question", "prompt"), [
        first_of(df, "sol1", "option1", "choice1"), first_of(df, "sol2", "option2", "choice2")], label)


def winogrande(df: DataFrame, keep_empty: bool = False) -> Row:
    """Numbered answers count from 1 here; other answers are letters."""
    answer = strip(first_of(df, "answer", "label"))
    options = F.array(first_of(df, "option1", "choice1"), first_of(df, "option2", "choice2"))
    letters = ch.letters_for(options)
    number = F.when(answer.rlike(r"^\d+$"), answer.try_cast("int"))
    letter = F.when(number.isNotNull(), ch.at(letters, number - 1)).otherwise(lone_letter(answer))
    sentence = first_text(df, "sentence", "question", "prompt", keep_empty=keep_empty)
    row = known_letter(sentence, letters, options, letter)
    row.messages = need(F.forall(options, lambda v: v.isNotNull()), row.messages)
    return row


def cosmos_qa(df: DataFrame) -> Row:
    question = with_question(first_of(df, "context", "passage", "story"), first_of(df, "question", "query", "prompt"))
    return _fixed_letters(question, [first_of(df, f"answer{i}", f"option{i}", f"choice{i}") for i in range(4)],
                          first_of(df, "label", "answer").try_cast("int"))


def boolq(df: DataFrame) -> Row:
    answer = F.lower(strip(first_of(df, "answer", "label")))
    yes = F.when(answer.isin("false", "no", "0"), "no").when(answer.isNotNull(), "yes")
    user = F.concat(first_of(df, "passage", "context"), F.lit("\n\nQuestion: "),
                    first_of(df, "question", "prompt"), F.lit(YES_NO_TAIL))
    return Row(ms.pair(user, yes))


def race(df: DataFrame) -> Row:
    options, _ = ch.extract_options(df, ("options", "choices"))
    question = F.concat(first_of(df, "article", "passage", "context"), F.lit("\n\nQuestion: "),
                        first_of(df, "question", "query", "prompt"))
    return known_letter(question, ch.letters_for(options), options, lone_letter(first_of(df, "answer", "label")))


SOCIAL_OPTIONS = ("answerA", "answerB", "answerC", "answer_a", "answer_b", "answer_c", "optionA", "optionB", "optionC")


def social_iqa(df: DataFrame, keep_empty: bool = False) -> Row:
    """Numbered labels count from 1 here, and 0 still means the first option."""
    own = F.filter(F.array(*[present(raw(df, k)) for k in SOCIAL_OPTIONS]), lambda o: o.isNotNull())
    listed, _ = ch.extract_options(df)
    options = own if listed is None else F.when(F.size(own) >= 2, own).otherwise(listed)
    answer = strip(first_of(df, "label", "answer", "correct", "answerKey"))
    number = F.when(answer.rlike(r"^-?\d+$"), answer.try_cast("int"))
    base0 = F.when(number.between(1, F.size(options)), number - 1).otherwise(number)
    asked = first_text(df, "question", "query", "prompt", keep_empty=keep_empty)
    question = with_question(first_of(df, "context", "story", "passage"), asked)
    row = multiple_choice(question, options, F.coalesce(base0.cast("string"), answer))
    row.messages = need(F.size(options) >= 2, row.messages)
    return row


def _listed(df: DataFrame, question: Column, answers: Sequence[str]) -> Row:
    options, labels = ch.extract_options(df)
    if options is None:
        return Row(F.lit(None).cast(ms.MESSAGES))
    return multiple_choice(question, options, first_of(df, *answers), labels)


def qasc(df: DataFrame) -> Row:
    return _listed(df, first_of(df, "question", "formatted_question"), ("answerKey", "answer", "label", "correct"))


def aqua_rat(df: DataFrame) -> Row:
    return _listed(df, first_of(df, "question", "problem", "prompt"),
                   ("answer_index", "correct", "label", "answer", "answerKey", "answer_text"))


def mmlu_pro_listed(df: DataFrame) -> Row:
    return _listed(df, first_of(df, "question", "prompt", "problem", "query"), ("answer_index", "answer", "label"))


def logiqa(df: DataFrame) -> Row:
    context = first_of(df, "context", "passage", "text")
    question = first_of(df, "query", "question", "prompt")
    options, labels = ch.extract_options(df)
    t_context, t_question, t_options = ch.tagged_input(first_of(df, "input", "instruction", "prompt"))
    options = t_options if options is None else F.coalesce(need(F.size(options) > 0, options), t_options)
    answer = first_of(df, "correct_option", "answer", "label", "answer_index", "expected_output", "output", "completion")
    return multiple_choice(
        with_question(F.coalesce(context, t_context), F.coalesce(question, t_question)), options, answer, labels)


def instruction(df: DataFrame, keep_empty: bool = False) -> Row:
    ask = first_text(df, "instruction", "prompt", "question", "query", keep_empty=keep_empty)
    context = first_of(df, "context", "input")
    user = F.when(blank(context), ask).otherwise(F.concat(ask, F.lit("\n\nContext:\n"), context))
    return Row(ms.pair(user, first_text(df, "output", "response", "answer", "completion", keep_empty=keep_empty)))


def prompt_completion(df: DataFrame) -> Row:
    return Row(ms.pair(
        first_of(df, "prompt", "input", "question", "instruction", "problem", "Problem", "query", "task", "text"),
        first_of(df, "completion", "output", "response", "answer", "solution", "Solution", "final", "final_answer",
                 "target", "label", "rationale", "explanation")))


def verifiable_corpus(df: DataFrame) -> Row:
    prompt = first_of(df, "problem", "question", "prompt", "input", "instruction", "description")
    about = first_of(df, "description", "context")
    user = F.when(blank(about) | F.contains(prompt, strip(about)), prompt).otherwise(
        F.concat(about, F.lit("\n\n"), prompt))
    single = ms.pair(user, first_of(df, "answer", "response", "output", "completion", "solution"))
    return Row(F.coalesce(chat_messages(df).messages, single))


def gpqa_d(df: DataFrame) -> Row:
    question = first_of(df, "Question", "question", "prompt", "problem", "query")
    options, labels = ch.extract_options(df)
    if options is not None:
        return multiple_choice(question, options, first_of(df, "answer_index", "answer", "label", "correct"), labels)
    right = first_of(df, "Correct Answer", "correct_answer", "correct", "answer")
    wrong = [F.array(*[present(raw(df, f"Incorrect Answer {i}")) for i in (1, 2, 3, 4)])]
    wrong += [F.col(k).cast("array<string>") for k in ("incorrect_answers", "distractors", "wrong_answers") if k in df.columns][:1]
    others = F.filter(F.concat(*wrong), lambda o: F.coalesce(o, F.lit("")) != "")
    row = multiple_choice(question, F.concat(F.array(right), others), F.lit("0"))
    row.messages = need(right.isNotNull() & (F.size(others) > 0), row.messages)
    return row


def math_ai(df: DataFrame) -> Row:
    question = first_of(df, "problem", "question", "prompt", "query", "instruction")
    options, labels = ch.extract_options(df)
    if options is not None:
        return multiple_choice(question, options, first_of(df, "answer", "label", "correct", "answer_index"), labels)
    solution = first_of(df, "solution", "rationale", "explanation")
    answer = first_of(df, "answer", "final_answer", "output", "response", "label")
    return Row(ms.pair(question, F.when(~blank(solution), solution).otherwise(answer)), answer=answer)


def mbpp_like(df: DataFrame) -> Row:
    return Row(ms.pair(first_of(df, "text", "prompt", "question", "instruction"),
                       first_of(df, "code", "completion", "output", "response", "answer")))


def open_orca(df: DataFrame, keep_empty: bool = False) -> Row:
    return Row(ms.pair(
        first_text(df, "question", "prompt", "instruction", "query", keep_empty=keep_empty),
        first_text(df, "response", "output", "answer", "completion", keep_empty=keep_empty), system=first_of(df, "system_prompt", "system")))


def json_mermaid(df: DataFrame) -> Row:
    return Row(ms.pair(first_of(df, "json", "input", "prompt", "instruction"),
                       first_of(df, "mermaid", "output", "response", "completion")))


ADAPTERS: dict[str, Adapter] = {
    # benchmark and chat tasks
    "mmlu": mmlu, "mmlu_subjects": mmlu, "mmlu_pro": mmlu_pro, "arc": arc, "hellaswag": hellaswag,
    "gpqa": gpqa, "sciq": sciq, "openbookqa": openbookqa, "gsm8k": gsm8k, "hendrycks_math": hendrycks_math,
    "aime": aime, "hle": hle, "triviaqa": triviaqa, "mbpp": mbpp, "humaneval": humaneval, "ifeval": ifeval,
    "smoltalk": smoltalk, "alpaca": alpaca, "code_bagel": code_bagel, "z1": question_response,
    "open_math_instruct": open_math_instruct, "numina_math": numina_math,
    "natural_reasoning": natural_reasoning, "skunkworks": skunkworks, "magpie": magpie,
    "open_thoughts": share_style, "function_calling_sharegpt": share_style, "hermes": share_style,
    "xlam": xlam, "custom_json": custom_json,
    "apigen": tool_calls, "toolbench": tool_calls, "toolalpaca": tool_calls, "api_bank": tool_calls,
    "apipack": tool_calls,
}

# The 38 sets with shared row rules, by their registry name.
SETS: dict[str, Adapter] = {
    "gsm8k": gsm8k_like, "gsm8k-platinum": gsm8k_like, "gsm8k-567": gsm8k_like, "math-augmented": gsm8k_like,
    "hendrycks-math": hendrycks_math, "hendrycks-math-benchmark": prompt_completion,
    "math_qa": math_qa, "calc-svamp": svamp, "alpaca": alpaca, "dolly-15k": instruction, "hh-rlhf": hh_rlhf,
    "lmsys-chat-1m": chat_messages, "oasst1-h2oai": instruction, "json-mermaid": json_mermaid,
    "ultrachat-200k": chat_messages, "openorca": open_orca, "sharegpt-52k": chat_messages,
    "verifiable-corpus": verifiable_corpus, "commonsense-qa": commonsense_qa, "piqa": piqa,
    "winogrande": winogrande, "cosmos-qa": cosmos_qa, "boolq": boolq, "race": race, "social-iqa": social_iqa,
    "qasc": qasc, "logiqa": logiqa, "aqua-rat-mcqa": aqua_rat, "gpqa-d": gpqa_d, "mmlu-pro": mmlu_pro_listed,
    "aime24": math_ai, "aime25": math_ai, "math500": math_ai, "amc23": math_ai, "mbpp": mbpp_like,
    "code-bagel": instruction, "z1-code-reasoning": prompt_completion,
}
# Other names of the sets.
SET_ALIASES = {
    "openai/gsm8k": "gsm8k", "madrylab/gsm8k-platinum": "gsm8k-platinum", "567-labs/gsm8k": "gsm8k-567",
    "eleutherai/hendrycks_math": "hendrycks-math", "nlile/hendrycks-math-benchmark": "hendrycks-math-benchmark",
    "allenai/math_qa": "math_qa", "regisss/math_qa": "math_qa", "mu-nlpc/calc-svamp": "calc-svamp",
    "nivektk/math-augmented-dataset": "math-augmented", "tatsu-lab/alpaca": "alpaca",
    "aisquared/databricks-dolly-15k": "dolly-15k", "databricks/databricks-dolly-15k": "dolly-15k",
    "anthropic/hh-rlhf": "hh-rlhf", "lmsys/lmsys-chat-1m": "lmsys-chat-1m", "openassistant/oasst1": "oasst1",
    "h2oai/openassistant_oasst1": "oasst1-h2oai", "mugivara1/json-mermaid": "json-mermaid",
    "moogin/json-mermaid": "json-mermaid", "huggingfaceh4/ultrachat_200k": "ultrachat-200k",
    "open-orca/openorca": "openorca", "ryokoai/sharegpt52k": "sharegpt-52k",
    "lasgroup/verifiable-corpus": "verifiable-corpus", "commonsense_qa": "commonsense-qa", "piqa": "piqa",
    "winogrande": "winogrande", "cosmos_qa": "cosmos-qa", "boolq": "boolq", "race": "race",
    "jet-ai/social_i_qa": "social-iqa", "happyeval/social_i_qa-text": "social-iqa",
    "allenai/social_i_qa": "social-iqa", "allenai/qasc": "qasc", "heka-ai/logiqa": "logiqa",
    "lucasmccabe/logiqa": "logiqa", "rikotemaster/aqua-rat-mcqa": "aqua-rat-mcqa",
    "deepmind/aqua_rat": "aqua-rat-mcqa", "idavidrein/gpqa-d": "gpqa-d", "tiger-lab/mmlu-pro": "mmlu-pro",
    "math-ai/aime24": "aime24", "math-ai/aime25": "aime25", "math-ai/math500": "math500", "math-ai/amc23": "amc23",
    "google-research-datasets/mbpp": "mbpp", "replete-ai/code_bagel": "code-bagel",
    "efficientscaling/z1-code-reasoning-107k": "z1-code-reasoning",
}
# "oasst1" is a join of messages with their parents: operators.turns.pair_messages.


def to_conversations(
    df: DataFrame, adapter: str | Adapter, keep: Sequence[str] = (), english_only: bool = False,
    on_invalid: str = "drop", registry: str | None = None,
) -> DataFrame:
    """``(keep..., messages, letters, parts, answer, subject, meta)``.

    ``adapter`` is a name or a function. Other names of sets (``SET_ALIASES``) mean the set's rule;
    a plain name that both registries have means the task's, unless ``registry`` says ``"sets"``. ``on_invalid='drop'`` removes rows that cannot be
    converted, ``'flag'`` keeps them with ``is_valid`` false.
    """
    if isinstance(adapter, str):
        alias = SET_ALIASES.get(adapter.lower())
        known = {"tasks": ADAPTERS, "sets": SETS, None: {**SETS, **ADAPTERS}}[registry]
        # an alias that is a task's plain name as well, such as "boolq", is in one registry only
        fn = SETS.get(alias) if alias is not None and registry != "tasks" else known.get(adapter)
        if fn is None:
            raise ValueError(f"Unknown adapter {adapter!r}")
    else:
        fn = adapter
    if english_only:
        df = filter_english(df)
    row = fn(df)
    null = lambda kind: F.lit(None).cast(kind)
    some = lambda c, kind: null(kind) if c is None else c.cast(kind)
    meta = F.create_map(*[x for k, v in row.meta.items() for x in (F.lit(k), v.cast("string"))]) if row.meta else null("map<string,string>")
    out = df.select(
        *keep, row.messages.cast(ms.MESSAGES).alias("messages"), some(row.letters, "array<string>").alias("letters"),
        some(row.parts, PARTS).alias("parts"), some(row.answer, "string").alias("answer"),
        some(row.subject, "string").alias("subject"), meta.alias("meta"),
    )
    if on_invalid == "flag":
        return out.withColumn("is_valid", F.col("messages").isNotNull())
    return out.filter(F.col("messages").isNotNull())
