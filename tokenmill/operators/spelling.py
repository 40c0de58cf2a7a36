"""Spelling and letter-counting examples made from a word table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.text import hash_pick, unit_interval
from tokenmill.operators.mixing import shuffle

# Ways to ask for a letter count.
TEMPLATES = (
    "How many {letter} are in the word {word}",
    "How many {letter} are in {word}",
    "Count the number of {letter} in {word}",
    "How many times does {letter} appear in {word}",
    "What's the count of {letter} in {word}",
    "In the word {word}, how many {letter} are there",
    "How many letter {letter} are in the word {word}",
    "Count how many {letter} appear in {word}",
    "Tell me the number of {letter} in {word}",
    "How many occurrences of {letter} are in {word}",
    "Find the count of {letter} in {word}",
    "Can you count the {letter} letters in {word}",
    "What is the frequency of {letter} in {word}",
    "How many {letter}s are in {word}",
    "How many {letter}'s are in {word}",
    "Count all the {letter} in {word}",
    "How many times is {letter} in {word}",
    "Number of {letter} in {word}",
    "Total count of {letter} in {word}",
    "How many {letter} does {word} have",
    "How many {letter} does {word} contain",
    "What's the number of {letter} in {word}",
    "{word} has how many {letter}",
    "In {word}, count the {letter}",
    "How many {letter} appear in {word}",
    "Count the {letter} in {word}",
    "Give me the count of {letter} in {word}",
    "How many instances of {letter} in {word}",
    "Show me how many {letter} are in {word}",
    "Calculate the number of {letter} in {word}",
    "¿Cuántas {letter} hay en {word}?",
    "¿Cuántas veces aparece {letter} en {word}?",
    "Cuenta las {letter} en {word}",
    "¿Cuántas letras {letter} tiene {word}?",
    "{word}中有多少个{letter}",
    "{word}里有几个{letter}",
    "数一下{word}中的{letter}",
    "{word}这个词里有多少{letter}",
    "{word}에 {letter}가 몇 개 있나요",
    "{word}에서 {letter}의 개수는",
    "{word}에 {letter}가 몇 번 나오나요",
    "{word}라는 단어에 {letter}가 몇 개",
    "Combien de {letter} dans {word}",
    "Combien de fois {letter} apparaît dans {word}",
    "Compte les {letter} dans {word}",
    "Wie viele {letter} sind in {word}",
    "Wie oft kommt {letter} in {word} vor",
    "Zähle die {letter} in {word}",
    "{word}に{letter}は何個ありますか",
    "{word}の中に{letter}がいくつ",
    "{word}に{letter}が何回出てくる",
)
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
QUOTES = ("", "'", '"')
# Fixed value: test examples are drawn with numbers from here on.
TEST_OFFSET = 10_000_000


def _characters(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))


def _walk(word: Column, letter: Column) -> Column:
    """One line per character, hits counted."""
    chars = _characters(word)

    def line(c, i):
        count = F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == letter))
        base = F.concat((i + 1).cast("string"), F.lit(":"), c)
        return F.when(c == letter, F.concat(base, F.lit(" hit! count="), count.cast("string"))).otherwise(base)

    return F.array_join(F.transform(chars, line), "\n")


def _examples(words: DataFrame, n: int, split: str, seed) -> DataFrame:
    """``n`` numbered draws of a word; ``words(word_no, word)`` with numbers from 0."""
    size = words.count()
    offset = 0 if split == "train" else TEST_OFFSET
    return words.sparkSession.range(n).select(
        F.col("id").alias("idx"), (F.col("id") + offset).alias("draw")
    ).withColumn("word_no", hash_pick(f"{seed}:word", size, "draw")).join(words, "word_no")


def generate_spelling(
    words: DataFrame, n: int, split: str = "train", seed="spelling", templates=TEMPLATES
) -> DataFrame:
    """Letter-count examples: question, walk through the word, check in Python, answer.

    Every choice is a hash of the example's number, so examples do not depend on partitioning.
    The word table is joined by its row number.
    """
    ex = _examples(words, n, split, seed)
    pick = lambda what, k: hash_pick(f"{seed}:{what}", k, "draw")
    draw = lambda what: unit_interval(f"{seed}:{what}", "draw")
    of = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    own = F.substring(F.col("word"), pick("own", F.length("word").cast("bigint")).cast("int") + 1, F.lit(1))
    letter = F.when(draw("side") < 0.9, own).otherwise(of(list(ALPHABET), pick("other", 26)))
    chosen = of(templates, pick("template", len(templates)))
    # Lower-casing leaves the placeholders as they are.
    template = F.when(draw("lower") < 0.3, F.lower(chosen)).otherwise(chosen)
    lq, wq = of(QUOTES, pick("letter_quote", 3)), of(QUOTES, pick("word_quote", 3))
    base = ex.withColumn("letter", letter)
    question = F.replace(
        F.replace(template, F.lit("{letter}"), F.concat(lq, "letter", lq)), F.lit("{word}"), F.concat(wq, "word", wq)
    )
    counted = F.size(F.filter(_characters(F.col("word")), lambda c: c == F.col("letter")))
    base = base.withColumn("count", counted)
    n_text = F.col("count").cast("string")
    quoted = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    manual = F.concat(
        F.lit("We are asked to find the number "), quoted("letter"), F.lit(" in the word "), quoted("word"),
        F.lit(". Let me try a manual approach first.\n\nFirst spell the word out:\n"),
        F.col("word"), F.lit(":"), F.array_join(_characters(F.col("word")), ","),
        F.lit("\n\nThen count the occurrences of "), quoted("letter"), F.lit(":\n"),
        _walk(F.col("word"), F.col("letter")), F.lit("\n\nThis gives us "), n_text, F.lit("."),
    )
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    parts = F.array(
        part("text", manual),
        part("text", F.lit("\n\nLet me double check this using Python:\n\n")),
        part("python", F.concat(quoted("word"), F.lit(".count("), quoted("letter"), F.lit(")"))),
        part("python_output", n_text),
        part("text", F.concat(F.lit("\n\nPython gives us "), n_text, F.lit(".\n\nMy final answer is:\n\n#### "), n_text)),
    )
    return base.select(
        "idx", "word", "letter", "count",
        F.concat(question, F.when(draw("mark") < 0.5, "?").otherwise("")).alias("question"), parts.alias("parts"),
    )


def generate_simple_spelling(words: DataFrame, n: int, split: str = "train", seed="simple") -> DataFrame:
    """``Spell the word`` examples, over the words in another order."""
    other = shuffle(words.select("word"), ["word"], 42, "word_no")
    ex = _examples(other, n, split, seed)
    return ex.select(
        "idx", "word", F.concat(F.lit("Spell the word: "), "word").alias("question"),
        F.concat("word", F.lit(":"), F.array_join(_characters(F.col("word")), ",")).alias("answer"),
    )
