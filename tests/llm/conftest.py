import random

import pytest

ODD = [
    (1, "  a  b \n c▁d▁"), (2, None), (3, ""), (4, " "), (5, "▁▁"), (6, "<s>x</s> \t <0x0A>"), (7, "日本 語　x é é \x00 "),
    (None, "x"), (10, "a<|ENDOFTEXT|>b Big <|EndOfText|> <|STARTOFTEXT|>"), (8, "it's <|endoftext|>x <|startoftext|> 12Ab ΑΣ Σ İ é a ́b"), (9, "x" * 50_000), (9, "y y"), (9, "y y"), (None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, long, repeated and strange texts, with columns whose names the operators use inside."""
    rows = [(i, t, "row", 1, "h", [1]) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, n int, label string, bands array<int>")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def prose(seed: int, words: int, letters: str = "abcdefgh") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(words))
