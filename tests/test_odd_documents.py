"""Queries over documents with empty and blank texts give the same rows as their SQL."""

from functools import partial

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests.oracle import difference
from tokenmill.operators import render as r
from tokenmill.plans import adapters as ad

TEXTS = ["one", "", "two words ", " \n\xa0", "x" * 512, "é" * 650, "the 7th"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Folder with a ``documents`` table that has every text with every remainder its queries look at."""
    folder, n = tmp_path_factory.mktemp("odd"), 60 * len(TEXTS)
    texts = [TEXTS[i % len(TEXTS)] for i in range(n)]
    pq.write_table(pa.table({
        "doc_id": pa.array(range(n), pa.int64()), "text": texts, "lang": [("en", "fr", "de", "es")[i % 4] for i in range(n)],
        "source": [f"src{i % 20}" for i in range(n)], "n_chars": pa.array([len(t) for t in texts], pa.int64()),
    }), folder / "documents.parquet")
    return str(folder)


def differs(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    return difference(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name])


@pytest.mark.parametrize("name", [
    "n7_rolling_windows", "p29_instruction_templates", "p9_openorca", "p9_social_iqa", "p9_winogrande"])
def test_empty_texts(spark, odd, name):
    assert differs(spark, name, odd) is None


def test_a_text_without_tokens_is_one_window(spark):
    ids = spark.createDataFrame([(0, []), (1, [5]), (2, None)], "doc_id int, ids array<int>")
    out = r.rolling_windows(ids, 4, 256).orderBy("doc_id").collect()
    assert [tuple(x) for x in out] == [(0, 0, [256], []), (1, 0, [256], [5])]


TEMPLATES = [
    (ad.instruction, "instruction string, response string", ("i", ""), None, ""),
    (ad.instruction, "instruction string, output string, response string", ("i", "", "r"), "r", "r"),
    (ad.instruction, "instruction string, response string", ("i", None), None, None),
    (ad.open_orca, "question string, response string", ("q", ""), None, ""),
    (ad.open_orca, "question string, response string", ("q", None), None, None),
    (ad.social_iqa, "question string, answerA string, answerB string, label string", ("", "x", "y", "2"), None, "B"),
    (ad.social_iqa, "question string, answerA string, answerB string, label string", (None, "x", "y", "2"), None, None),
    (ad.winogrande, "sentence string, option1 string, option2 string, answer string", ("", "x", "y", "2"), None, "B"),
    (ad.winogrande, "sentence string, option1 string, option2 string, answer string", ("", "x", "y", ""), None, None),
    (ad.skunkworks, "instruction string, reasoning string, output string", ("i", " why ", ""), "why", "why\n\n"),
    (ad.skunkworks, "instruction string, reasoning string, output string", ("i", "why", None), "why", "why"),
    (ad.open_math_instruct, "problem string, generated_solution string, expected_answer string", ("p", "", "7"), "7", "\n\nFinal answer: 7"),
    (ad.open_math_instruct, "problem string, generated_solution string, expected_answer string", ("p", None, "7"), "7", "7"),
    (ad.numina_math, "prompt string, response string, ground_truth string, correct boolean", ("p", "", "g", True), "g", ""),
    (ad.numina_math, "prompt string, response string, ground_truth string, correct boolean", ("p", None, "g", True), "g", "g"),
]


@pytest.mark.parametrize("adapter, ddl, row, plain, kept", TEMPLATES)
def test_empty_fields(spark, adapter, ddl, row, plain, kept):
    """An empty field counts as missing, or as a text where the caller keeps empty ones."""
    df = spark.createDataFrame([row], ddl)
    for fn, want in ((adapter, plain), (partial(adapter, keep_empty=True), kept)):
        out = ad.to_conversations(df, fn).collect()
        assert [c.messages[-1].content for c in out] == ([] if want is None else [want])
