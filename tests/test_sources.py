import json
import time
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tokenmill.operators import reports
from tokenmill.sources import conversations as cv, corpus as c, evals, files, logs, row_groups


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_names_and_split_rules():
    assert c.resolve_names("b, a,b,x", ["a", "b"], {"x": "a"}) == ["b", "a"]
    with pytest.raises(ValueError, match="Unknown"):
        c.resolve_names(["zzz"], ["a"])
    assert c.split_files(["1"], "val") == [] and c.split_files(["1"], "train") == ["1"]
    assert c.split_files(["1", "2"], "val") == ["2"] and c.split_files(["1", "2"], "train") == ["1"]
    assert c.interleave([["a0", "a1", "a2"], ["b0"]]) == ["a0", "b0", "a1", "a2"]


def test_broken_files_are_skipped(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select(F.col("id").cast("string").alias("text")).coalesce(1).write.parquet(str(tmp_path / f"s{i}"))
    write(tmp_path / "s1" / "zz.parquet", "this is no parquet file")
    spec = {"d": str(tmp_path)}
    out = c.read_corpus(spark, spec, None, on_corrupt="skip")
    assert out.count() == 30
    with pytest.raises(Exception):
        c.read_corpus(spark, spec, None).count()
    with pytest.raises(RuntimeError):
        c.read_corpus(spark, {"d": [str(tmp_path / "s1" / "zz.parquet")]}, None, on_corrupt="skip")


def test_reading_order(spark, tmp_path):
    for name in ("a", "b"):
        for i in range(2 if name == "b" else 3):
            spark.createDataFrame([(f"{name}{i}{k}",) for k in range(3)], "text string").coalesce(1).write.parquet(str(tmp_path / name / f"s{i}"))
    df = c.read_corpus(spark, {n: str(tmp_path / n) for n in "ab"}, "train")
    assert [r.text[:2] for r in df.orderBy("file_no", "row_no").collect()] == ["a0"] * 3 + ["b0"] * 3 + ["a1"] * 3
    assert c.read_corpus(spark, {n: str(tmp_path / n) for n in "ab"}, "val").select("dataset").distinct().count() == 2


@pytest.fixture(scope="module")
def uneven(tmp_path_factory):
    """Three files with row groups of 3, 5, 1 / 7 / 2, 2, 2, 2 rows, in a folder with odd characters."""
    folder = tmp_path_factory.mktemp("un even %41 é")
    files, at = [], 0
    for name, sizes in (("a", (3, 5, 1)), ("b", (7,)), ("c", (2, 2, 2, 2))):
        files.append(str(folder / f"{name}.parquet"))
        with pq.ParquetWriter(files[-1], pa.schema([("id", pa.int64()), ("text", pa.string())])) as out:
            for n in sizes:
                out.write_table(pa.table({"id": range(at, at + n), "text": [f"t{i}" for i in range(at, at + n)]}), row_group_size=n)
                at += n
    return files


def rank_walk(files, rank, world):
    """(file, row group, id) as a rank reads them."""
    out = []
    for f, path in enumerate(files):
        file = pq.ParquetFile(path)
        for g in range(rank, file.num_row_groups, world):
            out += [(f, g, i) for i in file.read_row_group(g).column("id").to_pylist()]
    return out


def test_ranks_take_real_row_groups(spark, uneven):
    ranked = c.assign_ranks(spark.read.parquet(*uneven), 2)
    got = ranked.collect()
    for rank in (0, 1):
        assert sorted(r.id for r in got if r["rank"] == rank) == sorted(i for _, _, i in rank_walk(uneven, rank, 2))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and plan.count("Exchange") == plan.count("BroadcastExchange")


def test_many_row_groups_share_partitions(spark, tmp_path):
    path, n = str(tmp_path / "many.parquet"), 2 * row_groups.TASKS + 7
    pq.write_table(pa.table({"id": range(n)}), path, row_group_size=1)
    df = row_groups.read_rank(spark, [path], "id bigint", epochs=2)
    assert df.rdd.getNumPartitions() == row_groups.TASKS
    assert [(r.epoch, r.row_group, r.id) for r in df.collect()] == [(e, i, i) for e in (1, 2) for i in range(n)]


@pytest.mark.parametrize("world", [1, 2, 3])
def test_a_rank_reads_one_partition_for_each_row_group(spark, uneven, world):
    for rank in range(world):
        df = row_groups.read_rank(spark, uneven, "id bigint", rank, world, epochs=2)
        walk = rank_walk(uneven, rank, world)
        assert df.rdd.getNumPartitions() == 2 * len({(f, g) for f, g, _ in walk})
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert [(r.epoch, r.file_no, r.row_group, r.id) for r in df.collect()] == [(e, *x) for e in (1, 2) for x in walk]


def test_broken_files_of_a_rank(spark, uneven, tmp_path):
    broken = write(tmp_path / "x.parquet", "no parquet")
    files = [uneven[0], broken, uneven[2]]
    got = row_groups.read_rank(spark, files, "id bigint", 1, 2, on_corrupt="skip").collect()
    assert [(r.file_no, r.id) for r in got] == [(2 * f, i) for f, _, i in rank_walk([uneven[0], uneven[2]], 1, 2)]
    with pytest.raises(Exception):
        row_groups.read_rank(spark, files, "id bigint").collect()
    with pytest.raises(Exception, match="No valid"):
        row_groups.read_rank(spark, [broken], "id bigint", on_corrupt="skip").collect()


def test_shard_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = str(tmp_path / "out")
    c.write_shards(docs, path, "doc_id", chars_per_shard=60_000, rows_per_group=16)
    plan = c.assign_shards(docs, "doc_id", "n_chars", 60_000, 16)
    sizes = {r.shard: r.n for r in plan.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    found = sorted(Path(path).glob("shard=*/*.parquet"))
    assert len(found) == len(sizes)
    for f in found:
        meta = pq.ParquetFile(f).metadata
        shard = int(f.parent.name.split("=")[1])
        assert meta.num_rows == sizes[shard]
        groups = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
        assert all(g == 16 for g in groups[:-1])
        assert meta.row_group(0).column(0).compression == "ZSTD"
        assert "PLAIN_DICTIONARY" not in meta.row_group(0).column(0).encodings
    complete = plan.filter("is_complete").select("shard").distinct().count()
    dropped = str(tmp_path / "dropped")
    c.write_shards(docs, dropped, "doc_id", chars_per_shard=60_000, rows_per_group=16, tail="drop")
    assert len(list(Path(dropped).glob("shard=*/*.parquet"))) == complete < len(found)


def test_conversation_lines(spark, tmp_path):
    good = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
    lines = [good, [good[0]], [good[1], good[0]], [{"role": "user"}, good[1]]]
    path = write(tmp_path / "c.jsonl", "\n\n".join(json.dumps(x) for x in lines) + "\n{\"a\": 1}\n")
    ok, bad = cv.read_conversations_jsonl(spark, path, "quarantine")
    assert ok.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["missing_field", "no_json_list", "roles_do_not_alternate", "too_few_messages"]
    with pytest.raises(Exception, match="Bad conversation"):
        cv.read_conversations_jsonl(spark, path).collect()
    with pytest.raises(Exception, match="do not alternate"):
        cv.write_conversations_jsonl(spark.createDataFrame([([("assistant", "x")],)], "messages array<struct<role:string,content:string>>"), str(tmp_path / "o"))


def test_long_blank_stretches_are_trimmed_at_once(spark, tmp_path):
    """A pattern looks at a stretch of blanks from each of its characters on; lines of documents hold long ones."""
    line = "a" + " " * 400_000 + "b"
    path = write(tmp_path / "blanks.jsonl", f"\u2003{line}\u00a0 \n \u3000\n")
    start = time.monotonic()
    _, bad = cv.read_conversations_jsonl(spark, path, "quarantine")
    assert [(r.line == line, r.reason) for r in bad.collect()] == [(True, "no_json_list")]
    assert time.monotonic() - start < 20


def test_file_selection():
    paths = ["README.md", "main/train.csv", "main/dev-1.json", "main/dev-2.json", "main/valid.csv", "other/test.parquet"]
    assert files.select_files(paths, "validation", "main") == ["main/dev-1.json", "main/dev-2.json"]
    assert files.select_files(paths, "train", "nosuch") == ["main/train.csv"]
    assert files.select_files(["x.tsv", "y.md"], "train") == ["x.tsv"]
    with pytest.raises(ValueError):
        files.select_files(["a/test.csv"], "train")


def test_mixed_formats(spark, tmp_path):
    write(tmp_path / "d" / "train.tsv", "a\tb\n1\tx, y\n2\t\"q\"\n")
    write(tmp_path / "d" / "test.jsonl", '{"a": 1}\n{"a": 2}\n')
    root = str(tmp_path / "d")
    assert {r.b for r in files.read_dataset_files(spark, ["train.tsv", "test.jsonl"], "train", root=root).collect()} == {"x, y", "q"}
    assert files.read_dataset_files(spark, ["train.tsv", "test.jsonl"], "test", root=root).count() == 2
    load = lambda name, split: files.read_dataset_files(spark, ["train.tsv"], split, root=root)
    df, name, split = files.load_with_fallback(load, ["n"], "test")
    assert (name, split, df.count()) == ("n", "train", 2)


@pytest.mark.parametrize("text, n", [
    ('[{"a": 1}, {"b": [2]}]', 2), ('{"records": [{"a": 1}]}', 1), ('{"a": 1}', 1), ('{"a": 1}\n\n{"b": 2}\n{"c": 3}', 3), ('{"items": []}', 0)])
def test_json_payloads(spark, tmp_path, text, n):
    assert files.read_json_any(spark, write(tmp_path / "p.json", text)).count() == n


def test_lines_are_told_from_documents():
    one = b'{"a": 1}'
    assert files.is_json_lines(one + b"\n" + one, True) and files.is_json_lines(b"\n" + one + b"\r\n" + one[:3], False)
    assert not files.is_json_lines(one, True) and not files.is_json_lines(one + b"\n\n", True) and not files.is_json_lines(b"", True)
    # pretty-printed, or a first line that goes on beyond what was read
    assert not files.is_json_lines(b'{\n "a": 1\n}\n', True) and not files.is_json_lines(one[:5], False) and not files.is_json_lines(b"[1,\n2]", True)


def test_large_json_lines_are_read_by_many_tasks(spark, tmp_path):
    """Numbers are dense within each file, whatever blocks it is read in, and a document beside them is read whole."""
    lines = [json.dumps({"k": i, "pad": "x" * (i % 90)}) for i in range(6000)]
    write(tmp_path / "in [1]" / "a.jsonl", "\n\n".join(lines) + "\n")
    write(tmp_path / "in [1]" / "b.jsonl", "\n".join(lines[:10]))
    write(tmp_path / "in [1]" / "c.json", json.dumps({"data": [1, 2, 3]}, indent=1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = files.read_json_any(spark, str(tmp_path / "in \\[1\\]"))
        got = df.select("row_no", F.try_variant_get("row", "$.k", "int").alias("k"), F.spark_partition_id().alias("p")).collect()
        assert len({r.p for r in got}) > 8
        assert sorted((r.row_no, r.k) for r in got if r.k is not None) == sorted([(i, i) for i in range(6000)] + [(i, i) for i in range(10)])
        assert sorted(r.row_no for r in got if r.k is None) == [0, 1, 2]
        with_blank = files.numbered_lines(spark, [str(tmp_path / "in \\[1\\]" / "a.jsonl")]).filter("line <> ''").collect()
        assert sorted((r.line_no, json.loads(r.line)["k"]) for r in with_blank) == [(2 * i, i) for i in range(6000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_small_json_files_are_not_opened_by_the_driver(spark, tmp_path, monkeypatch):
    """Lines and documents are told apart in the tasks, with any line end."""
    for i in range(40):
        write(tmp_path / "in" / f"d{i}.json", json.dumps({"records": [i, i]}))
        write(tmp_path / "in" / f"l{i}.txt", f"{i}\r\n\n{i}\n{i}")
    opened = []
    monkeypatch.setattr(files, "_start_of", lambda *a: opened.append(a))
    rows = files.read_json_any(spark, str(tmp_path / "in")).select("row_no", F.col("row").cast("int").alias("v")).collect()
    assert sorted((r.v, r.row_no) for r in rows) == sorted((i, k) for i in range(40) for k in (0, 1, 0, 1, 2)) and not opened


def test_eval_bundle(spark, tmp_path):
    write(tmp_path / "eval_data" / "x" / "t.jsonl", '{"query": "q", "gold": 1}\n\n{"query": "r", "gold": 0}\n')
    write(tmp_path / "eval_meta_data.csv", "Eval Task,Random baseline,More\nT,25,z\n")
    tasks = [{"label": "T", "icl_task_type": "multiple_choice", "dataset_uri": "x/t.jsonl", "num_fewshot": [3]},
             {"label": "U", "icl_task_type": "language_modeling", "dataset_uri": "x/t.jsonl2", "num_fewshot": [0], "continuation_delimiter": "\n"}]
    write(tmp_path / "eval_data" / "x" / "t.jsonl2", "")
    items, meta = evals.read_eval_bundle(spark, str(tmp_path), tasks)
    assert items.filter("task = 'T'").count() == 2
    rows = {r.task: r for r in meta.collect()}
    assert rows["T"].baseline == 25.0 and rows["U"].baseline is None and rows["U"].delimiter == "\n"


def test_metric_files_with_padding(spark, tmp_path):
    path = write(tmp_path / "m.csv", f"{'Task':<10}, {'Accuracy':<8}, {'Centered':<8}\n{'hella':<10}, {0.5:<8.6f}, {0.25:<8.6f}\n{'CORE':<10}, {'':<8}, {0.25:<8.6f}\n")
    assert {(r.task, r.accuracy, r.centered) for r in evals.read_metrics_csv(spark, path).collect()} == {("hella", 0.5, 0.25), ("CORE", None, 0.25)}


def test_training_log(spark, tmp_path):
    write(tmp_path / "logs" / "a_train.log", (
        "Number of parameters: 1\nNumber of parameters: 1,234,567 (scaling: 1,000,000)\nCalculated number of iterations from x: 1,907\n"
        "Step 1 | Validation bpb: 1.5\nStep 2 | Validation bpb: 0.9123\n"))
    r = logs.parse_train_logs(spark, str(tmp_path / "logs")).first()
    assert (r.num_params, r.num_scaling_params, r.num_iterations, r.val_bpb, r.core_score) == (1234567, 1000000, 1907, 0.9123, 0.0)
    assert r.tokens_trained == 1907 * 524288 and r.param_data_ratio == 999.82
    path = write(tmp_path / "sweep.csv", "flops_budget,depth,model_dim,num_params,num_scaling_params,num_iterations,tokens_trained,param_data_ratio,val_bpb,core_score,train_time_sec\n1e18,8,512,10,9,8,7,6.5,0.9,0.1,60\n")
    assert logs.read_sweep(spark, path).first().flops_budget == 1e18


def test_report(spark, tmp_path):
    write(tmp_path / "r" / "run1" / "header.md", "# x\nRun started: 2024-01-01 00:00:00\n")
    write(tmp_path / "r" / "run1" / "base-model-evaluation.md", "## Base\ntimestamp: 2024-01-01 02:03:04\n- CORE metric: 0.25\n")
    write(tmp_path / "r" / "run1" / "chat-evaluation-rl.md", "timestamp: 2025-01-01 02:03:04\n- GSM8K: 0.5\n")
    lines = logs.parse_report(spark, str(tmp_path / "r" / "*"))
    summary = [tuple(r)[2:] for r in reports.report_summary(reports.stage_metrics(lines)).orderBy("place").collect()]
    assert summary == [("CORE", "0.25", "-", "-", "-"), ("GSM8K", "-", "-", "-", "0.5")]
    assert reports.wall_clock(lines).first().wall_clock == "2h3m"
    assert reports.wall_clock(lines.filter("section <> 'header'")).first().wall_clock == "unknown"
