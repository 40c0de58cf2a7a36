import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.conftest import SF
from tokenmill.catalog import streams
from tokenmill.operators import training as tr
from tokenmill.operators.tokens import byte_vocab
from tokenmill.sources import row_groups
from tokenmill.streaming import jobs


def _log(spark, lo, hi):
    rng = np.random.default_rng(9)
    values = {r: 5 - np.arange(60) / 20 + rng.random(60) for r in ("a", "b")}
    rows = [(r, i, float(v[i])) for r, v in values.items() for i in range(lo, hi)]
    return spark.createDataFrame(rows, "run string, step bigint, loss double")


def test_state_survives_a_restart(spark, tmp_path):
    """Steps arrive in two files; the query is stopped in between and started anew."""
    feed, out = str(tmp_path / "feed"), {n: str(tmp_path / n) for n in ("ema", "stop", "c1", "c2")}
    for lo, hi in ((0, 25), (25, 60)):
        _log(spark, lo, hi).coalesce(1).write.mode("append").parquet(feed)
        source = spark.readStream.schema("run string, step bigint, loss double").parquet(feed)
        jobs.run_available(jobs.stream_ema(source, 0.9), out["ema"], out["c1"])
        jobs.run_available(jobs.stream_early_stop(source.withColumnRenamed("loss", "value"), 4, 0.2), out["stop"], out["c2"])
    whole = _log(spark, 0, 60)
    key = ["run", "step"]
    got = spark.read.parquet(out["ema"]).orderBy(*key).toPandas()
    want = tr.ema(whole, 0.9).orderBy(*key).toPandas()
    assert len(got) == 120 and np.allclose(got.debiased, want.debiased) and np.allclose(got.smooth, want.smooth)
    got = spark.read.parquet(out["stop"]).orderBy(*key).toPandas()
    want = tr.early_stop(whole.withColumnRenamed("loss", "value"), 4, 0.2).orderBy(*key).toPandas()
    for column in ("improved", "best", "bad_evals", "should_stop"):
        assert got[column].tolist() == want[column].tolist()


def test_steps_in_any_order_over_triggers(spark, tmp_path):
    """Shuffled arrival over four restarts, with repeated rows, equals the batch answer; a step waits for those before it."""
    feed, out = str(tmp_path / "feed"), {n: str(tmp_path / n) for n in ("ema", "stop", "c1", "c2")}
    whole = _log(spark, 0, 60)
    rows = whole.collect()
    np.random.default_rng(4).shuffle(rows)
    parts = [rows[i::4] for i in range(4)]
    parts[2] += parts[0][:9]
    for part in parts:
        spark.createDataFrame([tuple(r) for r in part], whole.schema).coalesce(1).write.mode("append").parquet(feed)
        source = spark.readStream.schema(whole.schema).parquet(feed)
        jobs.run_available(jobs.stream_ema(source, 0.9), out["ema"], out["c1"])
        jobs.run_available(jobs.stream_early_stop(source.withColumnRenamed("loss", "value"), 4, 0.2), out["stop"], out["c2"])
    key = ["run", "step"]
    got, want = spark.read.parquet(out["ema"]).orderBy(*key).toPandas(), tr.ema(whole, 0.9).orderBy(*key).toPandas()
    assert len(got) == 120 and np.allclose(got.debiased, want.debiased) and np.allclose(got.smooth, want.smooth)
    got = spark.read.parquet(out["stop"]).orderBy(*key).toPandas()
    want = tr.early_stop(whole.withColumnRenamed("loss", "value"), 4, 0.2).orderBy(*key).toPandas()
    for column in ("improved", "best", "bad_evals", "should_stop"):
        assert got[column].tolist() == want[column].tolist()


class FakeState:
    """Value, map and timers of one key, with the most map entries that were held."""

    def __init__(self):
        self.value, self.map, self.timers, self.most = None, {}, [], 0

    def getValueState(self, *_):
        return type("V", (), {"exists": lambda s: self.value is not None, "get": lambda s: self.value, "update": lambda s, v: setattr(self, "value", v)})()

    def getMapState(self, *_):
        def put(_, k, v):
            self.map[k] = v
            self.most = max(self.most, len(self.map))

        return type("M", (), {
            "exists": lambda s: bool(self.map), "containsKey": lambda s, k: k in self.map, "getValue": lambda s, k: self.map[k],
            "updateValue": put, "removeKey": lambda s, k: self.map.pop(k), "keys": lambda s: iter(list(self.map)), "clear": lambda s: self.map.clear()})()

    def registerTimer(self, at):
        self.timers.append(at)


def test_state_is_bounded_by_what_is_out_of_order():
    """A long run in order keeps nothing waiting, one displaced step only what came before it; a timer passes over a lost step."""
    now = type("T", (), {"getCurrentProcessingTimeInMs": lambda s: 1000})()

    def fold(batches, wait=None):
        state = FakeState()
        job = jobs.InOrder("loss", "", (0,), lambda c, v: ((c[0] + 1,), (c[0],)), ["run", "step", "loss", "n"], 0, wait)
        job.init(state)
        out = [f for f in job.handleInputRows(("a",), iter([pd.DataFrame({"step": b, "loss": [0.5] * len(b)}) for b in batches]), now)]
        return state, job, out

    state, _, out = fold([range(i, i + 5000) for i in range(0, 50_000, 5000)])
    assert state.most == 0 and sum(map(len, out)) == 50_000 and max(map(len, out)) <= jobs.OUT_ROWS
    state, _, out = fold([range(0, 10), range(20, 30), range(10, 20)])
    assert state.most == 10 and not state.map and [s for f in out for s in f.step] == list(range(30))
    state, job, out = fold([range(0, 5), range(7, 9)], wait=50)
    assert state.timers == [1050] and [s for f in out for s in f.step] == list(range(5))
    (late,) = job.handleExpiredTimer(("a",), now, None)
    assert late.step.tolist() == [7, 8] and state.value[0] == 9 and not state.map


def test_corpus_stream_resumes_without_repeats(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    feed, out, at = (str(tmp_path / n) for n in ("feed", "out", "at"))
    for part in range(3):
        docs.filter(F.col("doc_id") % 3 == part).repartition(2).write.mode("append").parquet(feed)
        stream = jobs.stream_corpus(spark, feed, "doc_id bigint, text string", files_per_trigger=1)
        jobs.run_available(jobs.stream_tokens(stream, byte_vocab(spark), ["doc_id"], bos=256), out, at)
    got = spark.read.parquet(out)
    assert got.count() == docs.count() == got.select("doc_id").distinct().count()
    assert got.join(docs, "doc_id").filter(F.size("ids") != F.octet_length("text") + 1).isEmpty()


def test_corpus_stream_of_a_file_and_of_a_folder(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, many = str(tmp_path / "one.parquet"), str(tmp_path / "many" / "documents.parquet")
    pq.write_table(docs.toArrow(), one)
    docs.repartition(3).write.parquet(many)
    for i, path in enumerate((one, many, many + "/")):
        out = str(tmp_path / f"out{i}")
        jobs.run_available(jobs.stream_corpus(spark, path, docs.schema), out, str(tmp_path / f"at{i}"))
        assert spark.read.parquet(out).exceptAll(docs).isEmpty() and spark.read.parquet(out).count() == docs.count()
    tables = tmp_path / "many"
    got = streams.stream_corpus(spark, str(tables))
    assert got.count() == docs.count()


def test_a_feed_reads_its_table_once(spark):
    """The cost of a feed grows with its rows, not with rows times batches."""
    seen = spark.sparkContext.accumulator(0)

    def passed(step):
        seen.add(1)
        return step

    steps = spark.range(400).coalesce(1).select(F.udf(passed, "bigint")("id").alias("step"))
    path = streams._feed(spark, steps, "step", 50)
    assert seen.value == 400
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path"), F.col("_metadata.file_modification_time").alias("at")).agg(F.min("step").alias("lo"), F.max("step").alias("hi"))
    assert [(r.lo, r.hi) for r in files.orderBy("at").collect()] == [(i, i + 49) for i in range(0, 400, 50)]


def test_a_rank_stops_inside_files_and_goes_on(spark, tmp_path):
    """Every stop is a restart on the checkpoint; no row group is repeated or left out, over files and epochs."""
    files, ids = [], iter(range(10_000))
    for name, sizes in (("a", (3, 5, 1, 4, 2)), ("b", (7,)), ("c", (2, 2, 2, 2))):
        files.append(str(tmp_path / f"{name}.parquet"))
        with pq.ParquetWriter(files[-1], pa.schema([("id", pa.int64())])) as out:
            for n in sizes:
                out.write_table(pa.table({"id": [next(ids) for _ in range(n)]}), row_group_size=n)
    out, at, seen = str(tmp_path / "out"), str(tmp_path / "at"), []
    for until in ((1, 0, 1), (1, 0, 4), (1, 0, 4), (1, 2, 2), (2, 0, 2), (9, 0, 0)):
        jobs.run_available(row_groups.stream_rank(spark, files, "id bigint", 0, 2, 2, until), out, at)
        seen.append(spark.read.parquet(out).count())
    walk = [(e, f, g) for e in (1, 2) for f, n in enumerate((5, 1, 4)) for g in range(0, n, 2)]
    got = spark.read.parquet(out)
    assert sorted(tuple(r) for r in got.select("epoch", "file_no", "row_group").distinct().collect()) == walk
    assert got.count() == got.select("epoch", "id").distinct().count() == 2 * (3 + 1 + 2 + 7 + 2 + 2)
    assert seen == [3, 4, 4, 15, 20, 34]
    # a file added at the end and one more epoch continue the same query
    more = [*files, files[0]]
    jobs.run_available(row_groups.stream_rank(spark, more, "id bigint", 0, 2, 3), out, at)
    assert spark.read.parquet(out).filter("epoch = 3").count() == 17 + 6


def test_limits(spark, tmp_path):
    rows = [(1, [("user", "hi"), ("assistant", "ho")]), (2, []), (3, [("system", "x"), ("user", "")]), (4, [("user", "x" * 9000)] * 4)]
    df = spark.createDataFrame(rows, "conv_id int, messages array<struct<role:string,content:string>>")
    out = {r.conv_id: r.reasons for r in jobs.stream_limits(df).collect()}
    assert out == {1: [], 2: ["empty_content"], 3: ["empty_content", "invalid_role"], 4: ["message_too_long", "conversation_too_long"]}
