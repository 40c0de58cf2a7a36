"""Streaming counterparts: resumable corpus tokens, running averages, early stopping, limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tokenmill.operators.tokens import tokenize
from tokenmill.operators.turns import LIMITS
from tokenmill.sources.corpus import GLOB


def stream_corpus(
    spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16, glob: str | None = None
) -> DataFrame:
    """Unbounded scan of a corpus: a growing folder, or one file.

    The position lives in the query's checkpoint: a restarted query goes on with the files it
    has not finished and repeats none.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    # as a pattern the path may also be a file, which the stream would else take for the root of a partitioned table
    place = path.rstrip("/")
    plain = GLOB.search(place) is None and place[-1].isalnum()
    return reader.parquet(f"{place[:-1]}[{place[-1]}]" if plain else path)


#: Keyed state of the jobs below lives in this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there into parquet files, then stop."""
    spark = df.sparkSession
    # every trigger opens each partition of the state, so a new query has one for each core
    own = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        query = (
            df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode(mode).trigger(availableNow=True).start()
        )
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    query.awaitTermination()


def stream_tokens(docs: DataFrame, vocab: DataFrame, key: list[str], bos: int | None = None) -> DataFrame:
    """Token ids of a document stream."""
    return tokenize(docs, vocab, key, prepend=bos)


#: Rows that a job hands on at once.
OUT_ROWS = 2048


class InOrder(StatefulProcessor):
    """Fold the steps of a run in their order, whatever order they arrive in.

    The state of a run is the next step, what the fold carries, and the steps that arrived before their turn. A
    step is folded as soon as all before it have been; one that was folded already is left out as
    a repetition. Rows of a trigger are taken a batch at a time and never put together. Where steps do not
    come within ``wait_ms`` of processing time, a timer lets the run go on with the steps it has.
    """

    def __init__(self, value: str, state: str, start: tuple, advance: Callable, columns: list[str], first_step: int, wait_ms: int | None):
        self.value, self.state, self.start, self.advance = value, state, start, advance
        self.columns, self.first_step, self.wait_ms = columns, first_step, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", f"next bigint, {self.state}")
        self.early = handle.getMapState("early", "step bigint", "value double")

    def _load(self) -> tuple[int, tuple]:
        if not self.carried.exists():
            return self.first_step, self.start
        nxt, *carried = self.carried.get()
        return nxt, tuple(carried)

    def _frame(self, run: str, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(run, *r) for r in rows], columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        nxt, carried = self._load()
        waiting, out = False, []
        for batch in rows:
            ordered = batch.sort_values("step")
            for step, value in zip(ordered["step"].tolist(), ordered[self.value].tolist()):
                if step == nxt:
                    carried, row = self.advance(carried, value)
                    out.append((step, value, *row))
                    nxt += 1
                elif step > nxt:
                    self.early.updateValue((step,), (value,))
                    waiting = True
                if len(out) >= OUT_ROWS:
                    yield self._frame(key[0], out)
                    out = []
            # steps that were waiting for one of this batch
            while self.early.exists() and self.early.containsKey((nxt,)):
                value = self.early.getValue((nxt,))[0]
                self.early.removeKey((nxt,))
                carried, row = self.advance(carried, value)
                out.append((nxt, value, *row))
                nxt += 1
                if len(out) >= OUT_ROWS:
                    yield self._frame(key[0], out)
                    out = []
        self.carried.update((nxt, *carried))
        if waiting and self.wait_ms is not None and self.early.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        if out:
            yield self._frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        nxt, carried = self._load()
        out = []
        for step in sorted(k[0] for k in self.early.keys()) if self.early.exists() else []:
            if step >= nxt:
                value = self.early.getValue((step,))[0]
                carried, row = self.advance(carried, value)
                out.append((step, value, *row))
                nxt = step + 1
        self.early.clear()
        self.carried.update((nxt, *carried))
        yield self._frame(key[0], out)


def _fold_in_order(
    df: DataFrame, value: str, state: str, start: tuple, advance: Callable, fields: str, first_step: int, wait_ms: int | None
) -> DataFrame:
    schema = f"run string, step bigint, {value} double, {fields}"
    columns = StructType.fromDDL(schema).names
    return df.select("run", "step", value).groupBy("run").transformWithStateInPandas(
        InOrder(value, state, start, advance, columns, first_step, wait_ms), schema, "append", "processingTime" if wait_ms is not None else "none"
    )


def stream_ema(step_log: DataFrame, beta: float = 0.9, first_step: int = 0, wait_ms: int | None = None) -> DataFrame:
    """Debiased moving average per run of ``step_log(run, step, loss)``, whose steps count from ``first_step`` on.

    Steps may arrive in any order, also over triggers; see ``InOrder``. The state is the average and the number of steps.
    """

    def advance(carried, loss):
        s, n = carried
        s, n = beta * s + (1 - beta) * loss, n + 1
        return (s, n), (s, s / (1 - beta**n))

    return _fold_in_order(step_log, "loss", "s double, n bigint", (0.0, 0), advance, "smooth double, debiased double", first_step, wait_ms)


def stream_early_stop(
    metrics: DataFrame, patience: int, min_delta: float = 0.0, first_step: int = 0, wait_ms: int | None = None
) -> DataFrame:
    """Early-stopping signal per run of ``metrics(run, step, value)``, steps in any order as in ``stream_ema``.

    The state is the best value and the evaluations since.
    """

    def advance(carried, value):
        best, bad = carried
        improved = best is None or value < best - min_delta
        best, bad = (value, 0) if improved else (best, bad + 1)
        return (best, bad), (improved, best, bad, bad >= patience)

    return _fold_in_order(
        metrics, "value", "best double, bad bigint", (None, 0), advance,
        "improved boolean, best double, bad_evals bigint, should_stop boolean", first_step, wait_ms,
    )


def stream_limits(conversations: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """Limit check on a stream of ``(conv_id, messages)``: reasons and accepted, without state.

    Filter on ``accepted`` for the good part and on its negation for the quarantine.
    """
    sizes = F.transform("messages", lambda m: F.length(F.coalesce(m["content"], F.lit(""))))
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda s, n: s + n)
    checks = [
        ("too_many_messages", F.size("messages") > limits["max_messages"]),
        ("empty_content", (F.size("messages") == 0) | F.exists(sizes, lambda n: n == 0)),
        ("message_too_long", F.exists(sizes, lambda n: n > limits["max_message_chars"])),
        ("conversation_too_long", total > limits["max_total_chars"]),
        ("invalid_role", F.exists("messages", lambda m: ~m["role"].isin("user", "assistant"))),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, name) for name, c in checks]))
    return conversations.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)
