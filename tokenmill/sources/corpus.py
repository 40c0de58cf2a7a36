"""Corpus shards: split-aware scans, interleaving, ranks and the re-sharding sink."""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions.text import order_key
from tokenmill.plans.scan import dense_index, greedy_chain, hash_blocks, ordered_scan
from tokenmill.plans.session import cut_lineage

TEXT_SCHEMA = "text string"


def list_files(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[str]:
    """Data files of a folder, sorted by path; sub-folders such as ``shard=0`` are entered."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found, walk = [], fs.listFiles(root, True)
    while walk.hasNext():
        path = walk.next().getPath()
        if path.getName().endswith(suffix) and not path.getName().startswith(("_", ".")):
            found.append(path.toString())
    return sorted(found)


def resolve_names(
    names: str | Sequence[str], known: Sequence[str], aliases: dict[str, str] | None = None
) -> list[str]:
    """Canonical dataset names in order, first mention kept; unknown names are an error."""
    if isinstance(names, str):
        names = [n.strip() for n in names.split(",") if n.strip()]
    out = list(dict.fromkeys((aliases or {}).get(n, n) for n in names))
    unknown = [n for n in out if n not in known]
    if unknown:
        raise ValueError(f"Unknown dataset(s): {unknown}. Available: {sorted(known)}")
    return out


def split_files(files: Sequence[str], split: str | None) -> list[str]:
    """The last file is validation data, but only when there are at least two."""
    files = list(files)
    train, val = (files[:-1], files[-1:]) if len(files) >= 2 else (files, [])
    return {"train": train, "val": val, None: files}[split]


def interleave(per_dataset: Sequence[Sequence]) -> list:
    """First of each, second of each, ...; shorter lists simply end."""
    longest = max((len(p) for p in per_dataset), default=0)
    return [p[i] for i in range(longest) for p in per_dataset if i < len(p)]


def reading_order(
    spark: SparkSession,
    specs: dict[str, str | Sequence[str]],
    split: str | None = "train",
    names: str | Sequence[str] | None = None,
    aliases: dict[str, str] | None = None,
) -> tuple[list[str], dict[str, str]]:
    """Files of the datasets in reading order, and the dataset of each."""
    chosen = resolve_names(list(specs) if names is None else names, list(specs), aliases)
    files = {
        n: list_files(spark, specs[n]) if isinstance(specs[n], str) else sorted(specs[n])
        for n in chosen
    }
    parts = [split_files(files[n], split) for n in chosen]
    ordered = [f for p in parts for f in p] if split == "val" else interleave(parts)
    return ordered, {f: n for n in chosen for f in files[n]}


def read_corpus(
    spark: SparkSession,
    specs: dict[str, str | Sequence[str]],
    split: str | None = "train",
    names: str | Sequence[str] | None = None,
    aliases: dict[str, str] | None = None,
    schema: str = TEXT_SCHEMA,
    on_corrupt: str = "fail",
) -> DataFrame:
    """Documents of the datasets with ``file_no``, their place in the reading order.

    ``specs`` maps a dataset to a folder or a list of files. Training files are interleaved
    over the datasets, validation files follow one another. ``on_corrupt='skip'`` leaves out
    files that are no valid parquet and fails only when nothing can be read.
    """
    ordered, owner = reading_order(spark, specs, split, names, aliases)
    if not ordered:
        return spark.createDataFrame([], f"{schema}, file_no bigint, row_no bigint, dataset string")
    reader = spark.read.schema(schema)
    if on_corrupt == "skip":
        reader = reader.option("ignoreCorruptFiles", "true")
    rows = reader.parquet(*[GLOB.sub(r"\\\1", f) for f in ordered]).select(
        "*", _scanned_file(), F.col("_metadata.row_index").alias("row_no")
    )
    places = spark.createDataFrame(
        [(k, i, owner[f]) for i, (f, k) in enumerate(zip(ordered, _uris(spark, ordered)))],
        "__key string, file_no bigint, dataset string",
    )
    lost = F.raise_error(F.concat(F.lit("no place in the reading order for "), F.col("__key")))
    out = rows.join(F.broadcast(places), "__key", "left").withColumn("file_no", F.coalesce("file_no", lost)).drop("__key")
    if on_corrupt == "skip" and out.isEmpty():
        raise RuntimeError("No valid parquet files remain.")
    return out


#: Characters of a path that a reader takes for patterns.
GLOB = re.compile(r"([\\{}\[\]*?])")


def _uris(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths as the scan reports them: with scheme and authority, and escaped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        out.append(re.sub("^file:/+", "file:/", path.getFileSystem(conf).makeQualified(path).toUri().toString()))
    return out


def _scanned_file():
    """The file of a scanned row as ``_uris`` writes it; local paths come with one slash or three."""
    return F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("__key")


def interleave_rows(df: DataFrame, dataset: str, key: Sequence[str], block_rows: int = 1) -> DataFrame:
    """Order of rows when datasets take turns, ``block_rows`` rows at a time."""
    placed = dense_index(df, key, "pos", by=[dataset])
    return dense_index(
        placed.withColumn("__turn", F.expr(f"pos div {block_rows}")), ["__turn", dataset, "pos"], "idx"
    ).drop("__turn")


def row_group_starts(spark: SparkSession, files: Sequence[str], threads: int = 16) -> DataFrame:
    """First row of every row group by the files' footers: ``(__key, starts)``, one row for each file.

    Footers are read by the driver through Hadoop's file systems, several at once.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def starts(path: str) -> list[int]:
        at, out = 0, []
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            for block in reader.getFooter().getBlocks():
                out.append(at)
                at += block.getRowCount()
        finally:
            reader.close()
        return out

    with ThreadPoolExecutor(threads) as pool:
        rows = list(zip(_uris(spark, files), pool.map(starts, files)))
    return spark.createDataFrame(rows, "__key string, starts array<bigint>")


def assign_ranks(df: DataFrame, world: int) -> DataFrame:
    """Row group of each row, and the rank that reads it when rank r takes the row groups r, r + world, ... of a file.

    ``df`` must come straight from a scan of Parquet files, whose footers tell the row groups; nothing is
    shuffled. ``row_groups.read_rank`` reads the share of one rank, one partition for each row group.
    """
    files = [unquote(f) for f in df.inputFiles()]
    starts = F.broadcast(row_group_starts(df.sparkSession, files))
    rows = df.select("*", _scanned_file(), F.col("_metadata.row_index").alias("__row"))
    group = F.size(F.filter("starts", lambda s: s <= F.col("__row"))) - 1
    return rows.join(starts, "__key").withColumn("row_group", group.cast("int")).withColumn(
        "rank", F.pmod("row_group", F.lit(world)).cast("int")
    ).drop("__row", "__key", "starts")


#: Shards whose starts may go to every task (32 MB).
MAX_SHARDS = 1 << 22


@dataclass
class ShardPlan:
    """Positions of all rows (key, __h, idx, group_no), the row groups at which shards start, and whether the last one is full."""

    placed: DataFrame
    starts: np.ndarray
    last_full: bool


def plan_shards(
    df: DataFrame, key: str, chars: str = "n_chars", chars_per_shard: int = 250_000_000, rows_per_group: int = 1024, seed=42
) -> ShardPlan:
    """Shuffled order of the rows, and where its shards start.

    A shard closes at the first full row group at which it holds ``chars_per_shard``
    characters, and counting starts anew. The boundaries form a greedy chain over the row
    groups' running character count. ``key`` must be unique.
    """
    keyed = df.select(key, F.col(chars).cast("bigint").alias("__c")).withColumn("__h", order_key(seed, key))
    # Read several times below, so the narrow table is written once.
    placed = cut_lineage(
        dense_index(keyed, ["__h", key], "idx", block=hash_blocks("__h")).select(
            key, "__h", "idx", "__c", F.expr(f"idx div {rows_per_group}").alias("group_no")
        ), "positions",
    )
    groups = placed.groupBy("group_no").agg(F.sum("__c").alias("chars"), F.count(F.lit(1)).alias("n_rows"))
    levels = cut_lineage(ordered_scan(groups, ["group_no"], {"level": ("sum", F.col("chars"), False)}), "row-groups")
    chain = greedy_chain(
        levels.select("group_no", F.col("level").cast("double").alias("level")), "group_no", "level", float(chars_per_shard)
    )
    starts = np.sort([r["group_no"] for r in chain.limit(MAX_SHARDS + 1).collect()]).astype(np.int64)
    if len(starts) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} shards; raise chars_per_shard")
    last_full = False
    if len(starts):
        # only the last row group can be short, so only the last shard can fall short
        last = levels.filter(F.col("group_no") >= int(starts[-1])).agg(
            F.sum("chars") >= chars_per_shard, F.bool_and(F.col("n_rows") == rows_per_group)
        ).first()
        last_full = bool(last[0] and last[1])
    return ShardPlan(placed.drop("__c"), starts, last_full)


def _find(spark: SparkSession, bounds: np.ndarray):
    """Number of the last bound at or below a value; the bounds go to every task."""
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("bigint")
    def find(value: pd.Series) -> pd.Series:
        values = value.to_numpy()
        values = values.astype(shared.value.dtype) if shared.value.dtype.kind == "S" else values
        return pd.Series(np.searchsorted(shared.value, values, side="right") - 1)

    return find


def assign_shards(
    df: DataFrame, key: str, chars: str = "n_chars", chars_per_shard: int = 250_000_000,
    rows_per_group: int = 1024, seed=42,
) -> DataFrame:
    """Shuffled position and shard of every row: ``(key, idx, shard, is_complete)``; see ``plan_shards``."""
    plan = plan_shards(df, key, chars, chars_per_shard, rows_per_group, seed)
    rows = plan.placed.withColumn("shard", _find(df.sparkSession, plan.starts)("group_no"))
    full = (F.col("shard") < len(plan.starts) - 1) | F.lit(plan.last_full)
    return rows.select(key, "idx", "shard", full.alias("is_complete"))


def write_shards(
    df: DataFrame, path: str, key: str, text: str = "text", chars_per_shard: int = 250_000_000,
    rows_per_group: int = 1024, seed=42, tail: str = "write",
) -> None:
    """Write shuffled shards, one zstd parquet file each, with row groups of equal row count.

    Shards are stretches of the shuffled order, so a row finds its shard by its place among the first keys of
    all shards, and texts cross one shuffle. ``tail='drop'`` leaves out the last, unfilled shard.
    """
    sized = df.withColumn("n_chars", F.length(text))
    plan = plan_shards(sized, key, "n_chars", chars_per_shard, rows_per_group, seed)
    spark = df.sparkSession
    first = spark.createDataFrame([(int(g) * rows_per_group,) for g in plan.starts], "idx bigint")
    bounds = np.array(sorted(r["__h"] for r in plan.placed.join(F.broadcast(first), "idx").select("__h").collect()), dtype="S32")
    rows = df.select(key, text, order_key(seed, key).alias("__h")).withColumn("shard", _find(spark, bounds)("__h"))
    if tail == "drop" and not plan.last_full:
        rows = rows.filter(F.col("shard") < len(plan.starts) - 1)
    (
        rows.repartition("shard").sortWithinPartitions("shard", "__h", key).select("shard", text)
        .write.partitionBy("shard")
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", "3")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.block.row.count.limit", str(rows_per_group))
        .parquet(path)
    )


def cap_corpus(docs: DataFrame, doc_cap: int, max_chars: int, order: Sequence[str], text: str = "text") -> DataFrame:
    """Crop documents to ``doc_cap`` characters and keep them while the total before is at most
    ``max_chars``; the document that crosses the limit stays."""
    cropped = docs.withColumn(text, F.left(F.col(text), F.lit(doc_cap)))
    slim = cropped.select(*order, F.length(text).alias("__n"))
    before = ordered_scan(slim, list(order), {"__before": ("sum", F.col("__n"), False)})
    # The kept documents are a prefix of the order, so its last key is all that is needed.
    last = before.filter(F.col("__before") <= max_chars).agg(F.max(F.struct(*order)).alias("k")).first()["k"]
    if last is None:
        return cropped.limit(0)
    types = {f.name: f.dataType for f in docs.select(*order).schema}
    bound = F.struct(*[F.lit(last[c]).cast(types[c]).alias(c) for c in order])
    if len(order) == 1:
        return cropped.filter(F.col(order[0]) <= F.lit(last[order[0]]))
    return cropped.filter(F.struct(*order) <= bound)
