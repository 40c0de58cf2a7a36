"""Dataset files of mixed formats, and JSON payloads of unknown shape."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenmill.functions.text import strict_json
from tokenmill.plans.joins import broadcast_up_to
from tokenmill.plans.session import cut_lineage
from tokenmill.sources.corpus import GLOB

# Data file endings, and the names a split goes by.
EXTENSIONS = (".parquet", ".json", ".jsonl", ".csv", ".tsv")
SPLIT_NAMES = {
    "train": ("train",),
    "validation": ("validation", "valid", "val", "dev"),
    "val": ("val", "valid", "validation", "dev"),
    "dev": ("dev", "validation", "valid", "val"),
    "test": ("test",),
}
FALLBACK = {
    "test": ("test", "validation", "val", "dev", "train"),
    "train": ("train", "validation", "val", "test"),
}


def _extension(path: str) -> str | None:
    low = path.lower()
    return next((e for e in EXTENSIONS if low.endswith(e)), None)


def select_files(paths: Sequence[str], split: str, subset: str | None = None) -> list[str]:
    """Files of one format that belong to the split.

    Files below ``subset/`` are preferred, then those with that folder anywhere. The most
    frequent ending wins. Training data may lack any split name.
    """
    files = [p for p in paths if _extension(p)]
    if subset:
        inside = [p for p in files if p.startswith(f"{subset}/")] or [p for p in files if f"/{subset}/" in p]
        files = inside or files
    names = SPLIT_NAMES.get(split, (split,))
    chosen = [p for p in files if any(n in p.lower() for n in names)]
    if not chosen and split == "train":
        every = {n for group in SPLIT_NAMES.values() for n in group}
        if not any(n in p.lower() for p in files for n in every):
            chosen = files
    if not chosen:
        raise ValueError(f"No files for split {split!r}")
    best = Counter(_extension(p) for p in chosen).most_common(1)[0][0]
    return [p for p in chosen if _extension(p) == best]


def read_dataset_files(
    spark: SparkSession, paths: Sequence[str], split: str, subset: str | None = None,
    root: str = "", schema: str | None = None,
) -> DataFrame:
    """Rows of the split's files; paths are relative to ``root``."""
    files = select_files(paths, split, subset)
    kind = _extension(files[0])
    full = [f"{root.rstrip('/')}/{p}" if root else p for p in files]
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == ".parquet":
        return reader.parquet(*full)
    if kind in (".json", ".jsonl"):
        return reader.json(full)
    return reader.csv(full, header=True, sep="\t" if kind == ".tsv" else ",", multiLine=True, escape='"')


def load_with_fallback(
    load: Callable[[str, str], DataFrame], names: Sequence[str], split: str
) -> tuple[DataFrame, str, str]:
    """(rows, name, split) of the first name and split candidate that can be loaded."""
    errors = []
    for name in names:
        for candidate in FALLBACK.get(split, (split, "train")):
            try:
                df = load(name, candidate)
                df.schema
                return df, name, candidate
            except (PySparkException, LookupError, OSError, ValueError) as exc:
                errors.append(f"{name}:{candidate} -> {str(exc)[:200]}")
    raise ValueError("Nothing could be loaded:\n" + "\n".join(errors))


def _json_line(line):
    bad = F.raise_error(F.concat(F.lit("Not JSON: "), F.left(line, F.lit(80)))).cast("variant")
    return F.coalesce(strict_json(line), bad)


#: Files of so many bytes are looked at by the driver, so many bytes of each; they decide how it is read.
SNIFF = 1 << 20


def _start_of(spark: SparkSession, path: str, n: int) -> bytes:
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(file)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def is_json_lines(start: bytes, whole: bool) -> bool:
    """Whether a file that begins so holds one JSON value on each line.

    A document has nothing behind its value, so a first line that is a value and is not alone tells lines. With
    a first line longer than the start nothing can be told, and the file counts as a document. ``whole``
    says that there is no more of the file.
    """
    lines = start.decode("utf-8", "replace").splitlines()
    if not whole:
        lines = lines[:-1]
    filled = [x for x in lines if x.strip()]
    if not filled or (len(filled) == 1 and whole):
        return False
    try:
        json.loads(filled[0].removeprefix("\ufeff"))
    except ValueError:
        return False
    return True


def numbered_lines(spark: SparkSession, paths: Sequence[str], blank: bool = True) -> DataFrame:
    """Lines of text files with their number in the file: ``(__f, line_no, line)``; a large file is read by many tasks.

    Numbers count from 0, with ``blank=False`` only lines that are not blank. The lines of a file's block lie together in a
    task, so a first pass counts them by block and only the blocks' few sums are put in order; no line is shuffled.
    """
    rows = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.col("value").alias("line")
    )
    if not blank:
        rows = rows.filter(F.trim("line") != "")
    rows = rows.withColumn("__i", F.monotonically_increasing_id())
    blocks = rows.groupBy("__f", "__b").agg(F.min("__i").alias("__lo"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__f").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("__f", "__b", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__lo")).alias("__add"))
    return rows.join(broadcast_up_to(cut_lineage(starts, "blocks"), BLOCKS), ["__f", "__b"]).select(
        "__f", (F.col("__i") + F.col("__add")).alias("line_no"), "line"
    )


#: File blocks whose places go to every task.
BLOCKS = 500_000


def read_json_any(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Rows of JSON files as ``(row_no, row VARIANT)``.

    The root may be a list, an object that holds a list under data, records or items, or a
    single object; a file that is no JSON document is read line by line. A file of less than ``SNIFF`` bytes, or than
    Spark gives to a task, is one row, which tells lines from a document; of a larger one the driver looks at the first
    bytes, and lines are read in blocks by many tasks, while a document is one row.
    """
    paths = [path] if isinstance(path, str) else list(path)
    number, unit = re.fullmatch(r"(\d+)\s*([kmg]?)i?b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    small = F.col("_metadata.file_size") < min(SNIFF, int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit])
    large = [unquote(r[0]) for r in spark.read.format("binaryFile").load(paths).filter(~small).select("_metadata.file_path").collect()]
    kinds = {f: is_json_lines(start, len(start) < SNIFF) for f in large for start in [_start_of(spark, f, SNIFF)]}
    literal = lambda kind: [GLOB.sub(r"\\\1", f) for f in large if kinds[f] == kind]
    by_line, documents = literal(True), literal(False)
    parts = [_documents(spark.read.text(paths, wholetext=True).filter(small))]
    if documents:
        parts.append(_documents(spark.read.text(documents, wholetext=True)))
    if by_line:
        lines = numbered_lines(spark, by_line, blank=False)
        parts.append(lines.select(F.col("line_no").cast("int").alias("row_no"), _json_line(F.col("line")).alias("row")))
    return reduce(DataFrame.unionByName, parts)


def _documents(files: DataFrame) -> DataFrame:
    whole = files.select(F.col("value").alias("__t"), strict_json("value").alias("v"))
    list_at = lambda v, key: F.try_variant_get(v, f"$.{key}", "array<variant>")
    inner = F.coalesce(
        F.col("v").try_cast("array<variant>"), *[list_at(F.col("v"), k) for k in ("data", "records", "items")],
        F.when(F.col("v").isNotNull(), F.array("v")),
    )
    lines = F.filter(F.split("__t", r"\r\n?|\n"), lambda x: F.trim(x) != "")
    rows = F.coalesce(inner, F.transform(lines, _json_line))
    return whole.select(F.posexplode(rows).alias("row_no", "row"))
