"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round the double columns, so that the order of a sum does not show."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; ``sql`` is the same question for DuckDB on the same tables."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf), digits)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_shuffle_key(seed, *cols: str) -> str:
    """Text of the md5 order key over columns."""
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"md5({inner})"


def sql_draw(seed, *cols: str) -> str:
    """Integer from the first eight digits of the order key."""
    return f"CAST(('0x' || left({sql_shuffle_key(seed, *cols)}, 8)) AS BIGINT)"


def sql_fewshot(seed, k: int) -> str:
    """Tables p (items by position, n) and s (item_id, shot, other): k different others of every item of ``benchmark``."""
    top = lambda j: f"(n - 1 - {k} + {j})"
    draws = ", ".join(f"""{sql_draw(seed, 'item_id', str(j))} % ({top(j)} + 1) AS t{j}""" for j in range(k))
    taken = ", ".join(
        f"CASE WHEN t{j} IN ({', '.join(f'c{i}' for i in range(j))}) THEN {top(j)} ELSE t{j} END AS c{j}" if j else "t0 AS c0" for j in range(k)
    )
    return f"""
    WITH p AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () AS n FROM benchmark),
    d AS (SELECT item_id, pos, n, {draws} FROM p),
    c AS (SELECT *, {taken} FROM d),
    u AS (SELECT item_id, pos, unnest([{', '.join(str(j + 1) for j in range(k))}]) AS shot, unnest([{', '.join(f'c{j}' for j in range(k))}]) AS v FROM c),
    s AS (SELECT u.item_id, CAST(shot AS INTEGER) AS shot, p.item_id AS other, p.text FROM u JOIN p ON p.pos = v + CASE WHEN v >= u.pos THEN 1 ELSE 0 END)"""
