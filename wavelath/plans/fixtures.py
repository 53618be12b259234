"""Inputs of the registered queries, as DataFrames and as DuckDB SQL over the same tables.

W: events in order by user, as samples. U: W with 0 where the event is an error.
V: embeddings as vectors; shorter inputs are the first numbers of each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import samples as src

PI = "pi()"


def w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.numbered(src.table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value")


def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W scaled to values between -1 and 1 by a fixed rule."""
    return w(spark, sf_dir).withColumn("x", (F.col("x") - 250) / 250)


def u(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")))
    return src.numbered(rows, "user_id", "ts", "event_id", "value")


def v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.vectors(src.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def first(df: DataFrame, count: int) -> DataFrame:
    return df.withColumn("x", F.slice("x", F.lit(1), F.lit(count)))


def long(df: DataFrame, keys: list[str], column: str, digits: int = 6, place: str = "k") -> DataFrame:
    """A vector's numbers as rows, rounded, without negative zeros."""
    rows = df.select(*keys, F.posexplode(column).alias(place, "y"))
    return rows.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col(place).cast("long").alias(place), (F.round("y", digits) + F.lit(0.0)).alias("y"))


def plain(df: DataFrame, keys: list[str], column: str = "x", digits: int = 6) -> DataFrame:
    return df.select(*[F.col(k).cast("long").alias(k) for k in keys], (F.round(column, digits) + F.lit(0.0)).alias("y"))


# --- SQL

W = "w AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value AS x FROM events), s AS (SELECT seq, max(n) + 1 AS len FROM w GROUP BY seq)"
UNIT = W.replace("value AS x", "(value - 250) / 250 AS x")
U = W.replace("value AS x", "CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS x")
V = "v AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS n FROM embeddings)"


def vectors_sql(count: int = 64, value: str = "x") -> str:
    """v with the first numbers of each vector, each one changed by a formula of x and n."""
    return f"v0 AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS n FROM embeddings), v AS (SELECT id, n, ({value})::DOUBLE AS x FROM v0 WHERE n < {count})"


def grid(name: str, count: int | str) -> str:
    return f"(SELECT unnest(range({count})) AS {name})"


def y(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS y"


def linear_sql(weight: str, outputs: int, inputs: int = 64, value: str = "x", digits: int = 6) -> str:
    """Sums of x times a formula of k (output) and n (input)."""
    return f"WITH {vectors_sql(inputs, value)} SELECT id, k, {y(f'sum(x * ({weight}))', digits)} FROM v, {grid('k', outputs)} g GROUP BY id, k"


def matrix_cte(matrix: np.ndarray, name: str = "m") -> str:
    """A matrix (outputs, inputs) as rows (k, n, a); zeros are left out."""
    rows = [f"({k},{n},{matrix[k, n]!r}::DOUBLE)".replace("np.float64(", "").replace(")::", "::") for k, n in zip(*np.nonzero(matrix), strict=True)]
    return f"{name} AS (SELECT k::BIGINT AS k, n::BIGINT AS n, a FROM (VALUES {','.join(rows)}) t(k, n, a))"


def matrix_sql(matrix: np.ndarray, value: str = "x", before: str = "", digits: int = 6) -> str:
    outputs, inputs = matrix.shape
    return (
        f"WITH {vectors_sql(inputs, value)}, {before}{matrix_cte(matrix)} "
        f"SELECT i.id, g.k, {y('coalesce(sum(v.x * m.a), 0)', digits)} FROM (SELECT DISTINCT id FROM v) i CROSS JOIN {grid('k', outputs)} g LEFT JOIN m ON m.k = g.k LEFT JOIN v ON v.id = i.id AND v.n = m.n GROUP BY i.id, g.k"
    )
