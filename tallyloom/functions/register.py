"""SQL functions and table functions: ``register(spark)`` makes them available to SQL text."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

PMF = T.ArrayType(T.StructType([T.StructField("value", T.IntegerType()), T.StructField("prob", T.DoubleType())]))


@pandas_udf(T.DoubleType())
def convolved_tail(slots: pd.Series, target: pd.Series) -> pd.Series:
    """P(sum of slot values >= target) of packed distributions; values over the target are clamped."""

    def one(pmfs, limit) -> float:
        state = {0: 1.0}
        for pmf in pmfs:
            after: dict[int, float] = {}
            for total, p in state.items():
                for x in pmf:
                    key = min(limit, total + x["value"])
                    after[key] = after.get(key, 0.0) + p * x["prob"]
            state = after
        return sum(p for v, p in state.items() if v >= limit)

    return pd.Series([one(s, int(t)) for s, t in zip(slots, target, strict=True)], dtype="float64")


@pandas_udf(T.DoubleType())
def draw_chance(pmfs: pd.Series, target: pd.Series, boss: pd.Series) -> pd.Series:
    """Chance that a bonus draw reaches the target; ``pmfs`` is array<array<struct<value, prob>>>."""
    from tallyloom.operators.flame import draw_chance as chance

    rows = zip(pmfs, target, boss, strict=True)
    return pd.Series([chance([{x["value"]: x["prob"] for x in pmf} for pmf in p], int(t), bool(b)) for p, t, b in rows], dtype="float64")


@udtf(returnType="n int, line array<string>")
class UniquePermutations:
    """Each order of a list once, in order of first appearance."""

    def eval(self, options: list) -> Iterator[tuple]:
        yield from enumerate(map(list, dict.fromkeys(permutations(options or []))))


SQL_FUNCTIONS = [
    "CREATE OR REPLACE TEMPORARY FUNCTION parse_num(t STRING) RETURNS INT RETURN coalesce(try_cast(regexp_replace(t, '[^0-9-]', '') AS INT), 0)",
    "CREATE OR REPLACE TEMPORARY FUNCTION expected_trials(p DOUBLE) RETURNS DOUBLE RETURN CASE WHEN p <= 0 THEN double('infinity') ELSE 1 / p END",
    "CREATE OR REPLACE TEMPORARY FUNCTION nearest_10(x DOUBLE) RETURNS DOUBLE RETURN floor((x + 5) / 10.0) * 10",
    "CREATE OR REPLACE TEMPORARY FUNCTION backoff_seconds(n INT) RETURNS BIGINT RETURN CAST(least(pow(2, n) * 30, 3600) AS BIGINT)",
    "CREATE OR REPLACE TEMPORARY FUNCTION content_hash(a STRING, b STRING, c STRING) RETURNS STRING RETURN sha2(concat_ws('|', coalesce(a, 'null'), coalesce(b, 'null'), coalesce(c, 'null')), 256)",
]


def register(spark: SparkSession) -> None:
    for text in SQL_FUNCTIONS:
        spark.sql(text)
    spark.udf.register("convolved_tail", convolved_tail)
    spark.udf.register("draw_chance", draw_chance)
    spark.udtf.register("unique_permutations", UniquePermutations)
