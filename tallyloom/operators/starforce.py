"""First-passage costs of upgrade chains that fall back to a reset stage.

Stages are folded backwards in a higher-order function, so a cost is one expression of
a row's parameters: no shuffle, no Python. Costs are written E[s] = a[s] E[12] + b[s];
carried to stage 12 that is closed by E[12] = b[12] / (1 - a[12]).
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.money import nearest_10
from tallyloom.operators import refdata as R

TINY = 1e-12


def star_cap(level: Column) -> Column:
    """Highest star of an item level."""
    chain = None
    for up_to, stars in R.STAR_LIMITS:
        chain = F.when(level <= up_to, stars) if chain is None else chain.when(level <= up_to, stars)
    return chain.otherwise(R.MAX_STAR)


def _at(values: list, star: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), star)


def raw_cost(star: Column, level: Column) -> Column:
    """Cost of one attempt before rounding: 1000 + level^3 (star + 1) / 36, from star 10 on (star + 1)^2.7 / divisor."""
    cubed = level.cast("long") * level * level
    low = 1000.0 + (cubed * (star + 1)).cast("double") / 36.0
    high = 1000.0 + cubed.cast("double") * F.pow((star + 1).cast("double"), F.lit(2.7)) / _at(R.STAR_DIVISOR, star)
    return F.when(star <= 9, low).otherwise(high)


def stage(star: Column, level: Column, catch: Column, event: Column, discount: Column, prevention: Column) -> Column:
    """struct<p, m, d, c>: chances of success, staying, destruction, and the cost, of one attempt."""
    p = _at(R.STAR_SUCCESS, star)
    d = _at(R.STAR_DESTROY, star) * F.when(event & star.between(15, 21), 0.7).otherwise(1.0)
    safe = prevention & star.between(15, 17)
    m = F.when(safe, 1.0 - p).otherwise(1.0 - p - d)
    d = F.when(safe, 0.0).otherwise(d)
    p2 = F.least(F.lit(1.0), p * 1.05)
    share = F.when(m + d < TINY, 0.0).otherwise(d / (m + d))
    kept = F.when(m + d < TINY, 1.0).otherwise(m / (m + d))
    cost = raw_cost(star, level) * F.when(safe, 3.0).otherwise(1.0) * F.when(discount, 0.7).otherwise(1.0)
    return F.struct(
        F.when(catch, p2).otherwise(p).alias("p"),
        F.when(catch, (1.0 - p2) * kept).otherwise(m).alias("m"),
        F.when(catch, (1.0 - p2) * share).otherwise(d).alias("d"),
        nearest_10(cost).alias("c"),
    )


def _folded(level, start, target, catch, event, discount, prevention, destroys: bool) -> Column:
    """E[start] of reaching ``target``; counts destructions instead of costs if ``destroys``."""
    zero = F.lit(0.0)
    first = F.struct(*(zero.alias(n) for n in ("a", "b", "a12", "b12", "a0", "b0")))
    stars = F.when(target >= 1, F.sequence(target - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    # stages are evaluated once each, before the fold uses their parts again and again
    stages = F.transform(stars, lambda star: F.struct(star.alias("star"), stage(star, level, catch, event, discount, prevention).alias("at")))

    def step(acc: Column, entry: Column) -> Column:
        star, s = entry["star"], entry["at"]
        total = s["p"] + s["d"]
        stuck = total < TINY
        own = s["d"] if destroys else s["c"]
        a = F.when(stuck, zero).otherwise((s["p"] * acc["a"] + s["d"]) / total)
        b = F.when(stuck, zero if destroys else F.lit(1.7976931348623157e308)).otherwise((own + s["p"] * acc["b"]) / total)
        return F.struct(
            a.alias("a"),
            b.alias("b"),
            F.when(star == R.RESET_STAR, a).otherwise(acc["a12"]).alias("a12"),
            F.when(star == R.RESET_STAR, b).otherwise(acc["b12"]).alias("b12"),
            F.when(star == start, a).otherwise(acc["a0"]).alias("a0"),
            F.when(star == start, b).otherwise(acc["b0"]).alias("b0"),
        )

    def close(acc: Column) -> Column:
        closed = F.when(F.abs(1 - acc["a12"]) < TINY, F.lit(1.7976931348623157e308)).otherwise(acc["b12"] / (1 - acc["a12"]))
        reset = F.when(target <= R.RESET_STAR, zero).otherwise(closed)
        return acc["a0"] * reset + acc["b0"]

    return F.aggregate(stages, first, step, close)


def expected_cost(level: Column, start: Column, target: Column, catch: Column, event: Column, discount: Column, prevention: Column) -> Column:
    """Expected cost (whole, half up) from ``start`` to ``target``, which the level's cap bounds; null where it never ends."""
    capped = F.least(target, star_cap(level))
    cost = _folded(level, start, capped, catch, event, discount, prevention, destroys=False)
    return F.when(start >= capped, F.lit(0).cast("decimal(38,0)")).otherwise(F.round(cost.try_cast("decimal(38,6)"), 0).cast("decimal(38,0)"))


def expected_destroys(start: Column, target: Column, catch: Column, event: Column, prevention: Column) -> Column:
    """Expected destructions (two decimals); the target is bounded by 30 alone; null where there is no end to them."""
    capped = F.least(target, F.lit(R.MAX_STAR))
    count = _folded(F.lit(200), start, capped, catch, event, F.lit(False), prevention, destroys=True)
    return F.when(start >= capped, F.lit(0).cast("decimal(38,2)")).otherwise(F.round(count.try_cast("decimal(38,10)"), 2).cast("decimal(38,2)"))


def success_rate(star: Column) -> Column:
    return F.coalesce(_at(R.STAR_SUCCESS, star), F.lit(0.0))


def destroy_rate(star: Column) -> Column:
    return F.coalesce(_at(R.STAR_DESTROY, star), F.lit(0.0))


def cost_table(spark: SparkSession, levels: list[int]) -> DataFrame:
    """From 0 to each level's cap, with and without prevention, other modes on: a table to broadcast."""
    rows = spark.createDataFrame([(x, p) for x in levels for p in (False, True)], "level int, prevention boolean")
    on = F.lit(True)
    rows = rows.withColumn("target", star_cap(F.col("level")))
    return rows.withColumn("cost", expected_cost(F.col("level"), F.lit(0), F.col("target"), on, on, on, F.col("prevention")))


_TEN = Context(prec=10, rounding=ROUND_HALF_UP)
_EXACT = Context(prec=60, rounding=ROUND_HALF_UP)


def noljang_tries(star: int, catch: bool = True) -> tuple[Decimal, Decimal]:
    """Expected attempts and failures at a star, to ten significant digits."""
    rate = min(R.NOLJANG_SUCCESS[star] * 1.05, 1.0) if catch else R.NOLJANG_SUCCESS[star]
    success = Decimal(repr(rate))
    return _TEN.divide(Decimal(1), success), _TEN.divide(Decimal(repr(1.0 - rate)), success)


def noljang_star_cost(star: int, level: int, catch: bool, discount: bool) -> Decimal:
    """Expected cost of one star of the chain that only fails; quotients have ten significant digits."""
    cubed = max(1, level) ** 3
    if star < 10:
        part = _TEN.divide(Decimal(cubed * (star + 1)), Decimal(36))
    else:
        power = Decimal(repr(math.pow(star + 1, 2.7)))
        part = _TEN.divide(_EXACT.multiply(Decimal(cubed), power), Decimal(R.STAR_DIVISOR[star]))
    hundreds = ((1000 + part) / 100).quantize(Decimal(1), rounding=ROUND_HALF_UP)
    attempt = hundreds * 100 * (Decimal("0.7") if discount else 1)
    tries, fails = noljang_tries(star, catch)
    return _EXACT.add(_EXACT.multiply(attempt, tries), _EXACT.multiply(Decimal(R.NOLJANG_FAIL_COST), fails))


def noljang_table(spark: SparkSession, levels: range = range(1, 301), catch: bool = True, discount: bool = True) -> DataFrame:
    """level, star, cost: built by the rule above; 15 rows a level, to be broadcast."""
    rows = [(x, s, noljang_star_cost(s, x, catch, discount)) for x in levels for s in range(15)]
    return spark.createDataFrame(rows, "level int, star int, cost decimal(38,18)")


def noljang_cost(items: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cost: sum over the stars from ``start`` up to ``target`` (15 at most), rounded half up."""
    target = F.least(F.col("target"), F.lit(15))
    wanted = items.select(*keys, "level", "start", target.alias("__target")).withColumn(
        "star", F.explode_outer(F.when((F.col("start") >= 0) & (F.col("start") < F.col("__target")), F.sequence(F.col("start"), F.col("__target") - 1)))
    )
    joined = wanted.join(F.broadcast(table), ["level", "star"], "left")
    return joined.groupBy(*keys).agg(F.round(F.coalesce(F.sum("cost"), F.lit(0)), 0).cast("decimal(38,0)").alias("cost"))
