"""Discrete distributions: building, checking, convolving and reading tails.

A distribution is long, rows (dist_id, slot, value, prob), or packed, an array of
struct<value, prob>. Parameter tuples should be made distinct first, computed once and
joined back (``once_per_tuple``).
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.session import cut

TOLERANCE = 1e-12
NEGATIVE = -1e-15


def once_per_tuple(df: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame], max_broadcast: int = 1_000_000) -> DataFrame:
    """Compute distinct key tuples once and join the results back to every row.

    The tuples are found by one scan of the keys, combined before the shuffle, and cut off
    from it, so ``compute`` may read them again and again. Up to ``max_broadcast`` results
    are broadcast: the rows themselves aren't shuffled, however few and hot the tuples are.
    """
    results = cut(compute(cut(df.select(*keys).distinct())))
    side = results.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    side = F.broadcast(side) if results.count() <= max_broadcast else side
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"__key_{k}")) for k in keys]  # a null is a value like any other
    return df.join(side, on, "left").drop(*(f"__key_{k}" for k in keys))


def kahan_sum(values: Column) -> Column:
    """Compensated sum of an array of doubles."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("lost"))

    def add(acc: Column, v: Column) -> Column:
        y = v - acc["lost"]
        t = acc["sum"] + y
        return F.struct(t.alias("sum"), ((t - acc["sum"]) - y).alias("lost"))

    return F.aggregate(values, zero, add, lambda acc: acc["sum"])


def group_mass(rates: DataFrame, keys: list[str], order: str, rate: str = "rate") -> DataFrame:
    """keys, mass: compensated sum of each group's rates in a fixed order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(rate))))
    return rates.groupBy(*keys).agg(kahan_sum(F.transform(ordered, lambda x: x[rate])).alias("mass"))


def normaliser(mass: Column, lenient: bool = False) -> Column:
    """1 where the mass is 1 within 1e-12; otherwise the mass if lenient, else an error. Mass 0 is an error."""
    off = F.abs(mass - 1) > TOLERANCE
    bad = (mass <= 0) if lenient else off
    message = F.concat(F.lit("bad probability mass "), mass.cast("string"))
    return F.when(bad, F.raise_error(message).cast("double")).when(off, mass).otherwise(F.lit(1.0))


def slot_pmf(rates: DataFrame, keys: list[str], order: str, contribution: str = "value", rate: str = "rate", lenient: bool = False) -> DataFrame:
    """keys, value, prob: rates summed by contribution and normalised (options that give nothing are value 0)."""
    mass = group_mass(rates, keys, order, rate).withColumn("__norm", normaliser(F.col("mass"), lenient))
    joined = rates.join(mass, keys)
    return joined.groupBy(*keys, F.col(contribution).alias("value")).agg(F.sum(F.col(rate) / F.col("__norm")).alias("prob"))


def with_empty_groups(pmf: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Groups without rows get the distribution {0: 1}."""
    missing = wanted.select(*keys).distinct().join(pmf.select(*keys).distinct(), keys, "left_anti")
    return pmf.unionByName(missing.withColumn("value", F.lit(0).cast(pmf.schema["value"].dataType)).withColumn("prob", F.lit(1.0)))


def invariants(pmf: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mass and whether the group breaks a law: mass, negative, not finite, over one."""
    p = F.col("prob")
    odd = F.isnan(p) | (F.abs(p) == float("inf"))
    return pmf.groupBy(*keys).agg(
        F.sum("prob").alias("mass"),
        (F.abs(F.sum("prob") - 1) > TOLERANCE).alias("bad_mass"),
        F.bool_or(p < NEGATIVE).alias("has_negative"),
        F.bool_or(odd).alias("has_odd"),
        F.bool_or(p > 1 + TOLERANCE).alias("has_over_one"),
    )


def convolve(pmfs: DataFrame, targets: DataFrame, slots: int = 3, clamp: bool = True) -> DataFrame:
    """dist_id, target, value, prob: the sum of ``slots`` slot values.

    One join on dist_id and one sum per slot; with ``clamp`` values over the target
    fall into it, so a group never holds more than target + 1 rows.
    """
    checked = pmfs.withColumn(
        "value", F.when(F.col("value") < 0, F.raise_error(F.lit("negative contribution")).cast("int")).otherwise(F.col("value"))
    )
    state = targets.select("dist_id", "target", F.lit(0).alias("value"), F.lit(1.0).alias("prob"))
    for slot in range(1, slots + 1):
        own = checked.where(F.col("slot") == slot).select("dist_id", F.col("value").alias("v"), F.col("prob").alias("p"))
        total = F.col("value") + F.col("v")
        state = (
            state.join(own, "dist_id")
            .groupBy("dist_id", "target", (F.least(total, F.col("target")) if clamp else total).alias("value"))
            .agg(F.sum(F.col("prob") * F.col("p")).alias("prob"))
        )
    return state


def convolve_packed(slots: Column, target: Column) -> Column:
    """Dense array of P(sum = t) for t in 0..target, the last one P(sum >= target).

    ``slots`` is array<array<struct<value, prob>>>; all on the JVM, without a shuffle.
    """
    cells = F.sequence(F.lit(0), target)
    start = F.transform(cells, lambda t: F.when(t == 0, F.lit(1.0)).otherwise(F.lit(0.0)))

    def place(dense: Column, pmf: Column) -> Column:
        def at(t: Column) -> Column:
            def gain(acc: Column, x: Column) -> Column:
                exact = F.coalesce(F.when(t >= x["value"], F.get(dense, t - x["value"])), F.lit(0.0))
                # the last cell gathers every start from target - value on
                tail = F.aggregate(
                    F.slice(dense, F.greatest(target - x["value"], F.lit(0)) + 1, F.size(dense)), F.lit(0.0), lambda s, v: s + v
                )
                return acc + x["prob"] * F.when(t == target, tail).otherwise(exact)

            return F.aggregate(pmf, F.lit(0.0), gain)

        return F.transform(cells, at)

    return F.aggregate(slots, start, place)


def tail(distribution: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p: P(value >= target)."""
    return distribution.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("value") >= F.col("target"), F.col("prob"))), F.lit(0.0)).alias("p")
    )


def survival(distribution: DataFrame, keys: list[str]) -> DataFrame:
    """The distribution with P(X >= value) for each of its values."""
    window = W.partitionBy(*keys).orderBy("value").rowsBetween(W.currentRow, W.unboundedFollowing)
    return distribution.withColumn("survival", F.sum("prob").over(window))


def expected_trials(p: Column) -> Column:
    """1 / p; infinite where p is 0 or less."""
    return F.when(p <= 0, F.lit(float("inf"))).otherwise(1 / p)


def expected_trials_ceil(p: Column) -> Column:
    return F.when(p <= 0, F.lit((1 << 63) - 1)).otherwise(F.ceil(1 / p))


def slots_of(items: DataFrame, slots: int = 3) -> DataFrame:
    """Every item once for each slot 1..slots."""
    return items.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(slots))))


def option_rate(option: Column, rate: Column) -> Column:
    """A looked-up rate: blank or unknown lines are 1, absent ones 0."""
    free = option.isNull() | (F.trim(option) == "") | (option == "UNKNOWN")
    return F.when(free, F.lit(1.0)).otherwise(F.coalesce(rate, F.lit(0.0)))


def permutation_trials(items: DataFrame, rates: DataFrame, key: str = "item_id", options: str = "options", order: str | None = None) -> DataFrame:
    """key, p, trials: chance of a set of three lines in any order, each order once.

    ``rates`` has (slot, option, rate), already restricted to the item's group or joined
    by its ``dist_id``. Of several rates of a slot and an option the first by ``order`` (a
    column of ``rates``) counts, the least one without it. Wildcard lines count 1, so p may
    exceed 1, as documented.
    """
    orders = F.array(*(F.array(*(F.lit(i) for i in p)) for p in permutations(range(3))))
    lines = F.array_distinct(F.transform(orders, lambda o: F.transform(o, lambda i: F.coalesce(F.get(F.col(options), i), F.lit("")))))
    wanted = items.select(key, *(["dist_id"] if "dist_id" in items.columns else []), F.posexplode(lines).alias("order", "line"))
    spread = wanted.select("*", F.posexplode("line").alias("at", "option")).withColumn("slot", F.col("at") + 1)
    on = ["slot", "option", *(["dist_id"] if "dist_id" in rates.columns else [])]
    first = rates.groupBy(*on).agg((F.min_by("rate", F.struct(order, "rate")) if order else F.min("rate")).alias("rate"))
    looked = spread.join(first, on, "left").withColumn("r", option_rate(F.col("option"), F.col("rate")))
    per_order = looked.groupBy(key, "order").agg(F.product("r").alias("p"))
    return per_order.groupBy(key).agg(F.sum("p").alias("p")).withColumn("trials", expected_trials(F.col("p")))


def infer_target(lines: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, stat, total, confidence: the stat with the largest sum of contributions.

    ``lines`` has (key, stat, value). All-stat per cent counts for the four main stats and
    not itself; the earlier stat in ``order`` wins ties; sums of 0 or less give no row.
    """
    main = [f"{m}_PERCENT" for m in ("STR", "DEX", "INT", "LUK")]
    spread = lines.withColumn(
        "stat", F.explode(F.when(F.col("stat") == "ALLSTAT_PERCENT", F.array(*map(F.lit, main))).otherwise(F.array("stat")))
    )
    sums = spread.groupBy(key, "stat").agg(F.sum("value").alias("total"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("stat"))
    window = W.partitionBy(key)
    ranked = sums.withColumn("__all", F.sum("total").over(window)).withColumn(
        "__rn", F.row_number().over(window.orderBy(F.desc("total"), rank))
    )
    return ranked.where("__rn = 1 and total > 0").select(key, "stat", "total", (F.col("total") / F.col("__all")).alias("confidence"))


def compound(lines: DataFrame, key: str) -> DataFrame:
    """key, is_compound: two valid categories or more; ``lines`` has (key, category)."""
    valid = F.when(F.col("category") != "OTHER", F.col("category"))
    return lines.groupBy(key).agg((F.count_distinct(valid) >= 2).alias("is_compound"))


def dispatch(items: DataFrame, dp: DataFrame, v1: DataFrame, key: str = "item_id") -> DataFrame:
    """Trials by the engine that fits each item, and the drift between both where both have a result."""
    both = items.join(dp.select(key, F.col("trials").alias("dp_trials")), key, "left").join(
        v1.select(key, F.col("trials").alias("v1_trials")), key, "left"
    )
    return both.withColumn("trials", F.when(F.col("is_dp"), F.col("dp_trials")).otherwise(F.col("v1_trials"))).withColumn(
        "drift", F.abs(F.col("v1_trials") - F.col("dp_trials"))
    )
