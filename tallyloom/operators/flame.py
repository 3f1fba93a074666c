"""Bonus draws: k of n options, each with a stage; chance that the score reaches a target."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import refdata as R


def level_bucket(level: Column) -> Column:
    """The largest bucket that the level reaches; 100 below that."""
    chain = None
    for bucket in sorted(R.FLAME_BUCKETS, reverse=True):
        chain = F.when(level >= bucket, bucket) if chain is None else chain.when(level >= bucket, bucket)
    return chain.otherwise(min(R.FLAME_BUCKETS))


def weapon_attack(level: Column, stage: Column, base: Column) -> Column:
    """floor((level / 40 + 1) * stage * (1 + 0.1 (stage - 3)) * base), the first quotient whole."""
    factor = (F.floor(level / 40) + 1) * stage * (1.0 + 0.1 * (stage - 3))
    return F.floor(factor * base).cast("int")


def weapon_boss_damage(stage: Column) -> Column:
    return stage * 2


def job_weights(df: DataFrame, weights: DataFrame, job: str = "job") -> DataFrame:
    """Weights of each row's class; unknown and blank classes are STR with DEX."""
    usual = dict(zip(R.WEIGHTS, R.job_weights("STR", "DEX"), strict=True))
    joined = df.join(F.broadcast(weights.withColumnRenamed("job", "__job")), F.col(job) == F.col("__job"), "left").drop("__job")
    return joined.withColumns({f"w_{w.lower()}": F.coalesce(f"w_{w.lower()}", F.lit(v)) for w, v in usual.items()})


def is_boss_item(name: Column, weapon: Column) -> Column:
    def starts(prefixes: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for prefix in prefixes:
            found = found | name.startswith(prefix)
        return found

    armour = starts(R.BOSS_ARMOUR) | name.isin(*R.BOSS_ACCESSORIES)
    return F.coalesce(F.when(weapon, starts(R.BOSS_WEAPONS)).otherwise(armour), F.lit(False))


def score(option: Column, value: Column, level: Column, stage: Column, weapon: Column, base_att: Column, base_mag: Column) -> Column:
    """Weighted score of an option at a stage, null where there is no such stage; weights are columns ``w_*``."""

    def w(name: str) -> Column:
        return F.col(f"w_{name.lower()}")

    chain = F.when(weapon & (option == "ATT"), weapon_attack(level, stage, base_att) * w("ATT"))
    chain = chain.when(weapon & (option == "MAG"), weapon_attack(level, stage, base_mag) * w("MAG"))
    chain = chain.when(weapon & (option == "BOSS_DMG_PCT"), weapon_boss_damage(stage) * w("BOSS_DMG_PCT"))
    for pair in R.PAIRS:
        one, two = pair.split("_")
        chain = chain.when(option == pair, value * (w(one) + w(two)))
    for single in R.WEIGHTS:
        chain = chain.when(option == single, value * w(single))
    return chain.otherwise(value * 0)


def option_pmfs(items: DataFrame, key: str) -> DataFrame:
    """key, position, score, prob: the score distribution of every option an item can draw.

    ``items`` has key, level, weapon, boss, flame_type, base_att, base_mag and the
    weights. An option without a value at a stage that can be rolled leaves the pool.
    """
    spark = items.sparkSession
    rolled = (
        items.join(F.broadcast(R.flame_stage_table(spark)), ["flame_type", "boss"])
        .join(F.broadcast(R.flame_option_table(spark)), "weapon")
        .withColumn("bucket", level_bucket(F.col("level")))
        .join(F.broadcast(R.flame_value_table(spark)), ["bucket", "option", "stage"], "left")
    )
    columns = ("option", "value", "level", "stage", "weapon", "base_att", "base_mag")
    scored = rolled.withColumn("score", score(*map(F.col, columns)))
    whole = scored.groupBy(key, "position").agg(F.bool_and(F.col("score").isNotNull()).alias("__whole")).where("__whole")
    return scored.join(whole.drop("__whole"), [key, "position"]).groupBy(key, "position", "score").agg(F.sum("prob").alias("prob"))


def subset_tail(pmfs: list[dict[int, float]], k: int, target: int) -> np.ndarray:
    """P(sum of r drawn options >= target), for r in 0..k, times C(n, r): a row per option, whole arrays at once."""
    table = np.zeros((k + 1, target + 1))
    table[0, 0] = 1.0
    for pmf in pmfs:
        drawn = np.zeros_like(table)
        for value, prob in pmf.items():
            step = min(value, target)
            shifted = np.zeros_like(table)
            shifted[1:, step:] = table[:-1, : target + 1 - step]
            if step:
                shifted[1:, target] += table[:-1, target + 1 - step :].sum(axis=1)
            drawn += prob * shifted
        table += drawn
    return table[:, target]


def draw_chance(pmfs: list[dict[int, float]], target: int, boss: bool, k: int = 4) -> float | None:
    """Chance of one draw: k options at once for bosses, else 1..4 with equal chances (a fourth each, whatever n is)."""
    n = len(pmfs)
    if not n:
        return None
    if target <= 0:
        return 1.0
    if boss:
        return 0.0 if k > n else float(subset_tail(pmfs, k, target)[k] / comb(n, k))
    most = min(k, n)
    tails = subset_tail(pmfs, most, target)
    return float(sum(tails[r] / comb(n, r) for r in range(1, most + 1)) / 4.0)


def flame_trials(items: DataFrame, pmfs: DataFrame, key: str) -> DataFrame:
    """key, p, trials; null where nothing can be drawn or the target is out of reach.

    Items should be distinct parameter tuples. One item's distributions (21 options of
    5 scores at most) travel as one row to an Arrow function; the table of the
    recurrence has 5 x (target + 1) numbers.
    """
    packed = pmfs.groupBy(key).agg(F.collect_list(F.struct("position", "score", "prob")).alias("pmf"))
    joined = items.select(key, "target", "boss").join(packed, key, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chances = []
            for target, boss, rows in zip(batch["target"], batch["boss"], batch["pmf"], strict=True):
                options: dict[int, dict[int, float]] = {}
                for r in rows if rows is not None else ():
                    options.setdefault(r["position"], {})[r["score"]] = r["prob"]
                chances.append(draw_chance([options[i] for i in sorted(options)], int(target), bool(boss)))
            yield pd.DataFrame({key: batch[key], "p": pd.Series(chances, dtype="float64")})

    kind = items.schema[key].dataType.simpleString()
    found = joined.mapInPandas(run, f"`{key}` {kind}, p double")
    found = found.withColumn("p", F.when(~F.isnan("p"), F.col("p")))
    return found.withColumn("trials", F.when(F.col("p") > 0, 1.0 / F.col("p")))


def current_score(columns: dict[str, Column]) -> Column:
    """Score of given bonus values: the dot product with the weights ``w_*``; absent ones are 0."""
    total = F.lit(0)
    for name, value in columns.items():
        total = total + F.coalesce(value, F.lit(0)) * F.col(f"w_{name.lower()}")
    return total


def reachable_target(score_now: Column) -> Column:
    """The target to roll for; a score of 0 or less has none."""
    return F.when(score_now > 0, score_now)


def binomial(n: Column, k: Column) -> Column:
    """C(n, k) as an exact fold; 0 outside 0..n."""
    low = F.least(k, n - k)
    folded = F.aggregate(
        F.when(low >= 1, F.sequence(F.lit(0), (low - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.lit(1).cast("long"),
        lambda acc, i: F.floor(acc * (n.cast("long") - i) / (i + 1)).cast("long"),
    )
    return F.when((k < 0) | (k > n), F.lit(0).cast("long")).otherwise(folded)
