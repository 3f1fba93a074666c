"""Item costs, preset roll-ups and the dearest preset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import refdata as R

COSTS = ("black_cube_cost", "red_cube_cost", "additional_cube_cost", "starforce_cost")


def cube_cost(items: DataFrame, cube_type: str = "cube_type", level: str = "level", grade: str = "grade") -> DataFrame:
    """Price of one cube: floor join of the level into ranges made beforehand."""
    table = R.cube_cost_table(items.sparkSession).withColumnsRenamed({"cube_type": "__t", "grade": "__g"})
    on = (F.col(cube_type) == F.col("__t")) & (F.col(grade) == F.col("__g")) & (F.col(level) >= F.col("lo")) & (F.col(level) < F.col("hi"))
    return items.join(F.broadcast(table), on, "left").drop("__t", "__g", "lo", "hi").withColumnRenamed("cost", "cube_cost")


def trial_cost(trials: Column, unit: Column, rounded: bool = True) -> Column:
    """Trials, half up (or cut off), times the price; endless trials cost nothing."""
    finite = F.when(F.abs(trials) != float("inf"), trials).otherwise(F.lit(0.0))
    whole = F.round(finite.cast("decimal(30,10)"), 0) if rounded else F.floor(finite)
    return (whole.cast("decimal(20,0)") * unit).cast("decimal(38,2)")


def path_text(base: Column, steps: list[tuple[str, Column]]) -> Column:
    """``base > step > step``, with the steps that cost something."""
    shown = [F.when(cost > 0, F.lit(name)) for name, cost in steps]
    return F.concat_ws(" > ", base, *shown)


def is_ready(part: Column, grade: Column, lines: Column) -> Column:
    """Part and grade there, three lines, one of them valid (``null`` as text is missing)."""
    blank = lambda c: c.isNull() | (F.trim(c) == "") | (c == "null")
    return F.coalesce(~blank(part) & ~blank(grade) & (F.size(lines) == 3) & F.exists(lines, lambda x: ~blank(x)), F.lit(False))


def preset_costs(items: DataFrame, owner: str, preset: str, costs: tuple[str, ...] = COSTS, listed: list[str] | None = None) -> DataFrame:
    """Sums of all cost parts for each preset, and their total; ``listed`` columns come as a sorted array of items."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("decimal(38,2)").alias(c) for c in costs]
    if listed:
        sums.append(F.array_sort(F.collect_list(F.struct(*listed))).alias("items"))
    sums = items.groupBy(owner, preset).agg(*sums, F.count("*").alias("n_items"))
    total = F.lit(0).cast("decimal(38,2)")
    for c in costs:
        total = total + F.col(c)
    return sums.withColumn("total_cost", total.cast("decimal(38,2)"))


def dearest_preset(presets: DataFrame, owner: str, preset: str, cost: str = "total_cost") -> DataFrame:
    """One row per owner: the preset of the largest cost; the first wins ties."""
    place = F.struct(F.col(cost).isNull(), -F.col(cost), F.col(preset))
    rest = [c for c in presets.columns if c != owner]
    best = presets.groupBy(owner).agg(F.min_by(F.struct(*rest), place).alias("__best"))  # combined before the shuffle, unsorted
    return best.select(*(F.col(owner) if c == owner else F.col(f"__best.{c}").alias(c) for c in presets.columns))


def secondary_part(slot: Column, part: Column) -> Column:
    """Part of the probability table: shields and soul rings have one of their own."""
    shield = F.coalesce(F.trim(part).contains("포스실드") | F.trim(part).contains("소울링"), F.lit(False))
    return F.when(F.coalesce(slot != "보조무기", F.lit(True)), slot).when(shield, "포스실드").otherwise("보조무기")


def starforce_summary(level: Column, star: Column, target: Column) -> Column:
    """struct of costs (to hundreds) and destructions from ``star`` to ``target``, with and without prevention."""
    from tallyloom.functions.money import nearest_100
    from tallyloom.operators.starforce import expected_cost, expected_destroys

    on = F.lit(True)
    parts = []
    for name, safe in (("plain", F.lit(False)), ("safe", F.lit(True))):
        cost = nearest_100(expected_cost(level, star, target, on, on, on, safe).cast("decimal(30,0)"))
        parts += [cost.cast("decimal(30,0)").alias(f"{name}_cost"), expected_destroys(star, target, on, on, safe).alias(f"{name}_destroys")]
    return F.struct(*parts)


def of_preset(presets: Column, number: Column) -> Column:
    """The entries of a nested array that belong to one preset; filter rows before computing where that can be done."""
    return F.filter(presets, lambda p: p["preset_no"] == number)
