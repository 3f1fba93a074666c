"""Relational operators: predicates, joins, pages, merges and counts.

Time and randomness come in as columns or parameters and ties are broken by a full
order. Nothing is collected; sides are counted where a bound is checked, and
``row_numbers`` cuts its ranges to a table.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.operators.stateful import fold
from tallyloom.session import cut, cut_to_table

# --- predicates ---------------------------------------------------------------


def has_text(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))


def is_dp_mode(target_stat: Column, min_total: Column) -> Column:
    """A target stat and a positive minimum."""
    return F.coalesce(target_stat.isNotNull() & (target_stat != "UNKNOWN") & (min_total > 0), F.lit(False))


def is_other_chain(scroll_flag: Column) -> Column:
    return F.coalesce(scroll_flag == "사용", F.lit(False))


def is_fresh(updated_at: Column, as_of: Column, ttl: str) -> Column:
    """Updated after as_of - ttl (an interval such as ``15 minutes``)."""
    return F.coalesce(updated_at > as_of - F.expr(f"INTERVAL {ttl}"), F.lit(False))


def is_stale(updated_at: Column, as_of: Column, ttl: str) -> Column:
    return ~is_fresh(updated_at, as_of, ttl)


def matches_label(value: Column, pattern: str) -> Column:
    """Whole-value regular expression, as label matchers have it."""
    return F.coalesce(value.rlike(f"^(?:{pattern})$"), F.lit(False))


def exceeds(value: Column, threshold: Column, comparator: Column) -> Column:
    """Dispatch on a comparator column; unknown ones mean greater, equality has a tolerance of 1e-4."""
    return (
        F.when(comparator.isin(">=", "gte"), value >= threshold)
        .when(comparator.isin("<", "lt"), value < threshold)
        .when(comparator.isin("<=", "lte"), value <= threshold)
        .when(comparator.isin("==", "eq"), F.abs(value - threshold) < 1e-4)
        .otherwise(value > threshold)
    )


def due_rows(rows: DataFrame, statuses: list[str], as_of: Column, n: int, order: str = "id") -> DataFrame:
    """Rows of some statuses whose time has come, in order, at most ``n``."""
    return rows.where(F.col("status").isin(statuses) & (F.col("next_retry_at") <= as_of)).orderBy(order).limit(n)


def stalled_rows(rows: DataFrame, as_of: Column, stale: str = "5 minutes", n: int = 100, order: str = "id") -> DataFrame:
    late = F.col("locked_at") < as_of - F.expr(f"INTERVAL {stale}")
    return rows.where((F.col("status") == "PROCESSING") & late).orderBy(order).limit(n)


# --- joins --------------------------------------------------------------------


def rate_lookup(items: DataFrame, table: DataFrame, version: str | None = None) -> DataFrame:
    """Rows of the probability table for each item: five equal keys, and a table version if one is named."""
    if version is not None and "table_version" in table.columns:
        table = table.where(F.col("table_version") == version).drop("table_version")
    return items.join(table, ["cube_type", "level", "part", "grade", "slot"])


def fetch_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left outer fetch; rows without a partner stay."""
    return left.join(right, key, "left")


def existing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_semi")


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def floor_join(rows: DataFrame, tiers: DataFrame, value: str, floor: str, max_broadcast: int = 100_000) -> DataFrame:
    """Each row with the tier of the greatest floor not above its value; the lowest tier below that.

    Floors become ranges [lo, hi), so the join is on a range and each row meets one tier.
    The tiers are broadcast up to a checked number. Past it the different values and the
    floors are sorted together by ranges, and each value takes the last floor before it.
    """
    if tiers.count() > max_broadcast:
        return _floor_join_sorted(rows, tiers, value, floor)
    order = W.orderBy(floor)
    ranged = tiers.withColumn("__hi", F.lead(floor).over(order)).withColumn(
        "__lo", F.when(F.row_number().over(order) > 1, F.col(floor))
    )
    side = F.broadcast(ranged)
    v = F.col(value)
    on = (F.col("__lo").isNull() | (v >= F.col("__lo"))) & (F.col("__hi").isNull() | (v < F.col("__hi")))
    return rows.join(side, on, "left").drop("__lo", "__hi")


def _floor_join_sorted(rows: DataFrame, tiers: DataFrame, value: str, floor: str) -> DataFrame:
    """``floor_join`` without a broadcast of the tiers; floors must differ."""
    marks = rows.select(F.col(value).alias("__v")).where("__v is not null").distinct().withColumn("__floor", F.lit(None).cast(tiers.schema[floor].dataType))
    marks = marks.unionByName(tiers.select(F.col(floor).alias("__v"), F.col(floor).alias("__floor")))
    ranged = cut_to_table(marks.repartitionByRange("__v").withColumn("__p", F.spark_partition_id()), "marks")
    # equal values lie in one range; a range begins with the greatest floor of those before it
    tops = ranged.groupBy("__p").agg(F.max("__floor").alias("__top"))
    before = F.max("__top").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
    carried = F.broadcast(tops.select("__p", before.alias("__before")))  # one row a range
    own = F.max("__floor").over(W.partitionBy("__p").orderBy("__v"))
    least = F.broadcast(tiers.agg(F.min(floor).alias("__least")))
    found = ranged.withColumn("__own", own).where("__floor is null").join(carried, "__p").crossJoin(least)
    found = found.select("__v", F.coalesce("__own", "__before", "__least").alias("__at"))
    named = rows.join(found, F.col(value) == F.col("__v"), "left").drop("__v")
    return named.join(tiers, F.col("__at") == F.col(floor), "left").drop("__at")


def prefix_join(rows: DataFrame, prefixes: DataFrame, text: str, prefix: str = "prefix", max_broadcast: int = 10_000) -> DataFrame:
    """Rows whose text starts with a prefix of the list, once each.

    The prefixes are broadcast up to a checked number; past it the different texts' beginnings
    of the prefixes' lengths are joined to them by equality.
    """
    if prefixes.count() <= max_broadcast:
        return rows.join(F.broadcast(prefixes), F.col(text).startswith(F.col(prefix)), "left_semi")
    wanted = prefixes.where(F.col(prefix).isNotNull()).select(F.col(prefix).alias("__begin")).distinct()
    lengths = wanted.agg(F.collect_set(F.length("__begin")).alias("__lengths"))
    texts = rows.select(F.col(text).alias("__text")).where("__text is not null").distinct()
    begins = texts.crossJoin(F.broadcast(lengths)).select("__text", F.explode("__lengths").alias("__n"))
    begins = begins.where("__n <= length(__text)").select("__text", F.expr("substring(__text, 1, __n)").alias("__begin"))
    found = begins.join(wanted, "__begin", "left_semi").select("__text").distinct()
    return rows.join(found, F.col(text) == F.col("__text"), "left_semi")


def snapshot_plus_delta(snapshot: DataFrame, deltas: DataFrame, key: str, value: str, delta: str) -> DataFrame:
    """max(0, stored + pending) for every stored row."""
    sums = deltas.groupBy(key).agg(F.sum(delta).alias("__delta"))
    joined = snapshot.join(sums, key, "left")
    return joined.withColumn(value, F.greatest(F.col(value) + F.coalesce("__delta", F.lit(0)), F.lit(0))).drop("__delta")


def ratio(left: DataFrame, right: DataFrame, labels: list[str], scale: float = 1.0) -> DataFrame:
    """left / right of series with equal labels; no row without a partner (see ``or_default``), null for a zero divisor."""
    joined = left.withColumnRenamed("value", "__l").join(right.withColumnRenamed("value", "__r"), labels)
    return joined.select(*labels, (F.try_divide(F.col("__l"), F.col("__r")) * scale).alias("value"))


def fallback_lookup(wanted: DataFrame, known_missing: DataFrame, sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """The value of the first source that has the key; keys known to be missing aren't looked up."""
    rows = wanted.join(known_missing.select(key).distinct(), key, "left_anti")
    names = []
    for i, source in enumerate(sources):
        names.append(f"__v{i}")
        rows = rows.join(source.select(key, F.col(value).alias(names[-1])), key, "left")
    found = F.coalesce(*names) if len(names) > 1 else F.col(names[0])
    return rows.withColumn(value, found).drop(*names)


# --- order, pages, samples ----------------------------------------------------


def top_k(rows: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(score), tie).limit(k)


def top_k_per_group(rows: DataFrame, group: list[str], score: str, k: int, tie: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def offset_page(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(page * size).limit(size)


def keyset_page(rows: DataFrame, key: str, cursor: int | None, size: int) -> DataFrame:
    """The rows after ``cursor``, at most ``size``, with has_next and next_cursor.

    One row more than asked for is read, to see if there is a next page. The filter on
    the key reaches the scan, so a late page costs no more than the first.
    """
    after = rows if cursor is None else rows.where(F.col(key) > cursor)
    taken = after.orderBy(key).limit(size + 1)
    counted = taken.withColumn("__rn", F.row_number().over(W.orderBy(key))).withColumn("__n", F.count("*").over(W.partitionBy()))
    page = counted.where(F.col("__rn") <= size)
    last = F.max(key).over(W.partitionBy())
    return page.withColumn("has_next", F.col("__n") > size).withColumn("next_cursor", F.when(F.col("__n") > size, last)).drop("__rn", "__n")


def sample_n(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows in an order drawn from the key and the seed; the same for the same seed."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def row_numbers(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Numbers 0, 1, ... in the order of a unique key, without one task that sees all rows.

    Rows are dealt out by ranges of the key; each range is numbered by itself and shifted
    by the sizes of the ranges before it, of which there is one row each.
    """
    ranged = cut_to_table(rows.repartitionByRange(F.col(key)).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
    shifts = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__shift"))
    own = F.row_number().over(W.partitionBy("__p").orderBy(key)) - 1
    return ranged.withColumn("__own", own).join(F.broadcast(shifts), "__p").withColumn(name, F.col("__own") + F.col("__shift")).drop("__p", "__own", "__shift")


def chunks(rows: DataFrame, key: str, size: int = 500) -> DataFrame:
    """Chunk number of each row, ``size`` rows of consecutive keys to a chunk."""
    return row_numbers(rows, key, "__n").withColumn("chunk", F.floor(F.col("__n") / size).cast("long")).drop("__n")


# --- merges and mutations -----------------------------------------------------


def merge_latest(stored: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: of rows with equal keys the latest stays, a change before a stored row of the same time, then by a hash of the row."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    rest = F.xxhash64(*(F.col(c).cast("string") for c in stored.columns))  # so that a replay takes the same row
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order), F.desc("__new"), rest))
    return both.withColumn("__rn", rank).where("__rn = 1").drop("__rn", "__new")


def merge_deltas(deltas: DataFrame, key: str, delta: str = "delta") -> DataFrame:
    return deltas.groupBy(key).agg(F.sum(delta).alias(delta))


def debit_if_covered(accounts: DataFrame, debits: DataFrame, account: str, balance: str, amount: str, order: str) -> DataFrame:
    """Each debit in order with whether what is left of the balance covers it; a refused one spends nothing.

    A debit of an unknown account or of no amount is refused.
    """

    def step(left: Decimal | None, row: dict) -> tuple[Decimal | None, bool]:
        left = row[balance] if left is None else left
        wanted = row[amount]
        if left is None or wanted is None or left < wanted:
            return left, False
        return left - wanted, True

    joined = debits.join(accounts.select(account, balance), account, "left")
    return fold(joined, account, [order], step, "accepted", "boolean", needs=[balance, amount]).drop(balance)


def or_default(series: DataFrame, wanted: DataFrame, labels: list[str], value: str = "value", default: float = 0.0) -> DataFrame:
    """The value of every wanted set of labels, ``default`` where the series has none."""
    return wanted.join(series, labels, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def transfers(moves: DataFrame, sender: str, receiver: str, amount: str) -> DataFrame:
    """account, net: credits less debits of every account."""
    out = moves.select(F.col(sender).alias("account"), (-F.col(amount)).alias("__n"))
    into = moves.select(F.col(receiver).alias("account"), F.col(amount).alias("__n"))
    return out.unionAll(into).groupBy("account").agg(F.sum("__n").alias("net"))


def reset_stalled(rows: DataFrame, as_of: Column, stale: str = "5 minutes") -> DataFrame:
    late = (F.col("status") == "PROCESSING") & (F.col("locked_at") < as_of - F.expr(f"INTERVAL {stale}"))
    return rows.withColumns(
        {
            "status": F.when(late, "PENDING").otherwise(F.col("status")),
            "locked_by": F.when(~F.coalesce(late, F.lit(False)), F.col("locked_by")),
            "locked_at": F.when(~F.coalesce(late, F.lit(False)), F.col("locked_at")),
        }
    )


def toggle_parity(events: DataFrame, edge: list[str]) -> DataFrame:
    """Edges toggled an odd number of times are there."""
    return events.groupBy(*edge).agg(F.count("*").alias("n_toggles")).withColumn("liked", F.col("n_toggles") % 2 == 1)


def set_effects(stored: DataFrame, added: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Set union, then difference."""
    return stored.select(*keys).union(added.select(*keys)).distinct().join(removed.select(*keys), keys, "left_anti")


def dead_letters(rows: DataFrame, max_retries: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows that go on, rows that go to the dead letters)."""
    dead = (F.col("status") == "DEAD_LETTER") | (F.col("retry_count") >= max_retries) | ~F.coalesce(F.col("intact"), F.lit(True))
    return rows.where(~dead), rows.where(dead)


def capped(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The last ``most`` rows by order: what a capped stream keeps."""
    return rows.orderBy(F.desc(order)).limit(most)


def reconcile(expected: DataFrame, done: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: expected = done + dead, and by how much it is off."""
    counted = None
    for name, df in (("expected", expected), ("done", done), ("dead", dead)):
        one = df.agg(F.count("*").alias(name))
        counted = one if counted is None else counted.crossJoin(one)  # rows of one
    return counted.withColumn("mismatch", F.col("expected") - F.col("done") - F.col("dead"))


def state_counts(rows: DataFrame, states: list[str], column: str = "status") -> DataFrame:
    """One row: how many rows have each state, and all."""
    return rows.agg(*(F.count_if(F.col(column) == s).alias(f"n_{s.lower()}") for s in states), F.count("*").alias("n_all"))
