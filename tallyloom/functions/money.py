"""Money text and roundings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of money text, largest first.
UNITS = [("조", 1_000_000_000_000), ("억", 100_000_000), ("만", 10_000)]


def _whole(amount: Column) -> Column:
    """Half up to a whole number, as an exact decimal."""
    return F.round(amount.cast("decimal(30,4)"), 0).cast("decimal(30,0)")


def money_text(amount: Column) -> Column:
    """``12조 3456억 7890만``; below one 만, zero, negative and null are ``0``."""
    whole = _whole(amount)
    jo = F.floor(whole / UNITS[0][1])
    eok = F.floor(F.pmod(whole, F.lit(UNITS[0][1])) / UNITS[1][1])
    man = F.floor(F.pmod(whole, F.lit(UNITS[1][1])) / UNITS[2][1])
    parts = [F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for n, (u, _) in zip((jo, eok, man), UNITS, strict=True)]
    text = F.concat_ws(" ", *parts)
    return F.when(amount.isNull() | (amount <= 0) | (text == ""), F.lit("0")).otherwise(text)


def money_compact(amount: Column) -> Column:
    """``12.3조``: one decimal, half up, without trailing zeros."""
    whole = _whole(amount)
    chain = F.when(amount.isNull() | (amount <= 0), F.lit("0"))
    for unit, size in UNITS:
        scaled = F.round((whole / F.lit(size)).cast("decimal(38,10)"), 1).cast("decimal(30,1)").cast("string")
        chain = chain.when(whole >= size, F.concat(F.regexp_replace(scaled, r"\.0$", ""), F.lit(unit)))
    return chain.otherwise(whole.cast("string"))


def money_comma(amount: Column) -> Column:
    return F.coalesce(F.format_number(_whole(amount), 0), F.lit("0"))


def nearest_10(value: Column) -> Column:
    """floor((x + 5) / 10) * 10 of a double."""
    return F.floor((value + 5) / 10.0).cast("double") * 10


def nearest_100(value: Column) -> Column:
    """Half up to hundreds of a decimal."""
    return F.round(value / 100, 0) * 100


def half_up(value: Column, digits: int) -> Column:
    return F.round(value.cast("decimal(38,10)"), digits)


def metric_2dp(value: Column) -> Column:
    """Two decimals by floor(x * 100 + 0.5); null, NaN and infinities are 0."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.floor(value * 100 + 0.5) / 100.0).otherwise(0.0)
