"""Option text: numbers, stat kinds, categories and contributions (columns only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stat kinds in order, with keyword, whether per cent, whether one of the four main stats.
STATS: list[tuple[str, str, bool, bool]] = [
    ("STR", "STR", False, True),
    ("DEX", "DEX", False, True),
    ("INT", "INT", False, True),
    ("LUK", "LUK", False, True),
    ("ALL_STAT", "올스탯", False, False),
    ("STR_PERCENT", "STR", True, True),
    ("DEX_PERCENT", "DEX", True, True),
    ("INT_PERCENT", "INT", True, True),
    ("LUK_PERCENT", "LUK", True, True),
    ("ALLSTAT_PERCENT", "올스탯", True, False),
    ("ATTACK_POWER", "공격력", False, False),
    ("MAGIC_POWER", "마력", False, False),
    ("ATTACK_POWER_PERCENT", "공격력", True, False),
    ("MAGIC_POWER_PERCENT", "마력", True, False),
    ("BOSS_DAMAGE", "보스 몬스터 공격 시 데미지", True, False),
    ("IGNORE_DEFENSE", "몬스터 방어율 무시", True, False),
    ("DAMAGE", "데미지", True, False),
    ("CRITICAL_DAMAGE", "크리티컬 데미지", True, False),
    ("COOLDOWN_REDUCTION", "재사용 대기시간", False, False),
    ("ITEM_DROP", "아이템 드롭률", True, False),
    ("MESO_DROP", "메소 획득량", True, False),
    ("HP", "HP", False, False),
    ("HP_PERCENT", "HP", True, False),
    ("LEVEL_STR", "캐릭터 기준 9레벨 당 STR", False, True),
    ("LEVEL_DEX", "캐릭터 기준 9레벨 당 DEX", False, True),
    ("LEVEL_INT", "캐릭터 기준 9레벨 당 INT", False, True),
    ("LEVEL_LUK", "캐릭터 기준 9레벨 당 LUK", False, True),
]
# Phrases that make an option count for nothing, and the two that mark a per-level stat.
PROC_PHRASES = ("피격 시", "오토스틸")
LEVEL_PHRASES = ("캐릭터 기준", "레벨 당")
MAIN = ("STR", "DEX", "INT", "LUK")
# Categories of stat kinds; all others are OTHER, which isn't valid.
CATEGORIES = {
    "STAT": [*MAIN, "ALL_STAT", *(f"{m}_PERCENT" for m in MAIN), "ALLSTAT_PERCENT", *(f"LEVEL_{m}" for m in MAIN)],
    "BOSS_IED": ["BOSS_DAMAGE", "IGNORE_DEFENSE"],
    "ATK_MAG": ["ATTACK_POWER", "MAGIC_POWER", "ATTACK_POWER_PERCENT", "MAGIC_POWER_PERCENT"],
    "CRIT_DMG": ["CRITICAL_DAMAGE"],
    "COOLDOWN": ["COOLDOWN_REDUCTION"],
}
#: Per-cent kinds that are added up under a plain kind.
BASE_KIND = {
    **{f"{m}_PERCENT": m for m in MAIN},
    "ALLSTAT_PERCENT": "ALL_STAT",
    "ATTACK_POWER_PERCENT": "ATTACK_POWER",
    "MAGIC_POWER_PERCENT": "MAGIC_POWER",
    "HP_PERCENT": "HP",
}
# Grades in order, in Korean and as names.
GRADES = {"레어": "RARE", "에픽": "EPIC", "유니크": "UNIQUE", "레전드리": "LEGENDARY"}


def _any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def parse_num(text: Column, strict: bool = False) -> Column:
    """The number in an option; blank or unreadable text is 0.

    All digits and signs are read as one number, so ``9레벨 당 STR +1`` is 91;
    ``strict`` reads the last signed number instead.
    """
    if strict:
        found = F.element_at(F.regexp_extract_all(text, F.lit(r"(-?\d+)"), 1), -1)
        found = F.when(F.regexp_like(text, F.lit(r"\d")), found)
    else:
        found = F.regexp_replace(text, "[^0-9-]", "")
    return F.coalesce(found.try_cast("int"), F.lit(0))


def is_percent(text: Column) -> Column:
    return F.coalesce(text.contains("%"), F.lit(False))


def _literal_kinds(percent: bool) -> Column:
    """(name, keyword) of one unit, longest keyword first, then in order; level kinds left out."""
    kinds = [(n, k) for n, k, p, _ in STATS if p is percent and not n.startswith("LEVEL_")]
    kinds.sort(key=lambda x: -len(x[1]))
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("keyword")) for n, k in kinds))


def all_stats(text: Column) -> Column:
    """Every stat kind of an option, longest keyword first; none for null, empty or proc options.

    A keyword that is found is taken out, so what it holds isn't found again.
    """
    text = F.coalesce(text, F.lit(""))
    level = _any_of(text, LEVEL_PHRASES[:1]) & _any_of(text, LEVEL_PHRASES[1:])
    level_kind = F.coalesce(*(F.when(text.contains(m), F.lit(f"LEVEL_{m}")) for m in MAIN))
    kinds = F.when(is_percent(text), _literal_kinds(True)).otherwise(_literal_kinds(False))
    start = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("hits"))
    folded = F.aggregate(
        kinds,
        start,
        lambda acc, kind: F.when(
            acc["rest"].contains(kind["keyword"]),
            F.struct(
                F.replace(acc["rest"], kind["keyword"], F.lit("")).alias("rest"),
                F.array_append(acc["hits"], kind["name"]).alias("hits"),
            ),
        ).otherwise(acc),
        lambda acc: acc["hits"],
    )
    nothing = F.array().cast("array<string>")
    return (
        F.when((text == "") | _any_of(text, PROC_PHRASES), nothing)
        .when(level & level_kind.isNotNull(), F.array(level_kind))
        .otherwise(folded)
    )


def all_stats_or_unknown(text: Column) -> Column:
    found = all_stats(text)
    return F.when(F.size(found) == 0, F.array(F.lit("UNKNOWN"))).otherwise(found)


def all_stats_strict(text: Column) -> Column:
    """Raises for an option without a stat."""
    found = all_stats(text)
    return F.when(F.size(found) > 0, found).otherwise(
        F.raise_error(F.concat(F.lit("no stat in option: "), F.coalesce(text, F.lit("null")))).cast("array<string>")
    )


def first_stat(text: Column, with_unit: bool = True) -> Column:
    """The first kind, in order, whose keyword is in the option and whose unit agrees.

    Without units, per-cent options are UNKNOWN and only plain kinds are looked at.
    """
    text = F.coalesce(text, F.lit(""))
    chain = F.when((text == "") | _any_of(text, PROC_PHRASES), F.lit("UNKNOWN"))
    if not with_unit:
        chain = chain.when(is_percent(text), F.lit("UNKNOWN"))
    for name, keyword, percent, _ in STATS:
        if with_unit:
            chain = chain.when((is_percent(text) == F.lit(percent)) & text.contains(keyword), F.lit(name))
        elif not percent:
            chain = chain.when(text.contains(keyword), F.lit(name))
    return chain.otherwise(F.lit("UNKNOWN"))


def looks_like_main_stat(text: Column) -> Column:
    upper = F.upper(F.coalesce(text, F.lit("")))
    return _any_of(upper, MAIN) | _any_of(F.coalesce(text, F.lit("")), ("올스탯", "올 스탯"))


def category(kind: Column) -> Column:
    chain = None
    for name, kinds in CATEGORIES.items():
        chain = F.when(kind.isin(kinds), name) if chain is None else chain.when(kind.isin(kinds), name)
    return chain.otherwise("OTHER")


def is_valid_category(kind: Column) -> Column:
    return category(kind) != "OTHER"


def base_kind(kind: Column) -> Column:
    chain = F.when(kind.isNull(), F.lit("UNKNOWN"))
    for percent, plain in BASE_KIND.items():
        chain = chain.when(kind == percent, F.lit(plain))
    return chain.otherwise(kind)


def grade_of(korean: Column) -> Column:
    """Grade name of its Korean text (trimmed); raises for any other."""
    chain = None
    for text, name in GRADES.items():
        hit = F.trim(korean) == text
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(F.raise_error(F.concat(F.lit("unknown grade: "), F.coalesce(korean, F.lit("null")))).cast("string"))


def contributions(text: Column, drift: str = "null") -> Column:
    """array<struct<stat, value>> of an option; every kind gets the option's number.

    An option that looks like a main stat and has no kind has drifted: ``raise`` stops,
    ``null`` gives null for the row, to be set aside.
    """
    kinds = all_stats(text)
    drifted = (F.size(kinds) == 0) & looks_like_main_stat(text)
    value = parse_num(text)
    made = F.transform(kinds, lambda k: F.struct(k.alias("stat"), value.alias("value")))
    kind = "array<struct<stat:string,value:int>>"
    if drift == "raise":
        return F.when(drifted, F.raise_error(F.concat(F.lit("main stat drifted: "), text)).cast(kind)).otherwise(made)
    return F.when(~drifted, made)


def contribution_for(text: Column, target: Column) -> Column:
    """What an option gives to a stat: its own value, else that of all-stat per cent for a main stat, else 0."""
    made = F.coalesce(contributions(text), F.array().cast("array<struct<stat:string,value:int>>"))
    own = F.filter(made, lambda c: c["stat"] == target)
    shared = F.filter(made, lambda c: c["stat"] == "ALLSTAT_PERCENT")
    main = target.isin([n for n, _, _, single in STATS if single])
    return (
        F.when(F.size(own) > 0, F.get(own, 0)["value"])
        .when(main & (F.size(shared) > 0), F.get(shared, 0)["value"])
        .otherwise(0)
    )
