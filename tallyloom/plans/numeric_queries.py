"""Distributions, upgrade chains, bonus draws and valuation over the star schema.

The probability tables are synthetic: weights made from brand, slot and value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import options as O
from tallyloom.operators import distributions as D
from tallyloom.operators import flame as FL
from tallyloom.operators import refdata as REF
from tallyloom.operators import starforce as S
from tallyloom.operators import valuation as V
from tallyloom.plans.registry import query
from tallyloom.sources import read_table

VALUES = (0, 3, 6, 9)
_RATES = """rates AS (
    SELECT b AS dist_id, slot, v AS value, 1 + (b * 7 + slot * 3 + v) % 5 AS w FROM
      (SELECT DISTINCT CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS b FROM part), (VALUES (1), (2), (3)) s(slot), (VALUES (0), (3), (6), (9)) t(v)),
    pmf AS (SELECT dist_id, slot, value, CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY dist_id, slot) AS prob FROM rates)"""


def _rates(spark: SparkSession, folder: str) -> DataFrame:
    brands = read_table(spark, folder, "part").select(F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("dist_id")).distinct()
    slots = D.slots_of(brands).withColumn("value", F.explode(F.array(*map(F.lit, VALUES))))
    return slots.withColumn("rate", (1 + (F.col("dist_id") * 7 + F.col("slot") * 3 + F.col("value")) % 5).cast("double"))


def _pmf(spark: SparkSession, folder: str) -> DataFrame:
    return D.slot_pmf(_rates(spark, folder), ["dist_id", "slot"], "value", lenient=True)


@query("group_mass", f"WITH {_RATES} SELECT dist_id, slot, CAST(sum(w) AS DOUBLE) AS mass FROM rates GROUP BY 1, 2")
def group_mass(spark: SparkSession, folder: str) -> DataFrame:
    return D.group_mass(_rates(spark, folder), ["dist_id", "slot"], "value")


@query("slot_pmf", f"WITH {_RATES} SELECT dist_id, slot, value, round(prob, 9) AS prob FROM pmf")
def slot_pmf(spark: SparkSession, folder: str) -> DataFrame:
    return _pmf(spark, folder).withColumn("prob", F.round("prob", 9))


@query("pmf_invariants", f"""WITH {_RATES} SELECT dist_id, slot, round(sum(prob), 9) AS mass, abs(sum(prob) - 1) > 1e-12 AS bad_mass,
    bool_or(prob < -1e-15) AS has_negative, bool_or(isnan(prob) OR isinf(prob)) AS has_odd, bool_or(prob > 1 + 1e-12) AS has_over_one FROM pmf GROUP BY 1, 2""")
def pmf_invariants(spark: SparkSession, folder: str) -> DataFrame:
    return D.invariants(_pmf(spark, folder), ["dist_id", "slot"]).withColumn("mass", F.round("mass", 9))


_CONVOLVED = f"""{_RATES}, targets AS (SELECT * FROM (VALUES (6), (15), (21)) t(target)),
    conv AS (SELECT a.dist_id, target, least(a.value + b.value + c.value, target) AS value, sum(a.prob * b.prob * c.prob) AS prob
      FROM pmf a JOIN pmf b ON b.dist_id = a.dist_id AND b.slot = 2 JOIN pmf c ON c.dist_id = a.dist_id AND c.slot = 3, targets
      WHERE a.slot = 1 GROUP BY 1, 2, 3)"""


def _convolved(spark: SparkSession, folder: str) -> DataFrame:
    pmf = _pmf(spark, folder)
    targets = pmf.select("dist_id").distinct().withColumn("target", F.explode(F.array(*map(F.lit, (6, 15, 21)))))
    return D.convolve(pmf, targets)


@query("cube_convolve3", f"WITH {_CONVOLVED} SELECT dist_id, target, value, round(prob, 9) AS prob FROM conv")
def cube_convolve3(spark: SparkSession, folder: str) -> DataFrame:
    return _convolved(spark, folder).withColumn("prob", F.round("prob", 9))


@query("cube_convolve_packed", f"WITH {_CONVOLVED} SELECT dist_id, round(sum(prob), 9) AS p FROM conv WHERE target = 15 AND value >= 15 GROUP BY 1")
def cube_convolve_packed(spark: SparkSession, folder: str) -> DataFrame:
    slots = _pmf(spark, folder).groupBy("dist_id", "slot").agg(F.array_sort(F.collect_list(F.struct("value", "prob"))).alias("pmf"))
    packed = slots.groupBy("dist_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "pmf"))), lambda s: s["pmf"]).alias("slots"))
    dense = D.convolve_packed(F.col("slots"), F.lit(15))
    return packed.select("dist_id", F.round(F.get(dense, 15), 9).alias("p"))


@query("tail_survival", f"WITH {_CONVOLVED} SELECT dist_id, target, value, round(sum(prob) OVER (PARTITION BY dist_id, target ORDER BY value DESC), 9) AS survival FROM conv")
def tail_survival(spark: SparkSession, folder: str) -> DataFrame:
    return D.survival(_convolved(spark, folder), ["dist_id", "target"]).select("dist_id", "target", "value", F.round("survival", 9).alias("survival"))


@query("expected_trials", f"""WITH {_CONVOLVED} SELECT dist_id, target, round(sum(CASE WHEN value >= target THEN prob ELSE 0 END), 9) AS p,
    round(1 / sum(CASE WHEN value >= target THEN prob ELSE 0 END), 6) AS trials FROM conv GROUP BY 1, 2""")
def expected_trials(spark: SparkSession, folder: str) -> DataFrame:
    found = D.tail(_convolved(spark, folder), ["dist_id", "target"])
    return found.select("dist_id", "target", F.round("p", 9).alias("p"), F.round(D.expected_trials(F.col("p")), 6).alias("trials"))


@query("rate_lookup", """
    SELECT p_partkey, slot, option, rate FROM part,
      (VALUES ('a', 1, 0.5::DOUBLE), ('b', 1, 0.5), ('a', 2, 0.25), ('b', 2, 0.75)) t(option, slot, rate)""")
def rate_lookup(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.operators.relational import rate_lookup as lookup

    rows = [("BLACK", 200, "cap", "RARE", s, o, r, v) for o, s, r in (("a", 1, 0.5), ("b", 1, 0.5), ("a", 2, 0.25), ("b", 2, 0.75)) for v in ("v1", "v2")]
    table = spark.createDataFrame(rows, "cube_type string, level int, part string, grade string, slot int, option string, rate double, table_version string")
    parts = read_table(spark, folder, "part")
    items = D.slots_of(parts.select("p_partkey", F.lit("BLACK").alias("cube_type"), F.lit(200).alias("level"), F.lit("cap").alias("part"), F.lit("RARE").alias("grade")), 2)
    return lookup(items, table, "v2").select("p_partkey", "slot", "option", "rate")


@query("permutation_v1", f"""WITH {_RATES},
    items AS (SELECT p_partkey AS item_id, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS dist_id,
        [CAST(p_size % 4 * 3 AS VARCHAR), CAST(p_size // 4 % 4 * 3 AS VARCHAR), CAST(p_size // 16 % 4 * 3 AS VARCHAR)] AS o FROM part),
    perms AS (SELECT DISTINCT item_id, dist_id, o[i] AS a, o[j] AS b, o[k] AS c FROM items, (VALUES (1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)) t(i, j, k))
    SELECT item_id, round(sum(x.prob * y.prob * z.prob), 9) AS p, round(1 / sum(x.prob * y.prob * z.prob), 5) AS trials FROM perms
      JOIN pmf x ON x.dist_id = perms.dist_id AND x.slot = 1 AND CAST(x.value AS VARCHAR) = a
      JOIN pmf y ON y.dist_id = perms.dist_id AND y.slot = 2 AND CAST(y.value AS VARCHAR) = b
      JOIN pmf z ON z.dist_id = perms.dist_id AND z.slot = 3 AND CAST(z.value AS VARCHAR) = c GROUP BY 1""")
def permutation_v1(spark: SparkSession, folder: str) -> DataFrame:
    value = lambda n: (F.floor(F.col("p_size") / n) % 4 * 3).cast("int").cast("string")
    items = read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("dist_id"), F.array(value(1), value(4), value(16)).alias("options")
    )
    rates = _pmf(spark, folder).select("dist_id", "slot", F.col("value").cast("string").alias("option"), F.col("prob").alias("rate"))
    keys = ["dist_id", "options"]

    def compute(tuples: DataFrame) -> DataFrame:
        named = tuples.withColumn("item_id", F.struct(*keys))
        return D.permutation_trials(named, rates).select(*(F.col(f"item_id.{k}").alias(k) for k in keys), "p", "trials")

    found = D.once_per_tuple(items, keys, compute)
    return found.select("item_id", F.round("p", 9).alias("p"), F.round("trials", 5).alias("trials"))


#: Option texts, with the kinds, the number and the category count that they stand for.
TEXTS = [
    ("STR +12%", "STR_PERCENT", 12),
    ("STR/DEX +6%", "STR_PERCENT,DEX_PERCENT", 6),
    ("올스탯 +9%", "ALLSTAT_PERCENT", 9),
    ("보스 몬스터 공격 시 데미지 +30%", "BOSS_DAMAGE", 30),
    ("캐릭터 기준 9레벨 당 STR +1", "LEVEL_STR", 91),
    ("피격 시 10% 확률로 데미지 무시", "", 10),
    ("잘못된 옵션 문자열", "", 0),
    ("스킬 재사용 대기시간 -2초", "COOLDOWN_REDUCTION", -2),
    ("크리티컬 데미지 +8%", "CRITICAL_DAMAGE", 8),
    ("공격력 +12", "ATTACK_POWER", 12),
    ("LUK +9%", "LUK_PERCENT", 9),
]
_TEXTS = "texts(i, text, kinds, n) AS (VALUES " + ", ".join(f"({i}, '{t}', '{k}', {n})" for i, (t, k, n) in enumerate(TEXTS)) + ")"


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """A line of text per item: three of the texts for each part."""
    texts = F.array(*(F.lit(t) for t, _, _ in TEXTS))
    parts = read_table(spark, folder, "part").select("p_partkey", F.posexplode(F.sequence(F.lit(0), F.lit(2))).alias("at", "k"))
    number = ((F.col("p_partkey") * (F.col("k") * 2 + 1) + F.col("k") * 5) % len(TEXTS)).cast("int")
    return parts.select("p_partkey", "k", F.get(texts, number).alias("text"))


_LINES = _TEXTS + ", lines AS (SELECT p_partkey, k, t.* FROM part, (VALUES (0), (1), (2)) s(k) JOIN texts t ON true WHERE t.i = (p_partkey * (k * 2 + 1) + k * 5) % 11)"


@query("option_stats", f"WITH {_LINES} SELECT p_partkey, k, kinds, n FROM lines")
def option_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("p_partkey", "k", F.array_join(O.all_stats(F.col("text")), ",").alias("kinds"), O.parse_num(F.col("text")).alias("n"))


_CONTRIB = _LINES + """, c AS (SELECT p_partkey, unnest(string_split(kinds, ',')) AS stat, n FROM lines WHERE kinds <> ''),
    x AS (SELECT p_partkey, stat, n FROM c WHERE stat <> 'ALLSTAT_PERCENT'
          UNION ALL SELECT p_partkey, s, n FROM c, (VALUES ('STR_PERCENT'), ('DEX_PERCENT'), ('INT_PERCENT'), ('LUK_PERCENT')) m(s) WHERE stat = 'ALLSTAT_PERCENT'),
    sums AS (SELECT p_partkey, stat, sum(n) AS total FROM x GROUP BY 1, 2)"""
_RANK = "list_position([" + ", ".join(f"'{n}'" for n, _, _, _ in O.STATS) + "], stat)"


def _contributions(spark: SparkSession, folder: str) -> DataFrame:
    made = _texts(spark, folder).withColumn("c", F.explode(O.contributions(F.col("text"))))
    return made.select("p_partkey", F.col("c.stat").alias("stat"), F.col("c.value").alias("value"))


@query("infer_target", f"""WITH {_CONTRIB}, r AS (SELECT *, sum(total) OVER (PARTITION BY p_partkey) AS everything, row_number() OVER (PARTITION BY p_partkey ORDER BY total DESC, {_RANK}) AS rn FROM sums)
    SELECT p_partkey, stat, CAST(total AS BIGINT) AS total, round(CAST(total AS DOUBLE) / everything, 6) AS confidence FROM r WHERE rn = 1 AND total > 0""")
def infer_target(spark: SparkSession, folder: str) -> DataFrame:
    found = D.infer_target(_contributions(spark, folder), "p_partkey", [n for n, _, _, _ in O.STATS])
    return found.withColumn("confidence", F.round("confidence", 6))


@query("compound_options", f"""WITH {_LINES}, c AS (SELECT p_partkey, unnest(string_split(kinds, ',')) AS stat FROM lines)
    SELECT p_partkey, count(DISTINCT CASE WHEN stat IN ('BOSS_DAMAGE', 'IGNORE_DEFENSE') THEN 'BOSS_IED' WHEN stat LIKE 'ATTACK%' OR stat LIKE 'MAGIC%' THEN 'ATK_MAG'
      WHEN stat = 'CRITICAL_DAMAGE' THEN 'CRIT' WHEN stat = 'COOLDOWN_REDUCTION' THEN 'COOL' WHEN stat <> '' THEN 'STAT' END) >= 2 AS is_compound FROM c GROUP BY 1""")
def compound_options(spark: SparkSession, folder: str) -> DataFrame:
    kinds = _texts(spark, folder).select("p_partkey", F.explode_outer(O.all_stats(F.col("text"))).alias("stat"))
    return D.compound(kinds.withColumn("category", F.coalesce(O.category(F.col("stat")), F.lit("OTHER"))), "p_partkey")


@query("stat_fold_pivot", f"""WITH {_LINES}, b AS (SELECT p_partkey, CASE kinds WHEN 'STR_PERCENT' THEN 'STR' WHEN 'STR_PERCENT,DEX_PERCENT' THEN 'STR' WHEN 'ALLSTAT_PERCENT' THEN 'ALL_STAT'
      WHEN 'LUK_PERCENT' THEN 'LUK' ELSE 'X' END AS stat, n FROM lines WHERE text NOT LIKE '캐릭터%'
      UNION ALL SELECT p_partkey, 'STR', n FROM lines WHERE text LIKE '캐릭터%')
    SELECT p_partkey, CAST(coalesce(sum(n) FILTER (WHERE stat = 'STR'), 0) + coalesce(sum(n) FILTER (WHERE stat = 'ALL_STAT'), 0) AS BIGINT) AS eff_str,
      CAST(coalesce(sum(n) FILTER (WHERE stat = 'LUK'), 0) + coalesce(sum(n) FILTER (WHERE stat = 'ALL_STAT'), 0) AS BIGINT) AS eff_luk,
      CAST(coalesce(sum(n) FILTER (WHERE stat = 'ALL_STAT'), 0) AS BIGINT) AS all_stat FROM b GROUP BY 1""")
def stat_fold_pivot(spark: SparkSession, folder: str) -> DataFrame:
    lines = _texts(spark, folder).select("p_partkey", O.base_kind(O.first_stat(F.col("text"))).alias("stat"), O.parse_num(F.col("text")).alias("n"))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("stat") == kind, F.col("n"))), F.lit(0))
    sums = lines.groupBy("p_partkey").agg(total("STR").alias("s"), total("LUK").alias("l"), total("ALL_STAT").alias("all_stat"))
    return sums.select("p_partkey", (F.col("s") + F.col("all_stat")).alias("eff_str"), (F.col("l") + F.col("all_stat")).alias("eff_luk"), "all_stat")


_STAGES = (
    "st(s, p0, d0, dv) AS (VALUES "
    + ", ".join(f"({s}, {REF.STAR_SUCCESS[s]}::DOUBLE, {REF.STAR_DESTROY[s]}::DOUBLE, {REF.STAR_DIVISOR[s]})" for s in range(30))
    + ")"
)


def _chain_sql(level: str, target: str, prevention: str, discount: str, own: str) -> str:
    """Recursive SQL of the chain: rows (level, target, prevention, result)."""
    return f"""WITH RECURSIVE {_STAGES},
    t AS (SELECT DISTINCT {level} AS lv, {target} AS tg, {prevention} AS pv FROM part),
    a1 AS (SELECT t.*, s, p0, CASE WHEN pv AND s BETWEEN 15 AND 17 THEN 0 WHEN s BETWEEN 15 AND 21 THEN d0 * 0.7 ELSE d0 END AS d1, dv FROM t, st WHERE s < tg),
    a2 AS (SELECT *, least(1.0, p0 * 1.05) AS p, (1.0 - least(1.0, p0 * 1.05)) * (d1 / (1.0 - p0)) AS d,
        floor(((1000.0 + CASE WHEN s <= 9 THEN CAST(CAST(lv AS BIGINT) * lv * lv * (s + 1) AS DOUBLE) / 36.0 ELSE CAST(CAST(lv AS BIGINT) * lv * lv AS DOUBLE) * pow(s + 1.0, 2.7) / dv END)
          * CASE WHEN pv AND s BETWEEN 15 AND 17 THEN 3.0 ELSE 1.0 END * {discount} + 5) / 10.0) * 10 AS c FROM a1),
    f(lv, tg, pv, s, a, b, a12, b12) AS (
      SELECT lv, tg, pv, CAST(tg AS INTEGER), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM t
      UNION ALL
      SELECT lv, tg, pv, s, a, b, CASE WHEN s = 12 THEN a ELSE a12 END, CASE WHEN s = 12 THEN b ELSE b12 END FROM (
        SELECT f.lv, f.tg, f.pv, x.s, (x.p * f.a + x.d) / (x.p + x.d) AS a, ({own} + x.p * f.b) / (x.p + x.d) AS b, f.a12, f.b12
        FROM f JOIN a2 x ON x.lv = f.lv AND x.tg = f.tg AND x.pv = f.pv AND x.s = f.s - 1))
    , r AS (SELECT lv, tg, pv, a * CASE WHEN tg <= 12 THEN 0 ELSE b12 / (1 - a12) END + b AS e FROM f WHERE s = 0)"""


_CAP = "CASE WHEN p_size * 5 <= 94 THEN 5 WHEN p_size * 5 <= 107 THEN 8 WHEN p_size * 5 <= 117 THEN 10 WHEN p_size * 5 <= 127 THEN 15 WHEN p_size * 5 <= 137 THEN 20 ELSE 30 END"


@query("starforce_cost", _chain_sql("p_size * 5", f"least(22, {_CAP})", "p_partkey % 2 = 1", "0.7", "x.c") + f"""
    SELECT p_partkey, CAST(floor(e + 0.5) AS BIGINT) AS cost FROM part JOIN r ON lv = p_size * 5 AND tg = least(22, {_CAP}) AND pv = (p_partkey % 2 = 1)""")
def starforce_cost(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "part").select("p_partkey", (F.col("p_size") * 5).alias("level"), (F.col("p_partkey") % 2 == 1).alias("prevention"))
    on = F.lit(True)

    def compute(tuples: DataFrame) -> DataFrame:
        cost = S.expected_cost(F.col("level"), F.lit(0), F.lit(22), on, on, on, F.col("prevention"))
        return tuples.withColumn("cost", cost.cast("long"))

    return D.once_per_tuple(items, ["level", "prevention"], compute).select("p_partkey", "cost")


@query("starforce_destroys", _chain_sql("200", "least(30, p_size)", "p_partkey % 2 = 1", "1.0", "x.d") + """
    SELECT p_partkey, floor(e * 100 + 0.5) / 100 AS destroys FROM part JOIN r ON tg = least(30, p_size) AND pv = (p_partkey % 2 = 1)""")
def starforce_destroys(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "part").select("p_partkey", F.col("p_size").alias("target"), (F.col("p_partkey") % 2 == 1).alias("prevention"))
    on = F.lit(True)

    def compute(tuples: DataFrame) -> DataFrame:
        return tuples.withColumn("destroys", S.expected_destroys(F.lit(0), F.col("target"), on, on, F.col("prevention")).cast("double"))

    return D.once_per_tuple(items, ["target", "prevention"], compute).select("p_partkey", "destroys")


@query("star_rates", "WITH " + _STAGES + " SELECT p_partkey, coalesce(p0, 0) AS success, coalesce(d0, 0) AS destroy FROM part LEFT JOIN st ON s = p_size")
def star_rates(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part").select("p_partkey", S.success_rate(F.col("p_size")).alias("success"), S.destroy_rate(F.col("p_size")).alias("destroy"))


_TRIES = (  # star, divisor, tries and failures to ten digits
    "(0, 36, 1.587301587::DECIMAL(18,12), 0.5873015873::DECIMAL(18,12)), (1, 36, 1.731601732, 0.7316017316), (2, 36, 1.904761905, 0.9047619048), (3, 36, 2.380952381, 1.380952381), "
    "(4, 36, 3.174603175, 2.174603175), (5, 36, 4.761904762, 3.761904762), (6, 36, 5.012531328, 4.012531328), (7, 36, 5.291005291, 4.291005291), (8, 36, 5.602240896, 4.602240896), "
    "(9, 36, 5.952380952, 4.952380952), (10, 571, 5.952380952, 4.952380952), (11, 314, 6.802721088, 5.802721088), (12, 214, 7.936507937, 6.936507937), (13, 157, 9.523809524, 8.523809524), "
    "(14, 107, 9.523809524, 8.523809524)"
)


@query("noljang_cost", f"""WITH n(s, dv, tries, fails) AS (VALUES {_TRIES}),
    h AS (SELECT p_partkey, tries, fails, CAST(floor((1000 + CASE WHEN s < 10 THEN pow(p_size * 5, 3) * (s + 1) / 36.0 ELSE pow(p_size * 5, 3) * pow(s + 1.0, 2.7) / dv END) / 100 + 0.5) AS DECIMAL(24,0)) AS hundreds
      FROM part JOIN n ON s < p_partkey % 16)
    SELECT p_partkey, CAST(round(coalesce(c, 0)) AS BIGINT) AS cost FROM part
      LEFT JOIN (SELECT p_partkey, sum(hundreds * 70 * tries + 150400000::DECIMAL(20,0) * fails) AS c FROM h GROUP BY 1) USING (p_partkey)""")
def noljang_cost(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "part").select("p_partkey", (F.col("p_size") * 5).alias("level"), F.lit(0).alias("start"), (F.col("p_partkey") % 16).cast("int").alias("target"))
    keys = ["level", "start", "target"]

    def compute(tuples: DataFrame) -> DataFrame:
        named = tuples.withColumns({f"k_{k}": F.col(k) for k in keys})
        found = S.noljang_cost(named, S.noljang_table(spark), [f"k_{k}" for k in keys])
        return found.withColumnsRenamed({f"k_{k}": k for k in keys})

    return D.once_per_tuple(items, keys, compute).select("p_partkey", F.col("cost").cast("long").alias("cost"))


@query("flame_subset_dp", """
    WITH o(i, stage, prob) AS (SELECT i, stage, prob FROM (VALUES (0), (1), (2), (3)) a(i), (VALUES (1, 0.5::DOUBLE), (2, 0.3), (3, 0.2)) b(stage, prob)),
    j AS (SELECT a.stage * 2 AS x0, b.stage * 4 AS x1, c.stage * 6 AS x2, d.stage * 8 AS x3, a.prob * b.prob * c.prob * d.prob AS p
          FROM o a, o b, o c, o d WHERE a.i = 0 AND b.i = 1 AND c.i = 2 AND d.i = 3),
    m AS (SELECT m0, m1, m2, m3, m0 + m1 + m2 + m3 AS k FROM (VALUES (0), (1)) a(m0), (VALUES (0), (1)) b(m1), (VALUES (0), (1)) c(m2), (VALUES (0), (1)) d(m3) WHERE m0 + m1 + m2 + m3 > 0)
    SELECT target, round(sum(CASE WHEN m0 * x0 + m1 * x1 + m2 * x2 + m3 * x3 >= target THEN p / CASE k WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 4 ELSE 1 END ELSE 0 END) / 4, 9) AS p
    FROM (SELECT DISTINCT p_size AS target FROM part) t, j, m GROUP BY 1""")
def flame_subset_dp(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "part").select(F.col("p_size").alias("target")).distinct().select(F.col("target").alias("id"), "target", F.lit(False).alias("boss"))
    rows = [(i, (i + 1) * s * 2, p) for i in range(4) for s, p in ((1, 0.5), (2, 0.3), (3, 0.2))]
    pmfs = items.select("id").join(F.broadcast(spark.createDataFrame(rows, "position int, score int, prob double")))
    found = FL.flame_trials(items, pmfs, "id")
    return found.select(F.col("id").alias("target"), F.round("p", 9).alias("p"))


@query("flame_trials")
def flame_trials(spark: SparkSession, folder: str) -> DataFrame:
    """Chances for items made from part: class, level, flame and target."""
    part = read_table(spark, folder, "part")
    flames = F.array(*map(F.lit, ("POWERFUL", "ETERNAL", "ABYSS")))
    jobs = F.array(*map(F.lit, ("비숍", "제논", "팬텀", "아델", "신궁")))
    items = part.select(
        "p_partkey",
        (F.col("p_size") * 2 + 150).alias("level"),
        (F.col("p_partkey") % 4 == 0).alias("weapon"),
        (F.col("p_partkey") % 2 == 0).alias("boss"),
        F.get(flames, (F.col("p_partkey") % 3).cast("int")).alias("flame_type"),
        F.get(jobs, (F.col("p_partkey") % 5).cast("int")).alias("job"),
        F.lit(150).alias("base_att"),
        F.lit(100).alias("base_mag"),
        F.lit(600).alias("target"),
    )
    keys = ["level", "weapon", "boss", "flame_type", "job", "base_att", "base_mag", "target"]

    def compute(tuples: DataFrame) -> DataFrame:
        named = FL.job_weights(tuples.withColumn("key", F.sha2(F.to_json(F.struct(*keys)), 256)), REF.job_weight_table(spark))
        return FL.flame_trials(named, FL.option_pmfs(named, "key"), "key").join(named.select("key", *keys), "key").drop("key")

    found = D.once_per_tuple(items, keys, compute)
    return found.select("p_partkey", F.round("p", 9).alias("p"), F.round("trials", 6).alias("trials"))


@query("binomial", """
    SELECT p_partkey, CASE WHEN p_partkey % 6 > p_size % 20 THEN 0 ELSE CAST(round(gamma(p_size % 20 + 1) / (gamma(p_partkey % 6 + 1) * gamma(p_size % 20 - p_partkey % 6 + 1))) AS BIGINT) END AS c FROM part""")
def binomial(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part").select("p_partkey", FL.binomial(F.col("p_size") % 20, F.col("p_partkey") % 6).alias("c"))


_COST_ROWS = ", ".join(
    f"('{k}', '{g}', {'-1' if i == 0 else floor}, {sorted(t)[i + 1] if i + 1 < len(t) else 100000}, {c})"
    for k, t in REF.CUBE_COST.items()
    for i, floor in enumerate(sorted(t))
    for g, c in zip(REF.GRADE_NAMES, t[floor], strict=True)
)
_COSTS = f"costs(kind, grade, lo, hi, cost) AS (VALUES {_COST_ROWS})"


@query("cube_cost", f"""WITH {_COSTS} SELECT p_partkey, CAST(cost AS BIGINT) AS cube_cost FROM part JOIN costs
    ON kind = CASE p_partkey % 3 WHEN 0 THEN 'BLACK' WHEN 1 THEN 'ADDITIONAL' ELSE 'RED' END
    AND grade = CASE p_size % 4 WHEN 0 THEN 'RARE' WHEN 1 THEN 'EPIC' WHEN 2 THEN 'UNIQUE' ELSE 'LEGENDARY' END AND p_size * 6 >= lo AND p_size * 6 < hi""")
def cube_cost(spark: SparkSession, folder: str) -> DataFrame:
    kinds, grades = F.array(*map(F.lit, ("BLACK", "ADDITIONAL", "RED"))), F.array(*map(F.lit, REF.GRADE_NAMES))
    items = read_table(spark, folder, "part").select(
        "p_partkey", F.get(kinds, (F.col("p_partkey") % 3).cast("int")).alias("cube_type"), F.get(grades, F.col("p_size") % 4).alias("grade"), (F.col("p_size") * 6).alias("level")
    )
    return V.cube_cost(items).select("p_partkey", "cube_cost")


_SLOT = [(0, 0.7), (6, 0.2), (9, 0.1)]


def _item_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item as an item: expected cube cost of its target at its level and grade."""
    grade = F.when(F.col("l_returnflag") == "A", "LEGENDARY").when(F.col("l_returnflag") == "N", "UNIQUE").otherwise("EPIC")
    items = read_table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        ((F.col("l_linenumber") - 1) % 3 + 1).alias("preset_no"),
        (F.col("l_quantity") * 5).cast("int").alias("level"),
        (F.round(F.col("l_discount") * 100) * 3).cast("int").alias("target"),
        grade.alias("grade"),
        F.lit("BLACK").alias("cube_type"),
    )
    pmf = spark.createDataFrame([(s, v, p) for s in (1, 2, 3) for v, p in _SLOT], "slot int, value int, prob double")

    def compute(targets: DataFrame) -> DataFrame:
        named = targets.withColumn("dist_id", F.col("target"))
        pmfs = named.select("dist_id").join(F.broadcast(pmf))
        chances = D.tail(D.convolve(pmfs, named), ["dist_id", "target"])
        return chances.select("target", D.expected_trials(F.col("p")).alias("trials"))

    priced = V.cube_cost(D.once_per_tuple(items, ["target"], compute))
    return priced.withColumn("black_cube_cost", V.trial_cost(F.col("trials"), F.col("cube_cost")))


_ITEMS = f"""{_COSTS}, pm(v, p) AS (VALUES (0, 0.7::DOUBLE), (6, 0.2), (9, 0.1)),
    tr AS (SELECT t AS target, CASE WHEN sum(x.p * y.p * z.p) FILTER (WHERE x.v + y.v + z.v >= t) > 0 THEN round(1 / sum(x.p * y.p * z.p) FILTER (WHERE x.v + y.v + z.v >= t)) ELSE 0 END AS trials
           FROM range(0, 61) r(t), pm x, pm y, pm z GROUP BY 1),
    items AS (SELECT l_orderkey, l_linenumber, (l_linenumber - 1) % 3 + 1 AS preset_no, CAST(trials AS BIGINT) * cost AS c FROM lineitem
      JOIN tr ON target = CAST(round(l_discount * 100) * 3 AS INTEGER)
      JOIN costs ON kind = 'BLACK' AND grade = CASE l_returnflag WHEN 'A' THEN 'LEGENDARY' WHEN 'N' THEN 'UNIQUE' ELSE 'EPIC' END
        AND CAST(l_quantity * 5 AS INTEGER) >= lo AND CAST(l_quantity * 5 AS INTEGER) < hi),
    presets AS (SELECT l_orderkey, preset_no, CAST(sum(c) AS DOUBLE) AS total_cost, count(*) AS n_items FROM items GROUP BY 1, 2)"""


def _presets(spark: SparkSession, folder: str) -> DataFrame:
    return V.preset_costs(_item_costs(spark, folder), "l_orderkey", "preset_no", ("black_cube_cost",))


@query("preset_rollup", f"WITH {_ITEMS} SELECT l_orderkey, preset_no, total_cost, n_items FROM presets")
def preset_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _presets(spark, folder).select("l_orderkey", "preset_no", F.col("total_cost").cast("double").alias("total_cost"), "n_items")


@query("preset_argmax", f"""WITH {_ITEMS} SELECT l_orderkey, preset_no, total_cost FROM
    (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY total_cost DESC, preset_no) AS rn FROM presets) WHERE rn = 1""")
def preset_argmax(spark: SparkSession, folder: str) -> DataFrame:
    found = V.dearest_preset(_presets(spark, folder), "l_orderkey", "preset_no")
    return found.select("l_orderkey", "preset_no", F.col("total_cost").cast("double").alias("total_cost"))


@query("summary_upsert", f"""WITH {_ITEMS} SELECT l_orderkey, preset_no, CASE WHEN l_orderkey % 3 = 0 THEN total_cost + 1 ELSE total_cost END AS total_cost FROM presets""")
def summary_upsert(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.operators.relational import merge_latest

    stored = _presets(spark, folder).select("l_orderkey", "preset_no", F.col("total_cost").cast("double").alias("total_cost"), F.lit(1).alias("calculated_at"))
    changed = stored.where("l_orderkey % 3 = 0").withColumn("total_cost", F.col("total_cost") + 1).withColumn("calculated_at", F.lit(2))
    return merge_latest(stored, changed, ["l_orderkey", "preset_no"], "calculated_at").drop("calculated_at")


@query("engine_dispatch", f"""WITH {_CONVOLVED}, dp AS (SELECT dist_id, 1 / sum(prob) AS d FROM conv WHERE target = 15 AND value >= 15 GROUP BY 1),
    perms AS (SELECT DISTINCT dist_id, o[i] AS a, o[j] AS b, o[k] AS c FROM (SELECT DISTINCT dist_id, [dist_id % 4 * 3, dist_id // 4 % 4 * 3, 6] AS o FROM pmf), (VALUES (1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)) t(i, j, k)),
    v1 AS (SELECT perms.dist_id, 1 / sum(x.prob * y.prob * z.prob) AS v FROM perms JOIN pmf x ON x.dist_id = perms.dist_id AND x.slot = 1 AND x.value = a
      JOIN pmf y ON y.dist_id = perms.dist_id AND y.slot = 2 AND y.value = b JOIN pmf z ON z.dist_id = perms.dist_id AND z.slot = 3 AND z.value = c GROUP BY 1)
    SELECT v1.dist_id, round(CASE WHEN v1.dist_id % 2 = 0 THEN d ELSE v END, 6) AS trials, round(abs(v - d), 6) AS drift FROM v1 JOIN dp USING (dist_id)""")
def engine_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Convolution of three slots for a sum of 15, or permutations of three given lines, and how far they are apart."""
    line = lambda n: (F.floor(F.col("dist_id") / n) % 4 * 3).cast("int").cast("string")
    pmf = _pmf(spark, folder)
    items = pmf.select("dist_id").distinct().select("dist_id", F.col("dist_id").alias("item_id"), F.array(line(1), line(4), F.lit("6")).alias("options"), (F.col("dist_id") % 2 == 0).alias("is_dp"))
    chances = D.tail(D.convolve(pmf, items.select("dist_id", F.lit(15).alias("target"))), ["dist_id", "target"])
    dp = chances.select(F.col("dist_id").alias("item_id"), D.expected_trials(F.col("p")).alias("trials"))
    v1 = D.permutation_trials(items, pmf.select("dist_id", "slot", F.col("value").cast("string").alias("option"), F.col("prob").alias("rate")))
    found = D.dispatch(items, dp, v1)
    return found.select("dist_id", F.round("trials", 6).alias("trials"), F.round("drift", 6).alias("drift"))


@query("job_mapping", """
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 0 ELSE 10 END AS w_str, CASE p_size % 4 WHEN 0 THEN 10 ELSE 0 END AS w_int,
           CASE p_size % 4 WHEN 2 THEN 1500 ELSE 40 END AS w_att FROM part""")
def job_mapping(spark: SparkSession, folder: str) -> DataFrame:
    jobs = F.array(*map(F.lit, ("비숍", "제논", "데몬어벤져", "없는 직업")))
    items = read_table(spark, folder, "part").select("p_partkey", F.get(jobs, F.col("p_size") % 4).alias("job"))
    return FL.job_weights(items, REF.job_weight_table(spark)).select("p_partkey", "w_str", "w_int", "w_att")


@query("flame_stage_values", """
    SELECT p_partkey, CASE WHEN b < 8 THEN stage * CASE WHEN b < 2 THEN 6 WHEN b < 4 THEN 7 ELSE 8 END WHEN b = 8 THEN CASE WHEN stage >= 3 THEN 9 * stage END END AS str_value
    FROM (SELECT p_partkey, CAST(least(p_size // 10 + 0, 6) AS INTEGER) AS t, CASE WHEN p_size // 10 = 0 THEN 0 WHEN p_size // 10 = 1 THEN 1 WHEN p_size // 10 = 2 THEN 2 WHEN p_size // 10 = 3 THEN 3 WHEN p_size // 10 = 4 THEN 4 ELSE 5 END AS b, CAST(p_partkey % 7 + 1 AS INTEGER) AS stage FROM part)""")
def flame_stage_values(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "part").select(
        "p_partkey", FL.level_bucket((F.floor(F.col("p_size") / 10) * 10 + 100).cast("int")).alias("bucket"), F.lit("STR").alias("option"), (F.col("p_partkey") % 7 + 1).cast("int").alias("stage")
    )
    values = REF.flame_value_table(spark)
    return items.join(F.broadcast(values), ["bucket", "option", "stage"], "left").select("p_partkey", F.col("value").alias("str_value"))


@query("starforce_table", _chain_sql("p_size * 10", "CASE WHEN p_size * 10 <= 94 THEN 5 WHEN p_size * 10 <= 107 THEN 8 WHEN p_size * 10 <= 117 THEN 10 WHEN p_size * 10 <= 127 THEN 15 WHEN p_size * 10 <= 137 THEN 20 ELSE 22 END", "false", "0.7", "x.c") + """
    SELECT DISTINCT CAST(lv AS INTEGER) AS level, CAST(floor(e / 100 + 0.5) * 100 AS BIGINT) AS cost FROM r""")
def starforce_table(spark: SparkSession, folder: str) -> DataFrame:
    levels = read_table(spark, folder, "part").select((F.col("p_size") * 10).alias("level")).distinct()
    target = F.least(S.star_cap(F.col("level")), F.lit(22))
    return levels.select("level", V.starforce_summary(F.col("level"), F.lit(0), target)["plain_cost"].cast("long").alias("cost"))
