"""Numeric core against brute force, laws and golden vectors."""

from __future__ import annotations

import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import distributions as D
from tallyloom.operators import flame as FL
from tallyloom.operators import refdata as R
from tallyloom.operators import starforce as S
from tallyloom.operators import valuation as V

PMFS = {
    "uniform2": [{0: 0.7, 6: 0.2, 9: 0.1}] * 2,
    "mixed2": [{0: 0.9, 6: 0.08, 12: 0.02}, {0: 0.85, 9: 0.1, 12: 0.05}],
    "same3": [{0: 0.7, 6: 0.2, 9: 0.1}] * 3,
    "mixed3": [{0: 0.6, 6: 0.3, 12: 0.1}, {0: 0.75, 9: 0.2, 12: 0.05}, {0: 0.8, 6: 0.15, 9: 0.05}],
    "rare3": [{0: 0.95, 6: 0.04, 12: 0.01}] * 3,
}


def brute_tail(slots, target):
    return sum(math.prod(p for _, p in combo) for combo in itertools.product(*(s.items() for s in slots)) if sum(v for v, _ in combo) >= target)


@pytest.mark.parametrize("clamp", [True, False])
def test_convolution_matches_brute_force(spark, clamp):
    for name, slots in PMFS.items():
        pmf = spark.createDataFrame([(name, i, v, p) for i, s in enumerate(slots, 1) for v, p in s.items()], "dist_id string, slot int, value int, prob double")
        targets = spark.createDataFrame([(name, t) for t in (0, 6, 15, 21, 99)], "dist_id string, target int")
        found = D.tail(D.convolve(pmf, targets, slots=len(slots), clamp=clamp), ["dist_id", "target"]).collect()
        assert len(found) == 5
        for r in found:
            assert r["p"] == pytest.approx(brute_tail(slots, r["target"]), abs=1e-12)


def test_packed_convolution(spark):
    slots = F.array(*(F.array(*(F.struct(F.lit(v).alias("value"), F.lit(p).alias("prob")) for v, p in s.items())) for s in PMFS["mixed3"]))
    rows = spark.createDataFrame([(t,) for t in (0, 6, 15, 21, 40)], "t int").select("t", F.element_at(D.convolve_packed(slots, F.col("t")), -1).alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(brute_tail(PMFS["mixed3"], r["t"]), abs=1e-12)


def test_negative_contribution_is_an_error(spark):
    pmf = spark.createDataFrame([("a", 1, -1, 1.0)], "dist_id string, slot int, value int, prob double")
    targets = spark.createDataFrame([("a", 1)], "dist_id string, target int")
    with pytest.raises(Exception, match="negative contribution"):
        D.convolve(pmf, targets, slots=1).collect()


def test_mass_policy(spark):
    rates = spark.createDataFrame([("k", 0, 0.5), ("k", 3, 0.48)], "k string, value int, rate double")
    lenient = D.slot_pmf(rates, ["k"], "value", lenient=True)
    assert lenient.agg(F.sum("prob")).first()[0] == pytest.approx(1, abs=1e-12)
    with pytest.raises(Exception, match="bad probability mass"):
        D.slot_pmf(rates, ["k"], "value").collect()
    with pytest.raises(Exception, match="bad probability mass"):
        D.slot_pmf(spark.createDataFrame([("k", 0, 0.0)], "k string, value int, rate double"), ["k"], "value", lenient=True).collect()


def test_kahan_sum(spark):
    assert spark.range(1).select(D.kahan_sum(F.array(*map(F.lit, (0.7, 0.2, 0.1))))).first()[0] == 1.0


def test_empty_groups(spark):
    pmf = spark.createDataFrame([("a", 1, 1.0)], "k string, value int, prob double")
    wanted = spark.createDataFrame([("a",), ("b",)], "k string")
    assert {(r["k"], r["value"], r["prob"]) for r in D.with_empty_groups(pmf, wanted, ["k"]).collect()} == {("a", 1, 1.0), ("b", 0, 1.0)}


def test_trials(spark):
    r = spark.createDataFrame([(0.0,), (0.132,)], "p double").select(D.expected_trials(F.col("p")).alias("t"), D.expected_trials_ceil(F.col("p")).alias("c")).collect()
    assert r[0]["t"] == math.inf and r[0]["c"] == (1 << 63) - 1
    assert r[1]["t"] == pytest.approx(7.575757576) and r[1]["c"] == 8


def test_permutations_count_each_order_once(spark):
    items = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", None, "zz"])], "item_id int, options array<string>")
    rates = spark.createDataFrame([(s, o, r) for s in (1, 2, 3) for o, r in (("a", 0.5), ("b", 0.25))], "slot int, option string, rate double")
    found = {r["item_id"]: r for r in D.permutation_trials(items, rates).collect()}
    assert found[1]["p"] == pytest.approx(3 * 0.5 * 0.5 * 0.25)
    assert found[2]["p"] == 0 and found[2]["trials"] == math.inf


# expected values: recomputed from the formulas, see the golden vectors
STARS = [
    (100, 8, 896859, 896859, 0, 0),
    (120, 15, 105430694, 105430694, 0, 0),
    (150, 17, 371629922, 642736826, 0.09, 0),
    (150, 22, 6821547153, 9072073892, 3.87, 2.43),
    (160, 22, 8278809763, 11010105443, 3.87, 2.43),
    (200, 12, 55108041, 55108041, 0, 0),
    (200, 22, 16169451106, 21503968049, 3.87, 2.43),
    (250, 22, 31580860664, 41999793477, 3.87, 2.43),
]


def test_starforce_golden(spark):
    df = spark.createDataFrame([(x[0], x[1]) for x in STARS], "level int, t int")
    on, off = F.lit(True), F.lit(False)
    level, t = F.col("level"), F.col("t")
    cost = lambda safe: S.expected_cost(level, F.lit(0), t, on, on, on, safe)
    rows = df.select("level", "t", cost(off).alias("a"), cost(on).alias("b"), S.expected_destroys(F.lit(0), t, on, on, off).alias("c"), S.expected_destroys(F.lit(0), t, on, on, on).alias("d")).collect()
    for r, want in zip(rows, STARS, strict=True):
        assert [float(x) for x in r] == pytest.approx(want, rel=1e-9)


def chain_by_solving(level, target):
    """The same chain as a linear system, for an independent answer."""
    import numpy as np

    a, b = np.eye(target), np.zeros(target)
    for s in range(target):
        p, d = R.STAR_SUCCESS[s], R.STAR_DESTROY[s]
        raw = 1000 + level**3 * (s + 1) / 36 if s <= 9 else 1000 + level**3 * (s + 1) ** 2.7 / R.STAR_DIVISOR[s]
        b[s] = math.floor((raw + 5) / 10) * 10
        a[s, s] -= 1 - p - d
        if s + 1 < target:
            a[s, s + 1] -= p
        if d:
            a[s, R.RESET_STAR] -= d
    return np.linalg.solve(a, b)


def test_starforce_solves_the_chain(spark):
    off = F.lit(False)
    got = spark.range(1).select(*(S.expected_cost(F.lit(160), F.lit(s), F.lit(22), off, off, off, off).alias(f"s{s}") for s in (0, 12, 17))).first()
    want = chain_by_solving(160, 22)
    assert [float(x) for x in got] == pytest.approx([want[0], want[12], want[17]], rel=1e-9)


def test_starforce_edges(spark):
    on = F.lit(True)
    r = spark.range(1).select(S.expected_cost(F.lit(90), F.lit(0), F.lit(22), on, on, on, on).alias("a"), S.expected_cost(F.lit(90), F.lit(0), F.lit(5), on, on, on, on).alias("b"), S.expected_cost(F.lit(90), F.lit(5), F.lit(9), on, on, on, on).alias("c")).first()
    assert r["a"] == r["b"] and r["c"] == 0


def test_noljang_golden(spark):
    items = spark.createDataFrame([(1, 150, 0, 10), (2, 150, 0, 12), (3, 140, 0, 15), (4, 140, 5, 5)], "id int, level int, start int, target int")
    got = {r["id"]: int(r["cost"]) for r in S.noljang_cost(items, S.noljang_table(spark, range(140, 151)), ["id"]).collect()}
    assert got == {1: 4137422688, 2: 5812932416, 3: 9879664942, 4: 0}


FLAMES = {("POWERFUL", 1000): 0.287587013266, ("POWERFUL", 1500): 0.129075393176, ("ETERNAL", 1000): 0.341724612201, ("ETERNAL", 1500): 0.169924485557, ("ABYSS", 1000): 0.380599475791, ("ABYSS", 1500): 0.201983368737}


def test_flame_golden(spark):
    rows = [(i, 200, False, True, f, 0, 0, t, None) for i, (f, t) in enumerate(FLAMES)]
    items = spark.createDataFrame([*rows, (9, 160, False, False, "POWERFUL", 0, 0, 10, "비숍")], "id int, level int, weapon boolean, boss boolean, flame_type string, base_att int, base_mag int, target int, job string")
    weighted = FL.job_weights(items, R.job_weight_table(spark))
    got = {r["id"]: r["p"] for r in FL.flame_trials(weighted, FL.option_pmfs(weighted, "id"), "id").collect()}
    assert got.pop(9) is None  # every option lacks stages 1 and 2
    assert [got[i] for i in range(6)] == pytest.approx(list(FLAMES.values()), abs=1e-11)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 12), st.floats(0.05, 1), min_size=1, max_size=3), min_size=1, max_size=6), st.integers(0, 25), st.booleans())
def test_draws_match_enumeration(raw, target, boss):
    pmfs = [{v: p / sum(d.values()) for v, p in d.items()} for d in raw]
    n = len(pmfs)

    def fixed(k):
        subsets = list(itertools.combinations(range(n), k))
        return sum(brute_tail([pmfs[i] for i in s], target) for s in subsets) / len(subsets) if subsets else 0.0

    want = fixed(4) if boss else sum(fixed(k) for k in range(1, min(4, n) + 1)) / 4
    got = FL.draw_chance(pmfs, target, boss)
    assert got == (1.0 if target <= 0 else pytest.approx(want, abs=1e-9))


def test_weapon_attack(spark):
    assert spark.range(1).select(FL.weapon_attack(F.lit(150), F.lit(5), F.lit(200))).first()[0] == 4800


# fixed cases of the cube price table
PRICES = [("BLACK", 200, "RARE", 4500000), ("BLACK", 200, "EPIC", 18000000), ("BLACK", 200, "UNIQUE", 38250000), ("BLACK", 200, "LEGENDARY", 45000000), ("ADDITIONAL", 200, "RARE", 14625000), ("ADDITIONAL", 200, "EPIC", 40950000), ("BLACK", -5, "RARE", 4000000), ("RED", 300, "EPIC", 1)]


def test_cube_cost(spark):
    items = spark.createDataFrame([(*p[:3], p[3]) for p in PRICES], "cube_type string, level int, grade string, want long")
    assert all(r["cube_cost"] == r["want"] for r in V.cube_cost(items).collect())


def test_trial_cost_modes(spark):
    df = spark.createDataFrame([(2.5,), (math.inf,)], "t double")
    rows = df.select(V.trial_cost(F.col("t"), F.lit(10)).alias("r"), V.trial_cost(F.col("t"), F.lit(10), rounded=False).alias("f")).collect()
    assert [(int(r["r"]), int(r["f"])) for r in rows] == [(30, 20), (0, 0)]


def test_dearest_preset_first_wins(spark):
    df = spark.createDataFrame([("o", 1, 5.0), ("o", 2, 7.0), ("o", 3, 7.0)], "o string, preset_no int, total_cost double")
    assert V.dearest_preset(df, "o", "preset_no").first()["preset_no"] == 2


def test_infer_target_ties(spark):
    lines = spark.createDataFrame([(1, "ALLSTAT_PERCENT", 9), (1, "LUK_PERCENT", 0), (2, "HP", 0)], "k int, stat string, value int")
    got = D.infer_target(lines, "k", ["STR_PERCENT", "DEX_PERCENT", "INT_PERCENT", "LUK_PERCENT", "HP"]).collect()
    assert [(r["k"], r["stat"], r["total"], r["confidence"]) for r in got] == [(1, "STR_PERCENT", 9, 0.25)]
