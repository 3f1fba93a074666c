"""Scalar functions on fixed cases."""

from __future__ import annotations

import hashlib
import hmac
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import keys as K
from tallyloom.functions import masking as M
from tallyloom.functions import money as MO
from tallyloom.functions import options as O
from tallyloom.operators import relational as R

KINDS = [
    ("STR +12%", ["STR_PERCENT"], 12),
    ("STR/DEX +6%", ["STR_PERCENT", "DEX_PERCENT"], 6),
    ("올스탯 +9%", ["ALLSTAT_PERCENT"], 9),
    ("보스 몬스터 공격 시 데미지 +30%", ["BOSS_DAMAGE"], 30),
    ("캐릭터 기준 9레벨 당 STR +1", ["LEVEL_STR"], 91),
    ("피격 시 10% 확률로 데미지 무시", [], 10),
    ("STR +9", ["STR"], 9),
    ("잘못된 옵션 문자열", [], 0),
    ("", [], 0),
    (None, [], 0),
]


def test_option_kinds(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in KINDS], "t string")
    rows = df.select(O.all_stats(F.col("t")).alias("k"), O.parse_num(F.col("t")).alias("n"), O.parse_num(F.col("t"), strict=True).alias("s"), O.all_stats_or_unknown(F.col("t")).alias("u")).collect()
    for r, (text, kinds, n) in zip(rows, KINDS, strict=True):
        assert (r["k"], r["n"]) == (kinds, n), text
        assert r["u"] == (kinds or ["UNKNOWN"])
    assert rows[4]["s"] == 1


def test_strict_kinds_raise(spark):
    with pytest.raises(Exception, match="no stat in option"):
        spark.range(1).select(O.all_stats_strict(F.lit("무엇"))).collect()


def test_contributions(spark):
    df = spark.createDataFrame([("올스탯 +9%",), ("str +9%",), ("LUK +3%",)], "t string")
    rows = df.select(O.contributions(F.col("t")).alias("c"), O.contribution_for(F.col("t"), F.lit("LUK_PERCENT")).alias("luk")).collect()
    assert [r["luk"] for r in rows] == [9, 0, 3]
    assert rows[1]["c"] is None  # looks like a main stat, has no kind
    with pytest.raises(Exception, match="main stat drifted"):
        df.select(O.contributions(F.col("t"), drift="raise")).collect()


def test_grades(spark):
    assert spark.range(1).select(O.grade_of(F.lit(" 레전드리 "))).first()[0] == "LEGENDARY"
    with pytest.raises(Exception, match="unknown grade"):
        spark.range(1).select(O.grade_of(F.lit("x"))).collect()


MONEY = [
    ("12345678900000", "12조 3456억 7890만", "12.3조", "12,345,678,900,000"),
    ("500000000000", "5000억", "5000억", "500,000,000,000"),
    ("1234567", "123만", "123.5만", "1,234,567"),
    ("9999", "0", "9999", "9,999"),
    ("9999.5", "1만", "1만", "10,000"),
    ("12345.67", "1만", "1.2만", "12,346"),
    ("12345678", "1234만", "1234.6만", "12,345,678"),
    ("0", "0", "0", "0"),
    ("-5", "0", "0", "-5"),
    (None, "0", "0", "0"),
]


def test_money(spark):
    df = spark.createDataFrame([(None if a is None else Decimal(a),) for a, *_ in MONEY], "a decimal(20,2)")
    a = F.col("a")
    rows = df.select(MO.money_text(a), MO.money_compact(a), MO.money_comma(a)).collect()
    assert [tuple(r) for r in rows] == [tuple(m[1:]) for m in MONEY]


def test_roundings(spark):
    r = spark.range(1).select(MO.nearest_10(F.lit(14.9)), MO.nearest_10(F.lit(15.0)), MO.nearest_100(F.lit(Decimal("150"))).cast("long"), MO.metric_2dp(F.lit(float("nan"))), MO.metric_2dp(F.lit(1.005))).first()
    assert tuple(r) == (10.0, 20.0, 200, 0.0, pytest.approx(1.0, abs=0.011))


PII = [
    ("from 10.0.0.1 to 192.168.1.1", "from [IP_MASKED] to [IP_MASKED]"),
    ("id 550e8400-e29b-41d4-a716-446655440000", "id [UUID_MASKED]"),
    ("Bearer abc123def456.xyz789", "Bearer [TOKEN_MASKED]"),
    ("mail a.b@c.org", "mail [EMAIL_MASKED]"),
    ("api_key: abcdefgh12345", "api_key: [REDACTED]"),
    ("eyJhbGciOi.eyJzdWIi.sig_1", "[JWT_MASKED]"),
    ("", ""),
    (None, None),
]


def test_pii(spark):
    df = spark.createDataFrame([(t,) for t, _ in PII], "t string")
    assert [r[0] for r in df.select(M.mask_pii(F.col("t"))).collect()] == [m for _, m in PII]
    trace = spark.range(1).select(M.mask_stack_trace(F.lit(r"at /home/joe/a C:\Users\joe\b"))).first()[0]
    assert trace == r"at /home/[USER]/a C:\Users\[USER]\b"
    assert spark.range(1).select(M.mask_exception(F.lit(None).cast("string"), F.lit(None).cast("string"))).first()[0] == "Unknown error"


def test_masks(spark):
    r = spark.range(1).select(M.mask_id(F.lit("abcdefghij")), M.mask_id(F.lit("abc")), M.mask_fingerprint(F.lit("abcdefghij"), True), M.mask_account(F.lit("")), M.mask_cache_key(F.lit("expectation:v4:abc:x")), M.mask_ip(F.lit("10.1.2.3")), M.mask_name(F.lit("Joe"))).first()
    assert tuple(r) == ("abcd***", "***", "abcd****ghij", "***", "expectation:v4:***:x", "10.1.*.*", "J***")


def test_hashes(spark):
    df = spark.createDataFrame([("a", "t", "p")], "a string, b string, c string")
    r = df.select(K.content_hash(F.col("a"), F.col("b"), F.col("c")).alias("h"), K.short_hash(F.col("a")).alias("s")).first()
    assert r["h"] == hashlib.sha256(b"a|t|p").hexdigest() and len(r["s"]) == 8
    sign = K.hmac_fingerprint(b"k")
    assert df.select(sign("a")).first()[0] == hmac.new(b"k", b"a", "sha256").hexdigest()
    assert df.select(K.hmac_verified(b"k")("a", "b")).first()[0] is False


def test_small_functions(spark):
    r = spark.range(1).select(
        K.relation_parts(F.lit("acc:a:b"))["target"],
        K.safe_long(F.lit("x")),
        K.value_pair(F.lit('[1700000000, "NaNx"]'))["value"],
        K.epoch_text(F.lit(None).cast("timestamp")),
        K.top_lines(F.lit("a\nb\nc"), 2),
        K.backoff_seconds(F.lit(10)),
        K.contains_any_case(F.array(F.lit("Ab")), F.lit("aB")),
        K.signed_percent(F.lit(3.25)),
    ).first()
    assert tuple(r) == ("a:b", 0, 0.0, "0", "a\nb", 3600, True, "+3.3%")
    t = spark.range(1).select(K.thresholds(F.from_json(F.lit('[{"value":null},{"value":5},{"value":9}]'), "array<struct<value:double>>")).alias("t")).first()["t"]
    assert (t["warn"], t["crit"]) == (5.0, 9.0)
    e = spark.range(1).select(K.error_analysis(F.lit("RedisTimeoutException"), F.lit("timed out")).alias("e")).first()["e"]
    assert e["severity"] == "MEDIUM" and e["components"].startswith("Redis") and e["actions"].startswith("1. 대상")


def test_comparators(spark):
    df = spark.createDataFrame([(5.0, 5.0, c) for c in (">", "gte", "<", "<=", "==", "??")], "v double, t double, c string")
    assert [r[0] for r in df.select(R.exceeds(F.col("v"), F.col("t"), F.col("c"))).collect()] == [False, True, False, True, True, False]
