"""Scalar functions over documents, orders, customers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import keys as K
from tallyloom.functions import masking as M
from tallyloom.functions import money as MO
from tallyloom.functions import options as O
from tallyloom.operators import valuation as V
from tallyloom.plans.registry import query
from tallyloom.sources import read_table


def _pii_sql(text: str) -> str:
    for pattern, mask in M.PII_RULES:
        ready = mask.replace("$1", r"\1").replace("'", "''")
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{ready}', 'g')"
    return text


@query("pii_mask", f"SELECT doc_id, sha256({_pii_sql('text')}) AS masked, {_pii_sql('text')} <> text AS changed FROM documents")
def pii_mask(spark: SparkSession, folder: str) -> DataFrame:
    masked = M.mask_pii(F.col("text"))
    return read_table(spark, folder, "documents").select("doc_id", F.sha2(masked, 256).alias("masked"), (masked != F.col("text")).alias("changed"))


@query("money_text", """
    WITH a AS (SELECT o_orderkey, CAST(round(o_totalprice * (1 + o_orderkey % 5 * 40000)) AS HUGEINT) AS n FROM orders)
    SELECT o_orderkey, CASE WHEN n < 10000 THEN '0' ELSE trim(concat_ws(' ', CASE WHEN n // 1000000000000 > 0 THEN (n // 1000000000000) || '조' END,
      CASE WHEN n % 1000000000000 // 100000000 > 0 THEN (n % 1000000000000 // 100000000) || '억' END, CASE WHEN n % 100000000 // 10000 > 0 THEN (n % 100000000 // 10000) || '만' END)) END AS text FROM a""")
def money_text(spark: SparkSession, folder: str) -> DataFrame:
    amount = F.round(F.col("o_totalprice") * (1 + F.col("o_orderkey") % 5 * 40000)).cast("decimal(20,2)")
    return read_table(spark, folder, "orders").select("o_orderkey", MO.money_text(amount).alias("text"))


@query("money_compact_comma", """
    WITH a AS (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) * 1000 AS n FROM orders)
    SELECT o_orderkey, CASE WHEN n >= 100000000 THEN regexp_replace(CAST(CAST(round(CAST(n AS DECIMAL(30,4)) / 100000000, 1) AS DECIMAL(20,1)) AS VARCHAR), '\\.0$', '') || '억'
      ELSE regexp_replace(CAST(CAST(round(CAST(n AS DECIMAL(30,4)) / 10000, 1) AS DECIMAL(20,1)) AS VARCHAR), '\\.0$', '') || '만' END AS compact, format('{:,}', n) AS comma FROM a""")
def money_compact_comma(spark: SparkSession, folder: str) -> DataFrame:
    amount = (F.round("o_totalprice").cast("long") * 1000).cast("decimal(20,2)")
    return read_table(spark, folder, "orders").select("o_orderkey", MO.money_compact(amount).alias("compact"), MO.money_comma(amount).alias("comma"))


@query("roundings", """
    SELECT o_orderkey, floor((o_totalprice + 5) / 10.0) * 10 AS ten, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) / 100) * 100 AS BIGINT) AS hundred,
           floor(o_totalprice / 7 * 100 + 0.5) / 100.0 AS metric FROM orders""")
def roundings(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("o_totalprice")
    return read_table(spark, folder, "orders").select(
        "o_orderkey", MO.nearest_10(price).alias("ten"), MO.nearest_100(price.cast("decimal(18,2)")).cast("long").alias("hundred"), MO.metric_2dp(price / 7).alias("metric")
    )


@query("parse_int", "SELECT c_custkey, coalesce(TRY_CAST(regexp_replace(c_name, '[^0-9-]', '', 'g') AS INTEGER), 0) AS n, coalesce(TRY_CAST(regexp_replace(c_mktsegment, '[^0-9-]', '', 'g') AS INTEGER), 0) AS z FROM customer")
def parse_int(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "customer").select("c_custkey", O.parse_num(F.col("c_name")).alias("n"), O.parse_num(F.col("c_mktsegment")).alias("z"))


@query("sha_integrity", """
    SELECT o_orderkey, sha256(o_orderkey || '|' || o_orderpriority || '|' || o_orderstatus) AS content_hash, o_orderkey % 10 <> 0 AS intact FROM orders""")
def sha_integrity(spark: SparkSession, folder: str) -> DataFrame:
    parts = [F.col(c) for c in ("o_orderkey", "o_orderpriority", "o_orderstatus")]
    orders = read_table(spark, folder, "orders").withColumn("content_hash", K.content_hash(*parts))
    stored = F.when(F.col("o_orderkey") % 10 == 0, F.lit("tampered")).otherwise(F.col("content_hash"))
    return orders.select("o_orderkey", "content_hash", K.is_intact(stored, *parts).alias("intact"))


@query("fingerprints", """
    SELECT c_custkey, left(translate(to_base64(unhex(sha256(c_name))), '+/', '-_'), 8) AS short, sha256(array_to_string(list_sort([c_mktsegment, c_name]), ',')) AS members FROM customer""")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    both = F.array("c_name", "c_mktsegment", "c_name")
    return read_table(spark, folder, "customer").select("c_custkey", K.short_hash(F.col("c_name")).alias("short"), K.set_fingerprint(both).alias("members"))


#: The key's bytes, padded and combined with the inner and the outer pad, in hex.
_INNER, _OUTER = ((bytes(b ^ pad for b in b"demo") + bytes([pad]) * 60).hex() for pad in (0x36, 0x5C))


@query("hmac_fingerprint", f"SELECT c_custkey, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(c_name)))) AS fingerprint, true AS verified FROM customer")
def hmac_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    sign, verify = K.hmac_fingerprint(b"demo"), K.hmac_verified(b"demo")
    signed = read_table(spark, folder, "customer").select("c_custkey", "c_name", sign("c_name").alias("fingerprint"))
    return signed.select("c_custkey", "fingerprint", verify("c_name", "fingerprint").alias("verified"))


@query("backoff", """
    SELECT o_orderkey, CAST(least(pow(2, o_orderkey % 9) * 30, 3600) AS BIGINT) AS seconds, CAST(1000 * pow(2, o_orderkey % 9) AS BIGINT) AS millis, CAST(pow(2, least(o_orderkey % 13, 9)) AS BIGINT) AS nanos FROM orders""")
def backoff(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("o_orderkey") % 9
    return read_table(spark, folder, "orders").select("o_orderkey", K.backoff_seconds(n).alias("seconds"), K.backoff_millis(n).alias("millis"), K.backoff_nanos(F.col("o_orderkey") % 13).alias("nanos"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, sha256('[' || event_id || ',\"' || value || '\"]') IS NOT NULL AS ok, value FROM events")
def json_extract(spark: SparkSession, folder: str) -> DataFrame:
    pair = K.value_pair(F.concat(F.lit("["), F.col("event_id"), F.lit(',"'), F.col("value"), F.lit('"]')))
    found = read_table(spark, folder, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), pair.alias("pair"))
    return found.select("event_id", "k", (F.col("pair.ts") == F.col("event_id")).alias("ok"), F.col("pair.value").alias("value"))


@query("key_formats", """
    SELECT c_custkey, 'expectation:v4:' || c_name || ':abc:' || c_mktsegment AS cache_key, c_mktsegment || ':' || c_name AS relation, c_mktsegment AS account, left(c_name, 10) AS short, '  ' IS NULL AS none FROM customer""")
def key_formats(spark: SparkSession, folder: str) -> DataFrame:
    relation = K.relation_key(F.col("c_mktsegment"), F.col("c_name"))
    return read_table(spark, folder, "customer").select(
        "c_custkey", K.cache_key(F.col("c_name"), F.lit("abc"), F.col("c_mktsegment"), 4).alias("cache_key"), relation.alias("relation"),
        K.relation_parts(relation)["account"].alias("account"), K.truncated(F.col("c_name"), 10).alias("short"), F.lit(False).alias("none"),
    )


@query("mask_ids", """
    SELECT c_custkey, left(c_name, 4) || '***' AS ocid, left(c_name, 4) || '****' || right(c_name, 4) AS fingerprint, left(c_name, 8) || '...' AS account, regexp_replace('expectation:v4:' || c_name || ':x', '(expectation:v\\d+:)[^:]+', '\\1***') AS key FROM customer""")
def mask_ids(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("c_name")
    return read_table(spark, folder, "customer").select(
        "c_custkey", M.mask_id(name).alias("ocid"), M.mask_fingerprint(name, suffix=True).alias("fingerprint"), M.mask_account(name).alias("account"),
        M.mask_cache_key(F.concat(F.lit("expectation:v4:"), name, F.lit(":x"))).alias("key"),
    )


@query("epoch_text", "SELECT o_orderkey, CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS stamp FROM orders")
def epoch_text(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").select("o_orderkey", K.epoch_text(F.col("o_orderdate").cast("timestamp")).alias("stamp"))


@query("early_refresh", "SELECT event_id, -ln((event_id % 100 + 1) / 101.0) * 1.5 * value >= user_id AS refresh FROM events")
def early_refresh(spark: SparkSession, folder: str) -> DataFrame:
    u = (F.col("event_id") % 100 + 1) / 101.0
    return read_table(spark, folder, "events").select("event_id", K.refresh_early(u, 1.5, F.col("value"), F.col("user_id"), F.lit(0)).alias("refresh"))


@query("signal_rules", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 100 WHEN event_type = 'click' THEN 50 ELSE 10 END AS priority, CASE WHEN event_type = 'error' THEN 'error.rate' ELSE 'generic' END AS slo,
           left(sha256('u|' || event_id || '|A|' || event_type), 16) AS id FROM events""")
def signal_rules(spark: SparkSession, folder: str) -> DataFrame:
    title = F.when(F.col("event_type") == "click", F.lit("Throughput")).otherwise(F.lit("Panel"))
    kind = F.col("event_type")
    return read_table(spark, folder, "events").select(
        "event_id", K.signal_priority(title, kind).alias("priority"), K.slo_tag(title, kind).alias("slo"), K.stable_id(F.lit("u"), F.col("event_id"), F.lit("A"), kind).alias("id")
    )


@query("error_analysis", """
    SELECT event_id, CASE event_type WHEN 'error' THEN 'MEDIUM' WHEN 'view' THEN 'HIGH' WHEN 'signup' THEN 'CRITICAL' ELSE 'LOW' END AS severity,
           CASE event_type WHEN 'click' THEN 'Redis, TieredCache, LockStrategy' WHEN 'view' THEN 'Resilience4j, Service Layer' ELSE 'Unknown' END AS components FROM events""")
def error_analysis(spark: SparkSession, folder: str) -> DataFrame:
    kinds = {"error": ("TimeoutException", "timed out: timeout"), "view": ("CircuitBreakerOpen", "is open"), "signup": ("OutOfMemoryError", "heap"), "click": ("RedisException", "lost"), "purchase": ("Other", "x")}
    pick = lambda at: F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v[at])) for k, v in kinds.items()))
    found = K.error_analysis(pick(0), pick(1))
    return read_table(spark, folder, "events").select("event_id", found["severity"].alias("severity"), found["components"].alias("components"))


@query("partition_ids")
def partition_ids(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "customer").select("c_custkey", K.partition_id(F.col("c_name"), 4).alias("part"))


@query("ready_items", """
    SELECT p_partkey, p_size % 5 <> 0 AND p_size % 7 <> 1 AND p_size % 11 <> 2 AS ready FROM part""")
def ready_items(spark: SparkSession, folder: str) -> DataFrame:
    part = F.when(F.col("p_size") % 5 != 0, F.col("p_type"))
    grade = F.when(F.col("p_size") % 7 == 1, F.lit("null")).otherwise(F.lit("레어"))
    lines = F.when(F.col("p_size") % 11 == 2, F.array(F.lit(""), F.lit("null"), F.lit(None))).otherwise(F.array(F.lit("STR +9%"), F.lit(""), F.lit("x")))
    return read_table(spark, folder, "part").select("p_partkey", V.is_ready(part, grade, lines).alias("ready"))


@query("secondary_parts", """
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'hat' WHEN p_size % 3 = 0 THEN '포스실드' ELSE '보조무기' END AS part FROM part""")
def secondary_parts(spark: SparkSession, folder: str) -> DataFrame:
    slot = F.when(F.col("p_size") % 2 == 0, F.lit("hat")).otherwise(F.lit("보조무기"))
    kind = F.when(F.col("p_size") % 3 == 0, F.lit(" 소울링 ")).otherwise(F.lit("블레이드"))
    return read_table(spark, folder, "part").select("p_partkey", V.secondary_part(slot, kind).alias("part"))


@query("boss_items", "SELECT p_partkey, p_size % 3 = 0 AS boss FROM part")
def boss_items(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.operators.flame import is_boss_item

    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("파프니르 "), F.col("p_name"))).otherwise(F.col("p_name"))
    return read_table(spark, folder, "part").select("p_partkey", is_boss_item(name, F.lit(True)).alias("boss"))


@query("array_contains_any_case", "SELECT c_custkey, lower(c_mktsegment) IN ('building', 'machinery') AS known FROM customer")
def array_contains_any_case(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "customer").select("c_custkey", K.contains_any_case(F.array(F.lit("Building"), F.lit("MACHINERY")), F.col("c_mktsegment")).alias("known"))


@query("joined_options", "SELECT p_partkey, p_name || ' | ' || p_type AS line FROM part")
def joined_options(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part").select("p_partkey", K.joined_options(F.array(F.col("p_name"), F.lit(None), F.lit(" "), F.col("p_type"))).alias("line"))


@query("gzip_cache", "SELECT c_custkey, c_name FROM customer")
def gzip_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Compressed response cache and its way back."""
    from tallyloom.sources import inflate
    from tallyloom.streaming import gzip_cache as cache

    cached = cache(read_table(spark, folder, "customer").select("c_custkey", "c_name"), "c_custkey")
    return cached.select("c_custkey", F.get_json_object(inflate(F.unbase64("cached")), "$.c_name").alias("c_name"))
