"""Relational queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import relational as R
from tallyloom.plans.registry import query
from tallyloom.sources import read_table


def money(column: str) -> F.Column:
    """Exact cents of a double."""
    return F.col(column).cast("decimal(18,2)")


@query("scan_filter_project", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
    WHERE l_quantity >= 45 AND l_discount > 0.05 AND l_returnflag = 'R'""")
def scan_filter_project(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "lineitem")
    kept = rows.where((F.col("l_quantity") >= 45) & (F.col("l_discount") > 0.05) & (F.col("l_returnflag") == "R"))
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def _outbox(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as outbox rows: status, due time, lock time."""
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "PROCESSING").otherwise("COMPLETED")
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("next_retry_at"), F.col("o_orderdate").alias("locked_at"), "o_totalprice"
    )


_OUTBOX = """(SELECT o_orderkey AS id, o_orderdate AS next_retry_at, o_orderdate AS locked_at, o_totalprice,
    CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'PROCESSING' ELSE 'COMPLETED' END AS status FROM orders)"""


@query("in_list_due_topn", f"""
    SELECT id, status, o_totalprice FROM {_OUTBOX}
    WHERE status IN ('PENDING', 'FAILED') AND next_retry_at <= TIMESTAMP '1998-01-01' ORDER BY id LIMIT 100""")
def in_list_due_topn(spark: SparkSession, folder: str) -> DataFrame:
    due = R.due_rows(_outbox(spark, folder), ["PENDING", "FAILED"], F.lit("1998-01-01").cast("timestamp_ntz"), 100)
    return due.select("id", "status", "o_totalprice")


@query("stalled_rows", f"""
    SELECT id, status FROM {_OUTBOX}
    WHERE status = 'PROCESSING' AND locked_at < TIMESTAMP '1996-01-01' - INTERVAL 5 MINUTE ORDER BY id LIMIT 100""")
def stalled_rows(spark: SparkSession, folder: str) -> DataFrame:
    return R.stalled_rows(_outbox(spark, folder), F.lit("1996-01-01").cast("timestamp_ntz")).select("id", "status")


@query("bulk_reset", f"""
    SELECT CASE WHEN status = 'PROCESSING' AND locked_at < TIMESTAMP '1998-01-01' - INTERVAL 5 MINUTE THEN 'PENDING' ELSE status END AS status,
           count(*) AS n FROM {_OUTBOX} GROUP BY 1""")
def bulk_reset(spark: SparkSession, folder: str) -> DataFrame:
    rows = _outbox(spark, folder).withColumn("locked_by", F.lit("w1"))
    return R.reset_stalled(rows, F.lit("1998-01-01").cast("timestamp_ntz")).groupBy("status").agg(F.count("*").alias("n"))


@query("point_lookup", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77")
def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "customer").where(F.col("c_custkey") == 77).select("c_custkey", "c_name", "c_acctbal")


@query("key_pattern_scan", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#0000001%'")
def key_pattern_scan(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.sources import keys_like

    return keys_like(read_table(spark, folder, "customer").select("c_custkey", "c_name"), "c_name", "Customer#0000001*")


@query("fresh_rows", """
    SELECT o_orderkey, o_orderdate > TIMESTAMP '2001-08-01' - INTERVAL 15 DAY AS fresh,
           o_orderdate > TIMESTAMP '2001-08-01' - INTERVAL 30 DAY AS active,
           o_orderdate <= TIMESTAMP '2001-08-01' - INTERVAL 15 MINUTE AS refresh
    FROM orders""")
def fresh_rows(spark: SparkSession, folder: str) -> DataFrame:
    as_of = F.lit("2001-08-01").cast("timestamp_ntz")
    at = F.col("o_orderdate")
    return read_table(spark, folder, "orders").select(
        "o_orderkey", R.is_fresh(at, as_of, "15 days").alias("fresh"), R.is_fresh(at, as_of, "30 days").alias("active"), R.is_stale(at, as_of, "15 minutes").alias("refresh")
    )


@query("conjunctive_search", """
    SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY' AND p_size >= 10""")
def conjunctive_search(spark: SparkSession, folder: str) -> DataFrame:
    part = read_table(spark, folder, "part")
    return part.where((F.col("p_brand") == "Brand#2") & (F.col("p_type") == "ECONOMY") & (F.col("p_size") >= 10)).select("p_partkey", "p_name")


@query("comparator_dispatch", """
    SELECT p_partkey, CASE CAST(p_partkey % 6 AS INTEGER)
             WHEN 1 THEN p_size >= 25 WHEN 2 THEN p_size < 25 WHEN 3 THEN p_size <= 25
             WHEN 4 THEN abs(p_size - 25) < 1e-4 ELSE p_size > 25 END AS exceeded FROM part""")
def comparator_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*map(F.lit, (">", ">=", "lt", "<=", "==", "other")))
    comparator = F.get(names, (F.col("p_partkey") % 6).cast("int"))
    return read_table(spark, folder, "part").select("p_partkey", R.exceeds(F.col("p_size").cast("double"), F.lit(25.0), comparator).alias("exceeded"))


@query("label_matchers", """
    SELECT event_type, count(*) AS n FROM events
    WHERE regexp_full_match(event_type, 'er.*|click') AND regexp_full_match(CAST(user_id AS VARCHAR), '1..') GROUP BY event_type""")
def label_matchers(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "events")
    kept = rows.where(R.matches_label(F.col("event_type"), "er.*|click") & R.matches_label(F.col("user_id").cast("string"), "1.."))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query("semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_exists(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return R.existing(read_table(spark, folder, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


@query("anti_missing", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_missing(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return R.missing(read_table(spark, folder, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


@query("left_fetch_join", """
    SELECT c.c_custkey, c.c_name, o.o_orderkey FROM customer c
    LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON o.o_custkey = c.c_custkey""")
def left_fetch_join(spark: SparkSession, folder: str) -> DataFrame:
    first = read_table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return R.fetch_one(read_table(spark, folder, "customer").select("c_custkey", "c_name"), first, "c_custkey")


_TIERS = [(1, "low"), (10, "middle"), (25, "high"), (40, "top")]


@query("floor_asof_tier", """
    WITH t(floor, tier) AS (VALUES (1, 'low'), (10, 'middle'), (25, 'high'), (40, 'top'))
    SELECT p_partkey, p_size - 5 AS level,
           coalesce((SELECT tier FROM t WHERE floor <= p_size - 5 ORDER BY floor DESC LIMIT 1), 'low') AS tier FROM part""")
def floor_asof_tier(spark: SparkSession, folder: str) -> DataFrame:
    tiers = spark.createDataFrame(_TIERS, "floor int, tier string")
    parts = read_table(spark, folder, "part").select("p_partkey", (F.col("p_size") - 5).alias("level"))
    return R.floor_join(parts, tiers, "level", "floor").select("p_partkey", "level", "tier")


@query("range_bucket", """
    SELECT p_partkey, CASE WHEN p_size * 5 <= 94 THEN 5 WHEN p_size * 5 <= 107 THEN 8 WHEN p_size * 5 <= 117 THEN 10
           WHEN p_size * 5 <= 127 THEN 15 WHEN p_size * 5 <= 137 THEN 20 ELSE 30 END AS star_cap FROM part""")
def range_bucket(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.operators.starforce import star_cap

    return read_table(spark, folder, "part").select("p_partkey", star_cap(F.col("p_size") * 5).alias("star_cap"))


@query("prefix_theta_join", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' OR p_name LIKE 'hot g%' OR p_name LIKE 'red%'")
def prefix_theta_join(spark: SparkSession, folder: str) -> DataFrame:
    prefixes = spark.createDataFrame([("small",), ("hot g",), ("red",)], "prefix string")
    return R.prefix_join(read_table(spark, folder, "part").select("p_partkey", "p_name"), prefixes, "p_name")


@query("snapshot_plus_delta", """
    SELECT c_custkey, greatest(CAST(floor(c_acctbal) AS BIGINT) + coalesce(d, 0), 0) AS balance FROM customer
    LEFT JOIN (SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN -1000 ELSE 100 END) AS BIGINT) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def snapshot_plus_delta(spark: SparkSession, folder: str) -> DataFrame:
    stored = read_table(spark, folder, "customer").select("c_custkey", F.floor("c_acctbal").cast("long").alias("balance"))
    deltas = read_table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", -1000).otherwise(100).alias("delta"))
    return R.snapshot_plus_delta(stored, deltas, "c_custkey", "balance", "delta")


@query("increment_update", """
    SELECT c_custkey, c_nationkey + coalesce(n, 0) AS n FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def increment_update(spark: SparkSession, folder: str) -> DataFrame:
    stored = read_table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("n"))
    deltas = read_table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("delta"))
    return R.snapshot_plus_delta(stored, deltas, "c_custkey", "n", "delta")


@query("fallback_lookup", """
    SELECT c_custkey, coalesce(a.v, b.v) AS v FROM customer c
    LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 450000 GROUP BY 1) a ON a.k = c_custkey
    LEFT JOIN (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_totalprice > 300000 GROUP BY 1) b ON b.k = c_custkey
    WHERE c_nationkey <> 3""")
def fallback_lookup(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    first = orders.where("o_orderstatus = 'F' and o_totalprice > 450000").groupBy("c_custkey").agg(F.max("o_orderkey").alias("v"))
    second = orders.where("o_totalprice > 300000").groupBy("c_custkey").agg(F.min("o_orderkey").alias("v"))
    customer = read_table(spark, folder, "customer")
    return R.fallback_lookup(customer.select("c_custkey"), customer.where("c_nationkey = 3"), [first, second], "c_custkey", "v")


@query("vector_ratio", """
    SELECT l_returnflag, CAST(a.n AS DOUBLE) / b.n * 100 AS value FROM
      (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) a
      JOIN (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) b USING (l_returnflag)""")
def vector_ratio(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "lineitem")
    part = rows.where("l_linestatus = 'F'").groupBy("l_returnflag").agg(F.count("*").alias("value"))
    return R.ratio(part, rows.groupBy("l_returnflag").agg(F.count("*").alias("value")), ["l_returnflag"], 100.0)


@query("status_rollup", """
    SELECT o_orderstatus, count(*) AS n, CAST(epoch(min(o_orderdate)) AS BIGINT) AS oldest, CAST(epoch(max(o_orderdate)) AS BIGINT) AS newest,
           CAST(date_diff('second', min(o_orderdate), TIMESTAMP '2001-08-02') // 60 AS BIGINT) AS lag_minutes FROM orders GROUP BY 1""")
def status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    stamp = lambda c: F.unix_timestamp(c.cast("timestamp"))
    grouped = read_table(spark, folder, "orders").groupBy("o_orderstatus")
    found = grouped.agg(F.count("*").alias("n"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    as_of = stamp(F.lit("2001-08-02").cast("timestamp_ntz"))
    return found.select("o_orderstatus", "n", stamp(F.col("a")).alias("oldest"), stamp(F.col("b")).alias("newest"), F.floor((as_of - stamp(F.col("a"))) / 60).cast("long").alias("lag_minutes"))


@query("error_rollup", """
    SELECT event_type, count(*) AS n, round(CAST(avg(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 6) AS mean FROM events
    WHERE ts >= TIMESTAMP '2024-01-30' GROUP BY 1 ORDER BY n DESC, event_type""")
def error_rollup(spark: SparkSession, folder: str) -> DataFrame:
    recent = read_table(spark, folder, "events").where(F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz"))
    mean = F.round(F.sum(money("value")).cast("double") / F.count("value"), 6)
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), mean.alias("mean")).orderBy(F.desc("n"), "event_type")


@query("prefix_having", "SELECT left(text, 50) AS head, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def prefix_having(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return docs.groupBy(F.left("text", F.lit(50)).alias("head")).agg(F.count("*").alias("n")).where("n > 1")


@query("reconcile_invariant", """
    SELECT (SELECT count(*) FROM orders) AS expected, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS done,
           (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS dead,
           (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS mismatch""")
def reconcile_invariant(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    return R.reconcile(orders, orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"))


@query("state_counts", """
    SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p,
           count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) AS n_all FROM orders""")
def state_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.state_counts(read_table(spark, folder, "orders"), ["O", "P", "F"], "o_orderstatus")


@query("count_all", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_owners FROM orders")
def count_all(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_owners"))


@query("delta_merge", """
    SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS delta FROM orders GROUP BY 1""")
def delta_merge(spark: SparkSession, folder: str) -> DataFrame:
    merged = R.merge_deltas(read_table(spark, folder, "orders").select("o_custkey", money("o_totalprice").alias("delta")), "o_custkey")
    return merged.withColumn("delta", F.col("delta").cast("double"))


@query("set_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def set_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select("user_id", "event_type").dropDuplicates()


@query("keyset_page", """
    SELECT o_orderkey, o_totalprice, true AS has_next, (SELECT max(k) FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey > 5000 ORDER BY 1 LIMIT 20)) AS next_cursor
    FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 20""")
def keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    return R.keyset_page(read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5000, 20)


@query("offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 200")
def offset_page(spark: SparkSession, folder: str) -> DataFrame:
    return R.offset_page(read_table(spark, folder, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 10, 20).select("o_orderkey", "o_totalprice")


@query("chunk_ids", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS chunk FROM orders")
def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    return R.chunks(read_table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("sample_n")
def sample_n(spark: SparkSession, folder: str) -> DataFrame:
    return R.sample_n(read_table(spark, folder, "events").select("event_id", "user_id"), 100, "event_id", 42)


@query("latest_wins_upsert", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey % 2 DESC, o_orderkey DESC) AS rn FROM orders)
    WHERE rn = 1""")
def latest_wins_upsert(spark: SparkSession, folder: str) -> DataFrame:
    # order of changes: date, then changes (odd keys) before stored rows, then the key
    orders = read_table(spark, folder, "orders").withColumn(
        "version", F.struct("o_orderdate", (F.col("o_orderkey") % 2).alias("odd"), "o_orderkey")
    )
    merged = R.merge_latest(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), ["o_custkey"], "version")
    return merged.select("o_custkey", "o_orderkey", "o_totalprice")


@query("toggle_parity", "SELECT user_id, event_type, count(*) AS n_toggles, count(*) % 2 = 1 AS liked FROM events GROUP BY 1, 2")
def toggle_parity(spark: SparkSession, folder: str) -> DataFrame:
    return R.toggle_parity(read_table(spark, folder, "events"), ["user_id", "event_type"])


@query("set_effects", """
    SELECT * FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 480000""")
def set_effects(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").withColumnRenamed("o_custkey", "k")
    return R.set_effects(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), orders.where("o_totalprice > 480000"), ["k"])


@query("balance_transfer", """
    SELECT account, CAST(sum(n) AS DOUBLE) AS net FROM (
      SELECT o_custkey AS account, -CAST(o_totalprice AS DECIMAL(18,2)) AS n FROM orders
      UNION ALL SELECT (o_custkey * 7 + 3) % 1000, CAST(o_totalprice AS DECIMAL(18,2)) FROM orders) GROUP BY 1""")
def balance_transfer(spark: SparkSession, folder: str) -> DataFrame:
    moves = read_table(spark, folder, "orders").select("o_custkey", ((F.col("o_custkey") * 7 + 3) % 1000).alias("receiver"), money("o_totalprice").alias("amount"))
    return R.transfers(moves, "o_custkey", "receiver", "amount").withColumn("net", F.col("net").cast("double"))


@query("debit_if_covered", """
    WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey AS k, CAST(c_acctbal * 100 AS DECIMAL(18,2)) AS balance, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders JOIN customer ON c_custkey = o_custkey),
    f AS (SELECT k, o_orderkey, rn, CASE WHEN balance >= amount THEN balance - amount ELSE balance END AS point, balance >= amount AS accepted FROM o WHERE rn = 1
          UNION ALL SELECT o.k, o.o_orderkey, o.rn, CASE WHEN point >= amount THEN point - amount ELSE point END, point >= amount FROM f JOIN o ON o.k = f.k AND o.rn = f.rn + 1)
    SELECT o_orderkey, accepted FROM f""")
def debit_if_covered(spark: SparkSession, folder: str) -> DataFrame:
    accounts = read_table(spark, folder, "customer").select("c_custkey", (F.col("c_acctbal") * 100).cast("decimal(18,2)").alias("balance"))
    debits = read_table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", money("o_totalprice").alias("amount"))
    debits = R.existing(debits, accounts, ["c_custkey"])
    return R.debit_if_covered(accounts, debits, "c_custkey", "balance", "amount", "o_orderkey").select("o_orderkey", "accepted")


@query("dead_letter_split", """
    SELECT CASE WHEN o_orderkey % 5 >= 3 OR o_orderstatus = 'F' THEN 'dead' ELSE 'live' END AS side, count(*) AS n FROM orders GROUP BY 1""")
def dead_letter_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "orders").select((F.col("o_orderkey") % 5).alias("retry_count"), F.lit("FAILED").alias("status"), (F.col("o_orderstatus") != "F").alias("intact"))
    live, dead = R.dead_letters(rows)
    return live.select(F.lit("live").alias("side")).unionAll(dead.select(F.lit("dead").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


@query("capped_log", "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 500")
def capped_log(spark: SparkSession, folder: str) -> DataFrame:
    return R.capped(read_table(spark, folder, "events").select("event_id", "user_id"), "event_id", 500)


@query("delete_by_key", "SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderstatus) NOT IN (SELECT c_custkey, 'F' FROM customer WHERE c_nationkey = 5)")
def delete_by_key(spark: SparkSession, folder: str) -> DataFrame:
    gone = read_table(spark, folder, "customer").where("c_nationkey = 5").select(F.col("c_custkey").alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    return R.missing(read_table(spark, folder, "orders"), gone, ["o_custkey", "o_orderstatus"]).select("o_orderkey", "o_custkey")


@query("topk_orders_per_customer", """
    SELECT o_custkey, o_orderkey, rank FROM (
      SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3""")
def topk_orders_per_customer(spark: SparkSession, folder: str) -> DataFrame:
    return R.top_k_per_group(read_table(spark, folder, "orders"), ["o_custkey"], "o_totalprice", 3, "o_orderkey").select("o_custkey", "o_orderkey", "rank")
