"""Hashes, fingerprints, keys, time stamps and other small functions."""

from __future__ import annotations

import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_hash(*parts: Column) -> Column:
    """SHA-256 hex of the parts joined by ``|``."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)), 256)


def is_intact(stored: Column, *parts: Column) -> Column:
    return F.coalesce(stored == content_hash(*parts), F.lit(False))


def short_hash(text: Column, size: int = 8) -> Column:
    """URL-safe base64 of SHA-256, shortened."""
    return F.left(F.translate(F.base64(F.unhex(F.sha2(text, 256))), "+/", "-_"), F.lit(size))


def set_fingerprint(members: Column) -> Column:
    """SHA-256 of a set's members: sorted, comma-joined; order and repeats don't matter."""
    return F.sha2(sorted_key(members), 256)


def sorted_key(members: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(members)), ",")


def hmac_fingerprint(key: bytes):
    """A vectorised function: HMAC-SHA256 hex of a text; no built-in has it."""

    @F.pandas_udf(T.StringType())
    def sign(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: None if t is None else hmac.new(key, t.encode(), "sha256").hexdigest())

    return sign


def hmac_verified(key: bytes):
    """A vectorised function: whether a fingerprint is that of a text, compared in constant time."""

    @F.pandas_udf(T.BooleanType())
    def verify(texts: pd.Series, given: pd.Series) -> pd.Series:
        pairs = zip(texts, given, strict=True)
        return pd.Series([t is not None and g is not None and hmac.compare_digest(hmac.new(key, t.encode(), "sha256").hexdigest(), g) for t, g in pairs])

    return verify


def epoch_text(moment: Column) -> Column:
    """Epoch seconds (UTC) as text; null is ``0``."""
    return F.coalesce(F.unix_timestamp(moment).cast("string"), F.lit("0"))


def cache_key(owner: Column, fingerprint: Column, table_hash: Column, version: int) -> Column:
    return F.concat(F.lit(f"expectation:v{version}:"), owner, F.lit(":"), fingerprint, F.lit(":"), table_hash)


def backoff_seconds(retries: Column, base: int = 30, most: int = 3600) -> Column:
    return F.least(F.pow(F.lit(2.0), retries) * base, F.lit(float(most))).cast("long")


def backoff_millis(retries: Column, base: int = 1000) -> Column:
    return F.lit(base).cast("long") * F.pow(F.lit(2.0), retries).cast("long")


def backoff_nanos(attempt: Column) -> Column:
    return F.pow(F.lit(2.0), F.least(attempt, F.lit(9))).cast("long")


def truncated(text: Column, size: int = 500) -> Column:
    return F.left(text, F.lit(size))


def refresh_early(u: Column, beta: float, compute: Column, expiry: Column, now: Column) -> Column:
    """-ln(u) * beta * compute time >= time left; ``u`` is a column in (0, 1]."""
    return -F.ln(u) * beta * compute >= expiry - now


def signal_priority(title: Column, expr: Column) -> Column:
    """100, 50 or 10 by words in the title and the query."""
    text = F.lower(F.concat_ws(" ", title, expr))
    # Words of high and middle priority.
    high = text.rlike("p99|error|timeout|deadletter|dlq|lag|pending|pool|gc|oom|lock")
    middle = text.rlike("hit rate|throughput|latency")
    return F.when(high, 100).when(middle, 50).otherwise(10)


def slo_tag(title: Column, expr: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, expr))
    return F.when(text.contains("p99"), "latency.p99").when(text.contains("error") | expr.contains("5.."), "error.rate").otherwise("generic")


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-256 of the parts joined by ``|``."""
    return F.left(content_hash(*parts), F.lit(16))


def thresholds(steps: Column) -> Column:
    """struct<warn, crit>: the first two values of steps that have one; none for fewer than two steps."""
    valued = F.filter(steps, lambda s: s["value"].isNotNull())
    enough = F.size(steps) >= 2
    return F.struct(
        F.when(enough, F.get(valued, 0)["value"]).alias("warn"), F.when(enough, F.get(valued, 1)["value"]).alias("crit")
    )


def signed_percent(value: Column) -> Column:
    return F.format_string("%+.1f%%", value)


def threshold_reason(severity: Column, title: Column, value: Column, comparator: Column, limit: Column, unit: Column) -> Column:
    text = F.format_string("[%s] %s: Current value %.2f %s threshold %.2f (%s)", severity, title, value, F.coalesce(comparator, F.lit(">")), limit, F.coalesce(unit, F.lit("")))
    return F.trim(text)


def zscore_reason(title: Column, value: Column, z: Column, mean: Column, deviation: Column, threshold: Column) -> Column:
    return F.format_string("[Z-SCORE] %s: Value %.2f deviates %.2fσ from baseline %.2f (σ=%.2f, threshold=%.1f)", title, value, z, mean, deviation, threshold)


def joined_options(options: Column) -> Column:
    return F.array_join(F.filter(options, lambda o: o.isNotNull() & (F.trim(o) != "")), " | ")


def relation_key(account: Column, target: Column) -> Column:
    return F.concat_ws(":", account, target)


def relation_parts(key: Column) -> Column:
    """struct<account, target>: split at the first colon only."""
    parts = F.split(key, ":", 2)
    return F.struct(F.get(parts, 0).alias("account"), F.get(parts, 1).alias("target"))


def safe_long(text: Column) -> Column:
    return F.coalesce(text.cast("string").try_cast("long"), F.lit(0).cast("long"))


def value_pair(text: Column) -> Column:
    """struct<ts, value> of a JSON pair ``[ts, "v"]``; a bad value is 0."""
    pair = F.from_json(text, "array<string>")
    return F.struct(
        F.get(pair, 0).try_cast("double").cast("long").alias("ts"),
        F.coalesce(F.get(pair, 1).try_cast("double"), F.lit(0.0)).alias("value"),
    )


def partition_id(key: Column, parts: int) -> Column:
    return F.pmod(F.hash(key), F.lit(parts))


def contains_any_case(values: Column, wanted: Column) -> Column:
    return F.coalesce(F.exists(values, lambda v: F.lower(v) == F.lower(wanted)), F.lit(False))


# Rules of error texts, in order; every word of a rule's row must be there.
ERROR_CAUSES = [
    ((("timeout",), ("timed out",)), "타임아웃 발생 - 외부 서비스 응답 지연 또는 네트워크 문제"),
    ((("connection", "refused"),), "연결 거부 - 대상 서비스 다운 또는 방화벽 차단"),
    ((("circuit", "open"),), "서킷브레이커 오픈 - 연속 장애로 보호 모드 진입"),
    ((("redis",), ("redisson",)), "Redis 관련 오류 - 캐시/락 서비스 문제"),
    ((("hikari",), ("connection pool",)), "DB 커넥션 풀 문제 - 커넥션 부족 또는 누수 의심"),
    ((("outofmemory",), ("heap",)), "메모리 부족 - JVM 힙 메모리 소진"),
    ((("thread", "exhaust"),), "스레드 풀 고갈 - 동시 요청 초과"),
]
NO_CAUSE = "원인 분석 필요 - 수동 점검 권장"
# Severities by words, in order.
SEVERITIES = [(("outofmemory", "critical"), "CRITICAL"), (("circuit", "pool exhausted"), "HIGH"), (("timeout", "connection"), "MEDIUM")]
# Components and actions by parts of the error's type (case counts).
COMPONENTS = [
    (("Redis",), "Redis, TieredCache, LockStrategy"),
    (("Hikari", "DataSource"), "MySQL, Repository Layer"),
    (("Nexon", "External"), "NexonApiClient, ExternalService"),
    (("CircuitBreaker",), "Resilience4j, Service Layer"),
]
ACTIONS = [
    (("Timeout",), "1. 대상 서비스 상태 확인\n2. 네트워크 지연 점검\n3. 타임아웃 값 검토"),
    (("Connection",), "1. 연결 대상 서비스 확인\n2. 방화벽/보안그룹 점검\n3. DNS 확인"),
    (("Circuit",), "1. 서킷브레이커 상태 확인\n2. 장애 원인 파악\n3. 수동 리셋 고려"),
]
NO_ACTION = "1. 로그 상세 확인\n2. 메트릭 모니터링\n3. 개발팀 에스컬레이션"


def _by_words(text: Column, rules: list, default: str) -> Column:
    chain = None
    for words, result in rules:
        hit = F.lit(False)
        for word in words:
            every = F.lit(True)
            for part in (word if isinstance(word, tuple) else (word,)):
                every = every & text.contains(part)
            hit = hit | every
        chain = F.when(hit, result) if chain is None else chain.when(hit, result)
    return chain.otherwise(default)


def error_analysis(error_type: Column, message: Column) -> Column:
    """struct<cause, severity, components, actions> of an error by keyword rules."""
    kind = F.coalesce(error_type, F.lit(""))
    text = F.lower(F.concat(kind, F.lit(" "), F.coalesce(message, F.lit(""))))
    return F.struct(
        _by_words(text, ERROR_CAUSES, NO_CAUSE).alias("cause"),
        _by_words(text, SEVERITIES, "LOW").alias("severity"),
        _by_words(kind, COMPONENTS, "Unknown").alias("components"),
        _by_words(kind, ACTIONS, NO_ACTION).alias("actions"),
    )


def top_lines(trace: Column, count: int) -> Column:
    return F.array_join(F.slice(F.split(trace, "\n", -1), 1, count), "\n")
