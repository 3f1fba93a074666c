"""Rules with memory, in batch: throttles, budgets, buckets and state machines.

Rules whose next state depends on what they let through are folds. ``fold`` streams
rows in key and time order, so that a key of any size needs the memory of its state
alone; the rest are windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyloom.session import cut

Step = Callable[[Any, dict], tuple[Any, Any]]


def fold(rows: DataFrame, key: str, order: list[str], step: Step, result: str, kind: str, needs: list[str] | None = None) -> DataFrame:
    """``rows`` with a column ``result``: step(state, row) -> (state, result), state None at a key's start.

    ``row`` has the key, the order and the columns that the step ``needs`` (all if None);
    the others pass through untouched. Rows of equal order come by a hash of the row.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(result, T._parse_datatype_string(kind))])
    names = rows.columns
    used = names if needs is None else list(dict.fromkeys([key, *order, *needs]))
    arrow = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64(), "double": pa.float64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, state = False, None, None
        for batch in batches:
            keys = batch.column(key).to_pylist()
            found = []
            for own, values in zip(keys, zip(*(batch.column(n).to_pylist() for n in used), strict=True), strict=True):
                if not begun or own != now:
                    begun, now, state = True, own, None
                state, value = step(state, dict(zip(used, values, strict=True)))
                found.append(value)
            own = batch.select(names)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, arrow)], names=[*names, result])

    tie = F.xxhash64(*(F.col(n).cast("string") for n in names))
    dealt = rows.repartition(key).withColumn("__tie", tie).sortWithinPartitions(key, *order, "__tie")
    return dealt.mapInArrow(run, schema)


def cooldown(events: DataFrame, key: str, seconds: str, wait: int = 60, tie: str | None = None) -> DataFrame:
    """``emitted``: the first event of a key, then each at least ``wait`` after the last one emitted."""

    def step(last: int | None, row: dict) -> tuple[int | None, bool]:
        now = row[seconds]
        if now is None:
            return last, False
        return (now, True) if last is None or now - last >= wait else (last, False)

    return fold(events, key, [seconds, *([tie] if tie else [])], step, "emitted", "boolean", [])


def duplicates_in_window(events: DataFrame, key: str, seconds: str, wait: int = 300, tie: str | None = None) -> DataFrame:
    """``is_new``: as ``cooldown``; looking a key up doesn't prolong its window."""
    return cooldown(events, key, seconds, wait, tie).withColumnRenamed("emitted", "is_new")


def budget_from_first(events: DataFrame, key: str, seconds: str, limit: int = 100, length: int = 60, tie: str | None = None) -> DataFrame:
    """``allowed``: ``limit`` events per window, which opens at the first event after the last one ended; none without a time."""

    def step(state: tuple[int, int] | None, row: dict) -> tuple[tuple[int, int] | None, bool]:
        now = row[seconds]
        if now is None:
            return state, False
        start, used = state if state else (now, 0)
        if now - start >= length:
            start, used = now, 0
        ok = used < limit
        return (start, used + ok), ok

    return fold(events, key, [seconds, *([tie] if tie else [])], step, "allowed", "boolean", [])


def token_bucket(events: DataFrame, key: str, seconds: str, capacity: int = 100, refill: int = 10, every: int = 6, tie: str | None = None) -> DataFrame:
    """``allowed``: a bucket of ``capacity`` that gets ``refill`` tokens every ``every`` seconds from a key's first event; none without a time."""

    def step(state: tuple[int, int, int] | None, row: dict) -> tuple[tuple[int, int, int] | None, bool]:
        now = row[seconds]
        if now is None:
            return state, False
        start, ticks, tokens = state if state else (now, 0, capacity)
        due = (now - start) // every
        if due > ticks:
            tokens, ticks = min(capacity, tokens + (due - ticks) * refill), due
        ok = tokens > 0
        return (start, ticks, tokens - ok), ok

    return fold(events, key, [seconds, *([tie] if tie else [])], step, "allowed", "boolean", [])


def _first_per_group(events: DataFrame, group: dict[str, Column], ts: str, tie: str, limit: int, max_broadcast: int = 100_000) -> DataFrame:
    """``allowed``: the first ``limit`` events of each group; an event without a time is not.

    Only the last allowed event of a group is looked for: the rank's limit is applied
    before the shuffle, and the events are compared with that one row, which is broadcast
    up to a checked number of groups. A null key is a key.
    """
    stamped = events.withColumns(group)
    place = F.struct(ts, tie)
    rank = F.row_number().over(W.partitionBy(*group).orderBy(ts, tie))
    firsts = stamped.where(F.col(ts).isNotNull()).select(*group, ts, tie).withColumn("__rn", rank).where(F.col("__rn") <= limit)
    last = cut(firsts.groupBy(*(F.col(g).alias(f"{g}_of") for g in group)).agg(F.max(place).alias("__last")))
    side = F.broadcast(last) if last.count() <= max_broadcast else last
    joined = stamped.join(side, [F.col(g).eqNullSafe(F.col(f"{g}_of")) for g in group], "left")
    return joined.withColumn("allowed", F.coalesce(place <= F.col("__last"), F.lit(False)) & F.col(ts).isNotNull()).drop(*group, *(f"{g}_of" for g in group), "__last")


def daily_quota(events: DataFrame, ts: str, tie: str, limit: int = 100, key: list[str] | None = None) -> DataFrame:
    """``allowed``: the first ``limit`` events of each day (of each key)."""
    group = {"__day": F.to_date(ts)} | {f"__k{i}": F.col(k) for i, k in enumerate(key or [])}
    return _first_per_group(events, group, ts, tie, limit)


def tumbling_budget(events: DataFrame, key: list[str], ts: str, tie: str, limit: int = 100, length: str = "60 seconds") -> DataFrame:
    """``allowed``: the first ``limit`` events of each aligned window."""
    group = {"__w": F.window(F.col(ts).cast("timestamp"), length).start} | {f"__k{i}": F.col(k) for i, k in enumerate(key)}
    return _first_per_group(events, group, ts, tie, limit)


def outbox_states(attempts: DataFrame, request: str, order: str, max_retries: int = 3) -> DataFrame:
    """One row per request: status and retries after all its attempts.

    ``attempts`` has ``succeeded`` and ``intact``. A broken hash and the third failure are
    dead letters; what is done or dead stays so.
    """

    def step(state: tuple[str, int, int] | None, row: dict) -> tuple[tuple[str, int, int], str]:
        status, retries, n = state or ("PENDING", 0, 0)
        if status in ("PENDING", "FAILED"):
            if row["intact"] is False:
                status = "DEAD_LETTER"
            elif row["succeeded"]:
                status = "COMPLETED"
            else:
                retries += 1
                status = "DEAD_LETTER" if retries >= max_retries else "FAILED"
        return (status, retries, n + 1), f"{status}:{retries}:{n}"

    # the key's own columns alone; states are numbered, so that attempts of one time have a last one
    folded = fold(attempts.select(request, order, "succeeded", "intact"), request, [order], step, "__state", "string")
    number = F.split("__state", ":")[2].cast("long")
    last = folded.groupBy(request).agg(F.max_by("__state", number).alias("__state"), F.count("*").alias("n_attempts"))
    parts = F.split("__state", ":")
    return last.select(request, F.get(parts, 0).alias("status"), F.get(parts, 1).cast("long").alias("retry_count"), "n_attempts")


#: (state, event) -> state; other pairs leave the state as it is.
HEALTH_MOVES = {
    ("HEALTHY", "OPEN"): "DEGRADED",
    ("DEGRADED", "CLOSED"): "RECOVERING",
    ("RECOVERING", "OPEN"): "DEGRADED",
    ("RECOVERING", "RECOVERED"): "HEALTHY",
}


def health_states(events: DataFrame, key: str, order: list[str], event: str = "event") -> DataFrame:
    """``state`` after each event, healthy at first."""

    def step(state: str | None, row: dict) -> tuple[str, str]:
        now = HEALTH_MOVES.get((state or "HEALTHY", row[event]), state or "HEALTHY")
        return now, now

    return fold(events, key, order, step, "state", "string", [event])


def first_of_each(messages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Idempotent processing: the first message of every key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return messages.withColumn("__rn", rank).where("__rn = 1").drop("__rn")


#: Life of a queued message: (state, action) -> state; other pairs leave it as it is.
QUEUE_MOVES = {
    (None, "PUBLISH"): "PENDING",
    ("PENDING", "CONSUME"): "INFLIGHT",
    ("INFLIGHT", "ACK"): "DONE",
    ("INFLIGHT", "NACK"): "RETRY",
    ("INFLIGHT", "REDRIVE"): "PENDING",
    ("RETRY", "DUE"): "PENDING",
    ("DLQ", "REPROCESS"): "PENDING",
    ("DLQ", "DISCARD"): "DONE",
}


def queue_step(action: str = "action", max_retries: int = 3) -> Step:
    """The rule of ``queue_states``, for batches and streams."""

    def step(held: tuple[str | None, int] | None, row: dict) -> tuple[tuple[str | None, int], str | None]:
        state, retries = held or (None, 0)
        now = QUEUE_MOVES.get((state, row[action]), state)
        if (state, row[action]) == ("INFLIGHT", "NACK"):
            retries += 1
            now = "DLQ" if retries > max_retries else "RETRY"
        elif (state, row[action]) == ("DLQ", "REPROCESS"):
            retries = 0
        return (now, retries), now

    return step


def queue_states(actions: DataFrame, message: str, order: list[str], action: str = "action", max_retries: int = 3) -> DataFrame:
    """``state`` of a message after each action; a refusal past ``max_retries`` goes to the dead letters."""
    return fold(actions, message, order, queue_step(action, max_retries), "state", "string", [action])


def recover_stalled(rows: DataFrame, as_of: Column, intact: Column, stale: str = "5 minutes") -> DataFrame:
    """Stalled rows go back to PENDING if their hash holds, else to the dead letters."""
    late = (F.col("status") == "PROCESSING") & (F.col("locked_at") < as_of - F.expr(f"INTERVAL {stale}"))
    return rows.withColumn("status", F.when(late & intact, "PENDING").when(late, "DEAD_LETTER").otherwise(F.col("status")))


def read_group(entries: DataFrame, held: DataFrame, entry: str, last: Column | int | None, as_of: Column, count: int, idle: str = "10 minutes") -> DataFrame:
    """The next ``count`` entries for a consumer of a group, with ``reclaimed``.

    Those that another consumer has ``held`` (entry, consumer, since, times) for ``idle`` or
    longer without an end come first, by entry; only if there are none come entries after
    ``last``, the group's last delivered one (all if None). Held entries that are no longer
    in the log, or have no time, aren't delivered.
    """
    late = held.where(F.col("since") <= as_of - F.expr(f"INTERVAL {idle}")).select(F.col(entry).alias("__held"))
    again = entries.join(late, F.col(entry) == F.col("__held"), "left_semi").orderBy(entry).limit(count)
    after = F.lit(True) if last is None else F.col(entry) > last
    fresh = entries.where(after).orderBy(entry).limit(count)
    either = again.withColumn("reclaimed", F.lit(True)).unionByName(fresh.withColumn("reclaimed", F.lit(False)))
    # two pages at most
    return either.withColumn("__any", F.max("reclaimed").over(W.partitionBy())).where("reclaimed = __any").drop("__any")


def held_after(held: DataFrame, taken: DataFrame, entry: str, consumer: str, now: Column) -> DataFrame:
    """The group's ``held`` entries after a consumer has taken some: theirs from ``now`` on, ``times`` counted on."""
    own = taken.select(F.col(entry).alias("__taken"))
    joined = held.join(own, F.col(entry) == F.col("__taken"), "full")
    mine = F.col("__taken").isNotNull()
    kind = held.schema["since"].dataType
    return joined.select(
        F.coalesce(entry, "__taken").alias(entry),
        F.when(mine, F.lit(consumer)).otherwise(F.col("consumer")).alias("consumer"),
        F.when(mine, now.cast(kind)).otherwise(F.col("since")).alias("since"),
        (F.coalesce("times", F.lit(0)) + mine.cast("int")).cast("long").alias("times"),
    )


def bounded_buffer(events: DataFrame, buffer: str, order: list[str], capacity: int = 10_000, action: str = "action", count: str = "n") -> DataFrame:
    """``accepted``: how many of the rows offered to a write-behind buffer it takes; a full one refuses the whole offer.

    ``OFFER`` adds ``n`` entries if they fit, ``DRAIN`` takes up to ``n`` out; other actions
    and null numbers change nothing and have no result.
    """
    return fold(events, buffer, order, buffer_step(capacity, action, count), "accepted", "long", [action, count])


def buffer_step(capacity: int, action: str = "action", count: str = "n") -> Step:
    """The rule of ``bounded_buffer``, for batches and streams."""

    def step(level: int | None, row: dict) -> tuple[int, int | None]:
        level, n = level or 0, row[count]
        if n is None or row[action] not in ("OFFER", "DRAIN"):
            return level, None
        if row[action] == "DRAIN":
            taken = min(level, n)
            return level - taken, taken
        return (level + n, n) if level + n <= capacity else (level, 0)

    return step


def idempotent_claims(events: DataFrame, key: str, seconds: str, action: str = "action", ttl: int = 300, tie: str | None = None) -> DataFrame:
    """``outcome`` of claims on keys: ``BEGIN`` is ``CLAIMED``, or refused as ``PROCESSING`` or ``COMPLETED`` by a claim that lives.

    A claim lives ``ttl`` seconds; ``DONE`` completes one that lives and renews it, ``FAIL``
    gives it up. Rows without a time, other actions and ends without a claim are ``IGNORED``.
    """
    return fold(events, key, [seconds, *([tie] if tie else [])], claim_step(seconds, action, ttl), "outcome", "string", [action])


def claim_step(seconds: str, action: str = "action", ttl: int = 300) -> Step:
    """The rule of ``idempotent_claims``, for batches and streams."""

    def step(state: tuple[str, int] | None, row: dict) -> tuple[tuple[str, int] | None, str]:
        now = row[seconds]
        if now is None:
            return state, "IGNORED"
        live = state if state and now - state[1] < ttl else None
        if row[action] == "BEGIN":
            return (live, live[0]) if live else (("PROCESSING", now), "CLAIMED")
        if live and live[0] == "PROCESSING" and row[action] == "DONE":
            return ("COMPLETED", now), "COMPLETED"
        if live and live[0] == "PROCESSING" and row[action] == "FAIL":
            return None, "RELEASED"
        return live, "IGNORED"

    return step
