"""Streams from files of JSON lines to merged tables, alerts and counts.

Stores are Parquet folders with one folder per version: a merge writes the next version
and then its ledger, so a reader sees a whole one and a replayed micro-batch is known. Offsets and state are in the stream's checkpoint, which replaces queues
with acknowledgements, re-delivery and orphan recovery.
"""

from __future__ import annotations

import json
import logging
import pickle
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.operators import relational as R
from tallyloom.sources.files import deflate

ENVELOPE = (
    "eventId string, eventType string, timestamp long, payload struct<ocid string, character_name string, world_name string, "
    "character_class string, character_level int, character_guild_name string, character_image string, date timestamp>"
)


def lines(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of text lines of a folder's files, ``per_trigger`` files a batch at most."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder)


def envelopes(raw: DataFrame) -> DataFrame:
    """Parsed messages with event time ``ts``; what can't be read has a null ``eventId``."""
    parsed = raw.select(F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE"}).alias("e"), "value")
    return parsed.select("e.*", F.timestamp_millis("e.timestamp").alias("ts"), "value")


def quarantine(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages that can be read, the raw text of those that can't)."""
    good = F.col("eventId").isNotNull() & F.col("payload.ocid").isNotNull()
    return messages.where(good), messages.where(~F.coalesce(good, F.lit(False))).select("value")


def deduplicated(messages: DataFrame, keys: list[str], window: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """The first message of every key within the window; state is dropped behind the watermark."""
    return messages.withWatermark(ts, window).dropDuplicatesWithinWatermark(keys)


class Store:
    """A versioned Parquet table; of its versions the last ``keep`` stay, for readers that began before.

    A version holds a ledger of the last batch that each stream merged, so a batch that
    comes again is known whatever other streams, or the same one with a new checkpoint,
    have merged meanwhile. A version without its ledger is not whole and is written anew.
    One writer at a time: of two at once the later one fails.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Whole versions, oldest first."""
        files, path = self._files()
        if not files.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path(self.path))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and files.exists(path(f"{self.path}/{n}/_ledger")))

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def read(self) -> DataFrame | None:
        version = self.version()
        return None if version is None else self.spark.read.parquet(f"{self.path}/v{version}")

    def ledger(self) -> dict[str, int]:
        """Stream -> the last batch of it that is merged."""
        version = self.version()
        if version is None:
            return {}
        files, path = self._files()
        stream = files.open(path(f"{self.path}/v{version}/_ledger"))
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def merge(self, batch: int, change: Callable[[DataFrame | None], DataFrame], stream: str = "") -> None:
        """Write the next version from the last one; a batch of the ``stream`` that is there already is left as it is."""
        known, now = self.ledger(), self.version()
        if known.get(stream, -1) >= batch:
            return
        version = 0 if now is None else now + 1
        change(self.read()).write.mode("overwrite").parquet(f"{self.path}/v{version}")
        files, path = self._files()
        out = files.create(path(f"{self.path}/v{version}/_ledger"), False)
        try:
            out.writeUTF(json.dumps(known | {stream: batch}))
        finally:
            out.close()
        for old in self.versions()[: -self.keep]:
            files.delete(path(f"{self.path}/v{old}"), True)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint belongs to; a new checkpoint in an old place has a new one."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def merge_stream(rows: DataFrame, write: Callable[[DataFrame, int, str], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start ``write(batch, number, stream)`` per micro-batch: all that is there, or one batch ``every`` interval."""
    spark, known = rows.sparkSession, {}

    def each(batch: DataFrame, number: int) -> None:
        if "id" not in known:
            known["id"] = stream_id(spark, checkpoint)
        write(batch, number, known["id"])

    when = {"processingTime": every} if every else {"availableNow": True}
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**when).start()


def _latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return R.merge_latest(rows.limit(0), rows, keys, order)


def ingest(raw: DataFrame, store: str, checkpoint: str, dead: str | None = None, every: str | None = None) -> StreamingQuery:
    """Micro-batches of messages merged by ocid, the latest date winning; unreadable text goes to ``dead``.

    ``every`` (such as ``5 seconds``) makes it run on, a batch an interval; a batch's
    messages are bounded at the source (``lines`` with files of bounded size, ``maxOffsetsPerTrigger`` of a topic).
    """
    spark = raw.sparkSession
    table = Store(spark, store)

    def write(batch: DataFrame, number: int, stream: str) -> None:
        good, bad = quarantine(envelopes(batch))
        rows = _latest(good.select("payload.*", "eventId"), ["ocid"], "date")
        table.merge(number, lambda old: rows if old is None else R.merge_latest(old, rows, ["ocid"], "date"), stream)
        if dead:
            bad.write.mode("overwrite").json(f"{dead}/stream={stream}/batch={number}")

    return merge_stream(raw, write, checkpoint, every)


def _kept_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that are kept whole in a folder, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    whole = [n for n in names if n.startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in whole)


def delta_sync(deltas: DataFrame, store: str, checkpoint: str, key: str = "user_ign", restore: str | None = None) -> StreamingQuery:
    """Counter deltas (key, delta) summed per batch and added to the stored counts, never below 0.

    A merge that fails stops the stream. With a folder ``restore`` it is compensated
    instead: the batch's sums are kept there, and each later batch first merges those
    kept before it, oldest first, each once. Sums kept by the last batch wait for the next.
    """
    spark = deltas.sparkSession
    table = Store(spark, store)

    def adding(sums: DataFrame) -> Callable[[DataFrame | None], DataFrame]:
        def change(old: DataFrame | None) -> DataFrame:
            if old is None:
                return sums.select(key, F.greatest("delta", F.lit(0)).cast("long").alias("count"))
            joined = old.join(sums, key, "full")
            return joined.select(key, F.greatest(F.coalesce("count", F.lit(0)) + F.coalesce("delta", F.lit(0)), F.lit(0)).cast("long").alias("count"))

        return change

    def write(batch: DataFrame, number: int, stream: str) -> None:
        sums = R.merge_deltas(batch, key)
        if restore is None:
            table.merge(number, adding(sums), stream)
            return
        folder, restored = f"{restore.rstrip('/')}/stream={stream}", f"{stream}:restored"
        log = logging.getLogger(__name__)
        kept = _kept_batches(spark, folder)
        for n in kept:
            path = f"{folder}/batch={n}"
            try:
                table.merge(n, adding(spark.read.parquet(path)), restored)
            except Exception:
                log.exception("kept batch %s can't be merged", n)
                break  # the later ones wait for it
            files, path_of = table._files()
            files.delete(path_of(path), True)
        if number in kept or table.ledger().get(restored, -1) >= number:
            return  # a batch that comes again, kept when it came first
        try:
            table.merge(number, adding(sums), stream)
        except Exception:
            if table.ledger().get(stream, -1) < number:
                log.exception("batch %s can't be merged and is kept", number)
                sums.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return merge_stream(deltas, write, checkpoint)


def relation_sync(edges: DataFrame, store: str, checkpoint: str, tally: list[dict] | None = None) -> StreamingQuery:
    """New (target, liker) edges are added, known ones skipped, edges without an end fail; ``tally`` gets counts per batch."""
    table = Store(edges.sparkSession, store)
    keys = ["target_ocid", "liker_account_id"]

    def write(batch: DataFrame, number: int, stream: str) -> None:
        whole = F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()
        offered = batch.where(whole).select(*keys).distinct()
        old = table.read()
        fresh = offered if old is None else R.missing(offered, old, keys)
        if tally is not None:
            n, new = offered.count(), fresh.count()
            tally.append({"batch": number, "added": new, "skipped": n - new, "failed": batch.where(~whole).count()})
        table.merge(number, lambda known: offered if known is None else known.unionByName(R.missing(offered, known, keys)), stream)

    return merge_stream(edges, write, checkpoint)


def replay(rows: DataFrame, store: str, dead: str, checkpoint: str, most: int = 3, waits: tuple[float, ...] = (1, 2, 4), sleep: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Compensation replay: rows with fewer than ``most`` attempts are merged by id, the rest are dead letters.

    A merge that fails is tried again after each of the ``waits`` (seconds); what can't be
    merged then goes to the dead letters with the others.
    """
    table = Store(rows.sparkSession, store)

    def write(batch: DataFrame, number: int, stream: str) -> None:
        gone = batch.where(F.col("attempts") >= most)
        live = _latest(batch.where(F.col("attempts") < most), ["id"], "ts")
        for wait in (*waits, None):
            try:
                table.merge(number, lambda old: live if old is None else R.merge_latest(old, live, ["id"], "ts"), stream)
                break
            except Exception:
                logging.getLogger(__name__).exception("batch %s can't be merged", number)
                if wait is None:
                    gone = batch
                else:
                    sleep(wait)
        gone.write.mode("overwrite").json(f"{dead}/stream={stream}/batch={number}")

    return merge_stream(rows, write, checkpoint)


def fold_stream(events: DataFrame, key: str, order: list[str], step: Callable, result: str, kind: str, needs: list[str]) -> DataFrame:
    """``stateful.fold`` on a stream: key, order, needed columns and ``result``, with a key's state kept between batches.

    A key's rows of one micro-batch are taken in order; rows that come in a later batch come
    later. The rules are those of ``stateful`` (``queue_step``, ``buffer_step``, ``claim_step``).
    """
    names = list(dict.fromkeys([key, *order, *needs]))
    fields = [events.schema[n] for n in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{result}` {kind}"])

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order, kind="stable", na_position="first")
        found = []
        for values in rows[names].itertuples(index=False, name=None):
            row = {n: None if pd.isna(v) else v for n, v in zip(names, values, strict=True)}
            held, value = step(held, row)
            found.append(value)
        state.update((pickle.dumps(held),))
        yield rows[names].assign(**{result: pd.Series(found, index=rows.index, dtype=object)})

    return events.select(*names).groupBy(key).applyInPandasWithState(run, schema, "held binary", "append", GroupStateTimeout.NoTimeout)


def cooldown_stream(events: DataFrame, key: str, ts: str = "ts", wait: int = 60, watermark: str = "10 minutes", idle: str | None = None) -> DataFrame:
    """key, ts of events at least ``wait`` seconds after the last one emitted; state per key is one time.

    A key's state goes when the watermark passes its last emitted time by ``wait``.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        moments = sorted(m for b in batches for m in b[ts] if not pd.isna(m))
        for moment in moments:
            seconds = moment.timestamp()
            if last is None or seconds - last >= wait:
                last = seconds
                out.append(moment)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(int((last + wait) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [keys[0]] * len(out), ts: out})

    kind = events.schema[key].dataType.simpleString()
    marked = events.select(key, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, watermark)
    return marked.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{ts}` timestamp", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def popularity(accesses: DataFrame, key: str, ts: str = "ts", keep: str = "48 hours") -> DataFrame:
    """Daily counts of each key; a day's counts are kept until the watermark passes it."""
    return accesses.withWatermark(ts, keep).groupBy(F.window(ts, "1 day").alias("day"), key).count()


def saturation_monitor(levels: DataFrame, threshold: int = 5000, every: str = "5 seconds", ts: str = "ts") -> DataFrame:
    """Windows in which a buffer's largest level passes the threshold."""
    marked = levels.withWatermark(ts, every)
    return marked.groupBy(F.window(ts, every).alias("w"), "buffer").agg(F.max("level").alias("level")).where(F.col("level") > threshold)


class MemoryChannel:
    """The last ``most`` alerts, for when the webhook can't be reached."""

    def __init__(self, most: int = 1000):
        self.held: deque[str] = deque(maxlen=most)

    def __call__(self, alerts: list[str]) -> None:
        self.held.extend(alerts)


def webhook(url: str, timeout: float = 5.0) -> Callable[[list[str]], None]:
    """A channel that posts each alert as JSON."""
    from urllib.request import Request, urlopen

    def send(alerts: list[str]) -> None:
        for alert in alerts:
            with urlopen(Request(url, alert.encode(), {"Content-Type": "application/json"}), timeout=timeout) as answer:
                if answer.status >= 300:
                    raise OSError(f"{url} answered {answer.status}")

    return send


def write_alerts(alerts: DataFrame, path: str, checkpoint: str, channels: list[Callable[[list[str]], None]] | None = None, most: int = 10_000) -> StreamingQuery:
    """Alerts to the first of the ``channels`` that takes them, else as JSON lines, a folder per batch.

    Up to ``most`` alerts of a batch go to a channel; larger batches, and those that every
    channel refuses, are written to files, where a batch that comes again replaces its own.
    """

    def write(batch: DataFrame, number: int, stream: str) -> None:
        if channels:
            rows = batch.toJSON().take(most + 1)
            if len(rows) <= most:
                for channel in channels:
                    try:
                        channel(rows)
                        return
                    except Exception:
                        logging.getLogger(__name__).exception("an alert channel failed")
        batch.write.mode("overwrite").json(f"{path}/stream={stream}/batch={number}")

    return merge_stream(alerts, write, checkpoint)


def capped_log(rows: DataFrame, store: str, checkpoint: str, order: str = "ts", most: int = 10_000) -> StreamingQuery:
    """An append log of the last ``most`` rows."""
    table = Store(rows.sparkSession, store)

    def write(batch: DataFrame, number: int, stream: str) -> None:
        table.merge(number, lambda old: R.capped(batch if old is None else old.unionByName(batch), order, most), stream)

    return merge_stream(rows, write, checkpoint)


def gzip_cache(rows: DataFrame, key: str) -> DataFrame:
    """key, cached: base64 of gzip of each row as JSON."""
    body = F.to_json(F.struct(*(c for c in rows.columns)))
    return rows.select(key, F.base64(deflate(body)).alias("cached"))
