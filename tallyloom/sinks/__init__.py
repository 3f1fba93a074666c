"""Sinks: JSON files, archives, backups and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.relational import merge_latest, missing


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; the committer makes the files visible all at once."""
    rows.write.mode("overwrite").json(path)


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def archive(spark: SparkSession, path: str, folder: str) -> str:
    """Move a written file or folder into an archive folder; returns its new path."""
    files, source = _path(spark, path)
    _, target = _path(spark, folder)
    files.mkdirs(target)
    moved = f"{folder.rstrip('/')}/{source.getName()}"
    if not files.rename(source, _path(spark, moved)[1]):
        raise OSError(f"can't move {path} to {moved}")
    return moved


def recover(stored: DataFrame, backup: DataFrame, keys: list[str], order: str, valid: F.Column) -> tuple[DataFrame, DataFrame]:
    """(the stored rows with a backup's valid rows merged in, the backup's rows that must be kept for later)."""
    good = backup.where(valid)
    merged = merge_latest(stored, good.select(*stored.columns), keys, order)
    failed = missing(backup, good.select(*keys).distinct(), keys)
    return merged, failed


def publish(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A topic as a folder of JSON lines; with a Kafka connector the same rows go to ``format("kafka")``."""
    body = messages.select(F.to_json(F.struct(*messages.columns)).alias("value"))
    return body.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
