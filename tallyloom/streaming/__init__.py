"""Structured Streaming: ingest, merges, throttles and monitors."""

from tallyloom.streaming.pipelines import (
    MemoryChannel,
    capped_log,
    cooldown_stream,
    deduplicated,
    delta_sync,
    envelopes,
    fold_stream,
    gzip_cache,
    ingest,
    popularity,
    quarantine,
    relation_sync,
    replay,
    saturation_monitor,
    webhook,
    write_alerts,
)

__all__ = [
    "MemoryChannel",
    "capped_log",
    "cooldown_stream",
    "deduplicated",
    "delta_sync",
    "envelopes",
    "fold_stream",
    "gzip_cache",
    "ingest",
    "popularity",
    "quarantine",
    "relation_sync",
    "replay",
    "saturation_monitor",
    "webhook",
    "write_alerts",
]
