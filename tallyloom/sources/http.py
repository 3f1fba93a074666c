"""A batch source of JSON documents over HTTP, by the Python data source API.

``spark.dataSource.register(CharacterSource)``, then ``spark.read.format("character_api")``
with options ``base_url``, ``ids`` (comma-separated), ``timeout`` and ``retries``.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class IdPartition(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class CharacterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "character_api"

    def schema(self) -> str:
        return "ocid string, status int, body string"

    def reader(self, schema) -> CharacterReader:
        return CharacterReader(self.options)


class CharacterReader(DataSourceReader):
    """Splits the ids into partitions; a 5xx answer is tried again with a longer wait each time."""

    def __init__(self, options: dict):
        self.base = options["base_url"].rstrip("/")
        self.ids = [i for i in options.get("ids", "").split(",") if i]
        self.timeout = float(options.get("timeout", "5"))
        self.retries = int(options.get("retries", "2"))
        self.wait = float(options.get("backoff", "0.2"))
        self.size = int(options.get("per_partition", "100"))

    def partitions(self) -> list[IdPartition]:
        return [IdPartition(self.ids[i : i + self.size]) for i in range(0, len(self.ids), self.size)]

    def read(self, partition: IdPartition) -> Iterator[tuple]:
        for ocid in partition.ids:
            yield self.fetch(ocid)

    def fetch(self, ocid: str) -> tuple[str, int, str | None]:
        for attempt in range(self.retries + 1):
            try:
                with urlopen(f"{self.base}/{quote(ocid, safe='')}", timeout=self.timeout) as answer:
                    return ocid, answer.status, answer.read().decode("utf-8")
            except HTTPError as error:
                if error.code < 500 or attempt == self.retries:
                    return ocid, error.code, None
            except OSError:
                if attempt == self.retries:
                    return ocid, 0, None
            time.sleep(self.wait * 2**attempt)
        return ocid, 0, None
