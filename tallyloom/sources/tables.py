"""Parquet tables of a data folder, read through Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.session import prepare


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``{folder}/{name}.parquet``, a file or a folder in any store that Spark reads."""
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, table: str, *, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, fetch: int = 10_000, **options: str) -> DataFrame:
    """A table of a database; with a numeric ``key`` and its ``bounds`` it is read by ``parts`` ranges of the key.

    Filters and columns are pushed to the database.
    """
    reader = prepare(spark).read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch), **options)
    if key is not None:
        if bounds is None:
            raise ValueError("a key needs its bounds")
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def write_jdbc(rows: DataFrame, url: str, table: str, *, mode: str = "append", batch: int = 1000, parts: int = 8, **options: str) -> None:
    """Rows into a table of a database, ``batch`` to a statement, over ``parts`` connections at most."""
    rows.coalesce(parts).write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode(mode).save()
