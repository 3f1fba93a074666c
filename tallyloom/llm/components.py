"""Connected components of a link table, by alternating large and small stars.

Each round moves links towards the smallest id of a neighbourhood. The least neighbour
of an id is an aggregate, combined before the shuffle, and goes back to the links by
``join_hot``: broadcast up to a checked number of ids, past it broadcast for the ids of
many links and joined for the rest, so that no task gathers the links of a star's
centre. Rounds go on until the links stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import join_hot
from tallyloom.session import cut


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def _least(links: DataFrame) -> DataFrame:
    """__a, m (the least neighbour of a), n (its links)."""
    return cut(links.groupBy(F.col("a").alias("__a")).agg(F.min("b").alias("m"), F.count("*").alias("n")))


def _with_least(links: DataFrame, least: DataFrame, limits: dict) -> DataFrame:
    return join_hot(links, least, "a", "__a", "n", F.xxhash64("b"), how="inner", **limits)


def _large_star(links: DataFrame, limits: dict) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = _with_least(both.where("b > a"), _least(both).withColumn("m", F.least("__a", "m")), limits)
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame, limits: dict) -> DataFrame:
    down = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    least = _least(down)
    joined = _with_least(down, least, limits).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.union(least.select(F.col("__a").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame, most_rounds: int = 60, **limits: int) -> DataFrame:
    """id, component (the smallest id reachable) of every id with a link to another.

    ``links`` has two long columns ``a`` and ``b``; nulls and loops are left out.
    An empty table gives an empty result. ``limits`` are those of ``join_hot``.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    links = cut(links)
    state = _state(links)
    for _ in range(most_rounds):
        if not state[0]:
            break
        links = cut(_small_star(_large_star(links, limits), limits).where("a <> b").distinct())
        now = _state(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def bounded_components(links: DataFrame, most: int = 1_000_000) -> DataFrame:
    """As ``components``; up to ``most`` links (cut, 16 bytes each) are joined up by one task in one job."""
    if links.count() > most:
        return components(links)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        ends = np.concatenate([np.concatenate(c) for c in zip(*held, strict=True)])
        ids, at = np.unique(ends, return_inverse=True)
        a, b = at[: len(at) // 2], at[len(at) // 2 :]
        root = np.arange(len(ids))
        while (root[a] != root[b]).any():
            least = np.minimum(root[a], root[b])
            for end in (a, b):
                np.minimum.at(root, root[end], least)
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "component"])

    kept = links.where("a is not null and b is not null and a <> b").select("a", "b")
    return kept.repartition(1).mapInArrow(join_up, "id long, component long")
