"""What the text operators share: Arrow maps over documents and their columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the white-space class ``[\x20\x09-\x0D]`` that lines and words are stripped by.
BLANKS = b" \t\n\x0b\x0c\r"
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Words that one call of a vectorised kernel takes at most; longer texts go in pieces.
CHUNK = 1 << 18
#: Keys of more rows than this are joined by a broadcast of their own (``join_hot``).
HOT_ROWS = 100_000


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text (null: empty), whatever other columns there are."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def map_texts(docs: DataFrame, each: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Run ``each()(batch) -> columns`` over Arrow batches; ``each`` is called once a task."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = each()
        for batch in batches:
            for piece in slices(batch):
                columns = handle(piece)
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)
        give_back()

    return docs.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system, since idle workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def join_hot(rows: DataFrame, table: DataFrame, on: str, key: str, weight: str, spread: Column, *, how: str = "left", max_broadcast: int = 1_000_000, hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key, null a key too), however many rows a key has.

    ``table`` should be cut; ``weight`` is its column of the rows that each key has. Up to
    ``max_broadcast`` keys the table is broadcast. Past that only keys of ``hot`` rows or
    more are, of which there are at most rows / ``hot``; the rest meet in a shuffle, where no
    key has more, and rows that are done are dealt by ``spread`` there.
    """
    if table.count() <= max_broadcast:
        return rows.join(F.broadcast(table), F.col(f"`{on}`").eqNullSafe(F.col(key)), how).drop(key, weight)
    values = [c for c in table.columns if c not in (key, weight)]
    large = table.where(F.col(weight) >= hot).select(F.col(key).alias("__hot"), F.lit(True).alias("__is_hot"), *(F.col(v).alias(f"__hot_{v}") for v in values))
    marked = rows.join(F.broadcast(large), F.col(f"`{on}`").eqNullSafe(F.col("__hot")), "left").drop("__hot")
    done = F.coalesce("__is_hot", F.lit(False))
    marked = marked.withColumn("__deal", F.when(done, F.pmod(spread, F.lit(1 << 20)).cast("int")).otherwise(F.lit(-1)))
    rest = table.where(F.col(weight) < hot).drop(weight).withColumn("__rest", F.lit(-1))
    joined = marked.join(rest, F.col(f"`{on}`").eqNullSafe(F.col(key)) & (F.col("__deal") == F.col("__rest")), "left")
    if how == "inner":
        joined = joined.where(F.col("__is_hot") | F.col("__rest").isNotNull())
    found = [F.when(done, F.col(f"__hot_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), *found)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of about ``most`` bytes, so that Python objects of one part stay small."""
    if not batch.num_rows:
        return
    rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with one column's values replaced, cast to that column's type."""
    at = batch.schema.get_field_index(name)
    return batch.set_column(at, batch.schema.field(at), values.cast(batch.schema.field(at).type))


def split_words(text: str) -> list[bytes]:
    """Lower-cased words between ASCII blanks, as UTF-8 bytes."""
    return text.lower().encode("utf-8", "replace").split()


FAN = 64


def merge_tree(partials: DataFrame, parts: int, merge: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Merge what tasks give for each ``part`` in rounds of ``FAN``, until one row a part is left.

    ``merge`` streams batches of (part, ...) and gives one row for each part it has seen.
    No task reads more than about ``FAN`` rows of a part, however many tasks there were.
    """
    tasks = max(1, partials.rdd.getNumPartitions())
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    partials = partials.withColumn("__from", F.spark_partition_id())
    while True:
        groups = -(-tasks // FAN)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_group: dict[int, list[pa.RecordBatch]] = {}
            for batch in batches:
                for group in pc.unique(batch.column("__from")).to_pylist():
                    own = batch.filter(pc.equal(batch.column("__from"), group)).select(names)
                    by_group[group] = [*by_group.get(group, []), own]
                    if len(by_group[group]) >= 8:
                        by_group[group] = list(merge(iter(by_group[group])))
            for group, held in by_group.items():
                for merged in merge(iter(held)):
                    yield merged.append_column("__from", pa.array([group] * merged.num_rows, pa.int32()))

        dealt = partials.withColumn("__from", (F.col("__from") % groups).cast("int")).repartition(groups * parts, "part", "__from")
        partials = dealt.mapInArrow(run, f"{schema}, __from int")
        if groups == 1:
            return partials.drop("__from")
        tasks = groups


def sum_partials(partials: DataFrame, parts: int) -> dict[int, np.ndarray]:
    """Sum arrays that tasks give in parts: rows (part int, data binary of zstd-packed float64).

    The sums, whose size the caller bounds, come back to the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = unpack(data)
                sums[part] = sums[part] + values if part in sums else values
        for part, values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack(values)], pa.binary())], names=["part", "data"])

    rows = merge_tree(partials.select("part", "data"), parts, add, "part int, data binary").collect()
    return {r["part"]: unpack(bytes(r["data"])) for r in rows}


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, dtype="<f8").tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<f8")


def cut_into(values: np.ndarray, parts: int) -> pa.RecordBatch:
    """A flat array as ``parts`` rows (part, data)."""
    pieces = np.array_split(values, parts)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(parts), pa.int32()), pa.array([pack(p) for p in pieces], pa.binary())], names=["part", "data"]
    )


def joined_parts(found: dict[int, np.ndarray], size: int, parts: int) -> np.ndarray:
    """The array again; zeros where no task gave anything."""
    pieces = np.array_split(np.zeros(size), parts)
    return np.concatenate([found.get(i, p) for i, p in enumerate(pieces)])
