"""SimHash near-dedup by a segment-popcount embedding and a grid range-join.

A fingerprint's 32 segments of two bits are mapped to their bit counts, a point of
{0, 1, 2}^32. The Manhattan distance of two points never exceeds the Hamming distance
of the fingerprints, so links lie within Manhattan distance ``most_bits``. Points
within 4 are within 2 in one of their halves (16 segments), and points within 2 have
a grid cell in common at distance 1 or less from both. So every distinct fingerprint
is sent to the cells at distance 0 and 1 of its two halves (50 at most), and the
fingerprints of a cell are compared exactly.

Copies collapse before that: only distinct fingerprints enter the grid, and components
are those of fingerprints. A cell of many fingerprints yields a spanning forest of its
links rather than all pairs, which leaves the components as they are.

Defined results: a null, empty or blank text has fingerprint zero, linked like any
other; a row without id links like any other, but its own component is null; rows that
share an id are one document if their fingerprints agree and documents of their own
otherwise; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import CHUNK, id_and_text, join_hot, map_texts
from tallyloom.llm.components import components
from tallyloom.session import cut, prepare

SEED = 42
SEGMENTS = 16
#: Cells of more fingerprints give a spanning forest of their links.
PAIRS_UP_TO = 24
LOW_BITS = np.uint64(0x5555555555555555)
#: Which of the pairs of rows (x, y) are near.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Position of the row that a forest grows from.
First = Callable[[np.ndarray], int]


def shingle_hashes(text: str, size: int) -> list[int]:
    """XXH64 of every shingle of ``size`` words; fewer words are one shingle, none give none."""
    return hashes_of(text.encode("utf-8").lower().split(), size)


def hashes_of(words: list[bytes], size: int) -> list[int]:
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: str, size: int = 4) -> int:
    """64 bits, each set if more than half of the shingles' hashes set it; unsigned."""
    hashes = shingle_hashes(text, size)
    if not hashes:
        return 0
    return majority(np.array(hashes, dtype="<u8"))


def majority(values: np.ndarray) -> int:
    """The bits that more than half of the values set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), CHUNK):
        part = values[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def text_mark(text: Column) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(text)


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text) and fp (the fingerprint as a signed long) of every whole text."""

    def each():
        def handle(batch: pa.RecordBatch) -> dict:
            found = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64)
            return {"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "fp": pa.array(found.view(np.int64))}

        return handle

    texts = id_and_text(docs, id_col, text_col).withColumn("mark", text_mark(F.col("text")))
    return map_texts(texts, each, "doc_id long, mark long, fp long")


def embed(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, packed in two bits each."""
    return fps - (fps >> np.uint64(1) & LOW_BITS)


def cells_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, cell): the grid cells at distance 0 and 1 of both halves."""
    points = embed(fps)
    index, cells = [], []
    every = np.arange(len(fps))
    for half in (0, 1):
        point = (points >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        mark = half << 32
        index.append(every)
        cells.append(point | mark)
        for segment in range(SEGMENTS):
            step = 1 << (2 * segment)
            count = point >> (2 * segment) & 3
            for move, may in ((step, count < 2), (-step, count > 0)):
                index.append(every[may])
                cells.append((point[may] + move) | mark)
    return np.concatenate(index), np.concatenate(cells)


def linked_in_cells(cell: np.ndarray, fps: np.ndarray, ids: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between the ids of one cell, exact; a spanning forest for large cells."""
    order = np.argsort(cell, kind="stable")
    cell, fps, ids = cell[order], fps[order], ids[order]
    a, b = link_rows(cell, lambda x, y: np.bitwise_count(fps[x] ^ fps[y]) <= most_bits)
    return ordered_pairs(ids[a], ids[b])


def ordered_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, the smaller id first."""
    if not len(a):
        return a, b
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pairs[0], pairs[1]


def runs(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal cells."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(cell)])


def link_rows(cell: np.ndarray, near: Near, pairs_up_to: int = PAIRS_UP_TO, first: First | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell (sorted) that are ``near``; of cells with more rows a spanning forest, grown from ``first``."""
    starts, sizes = runs(cell)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    some = (sizes > 1) & (sizes <= pairs_up_to)
    ahead = np.repeat(np.where(some, starts + sizes, 0), sizes)  # one past the end of the row's cell
    rows = np.flatnonzero(ahead > 0)
    for gap in range(1, pairs_up_to):
        rows = rows[rows + gap < ahead[rows]]
        if not len(rows):
            break
        found = rows[near(rows, rows + gap)]
        left.append(found)
        right.append(found + gap)
    for at in np.flatnonzero(sizes > pairs_up_to):
        own = np.arange(starts[at], starts[at] + sizes[at])
        a, b = _forest(own, near, 0 if first is None else first(own))
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _forest(rows: np.ndarray, near: Near, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``rows``; memory in proportion to them."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    waiting = np.r_[rows[first], np.delete(rows, first)]
    while len(waiting):
        frontier, waiting = [waiting[0]], waiting[1:]
        while frontier and len(waiting):
            pivot = frontier.pop()
            linked = near(np.full(len(waiting), pivot), waiting)
            if linked.any():
                found, waiting = waiting[linked], waiting[~linked]
                left.append(np.full(len(found), pivot))
                right.append(found)
                frontier += found.tolist()
    return np.concatenate(left), np.concatenate(right)


def links_of(distinct: DataFrame, most_bits: int = 4) -> DataFrame:
    """Links a < b between the ``id`` of rows (id, fp) that differ in ``most_bits`` or fewer."""
    if not 0 <= most_bits <= 4:
        raise ValueError("the grid finds links of 4 bits at most")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                ids, fps = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                index, cells = cells_of(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells), pa.array(ids[index]), pa.array(fps[index])], names=["cell", "id", "fp"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if held:
            cell, ids, fps = (np.concatenate(c) for c in zip(*held, strict=True))
            a, b = linked_in_cells(cell, fps.view(np.uint64), ids, most_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    gridded = distinct.select("id", "fp").mapInArrow(spread, "cell long, id long, fp long")
    return gridded.repartition("cell").mapInArrow(compare, "a long, b long").distinct()


def classified(docs: DataFrame, size: int, most_bits: int, id_col: str, text_col: str, max_broadcast: int = 100_000, hot: int = 10_000) -> DataFrame:
    """doc_id, mark (a hash of the text), fp, component_id, keeper (the fingerprint whose document stays) of every row.

    Components are those of fingerprints, so rows that share an id are not confused.
    """
    fps = cut(fingerprints(docs, size, id_col, text_col))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    found = components(links_of(distinct.select(F.col("fp").alias("id"), "fp"), most_bits))
    return with_classes(fps, distinct, found, max_broadcast, hot)


def with_classes(fps: DataFrame, distinct: DataFrame, found: DataFrame, max_broadcast: int = 100_000, hot: int = 10_000) -> DataFrame:
    """``fps`` with component_id and keeper, from the components ``found`` (id, component) of ``distinct`` (fp, id, n)."""
    linked = cut(
        distinct.join(found.withColumnRenamed("id", "__id"), F.col("fp") == F.col("__id"), "left").select(
            "fp", "id", "n", F.coalesce("component", "fp").alias("component")
        )
    )
    first = F.struct(F.col("id").isNull(), "id", "fp")
    least = linked.groupBy(F.col("component").alias("__c")).agg(
        F.min("id").alias("component_id"), F.min_by("fp", first).alias("keeper"), F.count("*").alias("__w")
    )
    classes = join_hot(linked, cut(least), "component", "__c", "__w", F.col("fp"), max_broadcast=max_broadcast, hot=hot)
    classes = cut(classes.select(F.col("fp").alias("__fp"), "component_id", "keeper", F.col("n").alias("__n")))
    return join_hot(fps, classes, "fp", "__fp", "__n", F.xxhash64("doc_id", "mark"), max_broadcast=max_broadcast, hot=hot)


def near_duplicates(docs: DataFrame, *, size: int = 4, most_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prepare(docs.sparkSession)
    return classified(docs, size, most_bits, id_col, text_col).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, *, size: int = 4, most_bits: int = 4, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component, all columns.

    That is the document of the smallest id (of equal ids that of the smallest
    fingerprint; a row without id only where the component has no id); rows that repeat
    both its id and its text stay with it. Rows are told apart by id and a hash of the text.
    """
    prepare(docs.sparkSession)
    return first_of_class(docs, classified(docs, size, most_bits, id_col, text_col), id_col, text_col, max_broadcast)


def first_of_class(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, max_broadcast: int) -> DataFrame:
    """The rows of ``docs`` that ``found`` (doc_id, mark, fp, component_id, keeper) lets stay."""
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("keeper"))
    gone = cut(found.where(~stays).select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark")).distinct())
    own, mark = F.col(f"`{id_col}`").cast("long"), text_mark(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    if gone.count() <= max_broadcast:  # one long a row
        side = gone.select(F.xxhash64("__gone", "__mark").alias("__key"))
        return docs.join(F.broadcast(side), F.xxhash64(own, mark) == F.col("__key"), "left_anti")
    return docs.join(gone, own.eqNullSafe(F.col("__gone")) & (mark == F.col("__mark")), "left_anti")
