"""SimHash near-dedup at a similarity of the shingle sets, by partial fingerprints.

Texts whose sets of shingles are 0.8 alike differ in about ten of a fingerprint's 64
bits, which no selective grid of whole fingerprints spans. So a text's different
shingles are dealt by their hash into parts of 4 to 8, and each part has a fingerprint
of its own: where no shingle of a part differs the partial fingerprints agree. The
segment counts of the first ``PARTS`` of them are grid cells. Texts of sizes on both
sides of a power of two, whose numbers of parts differ, meet in the smaller one's parts.
The chance to have no cell in common is about 0.01 at worst at 0.8, and vanishes above.

Texts of one cell are compared by the segment counts of their whole fingerprints
(Manhattan distance, a lower bound), then by the fingerprints' bits, within what the
similarity leaves likely (five deviations). What passes is verified on the shingle sets.

Links are found in rounds, so that large groups don't give all their pairs: forests in a
few cells, forests in all cells between what is still apart, then, in large cells,
whatever is outside the largest component against all that is apart from it. So no link
between texts of one cell is lost, and pairs grow with the texts where a group holds together.

Defined results: a null, empty or blank text has no shingles; such texts are copies of
each other. A text of fewer words has one shingle, its whole sequence. Rows without id,
rows that share an id and other columns are treated as in ``simhash_dedup``. Word
sequences are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import id_and_text, join_hot, map_texts
from tallyloom.llm.components import bounded_components
from tallyloom.llm.simhash_dedup import LOW_BITS, PAIRS_UP_TO, SEED, Near, embed, first_of_class, hashes_of, link_rows, majority, ordered_pairs, runs, text_mark, with_classes
from tallyloom.session import cut, prepare

#: Partial fingerprints of a text that are sent to the grid.
PARTS = 24
#: Of these, as many as the first round looks at; cells of more rows than that give a forest there.
EARLY = 3
EARLY_PAIRS = 4
#: Different shingles a part holds at least, on average, and parts at least.
PER_PART = 4
LEAST_PARTS = 8
#: Texts to verify that are looked up by a broadcast (32 bytes each); more are by a join.
MOST_BROADCAST = 500_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def likely_bits(similarity: float) -> int:
    """Bits in which fingerprints of sets so alike differ: the mean and five deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * share + 5 * math.sqrt(64 * share * (1 - share)))


def partial_cells(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """Grid cells of a text's different hashes; the lowest bit tells the first ``EARLY`` parts."""
    if not len(hashes):
        return np.empty(0, np.int64)
    level = len(hashes).bit_length() - 1
    found = []
    for at in (level, level - 1):
        if at < 0 or (at < level and similarity * len(hashes) >= 2**level):
            continue  # nothing that is similar has fewer than 2 ** level
        part = (hashes >> np.uint64(32)) % np.uint64(max(LEAST_PARTS, 2**at // PER_PART))
        sent = part < PARTS
        order = np.argsort(part[sent], kind="stable")
        part, own = part[sent][order], hashes[sent][order]
        starts, sizes = runs(part)
        if not len(starts):
            continue
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        fps = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
        number = part[starts]
        cells = (embed(fps) ^ (number + np.uint64(at * PARTS + 1)) * MIX[0]) * MIX[1]
        cells ^= cells >> np.uint64(29)
        found.append(cells & ~np.uint64(1) | (number < EARLY).astype(np.uint64))
    return np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)


def different_hashes(words: list[bytes], size: int) -> np.ndarray:
    return np.unique(np.array(hashes_of(words, size), dtype="<u8"))


def sequence_key(words: list[bytes]) -> int:
    """A signed hash of the words in their order: copies have the same."""
    return xxhash.xxh64_intdigest(b" ".join(words), SEED + 1) - (1 << 63)


def sketches(docs: DataFrame, size: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark, fp (hash of the word sequence), bits (the whole fingerprint), size, cells of every whole text."""

    def each():
        def handle(batch: pa.RecordBatch) -> dict:
            keys, bits, sizes, cells = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = text.encode("utf-8").lower().split()
                hashes = different_hashes(words, size)
                keys.append(sequence_key(words))
                bits.append(majority(hashes) if len(hashes) else 0)
                sizes.append(len(hashes))
                cells.append(partial_cells(hashes, similarity))
            return {
                "doc_id": batch.column("doc_id"),
                "mark": batch.column("mark"),
                "fp": pa.array(keys, pa.int64()),
                "bits": pa.array(np.array(bits, np.uint64).view(np.int64)),
                "size": pa.array(sizes, pa.int64()),
                "cells": pa.array(cells, pa.list_(pa.int64())),
            }

        return handle

    texts = id_and_text(docs, id_col, text_col).withColumn("mark", text_mark(F.col("text")))
    return map_texts(texts, each, "doc_id long, mark long, fp long, bits long, size long, cells array<long>")


def unary(fps: np.ndarray) -> np.ndarray:
    """Segment counts 0, 1, 2 as 00, 01, 11: bits that differ are the Manhattan distance."""
    both = fps & (fps >> np.uint64(1)) & LOW_BITS
    return ((fps | (fps >> np.uint64(1))) & LOW_BITS) | (both << np.uint64(1))


def may_link(bits: np.ndarray, sizes: np.ndarray, similarity: float) -> Near:
    """Pairs of rows whose sizes, segment counts and bits allow the similarity."""
    points, most = unary(bits), likely_bits(similarity)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        allowed = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9
        allowed &= np.bitwise_count(points[a] ^ points[b]) <= most
        return allowed & (np.bitwise_count(bits[a] ^ bits[b]) <= most)

    return near


def _outside_pairs(cell: np.ndarray, group: np.ndarray, near: Near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In cells of more than ``PAIRS_UP_TO`` rows, rows outside the largest group with all that is near and apart."""
    starts, sizes = runs(cell)
    for at in np.flatnonzero(sizes > PAIRS_UP_TO):
        rows = np.arange(starts[at], starts[at] + sizes[at])
        groups, counts = np.unique(group[rows], return_counts=True)
        if len(groups) == 1:
            continue
        largest = groups[np.argmax(counts)]
        for row in rows[group[rows] != largest]:
            others = rows[group[rows] != group[row]]
            found = others[near(np.full(len(others), row), others)]
            yield np.full(len(found), row), found


def candidates(members: DataFrame, similarity: float, early: bool, last: bool) -> DataFrame:
    """Pairs a < b of ``members`` (fp, bits, size, cells, component) to verify in a round, none inside a component."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        cell, ids, bits, sizes, group = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((ids, cell))
        cell, ids, bits, sizes, group = cell[order], ids[order], bits[order].view(np.uint64), sizes[order], group[order]
        near = may_link(bits, sizes, similarity)

        def middle(rows: np.ndarray) -> int:
            """What is nearest to the cell's common bits: a likely origin of the others."""
            return int(np.argmin(np.bitwise_count(bits[rows] ^ np.uint64(majority(np.ascontiguousarray(bits[rows]))))))

        found = _outside_pairs(cell, group, near) if last else [link_rows(cell, near, EARLY_PAIRS if early else PAIRS_UP_TO, middle)]
        for a, b in found:
            apart = group[a] != group[b]
            a, b = ordered_pairs(ids[a[apart]], ids[b[apart]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    gridded = members.select(F.explode("cells").alias("cell"), F.col("fp").alias("id"), "bits", "size", "component")
    if early:
        gridded = gridded.where(F.col("cell").bitwiseAND(F.lit(1)) == 1)
    return gridded.repartition("cell").mapInArrow(compare, "a long, b long").distinct()


def verified(pairs: DataFrame, distinct: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (cut) whose sets of shingles are as similar; only texts of a pair are read into sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [different_hashes(t.encode("utf-8").lower().split(), size).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("w"), pa.array(items, pa.binary())], names=["fp", "w", "items"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(common >= similarity * (len(one) + len(two) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).groupBy("fp").agg(F.count("*").alias("w"))
    needed = cut(distinct.join(ends, "fp").select("fp", "w", F.col("shown.doc_id").alias("__id"), F.col("shown.mark").alias("__mark")))
    if needed.count() <= MOST_BROADCAST:
        needed = F.broadcast(needed)
    shown = texts.join(needed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")))
    items = shown.select("fp", "w", "text").mapInArrow(sets, "fp long, w long, items binary").dropDuplicates(["fp"])
    table = cut(items.select(F.col("fp").alias("__fp"), F.col("w").alias("__w"), "items"))
    joined = pairs
    for end, name in (("a", "x"), ("b", "y")):
        side = table.withColumnRenamed("items", name)
        joined = join_hot(joined, side, end, "__fp", "__w", F.xxhash64("a", "b"), how="inner", max_broadcast=0)
    return joined.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def similar_classes(docs: DataFrame, *, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text), fp, component_id, keeper (the fp whose document stays) of every row."""
    if not 0.5 < similarity <= 1:
        raise ValueError("the similarity must be above 0.5 and at most 1")
    prepare(docs.sparkSession)
    made = cut(sketches(docs, size, similarity, id_col, text_col))
    row = F.struct("doc_id", "mark")
    distinct = cut(
        made.groupBy("fp").agg(
            F.min("doc_id").alias("id"), F.count("*").alias("n"), F.min(row).alias("shown"), *(F.first(c).alias(c) for c in ("bits", "size", "cells"))
        )
    )
    texts = id_and_text(docs, id_col, text_col).withColumn("mark", text_mark(F.col("text")))
    found = docs.sparkSession.createDataFrame([], "id long, component long")
    for early, last in ((True, False), (False, False), (False, True)):
        known = found.select(F.col("id").alias("fp"), "component")
        members = distinct.join(known, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        pairs = cut(candidates(members, similarity, early, last))
        if pairs.count():
            links = verified(pairs, distinct, texts, size, similarity)
            known = found.select(F.col("component").alias("a"), F.col("id").alias("b"))
            found = cut(bounded_components(cut(links.union(known))))
    return with_classes(made.select("doc_id", "mark", "fp"), distinct.select("fp", "id", "n"), found)


def drop_similar(docs: DataFrame, *, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its class, all columns, as in ``drop_near_duplicates``."""
    found = similar_classes(docs, size=size, similarity=similarity, id_col=id_col, text_col=text_col)
    return first_of_class(docs, found, id_col, text_col, max_broadcast)
