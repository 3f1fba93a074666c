"""Line dedup with two Bloom filters, for once-seen and twice-seen line hashes.

1. Each task hashes the distinct line keys of its documents and sets bits in a
   once-seen and a twice-seen filter. Filters of tasks are merged slice by slice;
   bits that two once-seen filters share go to the twice-seen one, so a key of two
   documents anywhere is never missed.
2. The merged twice-seen filter (bounded by ``max_bits``) is broadcast. Only lines
   that it suspects are shuffled, by their whole key, for the exact count of
   documents and the choice of the first occurrence.
3. Confirmed keys go back to the documents: broadcast if they fit ``max_broadcast``
   bytes, else as a join of each document with its own confirmed keys, those of very
   many documents by a broadcast of their own (``join_hot``).

Past ``max_bits`` the filter suspects more lines, so more of them shuffle; results
stay exact.

Defined results: a null or empty text is one empty line; empty keys are never
dropped; each row counts as a document, also where rows or ids repeat; null ids
are allowed and sort last when the first occurrence is chosen. In mode ``first``
rows that share an id and a line number are both first. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import BLANKS, id_and_text, join_hot, merge_tree, replace_column, slices
from tallyloom.session import cut, cut_to_table, prepare

SLICES = 16
LAST_ID = (1 << 63) - 1


def line_key(line: bytes) -> bytes:
    """What makes lines equal: stripped of ASCII blanks, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def spread(hashes: np.ndarray) -> np.ndarray:
    """Hashes dealt evenly over all values, also where those given are all small."""
    with np.errstate(over="ignore"):
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        return mixed * np.uint64(0xD6E8FEB86659FD93)


def _positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash; both lie in the slice that the hash's top bits name."""
    per = bits // SLICES
    hashes = spread(hashes)
    base = (hashes >> np.uint64(60)).astype(np.int64) % SLICES * per
    first = (hashes & np.uint64(0x3FFFFFFF)).astype(np.int64) % per
    second = (hashes >> np.uint64(30) & np.uint64(0x3FFFFFFF)).astype(np.int64) % per
    return base + first, base + second


def _slice_bits(bits: int, part: int, hashes: np.ndarray) -> np.ndarray:
    """One slice of a filter, packed: the bits of those hashes that belong to it."""
    own = hashes[spread(hashes) >> np.uint64(60) == part]
    flags = np.zeros(bits // SLICES, dtype=bool)
    for at in _positions(own, bits):
        flags[at - part * (bits // SLICES)] = True
    return np.packbits(flags, bitorder="little")


def has_bits(packed: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    found = np.ones(len(hashes), dtype=bool)
    for at in _positions(hashes, bits):
        found &= (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found


def _doc_hashes(text: str) -> tuple[list[bytes], np.ndarray]:
    """The distinct keys of a document, empty ones left out, and their hashes."""
    keys = list({k for k in map(line_key, text.encode("utf-8").split(b"\n")) if k})
    return keys, np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))


def twice_seen_filter(texts: DataFrame, hashes_of: Callable[[list[str]], np.ndarray], expected: int, max_bits: int = 1 << 28, bits_per_key: int = 12) -> tuple[np.ndarray, int]:
    """The merged twice-seen filter of ``text``'s hashes, packed, and its number of bits.

    ``hashes_of`` gives the hashes of a list of texts; ``expected`` is about how many
    there are in all.
    """
    bits = int(min(max_bits, max(1 << 14, 1 << int(np.ceil(np.log2(1 + bits_per_key * expected))))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [hashes_of(s.column(0).to_pylist()) for b in batches for s in slices(b)]
        if not held:
            return
        hashes, seen = np.unique(np.concatenate(held), return_counts=True)
        repeated = hashes[seen > 1]
        pack = zstandard.ZstdCompressor(level=1).compress
        for part in range(SLICES):
            yield pa.RecordBatch.from_pydict(
                {
                    "part": [part],
                    "once": [pack(_slice_bits(bits, part, hashes).tobytes())],
                    "twice": [pack(_slice_bits(bits, part, repeated).tobytes())],
                },
                schema=pa.schema([("part", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]),
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        merged: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                o, t = (np.frombuffer(unpack(x), np.uint8).copy() for x in (once, twice))
                if part in merged:
                    held_o, held_t = merged[part]
                    held_t |= t | (held_o & o)
                    held_o |= o
                else:
                    merged[part] = [o, t]
        pack = zstandard.ZstdCompressor(level=1).compress
        for part, (o, t) in merged.items():
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "once": [pack(o.tobytes())], "twice": [pack(t.tobytes())]},
                schema=pa.schema([("part", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]),
            )

    kind = "part int, once binary, twice binary"
    rows = merge_tree(texts.select("text").mapInArrow(build, kind), SLICES, merge, kind).select("part", "twice").collect()
    packed = np.zeros(bits // 8, np.uint8)
    step = len(packed) // SLICES
    for row in rows:  # max_bits / 8 bytes at most
        found = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["twice"])), np.uint8)
        packed[row["part"] * step : (row["part"] + 1) * step] = found
    return packed, bits


def suspected_lines(texts: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """doc_id, line, key of each document's first line of every suspected key."""
    lines = texts.select(F.sum(F.size(F.split("text", "\n", -1))).alias("n")).first()["n"] or 0

    def hashes_of(batch: list[str]) -> np.ndarray:
        return np.concatenate([_doc_hashes(t)[1] for t in batch])

    packed, bits = twice_seen_filter(texts, hashes_of, lines, max_bits)
    shared = texts.sparkSession.sparkContext.broadcast(packed)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int64()), ("key", pa.binary())])
        for batch in batches:
            for piece in slices(batch):
                out: tuple[list, list, list] = ([], [], [])
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    keys, hashes = _doc_hashes(text)
                    kept = {k for k, hit in zip(keys, has_bits(shared.value, bits, hashes), strict=True) if hit}
                    if not kept:
                        continue
                    for n, line in enumerate(text.encode("utf-8").split(b"\n")):
                        key = line_key(line)
                        if key in kept:
                            kept.discard(key)
                            for column, value in zip(out, (doc, n, key), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return texts.select("doc_id", "text").mapInArrow(probe, "doc_id long, line long, key binary")


def repeated_lines(suspects: DataFrame, min_docs: int) -> DataFrame:
    """key, n_docs, first_doc, first_line of keys in at least ``min_docs`` documents."""
    place = F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.col("line"))
    return (
        suspects.groupBy("key")
        .agg(F.count("*").alias("n_docs"), F.min(place).alias("place"))
        .where(F.col("n_docs") >= min_docs)
        .select("key", "n_docs", F.col("place.doc").alias("first_doc"), F.col("place.line").alias("first_line"))
    )


def _kept(text: str, doc: int | None, hot: dict[bytes, tuple[int, int]], first: bool) -> tuple[int, int, str]:
    """Lines, dropped lines and the text that stays."""
    lines = text.encode("utf-8").split(b"\n")
    left = []
    own = LAST_ID if doc is None else doc
    for n, line in enumerate(lines):
        key = line_key(line)
        place = hot.get(key) if key else None
        if place is None or (first and place == (own, n)):
            left.append(line)
    return len(lines), len(lines) - len(left), b"\n".join(left).decode("utf-8")


def dedup_lines(
    docs: DataFrame,
    *,
    mode: str = "all",
    min_docs: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = 1 << 28,
    max_broadcast: int = 32 << 20,
    names: tuple[str, str] | None = ("n_lines", "n_dropped"),
) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and two counts of lines.

    mode ``all``: keys found in ``min_docs`` documents lose all their lines.
    mode ``first``: they keep the line that comes first by id and line number.
    ``names`` are the counts' columns (an existing column of that name is replaced);
    None leaves them out.
    """
    if mode not in ("all", "first"):
        raise ValueError(f"unknown mode {mode}")
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more: the filters find keys that are seen twice")
    spark = prepare(docs.sparkSession)
    first = mode == "first"
    suspects = suspected_lines(id_and_text(docs, id_col, text_col), max_bits)
    hot = cut(repeated_lines(suspects, min_docs))
    size = hot.select(F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    base = docs.drop(*(n for n in names or () if n in docs.columns))
    small = size <= max_broadcast
    if small:
        rows = {bytes(r["key"]): (r["first_doc"], r["first_line"]) for r in hot.collect()}
        shared = spark.sparkContext.broadcast(rows)
        source = base
    else:
        shared = None
        table = hot.withColumnRenamed("key", "__key")
        own = (
            join_hot(cut_to_table(suspects, "suspects"), table, "key", "__key", "n_docs", F.xxhash64("doc_id", "line"), how="inner", max_broadcast=0)
            .groupBy(F.col("doc_id").alias("__id"))
            .agg(F.collect_list(F.struct("key", "first_doc", "first_line")).alias("__hot"))
        )
        source = base.join(own, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")), "left").drop("__id")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                texts, ids = piece.column(text_col).to_pylist(), piece.column(id_col).to_pylist()
                if small:
                    hots = [shared.value] * len(texts)
                else:
                    hots = [{h["key"]: (h["first_doc"], h["first_line"]) for h in x or ()} for x in piece.column("__hot").to_pylist()]
                    piece = piece.drop_columns(["__hot"])
                found = [_kept(t or "", i, h, first) for t, i, h in zip(texts, ids, hots, strict=True)]
                piece = replace_column(piece, text_col, pa.array([f[2] for f in found], pa.string()))
                for at, name in enumerate(names or ()):
                    piece = piece.append_column(name, pa.array([f[at] for f in found], pa.int64()))
                yield piece

    schema = T.StructType([*base.schema.fields, *(T.StructField(n, T.LongType()) for n in names or ())])
    return source.mapInArrow(drop, schema)


#: The query's SQL: keys by trim() of the six blanks and translate() of A-Z; each row is a document.
ORACLE_SQL = """
WITH lines AS (
  SELECT r, doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (
    SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
    FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
  )
), hot AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT l.doc_id, count(*) AS n_lines, count(h.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN h.key IS NULL THEN l.line END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM lines l LEFT JOIN hot h ON l.key = h.key
GROUP BY l.r, l.doc_id
"""
