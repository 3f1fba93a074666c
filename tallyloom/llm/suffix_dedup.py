"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that starts earlier.

The suffixes of the corpus are never sorted as a whole. Three steps leave only those
that can share ``length`` bytes with another, and only those are merged:

1. Anchors. Of any ``length`` bytes, the 32-byte gram with the least hash is an anchor;
   equal strings have equal anchors at equal places. Two Bloom filters (once seen,
   twice seen) find the anchors that may repeat; no others can lie in a repeat.
2. Contexts. The bytes around a suspected anchor, as far as a string of ``length``
   bytes around it reaches, are its context. A task keeps the first occurrence of each
   context; its other occurrences are repeats whatever the other tasks hold. Only
   first occurrences are shuffled, by anchor.
3. Merge. The contexts of an anchor are shards of a Burrows-Wheeler transform: a shard
   gives the symbols before its suffixes. The interleave of all shards' suffixes is
   refined step by step: each step places suffixes stably by the symbol before them,
   which orders them by one symbol more, and cuts the intervals where symbol or former
   interval change. Symbols are pairs of bytes, so ``length`` / 2 steps give the
   intervals of suffixes with ``length`` bytes in common. A suffix alone in its interval
   has its longest common prefix known and leaves the merge. Each interval's earliest
   suffix stays, the others are repeats.

Defined results: a null or empty text has no bytes and no repeats; matches never cross
documents; rows that share an id and a text are one document, rows that share an id
alone are documents of their own, in the order of a hash of their text; a row without
id is left whole and hidden from the others; texts shorter than ``length`` stay; other
columns are ignored.

Memory: a task holds ``HELD`` different contexts at most and passes them on past that;
the merge takes anchors in order and works off those it has past ``HELD``, so only the
different contexts of one anchor must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import give_back, id_and_text, slices
from tallyloom.llm.line_dedup import has_bits, twice_seen_filter
from tallyloom.session import prepare

GRAM = 32
#: Bytes that are hashed at once, so that the kernels' arrays stay in the caches.
STRETCH = 1 << 18
#: Suffixes that one call of the merge holds, so that its arrays stay in the caches.
MERGE = 1 << 17
#: Different contexts that a task holds.
HELD = 300_000
FIRSTS = "anchor long, context binary, before int, doc long, mark long, start long, end long"
FIRST_SCHEMA = pa.schema(
    [("anchor", pa.int64()), ("context", pa.binary()), ("before", pa.int32()), *((n, pa.int64()) for n in ("doc", "mark", "start", "end"))]
)
_BYTE_VALUES = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every gram, by doubling; ``len(data) - GRAM + 1`` of them."""
    with np.errstate(over="ignore"):
        h, power, n = _BYTE_VALUES[data], np.uint64(0x9E3779B97F4A7C15), 1
        while n < GRAM:
            h = h[:-n] * power + h[n:]
            power, n = power * power, 2 * n
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every run of ``width`` values, by doubling."""
    n = 1
    while 2 * n <= width:
        values = pick(values[:-n], values[n:])
        n *= 2
    rest = width - n
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of all anchors, in order."""
    width = length - GRAM + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    group, size = [], 0
    for i, text in enumerate(texts):
        if len(text) >= length:
            group.append(i)
            size += len(text)
        if group and (size >= STRETCH or i == len(texts) - 1):
            found.append(_anchors_of(texts, group, length, width))
            group, size = [], 0
    if group:
        found.append(_anchors_of(texts, group, length, width))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _anchors_of(texts: list[bytes], group: list[int], length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(texts[i]) for i in group])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
    hashes = gram_hashes(data)
    least = _slide(hashes, width, np.minimum)
    # a window that reaches into the next text counts for nothing
    starts_left = np.arange(len(least))
    least[starts_left + length > np.repeat(ends, sizes)[: len(least)]] = 0
    around = np.zeros(len(hashes) + width - 1, np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(_slide(around, width, np.maximum) == hashes)
    which = np.searchsorted(ends, at, side="right")
    return np.array(group)[which], at - (ends - sizes)[which], hashes[at]


def merged_intervals(pairs: np.ndarray, row: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Refine the interleave of suffixes; (suffix number, interval) of those in intervals of two or more.

    ``pairs[r, c]`` is the symbol of columns c and c + 1 of context r; suffix i is the
    string of ``length`` bytes of context ``row[i]`` at column ``start[i]``; only suffixes
    of one ``group`` can be equal.
    """
    order = np.argsort(group, kind="stable")
    first = (row * pairs.shape[1] + start)[order]  # where each suffix starts in the symbols laid out flat
    order, interval, first = _repeated(order, group[order], first)
    symbols = pairs.ravel()
    for step in range((length + 1) // 2):
        if not len(order):
            break
        # the last step of an odd length takes a pair that it has in part taken before
        symbol = symbols[first + max(0, length - 2 * (step + 1))]
        placed = np.argsort(symbol, kind="stable")
        order, interval, first, symbol = order[placed], interval[placed], first[placed], symbol[placed]
        fresh = np.empty(len(order), bool)
        fresh[0] = True
        np.not_equal(symbol[1:], symbol[:-1], out=fresh[1:])
        fresh[1:] |= interval[1:] != interval[:-1]
        order, interval, first = _repeated(order, np.cumsum(fresh, dtype=np.int32), first)
    return order, interval


def _repeated(order: np.ndarray, interval: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the suffixes that are alone in their interval."""
    if not len(order):
        return order, interval, first
    stay = np.zeros(len(order), bool)
    same = interval[1:] == interval[:-1]
    stay[1:] = same
    stay[:-1] |= same
    if stay.all():
        return order, interval, first
    return order[stay], interval[stay], first[stay]


def merge_contexts(contexts: list[bytes], before: np.ndarray, anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(context number, first byte, past-the-last byte) of repeats in first occurrences.

    All contexts are different and those of one anchor come together. ``before`` counts a
    context's bytes before its anchor; bytes are counted from the context's start. Of
    equal strings the one with the least (doc, start) stays; ``doc`` may be any numbers
    in the documents' order.
    """
    reach = length - GRAM
    spans: list[tuple[int, int, int]] = []
    edges = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
    lone = np.diff(edges) == 1
    at = 0
    while at < len(edges) - 1:
        if lone[at]:
            at += 1
            continue
        end = at + 1
        while end < len(edges) - 1 and (edges[end + 1] - edges[at]) * (reach + 1) <= MERGE:
            end += 1
        own = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in range(at, end) if not lone[i]])
        at = end
        # an anchor with very many contexts is merged by stretches of places
        places = max(1, min(reach + 1, MERGE // len(own)))
        for first in range(0, reach + 1, places):
            spans += _merge_places(contexts, before, anchor, doc, start, own, range(first, min(first + places, reach + 1)), length)
    return spans


def _merge_places(contexts, before, anchor, doc, start, own, places, length) -> list[tuple[int, int, int]]:
    reach = length - GRAM
    sizes = np.array([len(contexts[i]) for i in own])
    shift = reach - before[own]  # columns before the context's first byte, so that anchors stand in one column
    lo, hi = places.start, places.stop - 1 + length
    width = hi - lo + 1
    laid = (b"\0" * max(0, s - lo) + contexts[i][max(0, lo - s) : max(0, hi - s)] for i, s in zip(own.tolist(), shift.tolist(), strict=True))
    block = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in laid), np.uint8).reshape(len(own), width)
    pairs = block[:, :-1].astype(np.uint16) << np.uint16(8) | block[:, 1:]
    column = np.arange(places.start, places.stop)
    fits = (column >= shift[:, None]) & (column + length <= (shift + sizes)[:, None])
    row, place = np.nonzero(fits)
    number = np.cumsum(np.r_[True, anchor[own][1:] != anchor[own][:-1]])
    order, interval = merged_intervals(pairs, row, place, number[row] * np.int64(len(column)) + place, length)
    if not len(order):
        return []
    rows, places_of = row[order], place[order]
    # all suffixes of an interval stand at one distance from their anchors, so the anchors' order decides;
    # contexts may start later at a document's start, so their own order doesn't
    by = np.lexsort(((start + before)[own][rows], doc[own][rows], interval))
    first = np.r_[True, interval[by][1:] != interval[by][:-1]]
    later = by[~first]
    begin = column[places_of[later]] - shift[rows[later]]
    return runs(own[rows[later]], begin, begin + length)


def runs(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans joined into maximal runs for each key."""
    return joined_runs([(key, begin, end)])


def joined_runs(spans: list[tuple]) -> list[tuple]:
    """Runs of spans given as columns (key, ..., begin, end): those of one key that touch are joined."""
    columns = [np.concatenate(c) for c in zip(*spans, strict=True)] if spans else []
    if not columns or not len(columns[0]):
        return []
    *keys, begin, end = columns
    by = np.lexsort((begin, *reversed(keys)))
    begin, end = begin[by], end[by]
    fresh = np.ones(len(by), bool)
    same = np.ones(len(by) - 1, bool)
    for key in keys:
        same &= key[by][1:] == key[by][:-1]
    out, row = [], list(zip(*(k[by].tolist() for k in keys), strict=True))
    fresh[1:] = ~same
    lo, hi = int(begin[0]), int(end[0])
    for i, (new, b, e) in enumerate(zip(fresh.tolist(), begin.tolist(), end.tolist(), strict=True)):
        if i and (new or b > hi):
            out.append((*row[i - 1], lo, hi))
            lo, hi = b, e
        elif e > hi:
            hi = e
    out.append((*row[-1], lo, hi))
    return out


def first_occurrences(texts: DataFrame, length: int, max_bits: int) -> DataFrame:
    """Rows with a context: its first occurrence in a task; rows without: repeats, as spans of a document."""
    size = texts.select(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0

    def hashes_of(batch: list[str]) -> np.ndarray:
        return anchors([t.encode("utf-8") for t in batch], length)[2]

    packed, bits = twice_seen_filter(texts.select("text"), hashes_of, size // (length // 3), max_bits)
    shared = texts.sparkSession.sparkContext.broadcast(packed)
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts: dict[tuple[int, int, bytes], tuple[int, int, int]] = {}
        again: list[tuple[int, int, int, int]] = []
        for batch in batches:
            for piece in slices(batch):
                ids, marks = piece.column("doc_id").to_pylist(), piece.column("mark").to_pylist()
                data = [t.encode("utf-8") for t in piece.column("text").to_pylist()]
                which, at, hashes = anchors(data, length)
                hit = has_bits(shared.value, bits, hashes)
                for i, place, anchor in zip(which[hit].tolist(), at[hit].tolist(), hashes[hit].view(np.int64).tolist(), strict=True):
                    lo = max(0, place - reach)
                    key = (anchor, place - lo, data[i][lo : place + length])
                    own = (ids[i], marks[i], lo)
                    held = firsts.get(key)
                    if held is None:
                        firsts[key] = own
                    elif held != own:
                        if own < held:
                            firsts[key], own = own, held
                        again.append((*own, own[2] + len(key[2])))
                if len(again) > 1_000_000:
                    again = _joined(again)
                if len(firsts) > HELD:
                    yield from _first_rows(firsts)
        spans = _joined(again)
        for i in range(0, len(spans), 50_000):
            part = spans[i : i + 50_000]
            none = [None] * len(part)
            yield _first_batch(none, none, none, *map(list, zip(*part, strict=True)))
        yield from _first_rows(firsts)
        give_back()

    return texts.where("doc_id is not null").mapInArrow(run, FIRSTS)


def _joined(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    return joined_runs([tuple(np.array(spans, np.int64).T)]) if spans else []


def _first_rows(firsts: dict[tuple[int, int, bytes], tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """The first occurrences, which are then forgotten."""
    keys = list(firsts)
    for i in range(0, len(keys), 20_000):
        part = keys[i : i + 20_000]
        own = [firsts[k] for k in part]
        yield _first_batch(
            [k[0] for k in part], [k[2] for k in part], [k[1] for k in part],
            [o[0] for o in own], [o[1] for o in own], [o[2] for o in own], [o[2] + len(k[2]) for o, k in zip(own, part, strict=True)],
        )
    firsts.clear()


def _first_batch(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIRST_SCHEMA, strict=True)], schema=FIRST_SCHEMA)


def resolved_spans(firsts: DataFrame, length: int) -> DataFrame:
    """doc, mark, start, end of all repeats: those that tasks found by themselves, and those among their first occurrences."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc", "mark", "start", "end")])

    def merged(held: dict[tuple[int, int, bytes], tuple[int, int, int]], spans: list[tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
        """Repeats among the contexts held and the spans known; both are then forgotten."""
        keys = sorted(held, key=lambda k: k[0])
        anchor, before = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
        doc, mark, start = (np.array([held[k][i] for k in keys], np.int64) for i in (0, 1, 2))
        contexts = [k[2] for k in keys]
        held.clear()
        if keys:
            by = np.lexsort((mark, doc))
            number = np.empty(len(by), np.int64)  # the documents' order
            number[by] = np.cumsum(np.r_[False, (doc[by][1:] != doc[by][:-1]) | (mark[by][1:] != mark[by][:-1])])
            for i, lo, hi in merge_contexts(contexts, before, anchor, number, start, length):
                spans.append((int(doc[i]), int(mark[i]), int(start[i]) + lo, int(start[i]) + hi))
        joined = _joined(spans)
        spans.clear()
        for i in range(0, len(joined), 50_000):
            part = zip(*joined[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in part], schema=schema)
        give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, bytes], tuple[int, int, int]] = {}
        spans: list[tuple[int, int, int, int]] = []
        now = None
        for batch in batches:
            known_spans = pc.is_null(batch.column("context"))
            yield batch.filter(known_spans).select(["doc", "mark", "start", "end"])
            batch = batch.filter(pc.invert(known_spans))
            columns = (batch.column(c).to_pylist() for c in ("anchor", "before", "context", "doc", "mark", "start"))
            for anchor, before, context, *own in zip(*columns, strict=True):
                if anchor != now:
                    if len(held) > HELD:
                        yield from merged(held, spans)
                    now = anchor
                key, own = (anchor, before, context), tuple(own)
                known = held.get(key)
                if known is None:
                    held[key] = own
                elif known != own:
                    if own < known:
                        held[key], own = own, known
                    spans.append((*own, own[2] + len(context)))
        yield from merged(held, spans)

    # anchors in order, so that those that are done needn't be held
    dealt = firsts.repartition(F.coalesce("anchor", F.xxhash64("doc", "mark"))).sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "doc long, mark long, start long, end long")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 28) -> DataFrame:
    """doc, mark (a hash of its text), spans (array of start, end in bytes, unordered, may overlap) of every document with repeats."""
    if length < GRAM + 2:
        raise ValueError(f"length must be {GRAM + 2} or more")
    prepare(docs.sparkSession)
    firsts = first_occurrences(_marked(docs, id_col, text_col), length, max_bits)
    return resolved_spans(firsts, length).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def dedup_repeats(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 28) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs, in order) and kept (the bytes left) of every document."""
    spans = repeated_spans(docs, length=length, id_col=id_col, text_col=text_col, max_bits=max_bits)
    texts = _marked(docs, id_col, text_col)
    spans = spans.withColumnRenamed("mark", "own")
    joined = texts.where("doc_id is not null").join(spans, (F.col("doc_id") == F.col("doc")) & (F.col("mark") == F.col("own")), "left")
    # rows without id would all meet in one task
    alone = texts.where("doc_id is null").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    joined = joined.select("doc_id", "text", "spans").unionByName(alone.select("doc_id", "text", "spans"))
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_bytes", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("kept", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                rows = []
                for doc, text, found in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                    data = text.encode("utf-8")
                    own = _joined([(0, 0, s["start"], s["end"]) for s in found or ()])
                    left, at = [], 0
                    for *_, lo, hi in own:
                        left.append(data[at:lo])
                        at = hi
                    left.append(data[at:])
                    rows.append((doc, len(data), [{"start": lo, "end": hi} for *_, lo, hi in own], b"".join(left)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


#: The query's SQL; each row is a document, by its id and a hash of its text.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS r, encode(coalesce(text, '')) AS b FROM documents
), s AS (
  SELECT r, i, b[i : i + 99] AS g FROM (SELECT r, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d)
), again AS (
  SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY g ORDER BY r, i) AS n FROM s) WHERE n > 1
), marked AS (
  SELECT r, i, sum(CASE WHEN i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM again)
), spans AS (
  SELECT r, min(i) AS lo, max(i) + 99 AS hi FROM marked GROUP BY r, run
), pieces AS (
  SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) + 1 AS a, lo - 1 AS z FROM spans
  UNION ALL SELECT r, max(hi) + 1, NULL FROM spans GROUP BY r
), kept AS (
  SELECT r, string_agg(hex(b[a : coalesce(z, octet_length(b))]), '' ORDER BY a) AS h FROM pieces JOIN d USING (r) WHERE a <= coalesce(z, octet_length(b)) GROUP BY r
), sums AS (
  SELECT r, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN sums.r IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""
