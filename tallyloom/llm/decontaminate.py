"""Benchmark decontamination by latent semantic retrieval.

1. Texts are read once into numbers of the benchmark's words, a table in the shared
   folder that the passes below read. Document frequencies of the words are counted over
   all documents (their passages of ``window`` words) and give the weights: squared logarithms,
   since passage and item both bring one; words of over a fifth of them weigh nothing.
2. A latent space of TF-IDF passages is fitted by a distributed randomised SVD: tasks
   sum ``A^T A`` times a random matrix for their passages, the sum is orthogonalised,
   and a second pass gives the small matrix whose eigenvectors turn that basis into
   singular vectors. Divided by their values, so that no language's common words
   outweigh the rest, they are the space. It is fitted on all passages of all documents,
   those without id too.
3. Every passage of every document (windows of ``window`` words that overlap by half)
   is projected; items with a cosine of ``least_cosine`` or more are its candidates.
   An item of over one and a half windows is searched by windows of its own too, also
   overlapping by half, since no passage is like the whole of a long item.
4. A candidate is confirmed by the longest common subsequence of words of the item
   and the words around its passage (where the item's window says the item lies): ``sure`` of the item's words or more, or
   ``likely`` of them with the item's answer (its last ``answer`` words) confirmed too.

Words are lower-cased runs without ASCII blanks and punctuation. The latent space
spans the benchmark's words; others have no weight in it.

Defined results: a null or empty text or item gives nothing; repeated rows give their
matches each; rows without id match with a null id; an empty benchmark or corpus gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import cut_into, give_back, id_and_text, joined_parts, slices, sum_partials
from tallyloom.session import cut_to_table, prepare

PARTS = 4
#: Tasks of a pass of the fit that are never joined, however many words the benchmark has.
FIT_PARTITIONS = 32
#: Words in a larger share of all passages have no weight.
STOP_SHARE = 0.2
#: Cosines that are held at once, and items whose tables are.
COSINES, HELD_TABLES = 1 << 22, 4096
NO_PUNCTUATION = bytes(0x20 if chr(b) in string.punctuation else b for b in range(256))
MATCH = "doc_id long, item_id long, cosine double, lcs double, answer_lcs double, start_word long, end_word long"


def plain_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(NO_PUNCTUATION).split()


@dataclass
class Items:
    """The benchmark: a stated query set, whose size the caller checks."""

    ids: list[int]
    words: list[list[int]]  # word numbers of each item
    index: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        index: dict[bytes, int] = {}
        ids, words = [], []
        for item, text in rows:
            if found := [index.setdefault(w, len(index)) for w in plain_words(text or "")]:
                ids.append(item)
                words.append(found)
        return cls(ids, words, index)


def numbers(text: str, index: dict[bytes, int]) -> np.ndarray:
    """Word numbers of a text; -1 for words that no item has."""
    get = index.get
    return np.array([get(w, -1) for w in plain_words(text)], np.int32)


def lcs_mask_tables(words: list[int]) -> dict[int, int]:
    """Bit positions of every word of an item, for ``lcs_length``."""
    table: dict[int, int] = {}
    for i, w in enumerate(words):
        table[w] = table.get(w, 0) | 1 << i
    return table


def lcs_length(table: dict[int, int], size: int, other: list[int]) -> int:
    """Longest common subsequence by bit-parallel rows (one integer a row)."""
    full = (1 << size) - 1
    row = full
    for w in other:
        mask = table.get(w)
        if mask:
            hit = row & mask
            row = (row + hit | row & ~mask) & full
    return size - row.bit_count()


def number_texts(texts: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """Ids and the word numbers of their texts, packed as 32-bit integers."""
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for piece in slices(batch):
                packed = pa.array([numbers(t, own).tobytes() for t in piece.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), packed], names=["doc_id", "words"])
        give_back()

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, words binary")


def passage_rows(piece: pa.RecordBatch, window: int) -> np.ndarray:
    """The passages of packed texts, sorted word numbers in a row each; -1 past a text's end too."""
    texts = [np.frombuffer(words, np.int32) for words in piece.column("words").to_pylist()]
    counts = np.array([-(-len(t) // window) for t in texts], np.int64)
    rows = np.full((int(counts.sum()), window), -1, np.int32)
    flat = rows.ravel()
    for text, first in zip(texts, (np.cumsum(counts) - counts) * window, strict=True):
        flat[first : first + len(text)] = text
    rows.sort(axis=1)
    return rows


def run_starts(rows: np.ndarray) -> np.ndarray:
    """Flat positions where a word of a sorted row is first."""
    change = np.ones(rows.shape, bool)
    change[:, 1:] = rows[:, 1:] != rows[:, :-1]
    return np.flatnonzero(change)


def passage_frequencies(numbered: DataFrame, size: int, window: int) -> tuple[np.ndarray, int]:
    """Passages that hold each word of the benchmark, and all passages, over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size + 1)
        for batch in batches:
            for piece in slices(batch):
                rows = passage_rows(piece, window)
                word = rows.ravel()[run_starts(rows)]
                sums[:size] += np.bincount(word[word >= 0], minlength=size)
                sums[size] += len(rows)
        if sums[size]:
            yield cut_into(sums, PARTS)

    sums = joined_parts(sum_partials(numbered.select("words").mapInArrow(run, "part int, data binary"), PARTS), size + 1, PARTS)
    return sums[:size], int(sums[size])


@dataclass
class Passages:
    """Unit TF-IDF rows of passages, sparse: entries by passage, then word."""

    n: int  # passages, those without entries too
    row: np.ndarray
    word: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, piece: pa.RecordBatch, weights: np.ndarray, window: int) -> Passages:
        rows = passage_rows(piece, window)
        starts = run_starts(rows)
        count, word = np.diff(starts, append=rows.size), rows.ravel()[starts]
        heavy = (word >= 0) & (weights[word] > 0)
        row, word = starts[heavy] // window, word[heavy].astype(np.int64)
        value = count[heavy] * weights[word]
        norms = np.sqrt(np.bincount(row, value * value, minlength=len(rows)))
        return cls(len(rows), row, word, value / norms[row])

    def project(self, basis: np.ndarray) -> np.ndarray:
        """``basis`` (rank x words) times the transposed rows: rank x passages."""
        return np.stack([np.bincount(self.row, own[self.word] * self.value, minlength=self.n) for own in basis])

    def add_back(self, projected: np.ndarray, total: np.ndarray) -> None:
        """Add ``projected`` times the rows to ``total`` (rank x words)."""
        some, word = np.unique(self.word, return_inverse=True)
        for own, sums in zip(projected, total, strict=True):
            sums[some] += np.bincount(word, own[self.row] * self.value, minlength=len(some))


def passage_svd(numbered: DataFrame, weights: np.ndarray, *, rank: int, window: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (words x rank) and singular values of the TF-IDF passages of packed texts.

    Tasks send sums of words x rank numbers, whatever the number of passages.
    """
    size = len(weights)
    rank = min(rank, size)
    context = numbered.sparkSession.sparkContext
    shared = context.broadcast(weights)

    def summed(basis: np.ndarray, small: bool) -> np.ndarray:
        own_basis = context.broadcast(basis.T.astype(np.float32))
        shape = (rank, rank) if small else (rank, size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            across, own_weights = np.ascontiguousarray(own_basis.value, np.float64), shared.value
            some = False
            for batch in batches:
                for piece in slices(batch, 1 << 20):
                    rows = Passages.of(piece, own_weights, window)
                    if len(rows.word):
                        projected = rows.project(across)
                        if small:
                            total += projected @ projected.T
                        else:
                            rows.add_back(projected, total)
                        some = True
            if some:
                yield cut_into(total.ravel(), PARTS)
            give_back()

        partials = numbered.select("words").mapInArrow(run, "part int, data binary")
        return joined_parts(sum_partials(partials, PARTS), shape[0] * shape[1], PARTS).reshape(shape)

    basis = np.random.default_rng(seed).standard_normal((size, rank))
    basis = np.linalg.qr(summed(basis, small=False).T)[0]
    values, vectors = np.linalg.eigh(summed(basis, small=True))
    order = np.argsort(values)[::-1]
    return basis @ vectors[:, order], np.sqrt(np.maximum(values[order], 0))


def randomised_svd(texts: DataFrame, index: dict[bytes, int], weights: np.ndarray, *, rank: int, window: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``passage_svd`` of the column ``text``."""
    numbered = number_texts(texts.select(F.lit(0).cast("long").alias("doc_id"), "text"), index)
    return passage_svd(numbered, weights, rank=rank, window=window, seed=seed)


def item_queries(words: list[list[int]], window: int) -> list[tuple[int, int | None, list[int]]]:
    """(item, first word, words) to search by: every item whole (no first word), long ones in windows too."""
    found: list[tuple[int, int | None, list[int]]] = []
    for item, own in enumerate(words):
        found.append((item, None, own))
        if 2 * len(own) > 3 * window:
            starts = [*range(0, len(own) - window, window // 2), len(own) - window]
            found += [(item, at, own[at : at + window]) for at in starts]
    return found


def latent_queries(queries: list[list[int]], weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors of word lists in the latent space; zero where nothing is left of one."""
    found = np.stack([weights[w] @ basis[w] for w in queries])
    norms = np.linalg.norm(found, axis=1, keepdims=True)
    return found / np.where(norms > 1e-9, norms, np.inf)


class Searcher:
    """Finds the items of one text; one per task."""

    def __init__(self, items: Items, weights: np.ndarray, basis: np.ndarray, **limits: float):
        self.items, self.limits = items, limits
        self.projection = (basis * weights[:, None]).astype(np.float32)
        self.heavy = weights > 0
        parts = item_queries(items.words, int(limits["window"]))
        self.places = [(item, at) for item, at, _ in parts]
        self.queries = latent_queries([w for *_, w in parts], weights, basis).astype(np.float32)
        self.held: dict[int, tuple[dict[int, int], dict[int, int], int]] = {}

    def tables(self, item: int) -> tuple[dict[int, int], dict[int, int], int]:
        """Bit tables of an item and of its answer, and the answer's size; made when a candidate needs them."""
        found = self.held.get(item)
        if found is None:
            if len(self.held) >= HELD_TABLES:
                self.held.clear()
            words = self.items.words[item]
            tail = words[-int(self.limits["answer"]) :]
            found = self.held[item] = (lcs_mask_tables(words), lcs_mask_tables(tail), len(tail))
        return found

    def candidates(self, found: np.ndarray) -> list[tuple[int, int, float]]:
        """(query, first word of the window, cosine) of all windows at or above the limit."""
        step = int(self.limits["window"]) // 2
        known = np.flatnonzero((found >= 0) & self.heavy[found])
        if not len(known):
            return []
        blocks = np.zeros((len(found) // step + 1, self.projection.shape[1]), np.float32)
        at = known // step
        edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        # rows of a block are contiguous; long texts go in stretches of blocks
        for i in range(0, len(edges), 2048):
            lo = edges[i]
            hi = edges[i + 2048] if i + 2048 < len(edges) else len(known)
            part = edges[i : i + 2048]
            blocks[at[part]] = np.add.reduceat(self.projection[found[known[lo:hi]]], part - lo, axis=0)
        windows = blocks.copy()
        windows[:-1] += blocks[1:]
        norms = np.linalg.norm(windows, axis=1, keepdims=True)
        windows /= np.where(norms > 1e-9, norms, np.inf)
        hits = []
        block = max(1, COSINES // len(self.queries))
        for i in range(0, len(windows), block):
            cosines = windows[i : i + block] @ self.queries.T
            for w, q in zip(*np.nonzero(cosines >= self.limits["least_cosine"]), strict=True):
                hits.append((int(q), (i + int(w)) * step, float(cosines[w, q])))
        return hits

    def around(self, query: int, at: int, cosine: float) -> tuple[int, int, int, float]:
        """Item, first and past-the-last word of where a hit's item may lie, cosine."""
        window = int(self.limits["window"])
        item, first = self.places[query]
        size = len(self.items.words[item])
        if first is None:
            reach = max(window, size)
            return item, max(0, at - reach // 2), at + window + reach // 2, cosine
        slack = window + size // 4
        return item, max(0, at - first - slack), at - first + size + slack, cosine

    def matches(self, text: str) -> list[tuple]:
        """``matches_in`` of a text."""
        return self.matches_in(numbers(text, self.items.index))

    def matches_in(self, found: np.ndarray) -> list[tuple]:
        """(item id, cosine, lcs, answer lcs, first and past-the-last word), best of each item's stretches that meet the rule."""
        if not len(found):
            return []
        window = int(self.limits["window"])
        stretches: dict[int, list[list]] = {}
        for item, lo, hi, cosine in sorted(self.around(*c) for c in self.candidates(found)):
            own = stretches.setdefault(item, [])
            if own and lo <= own[-1][1]:
                own[-1][1] = max(own[-1][1], hi)
                own[-1][2] = max(own[-1][2], cosine)
            else:
                own.append([lo, hi, cosine])
        out = []
        for item, own in stretches.items():
            size = len(self.items.words[item])
            reach = 2 * max(window, size)
            best, rank = None, (False, -1.0)
            for lo, hi, cosine in own:
                for at in range(lo, max(lo + 1, hi - reach // 2), reach // 2):  # stretches are read in bounded, overlapping parts
                    words = found[at : min(at + reach, hi)].tolist()
                    whole, table, n = self.tables(item)
                    shared = lcs_length(whole, size, words) / size
                    if shared < min(self.limits["sure"], self.limits["likely"]):
                        continue
                    answered = lcs_length(table, n, words) / n
                    meets = shared >= self.limits["sure"] or answered >= self.limits["likely"]
                    if (meets, shared) > rank:
                        best, rank = (self.items.ids[item], cosine, shared, answered, at, min(at + reach, hi, len(found))), (meets, shared)
            if rank[0]:
                out.append(best)
        return out


def numbered_and_search(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str,
    text_col: str,
    *,
    rank: int = 128,
    window: int = 40,
    least_cosine: float = 0.4,
    sure: float = 0.8,
    likely: float = 0.6,
    answer: int = 8,
    most_items: int = 50_000,
) -> tuple[DataFrame, Callable[[], Searcher]] | None:
    """Packed texts (``number_texts``) and what makes a task's searcher, with the space fitted; None for a benchmark without words.

    The benchmark is a query set of ``most_items`` items at most (an error past that).
    """
    spark = prepare(docs.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("long"), "text").limit(most_items + 1).collect()
    if len(rows) > most_items:
        raise ValueError(f"the benchmark has over {most_items} items; search it in parts")
    items = Items.of(sorted({(r["item_id"], r["text"]) for r in rows if r["item_id"] is not None}, key=lambda r: (r[0], r[1] or "")))
    texts = id_and_text(docs, id_col, text_col)
    if not items.ids:
        return None
    numbered = cut_to_table(number_texts(texts, items.index), "word_numbers")
    held, passages = passage_frequencies(numbered, len(items.index), window)
    weights = np.square(np.log((1.0 + passages) / (1.0 + held)))
    weights[held > STOP_SHARE * passages] = 0
    # a task sends words x rank numbers of 8 bytes: no more tasks than read as much, but one for every core
    tasks = max(FIT_PARTITIONS, spark.sparkContext.defaultParallelism, 4 * window * passages // (8 * rank * len(items.index)))
    basis, values = passage_svd(numbered.coalesce(tasks), weights, rank=rank, window=window)
    basis = basis / np.maximum(values, 1e-3 * max(1e-9, values.max(initial=0.0)))
    limits = {"window": window, "least_cosine": least_cosine, "sure": sure, "likely": likely, "answer": answer}
    shared = spark.sparkContext.broadcast((items, weights, basis.astype(np.float32)))
    return numbered, lambda: Searcher(*shared.value, **limits)


def fitted_search(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, **limits) -> Callable[[], Searcher] | None:
    """What makes a task's searcher: see ``numbered_and_search``."""
    found = numbered_and_search(docs, benchmark, id_col, text_col, **limits)
    return found and found[1]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per document and item that it leaks: see ``MATCH`` for the columns and ``numbered_and_search`` for the limits.

    ``lcs`` and ``answer_lcs`` are shares of the item's words and of its answer's.
    """
    fitted = numbered_and_search(docs, benchmark, id_col, text_col, **limits)
    if fitted is None:
        return docs.sparkSession.createDataFrame([], MATCH)
    numbered, search = fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = search()
        schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.float64()) for c in MATCH.split(", ")])
        for batch in batches:
            for piece in slices(batch):
                rows = zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)
                out = [(doc, *m) for doc, words in rows for m in searcher.matches_in(np.frombuffer(words, np.int32))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        give_back()

    return numbered.mapInArrow(run, MATCH)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns; each row is searched by itself, also one without id."""
    search = fitted_search(docs, benchmark, id_col, text_col, **limits)
    if search is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = search()
        for batch in batches:
            for piece in slices(batch):
                clean = [not searcher.matches(t or "") for t in piece.column(text_col).to_pylist()]
                yield piece.filter(pa.array(clean, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
