"""LM scoring by cross-entropy difference of two matched bigram models.

Both models, one of the target documents and one of all documents (the background),
are bigram models with the same Dirichlet smoothing towards their unigrams, over all
words of the corpus. A document's score is the mean over its tokens of target loss
less background loss: the lower, the more it is like the target.

Counts are exact and stay distributed. A first pass counts tokens and distinct words.
Then texts are read in chunks of about ``CHUNK_BYTES``: a chunk keeps its texts as word
numbers and sends its distinct words and bigrams with their counts to parts of the key
space, whose number grows with the corpus. A part sums the counts of all chunks and
answers each with the sums of the keys it sent; a chunk scores its texts by its
answers. Two shuffles, no table; nothing but a few totals comes
to the driver, and nothing is broadcast but the targets' ids (up to a checked number).
Keys are 64-bit hashes of words and of pairs of them: n distinct keys have about
n^2 / 2^65 colliding pairs (0.03 at 10^9).

A chunk sends a string to each part, so there are chunks x parts strings: raise
``chunk_bytes`` and ``part_bytes`` with the corpus as far as the workers' memory
allows (a worker holds about 25 times as much as the larger of them).

Given ``vocabulary`` and ``bucket_bits``, counts are bounded instead: the
``vocabulary`` most frequent words, ties by the word, the rest being one unknown word,
and bigram counts in hash buckets shared by both models. Memory is then set by the
parameters, and losses grow worse with the corpus as bigrams share buckets.

Defined results: a null or empty text has 0 tokens and null losses and score; without
target documents both models are smoothed alike and the target one is uniform; a
null id is never a target; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import cut_into, give_back, id_and_text, joined_parts, map_texts, slices, split_words, sum_partials
from tallyloom.session import prepare

PARTS = 16
UNKNOWN, BEGIN = 0, 1
FIRST_WORD = 2
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text of a chunk, and for each part of the key space.
CHUNK_BYTES, PART_BYTES = 8 << 20, 8 << 20
#: Tokens that are scored at once.
BLOCK = 1 << 17
BEGIN_KEY = np.uint64(0xD6E8FEB86659FD93)
SENT = ("<u8", "<u4", "<u4") * 2  # words, their counts in all texts and in targets; bigrams and theirs
ANSWERED = ("<i8",) * 4  # counts of words in all texts and in targets; of bigrams
KEPT = ("<i8", "u1", "<i8", "<u8", "<u4")  # ids, whether null, numbers of tokens; keys of words, word numbers of tokens
SCORES = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


def mark_targets(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, max_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, text, target (0 or 1); the targets' ids are broadcast up to a checked number."""
    ids = targets.select(F.col(targets.columns[0]).cast("long").alias("__target")).where("__target is not null").distinct()
    side = ids.withColumn("target", F.lit(1))
    if ids.count() <= max_broadcast:
        side = F.broadcast(side)
    texts = id_and_text(docs, id_col, text_col)
    return texts.join(side, texts["doc_id"] == F.col("__target"), "left").select(
        "doc_id", "text", F.coalesce("target", F.lit(0)).alias("target")
    )


def count_words(marked: DataFrame) -> DataFrame:
    """word, n, n_target over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter = Counter()
        wanted: Counter = Counter()
        for batch in batches:
            for piece in slices(batch):
                for text, target in zip(piece.column("text").to_pylist(), piece.column("target").to_pylist(), strict=True):
                    words = split_words(text)
                    every.update(words)
                    if target:
                        wanted.update(words)
                if len(every) > 2_000_000:
                    yield _counted(every, wanted)
                    every, wanted = Counter(), Counter()
        if every:
            yield _counted(every, wanted)

    rows = marked.mapInArrow(run, "word binary, n long, n_target long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def _counted(every: Counter, wanted: Counter) -> pa.RecordBatch:
    words = list(every)
    columns = [pa.array(words, pa.binary()), pa.array(every.values(), pa.int64()), pa.array([wanted[w] for w in words], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n", "n_target"])


def token_ids(texts: list[str], index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts' tokens, the ids before them, and each text's number of tokens."""
    get = index.get
    found = [[get(w, UNKNOWN) for w in split_words(t)] for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum()))
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    starts = np.cumsum(sizes) - sizes
    before[starts[sizes > 0]] = BEGIN
    return ids, before, sizes


def buckets_of(before: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
    pair = before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)
    return (pair * SPREAD >> np.uint64(64 - bits)).astype(np.int64)


class Model:
    """Unigram and bucketed bigram counts of one side, with Dirichlet smoothing."""

    def __init__(self, unigrams: np.ndarray, bigrams: np.ndarray, strength: float):
        total = unigrams.sum()
        self.unigram = (unigrams + 1.0) / (total + len(unigrams))
        self.seen = unigrams.astype(np.float32)
        self.bigrams = bigrams.astype(np.float32)
        self.strength = strength

    def loss(self, before: np.ndarray, ids: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Natural-log loss of every token."""
        context = self.seen[before]
        joint = np.minimum(self.bigrams[bucket], context)
        return -np.log((joint + self.strength * self.unigram[ids]) / (context + self.strength))


def pack_columns(columns: list[np.ndarray], kinds: tuple[str, ...]) -> bytes:
    """Arrays as one compressed string, by planes of bytes, since high bytes are mostly zero."""
    arrays = [np.ascontiguousarray(c, dtype=k) for c, k in zip(columns, kinds, strict=True)]
    planes = [a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    sizes = np.array([len(a) for a in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes, *planes]))


def unpack_columns(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    at, columns = 8 * len(kinds), []
    for n, kind in zip(raw[:at].view("<i8").tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        columns.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return columns


def bigram_keys(words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of every token's bigram, and the numbers of the words before; len(words) is the begin of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = len(words)
    return np.r_[words, BEGIN_KEY][before] * SPREAD + words[tokens], before


class Chunk:
    """Texts as numbers of the chunk's own words."""

    def __init__(self):
        self.index: defaultdict[bytes, int] = defaultdict(counter().__next__)
        self.n_bytes, self.ids, self.targets, self.sizes, self.tokens = 0, [], [], [], []

    def add(self, piece: pa.RecordBatch) -> None:
        index = self.index
        for text in piece.column("text").to_pylist():
            found = [index[w] for w in split_words(text)]
            self.sizes.append(len(found))
            self.tokens.append(np.array(found, np.uint32))
        self.ids += piece.column("doc_id").to_pylist()
        self.targets.append(piece.column("target").to_numpy(zero_copy_only=False).astype(bool))
        self.n_bytes += piece.nbytes

    def rows(self, number: int, parts: int) -> Iterator[pa.RecordBatch]:
        """The chunk's texts (part -1) and what it sends to the parts."""
        words = np.fromiter(map(xxhash.xxh64_intdigest, self.index), np.uint64, len(self.index))
        sizes, tokens, targets = np.array(self.sizes, np.int64), np.concatenate(self.tokens), np.concatenate(self.targets)
        keys, _ = bigram_keys(words, tokens, sizes)
        wanted = np.repeat(targets, sizes)
        sent = []
        for found in (words[tokens], keys):
            distinct, n = np.unique(found, return_counts=True)
            some, n_some = np.unique(found[wanted], return_counts=True)
            n_target = np.zeros_like(n)
            n_target[np.searchsorted(distinct, some)] = n_some
            sent.append((distinct, n, n_target))
        # parts are equal ranges of keys, so that answers by part are in the order of keys
        edges = [range_edges(k[0], parts) for k in sent]
        null = [i is None for i in self.ids]
        kept = pack_columns([np.array([i or 0 for i in self.ids]), null, sizes, words, tokens], KEPT)
        yield _row(number, -1, kept)
        for part in range(parts):
            slots = [slice(e[part], e[part + 1]) for e in edges]
            if any(s.stop > s.start for s in slots):
                yield _row(number, part, pack_columns([c[s] for k, s in zip(sent, slots, strict=True) for c in k], SENT))


def _row(chunk: int, part: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part], pa.int64()), pa.array([data], pa.binary())], names=["chunk", "part", "data"])


def range_edges(keys: np.ndarray, parts: int) -> list[int]:
    """Where each of ``parts`` equal ranges begins in sorted keys, and the end."""
    return [*np.searchsorted(keys, np.array([(p << 64) // parts for p in range(parts)], np.uint64)).tolist(), len(keys)]


def corpus_totals(marked: DataFrame, parts: int) -> tuple[int, list[int], list[int]]:
    """Distinct words; tokens, and texts that have any, of all texts and of the targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: set[bytes] = set()
        sums = np.zeros(4, np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            keys = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
            edges = range_edges(keys, parts)
            for part, (lo, hi) in enumerate(zip(edges, edges[1:])):
                yield _row(0, part, pack_columns([keys[lo:hi], sums if part == 0 else np.zeros(4)], ("<u8", "<i8")))
            words.clear()
            sums[:] = 0

        for batch in batches:
            for piece in slices(batch, 2 << 20):
                for text, target in zip(piece.column("text").to_pylist(), piece.column("target").to_pylist(), strict=True):
                    found = split_words(text)
                    words.update(found)
                    sums += (len(found), len(found) * target, bool(found), bool(found) * target)
                if len(words) > 500_000:
                    yield from rows()
        if words:
            yield from rows()
        give_back()

    def merge(table: pa.Table) -> pa.Table:
        got = [unpack_columns(d, ("<u8", "<i8")) for d in table.column("data").to_pylist()]
        sums = np.sum([g[1] for g in got], axis=0)
        return pa.table({"n_words": [len(np.unique(np.concatenate([g[0] for g in got])))]} | {c: [int(v)] for c, v in zip("abcd", sums, strict=True)})

    rows = marked.mapInArrow(run, "chunk long, part long, data binary")
    merged = rows.groupBy("part").applyInArrow(merge, "n_words long, a long, b long, c long, d long")
    n_words, *sums = merged.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", *"abcd"))).first()
    return n_words, sums[:2], sums[2:]


def summed_part(table: pa.Table) -> pa.Table:
    """Answers of one part to the chunks that sent keys to it; a chunk's texts pass."""
    if table.column("part")[0].as_py() < 0:
        return table.select(["chunk", "part", "data"])
    rows = [unpack_columns(d, SENT) for d in table.column("data").to_pylist()]
    answers: list[list[np.ndarray]] = [[] for _ in rows]
    for at in (0, 3):
        ends = np.cumsum([len(r[at]) for r in rows])[:-1]
        distinct, which = np.unique(np.concatenate([r[at] for r in rows]), return_inverse=True)
        for side in (1, 2):
            total = np.bincount(which, np.concatenate([r[at + side] for r in rows]), len(distinct)).astype(np.int64)  # exact up to 2^53
            for own, part in zip(answers, np.split(total[which], ends), strict=True):
                own.append(part)
    packed = pa.array([pack_columns(a, ANSWERED) for a in answers], pa.binary())
    del rows, answers, which, distinct, total
    give_back()
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "data": packed})


def score_exactly(marked: DataFrame, strength: float, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Scores of all texts by exact counts."""
    n_bytes = marked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-n_bytes // part_bytes))
    n_words, n_tokens, n_texts = corpus_totals(marked, -(-parts // 8))
    size = n_words + FIRST_WORD

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, Chunk()
        for batch in batches:
            for piece in slices(batch, chunk_bytes // 4):
                chunk.add(piece)
                if chunk.n_bytes >= chunk_bytes:
                    yield from chunk.rows(number, parts)
                    number, chunk = number + 1, Chunk()
                    give_back()
        if chunk.ids:
            yield from chunk.rows(number, parts)
        del chunk
        give_back()

    def score(table: pa.Table) -> pa.Table:
        (_, texts), *answers = sorted(zip(table.column("part").to_pylist(), table.column("data").to_pylist(), strict=True))
        ids, null, sizes, words, tokens = unpack_columns(texts, KEPT)
        keys, before = bigram_keys(words, tokens, sizes)
        word_of = np.unique(words, return_inverse=True)[1]
        bigram_of = np.unique(keys, return_inverse=True)[1].astype(np.uint32)
        got = [unpack_columns(d, ANSWERED) for _, d in answers]
        seen = [np.concatenate([g[i] for g in got]) if got else np.empty(0, np.int64) for i in range(4)]
        ends = np.cumsum(sizes)
        losses = {}
        for side, name in enumerate(("loss_background", "loss_target")):
            n = seen[side][word_of]
            unigram = strength * (n + 1.0) / (n_tokens[side] + n_texts[side] + size)
            context = np.r_[n, n_texts[side]] + strength
            total = np.zeros(len(tokens) + 1)
            for at in range(0, len(tokens), BLOCK):
                own = slice(at, at + BLOCK)
                joint = seen[2 + side][bigram_of[own]] + unigram[tokens[own]]
                total[at + 1 : at + 1 + len(joint)] = -np.log(joint / context[before[own]])
            np.cumsum(total, out=total)
            losses[name] = (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)
        del total, seen, got, keys, before, word_of, bigram_of, tokens
        give_back()
        target, background = losses["loss_target"], losses["loss_background"]
        empty = sizes == 0
        columns = {"doc_id": pa.array(ids, mask=null.astype(bool)), "n_tokens": pa.array(sizes)}
        columns |= {"loss_target": pa.array(target, mask=empty), "loss_background": pa.array(background, mask=empty)}
        return pa.table(columns | {"score": pa.array(target - background, mask=empty)})

    sent = marked.mapInArrow(stage, "chunk long, part long, data binary")
    answered = sent.groupBy(F.when(F.col("part") < 0, -1 - F.col("chunk")).otherwise(F.col("part")).alias("slot")).applyInArrow(summed_part, "chunk long, part long, data binary")
    return answered.groupBy("chunk").applyInArrow(score, SCORES)


def score_documents(
    docs: DataFrame,
    targets: DataFrame,
    *,
    vocabulary: int | None = None,
    bucket_bits: int | None = None,
    strength: float = 200.0,
    chunk_bytes: int = CHUNK_BYTES,
    part_bytes: int = PART_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score of every whole text.

    ``targets``' first column holds the ids of the target documents. Counts are exact
    unless ``vocabulary`` and ``bucket_bits`` (both or neither) bound them.
    """
    if (vocabulary is None) != (bucket_bits is None):
        raise ValueError("vocabulary and bucket_bits go together")
    spark = prepare(docs.sparkSession)
    marked = mark_targets(docs, targets, id_col, text_col)
    if vocabulary is None:
        return score_exactly(marked, strength, chunk_bytes, part_bytes)
    words = count_words(marked)
    top = words.orderBy(F.desc("n"), "word").limit(vocabulary).collect()  # bounded by the parameter
    index = {bytes(r["word"]): i + FIRST_WORD for i, r in enumerate(top)}
    shared_index = spark.sparkContext.broadcast(index)
    size, cells = len(index) + FIRST_WORD, 1 << bucket_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * (size + cells))
        own_index = shared_index.value
        some = False
        for batch in batches:
            for piece in slices(batch):
                some = True
                ids, before, sizes = token_ids(piece.column("text").to_pylist(), own_index)
                target = np.repeat(piece.column("target").to_numpy(zero_copy_only=False), sizes).astype(bool)
                bucket = buckets_of(before, ids, bucket_bits)
                for side, rows in enumerate((slice(None), target)):
                    at = side * (size + cells)
                    sums[at : at + size] += np.bincount(ids[rows], minlength=size)
                    sums[at + BEGIN] += np.count_nonzero(before[rows] == BEGIN)
                    sums[at + size : at + size + cells] += np.bincount(bucket[rows], minlength=cells)
        if some:
            yield cut_into(sums, PARTS)

    partials = marked.select("text", "target").mapInArrow(count, "part int, data binary")
    sums = joined_parts(sum_partials(partials, PARTS), 2 * (size + cells), PARTS)
    background = Model(sums[:size], sums[size : size + cells], strength)
    target = Model(sums[size + cells : 2 * size + cells], sums[2 * size + cells :], strength)
    models = spark.sparkContext.broadcast((target, background))

    def each():
        own_index, (wanted, every) = shared_index.value, models.value

        def handle(batch: pa.RecordBatch) -> dict:
            ids, before, sizes = token_ids(batch.column("text").to_pylist(), own_index)
            bucket = buckets_of(before, ids, bucket_bits)
            ends = np.cumsum(sizes)
            columns: dict = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(sizes)}
            means = []
            for name, model in (("loss_target", wanted), ("loss_background", every)):
                total = np.r_[0.0, np.cumsum(model.loss(before, ids, bucket), dtype=np.float64)]
                means.append((total[ends] - total[ends - sizes]) / np.maximum(sizes, 1))
                columns[name] = pa.array(means[-1], mask=sizes == 0)
            columns["score"] = pa.array(means[0] - means[1], mask=sizes == 0)
            return columns

        return handle

    return map_texts(id_and_text(docs, id_col, text_col), each, SCORES)


#: The query's SQL, rounded as the query is: exact counts of words and of bigrams within a document.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \t-\r]+') AS ws,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS wanted FROM documents
), u AS (
  SELECT r, wanted, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS b FROM (SELECT r, wanted, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)
), uni AS (
  SELECT w, count(*) AS n, count(*) FILTER (WHERE wanted) AS m FROM u GROUP BY w
), bi AS (
  SELECT b, w, count(*) AS n, count(*) FILTER (WHERE wanted) AS m FROM u GROUP BY b, w
), t AS (
  SELECT (SELECT count(*) + 2 FROM uni) AS size, count(*) AS n, count(*) FILTER (WHERE wanted) AS m,
         count(*) FILTER (WHERE b IS NULL) AS n0, count(*) FILTER (WHERE b IS NULL AND wanted) AS m0 FROM u
), p AS (
  SELECT bi.b, bi.w,
         -ln((bi.m + 200.0::DOUBLE * (uni.m + 1) / (t.m + t.m0 + t.size)) / (CASE WHEN bi.b IS NULL THEN t.m0 ELSE c.m END + 200.0::DOUBLE)) AS lt,
         -ln((bi.n + 200.0::DOUBLE * (uni.n + 1) / (t.n + t.n0 + t.size)) / (CASE WHEN bi.b IS NULL THEN t.n0 ELSE c.n END + 200.0::DOUBLE)) AS lb
  FROM bi JOIN uni USING (w) LEFT JOIN uni c ON c.w = bi.b CROSS JOIN t
), s AS (
  SELECT r, count(*) AS n_tokens, avg(lt) AS lt, avg(lb) AS lb FROM u JOIN p ON u.w = p.w AND u.b IS NOT DISTINCT FROM p.b GROUP BY r
)
SELECT d.doc_id, coalesce(s.n_tokens, 0) AS n_tokens, round(lt, 6) + 0.0 AS loss_target, round(lb, 6) + 0.0 AS loss_background, round(lt - lb, 6) + 0.0 AS score
FROM d LEFT JOIN s USING (r)
"""
