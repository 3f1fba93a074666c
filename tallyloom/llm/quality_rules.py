"""Quality rules of documents, and verdicts on whole hosts.

Base rules look at a document alone. Soft rules (many symbols, many repeated lines,
odd word lengths) are too weak to reject by themselves; their failures are summed by
domain, each domain's failure rate is shrunk by a beta prior fitted to all domains'
rates (empirical Bayes, by moments), and a domain whose shrunk rate lies more than
``deviations`` of the prior's standard deviation above its mean, or above ``host_limit``,
gets a bad verdict. Joined back, that verdict rejects those documents of the domain that
fail a soft rule, which other domains' documents may; documents without a failure
always stay.

Defined results: a null or empty text has no words and fails the base rules; a null
domain is a domain of its own; a null id stays null; repeated rows are judged each
and count each; other columns pass through ``filter_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import give_back, join_hot, map_texts, slices
from tallyloom.session import cut, prepare

SYMBOLS = "#*$%&|<>"
WORD_BREAKS = str.maketrans("\t\n\x0b\x0c\r", "     ")
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: str) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+``: other Unicode blanks belong to words."""
    return [w for w in text.translate(WORD_BREAKS).split(" ") if w]


def repeated_words(words: list[str]) -> int:
    """Words inside windows of five that are found twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == n:
        return 0
    seen: dict[tuple, int] = {}
    twice = set()
    for w in windows:
        if w in seen:
            twice.add(w)
        seen[w] = 1
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def counts_of(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = words_of(text)
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        repeated_lines(text),
        repeated_words(words),
    )


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the five counts of every whole text."""
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.col(f"`{host_col}`").cast("string").alias("host"),
    )

    def each():
        def handle(batch: pa.RecordBatch) -> dict:
            found = [counts_of(t) for t in batch.column("text").to_pylist()]
            columns = {n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(COUNTS)}
            return columns | {"doc_id": batch.column("doc_id"), "host": batch.column("host")}

        return handle

    return map_texts(texts, each, "doc_id long, host string, " + ", ".join(f"{n} long" for n in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def soft_failed() -> Column:
    """A tenth of the words' characters as symbols, a third of lines repeated, or words of odd mean length."""
    words = F.col("n_words")
    return (
        (10 * F.col("n_symbols") > F.col("word_chars"))
        | (5 * F.col("n_dup_lines") > words)
        | (F.col("word_chars") > 20 * words)
        | (F.col("word_chars") < 2 * words)
    )


def host_verdicts(counts: DataFrame, host_limit: float = 0.5, deviations: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, bad: one row per domain.

    The beta prior is fitted by moments over domains, weighted by their documents.
    """
    failed = base_failed() | soft_failed()
    hosts = counts.groupBy("host").agg(
        F.count("*").alias("n_docs"), F.sum(F.when(failed, 1).otherwise(0)).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    weight = F.col("n_docs")
    fitted = hosts.agg(
        (F.sum("n_failed") / F.sum(weight)).alias("mean"),
        (F.sum(weight * rate * rate) / F.sum(weight)).alias("square"),
    ).select(
        "mean",
        F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)).alias("spread"),
    )
    # strength of the prior in documents: m (1 - m) / v - 1, within [1, 1000]
    strength = F.least(
        F.greatest(F.col("mean") * (1 - F.col("mean")) / F.greatest("spread", F.lit(1e-6)) - 1, F.lit(1.0)), F.lit(1000.0)
    )
    prior = fitted.select((F.col("mean") * strength).alias("a"), strength.alias("strength"), "mean")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    shrunk = (F.col("n_failed") + F.col("a")) / (F.col("n_docs") + F.col("strength"))
    bad = (F.col("shrunk_rate") > F.col("mean") + deviations * deviation) | (F.col("shrunk_rate") > host_limit)
    return (
        hosts.crossJoin(F.broadcast(prior))  # one row
        .withColumn("shrunk_rate", shrunk)
        .select("host", "n_docs", "n_failed", "shrunk_rate", bad.alias("bad"))
    )


def judge_documents(
    docs: DataFrame,
    *,
    host_limit: float = 0.5,
    deviations: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_broadcast: int = 100_000,
) -> DataFrame:
    """doc_id, host, the counts, base_failed, soft_failed, shrunk_rate and kept of every document."""
    prepare(docs.sparkSession)
    counts = cut(document_counts(docs, id_col, text_col, host_col))
    verdicts = cut(host_verdicts(counts, host_limit, deviations)).select(F.col("host").alias("__host"), "n_docs", "shrunk_rate", "bad")
    return (
        join_hot(counts, verdicts, "host", "__host", "n_docs", F.xxhash64("doc_id", "n_words"), max_broadcast=max_broadcast)
        .withColumn("base_failed", base_failed())
        .withColumn("soft_failed", soft_failed())
        .withColumn("kept", ~F.col("base_failed") & ~(F.col("bad") & F.col("soft_failed")))
        .select("doc_id", "host", *COUNTS, "base_failed", "soft_failed", "shrunk_rate", "kept")
    )


def filter_documents(
    docs: DataFrame,
    *,
    host_limit: float = 0.5,
    deviations: float = 0.5,
    text_col: str = "text",
    id_col: str = "doc_id",
    host_col: str = "source",
    max_broadcast: int = 100_000,
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Counts are taken twice rather than joined back by id, so no text is shuffled. Bad
    hosts are broadcast up to ``max_broadcast`` of them; past that they are joined, the
    hosts of many documents apart.
    """
    spark = prepare(docs.sparkSession)
    counts = document_counts(docs, id_col, text_col, host_col)
    bad = cut(host_verdicts(counts, host_limit, deviations).where("bad").select("host", F.col("n_docs").alias("__n")))
    few = bad.count() <= max_broadcast
    shared = spark.sparkContext.broadcast({r["host"] for r in bad.collect()} if few else None)
    source = docs
    if not few:
        marks = bad.select(F.col("host").alias("__host"), "__n", F.lit(True).alias("__bad"))
        source = join_hot(docs, marks, host_col, "__host", "__n", F.xxhash64(F.col(f"`{text_col}`")), max_broadcast=max_broadcast)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                hosts = piece.column(host_col).to_pylist()
                if few:
                    marked = [h in shared.value for h in hosts]
                else:
                    marked = piece.column("__bad").to_pylist()
                    piece = piece.drop_columns(["__bad"])
                texts = piece.column(text_col).to_pylist()
                stay = [keeps(counts_of(t or ""), bool(m)) for t, m in zip(texts, marked, strict=True)]
                yield piece.filter(pa.array(stay, pa.bool_()))
        give_back()

    return source.mapInArrow(keep, docs.schema)


def keeps(counts: tuple[int, int, int, int, int], bad_host: bool) -> bool:
    """The same rules as ``base_failed`` and ``soft_failed``, for one document."""
    n, chars, symbols, lines, repeats = counts
    if n < 10 or 100 * repeats > 20 * n:
        return False
    soft = 10 * symbols > chars or 5 * lines > n or chars > 20 * n or chars < 2 * n
    return not (bad_host and soft)


#: The query's SQL: the same counts, rules and shrinkage.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, source, t, regexp_extract_all(t, '[^ \t-\r]+') AS ws FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c
  FROM (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w))
), rep AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM win, (VALUES (0), (1), (2), (3), (4)) v(o) WHERE c > 1 GROUP BY doc_id
), lin AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY doc_id
), c AS (
  SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(lin.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lin USING (doc_id) LEFT JOIN rep USING (doc_id)
), j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         10 * n_symbols > word_chars OR 5 * n_dup_lines > n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words AS soft FROM c
), h AS (
  SELECT source, count(*) AS n, CAST(count(*) FILTER (WHERE base_failed OR soft) AS DOUBLE) AS f FROM j GROUP BY source
), m AS (
  SELECT sum(f) / sum(n) AS mean, greatest(sum(n * (f / n) * (f / n)) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)), 0) AS spread FROM h
), p AS (
  SELECT mean, least(greatest(mean * (1 - mean) / greatest(spread, 1e-6) - 1, 1.0), 1000.0) AS s FROM m
), b AS (
  SELECT source, (f + mean * s) / (n + s) > mean + 0.5 * sqrt(mean * (1 - mean) / (s + 1)) OR (f + mean * s) / (n + s) > 0.5 AS bad FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (bad AND soft) AS kept
FROM j LEFT JOIN b ON j.source IS NOT DISTINCT FROM b.source
"""
