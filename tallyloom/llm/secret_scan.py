"""Secret scans: fixed patterns, and dictionary-primed compression novelty.

Patterns find assignments, access keys and hex digests. The method adds spans: every
string of 16 or more key characters, whatever they are, in a sensitive context is
compressed behind its surrounding text by zstandard primed with a dictionary of
identifiers. The marginal bytes, compressed size with the candidate less that without
it, are small for words and identifiers that the context or the dictionary knows and
large for random material. A context is sensitive

* within ``REACH`` behind a word such as ``credential``, or inside a base span: strings
  that cost ``novelty`` bytes a character are reported as ``novel``;
* right behind an assignment or an opening quote, whatever the name: there it takes
  ``bare_novelty``, since names and paths stand there too.

So a base span whose value is ``novel`` too is likely a secret, and one whose value the
text itself repeats, a name or a placeholder.

The dictionary holds the corpus's own identifiers (names before an assignment, a call,
a key or a member, with an underscore, a digit or a capital inside, counted by
documents over the whole corpus) behind a few code words. Of the counts only those of
the most frequent, ``most_identifiers`` at most, come to the driver.

Defined results: a null or empty text has no spans; offsets count code points, end
exclusive; a null id stays null; repeated rows are scanned each; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import give_back, id_and_text, map_texts, slices
from tallyloom.session import cut, prepare

KINDS = ("assign", "access", "hex", "novel")
# The patterns and least lengths of the three base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs, since the class is greedy
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: Words that make the following text sensitive.
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "credential", "private", "bearer", "authorization", "access_key", "signing", "webhook")
CONTEXT = re.compile("|".join(SENSITIVE), re.I | re.A)
LEAST_CANDIDATE = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_CANDIDATE},}}={{0,2}}")
REACH, AROUND = 96, 256
#: What stands right before a value: an assignment or an opening quote.
ASSIGNED = re.compile(r"""(?:[:=]\s?["'`]?|["'`])\Z""")
#: Names of code: before an assignment, a key's colon, a call, an index or a member, or with an inner mark.
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,39}(?=\s?[=:(\[]|\.\w)|[A-Za-z]+(?:_[A-Za-z0-9]+)+|[a-z]+(?:[A-Z][a-z0-9]+)+")
#: Code words that prime the compressor, also where the corpus has no identifiers.
IDENTIFIERS = (
    "password passwd secret token api_key apiKey access_key credential private_key public_key client_id client_secret "
    "authorization Bearer signing webhook username account session cookie header request response config settings "
    "environment variable getenv process.env export default return function class import include public static void "
    "string value index length buffer result error message handler service controller repository transaction "
    "connection database localhost https:// http:// .com .org .json .yaml .properties true false null none example "
    "placeholder changeme your_token_here insert_secret_here xxxxxxxxxxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 aaaaaaaa _test_ _prod_ _dev_ _key_ _id_ -----BEGIN PRIVATE KEY-----"
)


class Novelty:
    """Marginal compressed bytes of a candidate behind its context."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=9)
        self.compress = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False).compress

    def marginal(self, context: str, candidate: str) -> int:
        plain = context.encode("utf-8")
        return len(self.compress(plain + candidate.encode("utf-8"))) - len(self.compress(plain))


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, in order."""
    spans = []
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def novel_spans(text: str, low: str, base: list[tuple[int, int, int]], judge: Novelty, novelty: float, bare_novelty: float | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of incompressible strings in sensitive context."""
    reaches = [w.end() for w in CONTEXT.finditer(text)] if any(w in low for w in SENSITIVE) else []
    found, word, span = [], 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while word < len(reaches) and reaches[word] + LEAST_CANDIDATE <= end:
            word += 1
        first = max(start, reaches[word - 1]) if word else start  # a sensitive word within the run is not of the string
        while span < len(base) and base[span][2] <= start:
            span += 1
        least = None
        if word and first - reaches[word - 1] < REACH or span < len(base) and base[span][0] < end:
            least = novelty
        elif bare_novelty is not None and ASSIGNED.search(text, max(0, start - 3), start):
            least = bare_novelty
        if least is None:
            continue
        candidate = text[first:end]
        context = text[max(0, first - AROUND) : first] + text[end : end + AROUND] + " "
        if judge.marginal(context, candidate) >= least * len(candidate):
            found.append((first, 3, end))
    return found


def corpus_identifiers(texts: DataFrame, most: int) -> str:
    """The identifiers found in most documents, rarest first (what stands last is nearest to the compressor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64())], names=["name", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for piece in slices(batch):
                for text in piece.column("text").to_pylist():
                    seen.update(set(IDENTIFIER.findall(text)))
                if len(seen) > 200_000:
                    yield rows()
        yield rows()
        give_back()

    counted = texts.mapInArrow(run, "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))
    counted = cut(counted.where("n > 1").withColumn("size", F.floor(F.log2("n")).cast("int")))
    sizes = {r["size"]: r["count"] for r in counted.groupBy("size").count().collect()}  # 64 rows at most
    taken, least = 0, None
    for size in sorted(sizes, reverse=True):  # whole classes of counts, so that no task sends more than stays
        if taken + sizes[size] > most:
            break
        taken, least = taken + sizes[size], size
    if least is None:
        return ""
    names = counted.where(F.col("size") >= least).select("n", "name").collect()
    return " ".join(r["name"] for r in sorted(names, key=lambda r: (r["n"], r["name"])))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, *, novelty: float = 0.6, bare_novelty: float = 0.75, most_identifiers: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_spans, spans of every whole text.

    Spans are ``kind:start:end`` by start, then kind as listed, comma-joined.
    """
    prepare(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    identifiers = f"{corpus_identifiers(texts.select('text'), most_identifiers)} {IDENTIFIERS}"

    def each():
        judge = Novelty(identifiers)

        def handle(batch: pa.RecordBatch) -> dict:
            rows = []
            for text in batch.column("text").to_pylist():
                low = text.lower()
                base = base_spans(text, low)
                more = novel_spans(text, low, base, judge, novelty, bare_novelty)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more), joined(base), joined(sorted(base + more))))
            counts = ("n_assign", "n_access", "n_hex", "n_novel")
            columns = {n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(counts)}
            columns |= {n: pa.array([r[4 + i] for r in rows], pa.string()) for i, n in enumerate(("base_spans", "spans"))}
            return columns | {"doc_id": batch.column("doc_id")}

        return handle

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_spans string, spans string"
    return map_texts(texts, each, schema)
