"""Token counts by a two-tier look-up on the map side; no pre-token is shuffled.

Tier one is a compact table of the corpus's frequent pre-tokens and their numbers of
tokens, broadcast: the ``frequent`` most common ones of a sample of at most ``sample``
documents (those of the smallest id hashes), counted there. Tier two is a cache per
Python worker: a miss is encoded by the library and remembered, up to a fixed number
of entries. The sample decides what is fast, never a count.

Every text is cut into pre-tokens and looked up. Special strings are cut out first, as
the library does, and are one token each. Texts with code points below 0x250 are split
by the tokenizer's own pattern with its classes spelt out; there NFC changes nothing
and lower-casing is one to one. Others are normalised and split by the library's own
normaliser and splitter, a stretch of lines at a time.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null id stays
null; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter as Tally
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm.bpe import NARROW, splitter
from tallyloom.llm.common import id_and_text, map_texts, slices
from tallyloom.session import cut, prepare

class Counts(dict):
    """Pre-token -> number of tokens; both tiers, of which only the second grows."""

    def __init__(self, frequent: dict[str, int], tokenizer: Tokenizer, most: int, longest: int = 64):
        super().__init__(frequent)
        self.frequent, self.tokenizer, self.most, self.longest = frequent, tokenizer, most + len(frequent), longest
        self.misses = 0

    def __missing__(self, piece: str) -> int:
        self.misses += 1
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


#: Characters that the library normalises at once, if there is a line end to cut at.
STRETCH = 1 << 16


class Counter:
    """Counts tokens as the library does."""

    def __init__(self, content: str, frequent: dict[str, int], cache: int):
        self.tokenizer = bare(content)
        spec = json.loads(content)
        added = spec.get("added_tokens", [])
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("token counts need special strings that match as they are")
        longest_first = sorted((t["content"] for t in added), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, longest_first)) or r"(?!)")
        self.find = splitter(pattern_of(spec))
        self.beyond = re.compile(f"[^\\u0000-\\u{NARROW - 1:04x}]").search
        self.counts = Counts(frequent, self.tokenizer, cache)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text without special strings, in lists."""
        if not self.beyond(text):
            yield self.find(text.lower())
            return
        normalise, split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        at = 0
        while at < len(text):
            # white space ends a pre-token and a line end composes with nothing
            end = len(text) if len(text) - at <= STRETCH else text.find("\n", at + STRETCH) + 1 or len(text)
            normal = normalise(text[at:end])
            yield [normal[a:b] for _, (a, b) in split(normal)]
            at = end

    def count(self, text: str) -> int:
        n, at, get = 0, 0, self.counts.__getitem__
        for special in self.specials.finditer(text):
            n += 1 + self.plain(text[at : special.start()], get)
            at = special.end()
        return n + self.plain(text[at:] if at else text, get)

    def plain(self, text: str, get) -> int:
        return sum(sum(map(get, own)) for own in self.pieces(text)) if text else 0


def bare(content: str) -> Tokenizer:
    """The tokenizer without truncation and padding."""
    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pattern_of(spec: dict) -> str:
    """The split pattern; raises for a pipeline that this operator doesn't know."""
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        raise ValueError("token counts need NFC, white space and lower case, then one split pattern")
    return steps[0]["pattern"]["Regex"]


def frequent_lengths(texts: DataFrame, content: str, frequent: int, sample: int, longest: int = 64) -> dict[str, int]:
    """Tier one: the most common pre-tokens of the sampled documents and their numbers of tokens."""
    chosen = texts.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    sampled = cut(texts.join(F.broadcast(chosen), "doc_id").select("text")).coalesce(4)  # ``sample`` ids at most

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(content, {}, 1)
        seen: Tally = Tally()
        for batch in batches:
            for piece in slices(batch):
                for text in piece.column("text").to_pylist():
                    for stretch in counter.specials.split(text):
                        for own in counter.pieces(stretch):
                            seen.update(own)
        most = sorted((w for w in seen if len(w) <= longest), key=lambda w: (-seen[w], w))[: 2 * frequent]
        yield pa.RecordBatch.from_arrays([pa.array(most, pa.string()), pa.array([seen[w] for w in most], pa.int64())], names=["piece", "n"])

    found: Tally = Tally()
    for row in sampled.mapInArrow(tally, "piece string, n long").collect():  # 8 x ``frequent`` rows at most
        found[row["piece"]] += row["n"]
    words = sorted(found, key=lambda w: (-found[w], w))[:frequent]
    encoded = bare(content).encode_batch(words, add_special_tokens=False)
    return {w: len(e.ids) for w, e in zip(words, encoded, strict=True)}


_counters: dict[tuple, Counter] = {}


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    *,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    cache: int = 700_000,
    frequent: int = 32_768,
    sample: int = 2_000,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text."""
    with open(vocabulary, encoding="utf-8") as file:
        content = file.read()
    prepare(docs.sparkSession)
    table = frequent_lengths(id_and_text(docs, id_col, text_col), content, frequent, sample)
    shared = docs.sparkSession.sparkContext.broadcast((content, table))
    key = (vocabulary, cache, hash(frozenset(table.items())))

    def each():
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(*shared.value, cache)
        count = _counters[key].count

        def handle(batch: pa.RecordBatch) -> dict:
            counted = [count(t) for t in batch.column("text").to_pylist()]
            return {
                "doc_id": batch.column("doc_id"),
                "n_bytes": batch.column("n_bytes"),
                "n_tokens": pa.array(counted, pa.int64()),
            }

        return handle

    texts = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = map_texts(texts, each, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
