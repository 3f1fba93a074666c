"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

Each pre-token is an array of byte positions. A segment tree over the positions
keeps the leftmost minimum of the ranks of neighbouring pairs, so a merge reads
the root and updates at most three leaves, each in a logarithmic number of steps;
a pre-token of n bytes costs O(n log n) however long it is.

Defined results: a null or empty text gives no ids and decodes to empty bytes; a
null id stays null; repeated rows are encoded each; other columns are ignored. A
vocabulary without all 256 bytes is an error.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyloom.llm.common import id_and_text, map_texts

NO_RANK = 1 << 40
SHIFT = 32
MASK = (1 << SHIFT) - 1
NOTHING = NO_RANK << SHIFT


def load_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: lines of base64 bytes and a number."""
    ranks = {}
    for line in content.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    get = ranks.get
    leaves = [NOTHING] * size
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            leaves[i] = rank << SHIFT | i
    # tree[1] is the root; the children of tree[i] are tree[2 * i] and tree[2 * i + 1]
    levels = [leaves]
    while len(leaves) > 1:
        leaves = list(map(min, leaves[::2], leaves[1::2]))
        levels.append(leaves)
    tree = [NOTHING]
    for level in reversed(levels):
        tree += level
    # part i spans piece[i:after[i]]; before[i] is the live part to its left
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    while (low := tree[1]) < NOTHING:
        i = low & MASK
        j = after[i]
        end = after[i] = after[j]
        before[end] = i
        if j < n - 1:
            _set(tree, size + j, NOTHING)
        rank = get(piece[i : after[end]]) if end < n else None
        _set(tree, size + i, NOTHING if rank is None else rank << SHIFT | i)
        left = before[i]
        if left >= 0:
            rank = get(piece[left:end])
            _set(tree, size + left, NOTHING if rank is None else rank << SHIFT | left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def _set(tree: list[int], at: int, value: int) -> None:
    """Point update: change a leaf and the minima above it, as far as they change."""
    if tree[at] == value:
        return
    tree[at] = value
    while at > 1:
        other = tree[at ^ 1]
        if other < value:
            value = other
        at >>= 1
        if tree[at] == value:
            return
        tree[at] = value


class PieceCache(dict):
    """Pre-token -> its ids as packed little-endian 32-bit integers; misses are encoded."""

    def __init__(self, ranks: dict[bytes, int], most: int, longest: int = 64):
        super().__init__()
        self.ranks, self.most, self.longest = ranks, most, longest

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(merge_piece(piece.encode("utf-8"), self.ranks), dtype="<u4").tobytes()
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = packed
        return packed


#: Texts of code points below this are split by the faster ``re`` with the classes spelt out.
NARROW = 0x250


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pattern that uses ``\\p{L}``, ``\\p{N}`` and ``\\s``; equal on every text."""
    wide = regex.compile(pattern).findall

    def members(kind: str) -> str:
        return "".join(f"\\u{c:04x}" for c in range(NARROW) if regex.match(kind, chr(c)))

    letters, numbers, spaces = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    spelt = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    for kind, own in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]")):
        spelt = spelt.replace(f"[{kind}]", own).replace(kind, own)
    spelt = spelt.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")
    narrow = re.compile(spelt).findall
    beyond = re.compile(f"[^\\u0000-\\u{NARROW - 1:04x}]").search
    return lambda text: wide(text) if beyond(text) else narrow(text)


class Codec:
    """Encoder and decoder of one vocabulary; one per Python worker."""

    def __init__(self, content: bytes, pattern: str, cache: int):
        self.ranks = load_ranks(content)
        if lacking := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks the bytes {lacking[:8]}")
        self.find = splitter(pattern)
        self.cache = PieceCache(self.ranks, cache)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[tuple, Codec] = {}


def codec(key: tuple, content: bytes, pattern: str, cache: int) -> Codec:
    """The worker's codec, kept from task to task."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(content, pattern, cache)
    return _codecs[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_bpe(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    *,
    decoded: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    cache: int = 700_000,
) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit integers) of every text.

    ``vocabulary`` is the path of a rank file on the driver; its content, a few
    hundred kB, is broadcast. ``decoded`` adds the bytes that the ids stand for.
    ``cache`` bounds the pre-tokens that a worker remembers.
    """
    context = docs.sparkSession.sparkContext
    content = context.broadcast(read_vocabulary(vocabulary))
    key = (vocabulary, pattern, cache)

    def each():
        own = codec(key, content.value, pattern, cache)

        def handle(batch: pa.RecordBatch) -> dict:
            packed = [own.encode(t) for t in batch.column("text").to_pylist()]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                "ids": pa.array(packed, pa.binary()),
            }
            if decoded:
                columns["decoded"] = pa.array(map(own.decode, packed), pa.binary())
            return columns

        return handle

    schema = "doc_id long, n_tokens long, ids binary" + (", decoded binary" if decoded else "")
    return map_texts(id_and_text(docs, id_col, text_col), each, schema)


def decode_bpe(encoded: DataFrame, vocabulary: str, pattern: str, *, cache: int = 700_000) -> DataFrame:
    """doc_id and text of rows of ``encode_bpe``; bytes that are no UTF-8 become U+FFFD."""
    content = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    key = (vocabulary, pattern, cache)

    def each():
        own = codec(key, content.value, pattern, cache)

        def handle(batch: pa.RecordBatch) -> dict:
            texts = [own.decode(p or b"").decode("utf-8", "replace") for p in batch.column("ids").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())}

        return handle

    return map_texts(encoded.select("doc_id", "ids"), each, "doc_id long, text string")


def ids_of(packed: Iterable[int] | bytes) -> list[int]:
    """The ids of a packed column value."""
    values = np.frombuffer(bytes(packed), dtype="<u4")
    return (values.byteswap() if sys.byteorder == "big" else values).tolist()
