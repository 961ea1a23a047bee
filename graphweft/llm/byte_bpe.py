"""Byte-level BPE: encoding and decoding as a reduction over a tree of text halves."""

from __future__ import annotations

import base64
import functools
import hashlib
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A text of at most so many characters is a leaf of the tree.
LEAF = 1 << 14
#: A match that starts so near the end of the text may change with what follows: the longest literal of the one pattern that
#: the tree is proved for, the public tokenizers' own.
AHEAD = 3
#: Pieces remembered by a worker, and the longest one remembered.
MEMO, LONGEST = 1 << 18, 40


class Codec:
    """Encodes by the ranks of a file, each match of `pattern` by itself; decodes ids.

    A node of the tree is the list of the matches in its part of the text. A leaf is matched directly. To join two
    neighbours, the matches of the left one that what follows could change (those that reach its end, or start within
    AHEAD characters of it) are matched again together with a growing number of the right one's first matches, until a
    match that the window's end can't change ends where a match of the right one ends. From there on the pattern, which
    never looks back, must go on as it did in the right half; so the matches outside of the window are final.
    """

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        if pattern != public_tokenizers.PATTERN:
            raise ValueError("how far this pattern looks ahead is not known")
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.leaf = regex.compile(pattern), leaf
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.memo: dict[str, tuple[int, ...]] = {}

    def _matches(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _join(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left or right
        again, n = "", len(left)
        while n and (n == len(left) or len(again) < AHEAD):
            n -= 1
            again = left[n] + again
        ends, at = {}, len(again)
        take, size = 0, at
        while take < len(right):
            more = max(4, take)
            for piece in right[take : take + more]:
                take += 1
                size += len(piece)
                ends[size] = take
            window = again + "".join(right[:take])
            found, start = self._matches(window), 0
            for i, piece in enumerate(found):
                end = start + len(piece)
                if end >= size or start + AHEAD > size:
                    break
                if end in ends:
                    return left[:n] + found[: i + 1] + right[ends[end] :]
                start = end
        return left[:n] + self._matches(again + "".join(right))

    def pieces(self, text: str) -> list[str]:
        if len(text) <= self.leaf:
            return self._matches(text)
        parts = [self._matches(text[i : i + self.leaf]) for i in range(0, len(text), self.leaf)]
        while len(parts) > 1:
            parts = [self._join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.bpe._core_bpe.encode_single_piece(piece.encode("utf-8")))
        if len(piece) <= LONGEST:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        memo, own = self.memo, self._piece
        return list(chain.from_iterable([memo.get(p) or own(p) for p in self.pieces(text)]))

    def decode(self, ids: list[int]) -> bytes:
        """Leaves of ids are looked up and joined; the tree above only concatenates, so any split gives the same."""
        look = self.bytes_of.__getitem__
        parts = [b"".join(map(look, ids[i : i + self.leaf])) for i in range(0, len(ids), self.leaf)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


@functools.lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


@functools.lru_cache(1)
def _decimal(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for each row of docs. Null and empty text: an empty array. Texts are encoded whole; rows are
    independent, so a lost task is just run again. Other columns are left out."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for lo in range(0, len(texts), 256):
                ids = pa.array([own.encode(x or "") for x in texts[lo : lo + 256]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("__key").slice(lo, 256), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes binary) for each row of ids. Null ids: no bytes."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = pa.array([own.decode(x or []) for x in batch.column("__ids").slice(lo, 256).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("__key").slice(lo, 256), out], names=[key, "bytes"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("__key"), F.col(ids).alias("__ids")).mapInArrow(run, f"`{key}` {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of what encode() gives and of what decode() makes of it,
    in one pass that moves neither ids nor bytes. Null text counts as empty."""

    def run(batches):
        own = codec(path, pattern)
        decimal = _decimal(max(own.bytes_of) + 1).__getitem__
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column("__text"):
                ids = own.encode(x.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
