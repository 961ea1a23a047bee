"""Bulk-synchronous best-fit packing of token sequences."""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ordered, stored

#: Characters on whose classes all versions of Unicode agree; a text of others goes through the slower library.
SETTLED = re.compile(r"[^\x20-\x7e\t\n\r¡-ɏ‐-‧‰-⁞]")


@functools.lru_cache(2)
def _encoder(path: str):
    """Text to ids, as the tokenizers library gives them. tiktoken runs the same merges several times as fast where
    the file is a byte-level BPE of the usual pattern, the text holds no special string and only SETTLED characters."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def slow(text: str) -> np.ndarray:
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    vocab, added = spec["model"]["vocab"], [x["content"] for x in spec["added_tokens"]]
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec["model"].get("ignore_merges"):
        return slow
    # bytes stand for themselves where they print; the others, in order, for the characters from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in vocab.items() if word not in added}
    import public_tokenizers

    fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if SETTLED.search(text) or any(x in text for x in added):
            return slow(text)
        return np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and the end id. A longer document is cut into
    pieces of `capacity` ids, of which only the first may be shorter. Null text counts as empty."""

    def run(batches):
        encode, end = _encoder(tokenizer), np.array([end_id], dtype="<u4")
        for batch in batches:
            out = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.concatenate([encode(text.as_py() or ""), end]).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                out += [(key, i, lo, hi - lo, zlib.crc32(ids[lo:hi])) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where the documents of each length go: rows (length, from rank, to rank, first sequence, offset).

    Rounds run over the lengths from the longest down. In a round all documents of the length are matched at once: a
    sweep gives the next of them, by rank, to the sequences of the smallest gap that holds them, by rank, each as many as
    fit; where there are more documents than that, the rest go on to the next gap, and at last to new sequences. Then the
    gaps are updated. So each document stands where best fit, longest first, puts it when it takes them one by one.
    Sequences that have the same gap are kept as runs of consecutive numbers, so the table has as many rows as lengths and
    gaps meet, which `capacity` bounds, however many documents there are.
    """
    gaps: dict[int, deque] = {}  # gap: runs (first sequence, how many)
    order: list[int] = []  # the gaps that have runs, sorted
    made, plan = 0, []

    def put(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = deque()
                bisect.insort(order, gap)
            gaps[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while rank < count:
            k = bisect.bisect_left(order, length)
            gap = order[k] if k < len(order) else capacity
            each = gap // length
            if k == len(order):
                first, many = made, -(-(count - rank) // each)
                made += many
            else:
                first, many = gaps[gap].popleft()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(k)
            full, rest = divmod(min(count - rank, many * each), each)
            for at, sequences, documents in ((first, full, each), (first + full, 1, rest)):
                if sequences and documents:
                    for j in range(documents):
                        plan.append((length, rank, rank + sequences, at, capacity - gap + j * length))
                        rank += sequences
                    put(gap - documents * length, at, sequences)
            used = full + (rest > 0)
            if used < many:
                put(gap, first + used, many - used)
    return plan


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document.

    Pieces are range-sorted by length and ranked inside their length by prefix sums over the sorted partitions.
    best_fit() sweeps lengths against gaps, which it keeps as sorted runs, in one loop on the driver: it sees at most
    `capacity` counts, one for each length, and is exact as only lengths decide. Each piece then finds its place from its rank, in one join with the table of runs, whose size `capacity` bounds (at most some 2 * capacity^2
    rows of 40 bytes; a few thousand in practice). Pieces are written before, so texts are encoded once.
    Null and empty texts are packed as their end id alone; repeated rows and keys are packed each by itself, in the order of
    their pieces' digests; null keys come first; no rows: no rows. Columns but doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = spark.createDataFrame(best_fit(counts, capacity), "__length long, __from long, __to long, __first long, offset long")
    ranked = ordered(cut, "piece-ranks", ["doc_id", "piece", "start", "ids_crc32"], "length", {"__rank": F.lit(1)})
    at = F.col("__rank") - 1
    return (
        ranked.join(F.broadcast(plan), (F.col("length") == F.col("__length")) & (at >= F.col("__from")) & (at < F.col("__to")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__first") + at - F.col("__from")).alias("sequence_id"), "offset")
    )
