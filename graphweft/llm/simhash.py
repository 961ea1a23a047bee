"""SimHash near-duplicates through pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, stored

BITS, SEED = 64, 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of text taken at a time; a longer text goes in runs that share their border shingles.
RUN = 1 << 20
#: A bucket of more fingerprints is compared in pairs of blocks of about so many.
BLOCK = 1024
#: Fingerprints that a worker gathers before it compares the buckets it has whole.
GATHER = 1 << 16
#: Segments of the ring and segments of the chain that is indexed, for up to so many different fingerprints.
LADDER = ((1 << 26, 9, 4), (1 << 31, 13, 6), (1 << 63, 13, 9))


def _runs(text: bytes, words: int) -> Iterator[list[bytes]]:
    if len(text) <= RUN:
        yield text.split()
        return
    at, carry = 0, []
    while at < len(text):
        end = at + RUN
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        carry += text[at:end].split()
        at = end
        if len(carry) >= words or at >= len(text):
            yield carry
            carry = carry[-(words - 1) :] if words > 1 else []


def fingerprint(text: str, words: int = 4) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes. No word: 0."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    short: list[bytes] = []
    hashed = xxhash.xxh64_intdigest
    for run in _runs(text.encode("utf-8", "surrogatepass").translate(LOWER), words):
        if len(run) < words:
            short = run
            continue
        joined = b" ".join(run)
        ends = list(accumulate(len(w) + 1 for w in run))
        h = np.fromiter((hashed(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1 :])), dtype=np.uint64, count=len(run) - words + 1)
        for lo in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[lo : lo + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    if not n and short:
        return hashed(b" ".join(short), SEED)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > n)) if n else 0


def majority(h: np.ndarray) -> int:
    """The SimHash of hashes: a bit is 1 if it is set in over half of them. No hash: 0."""
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[lo : lo + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(h)))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; 0 for a null text. Each row by itself; no rows: no rows."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(x.as_py() or "", words) for x in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def segments(m: int) -> list[int]:
    """The bits of each of m segments as a mask; sizes differ by one at most."""
    cuts = [i * BITS // m for i in range(m + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def chain_keys(m: int, length: int, limit: int) -> list[tuple[int, int, tuple[tuple[int, int], ...]]]:
    """(start, bits that must agree, ((bits of a chain's prefix, its budget), ...)).

    If two fingerprints differ in at most `limit` bits, some segment of the ring starts chains of which those of every
    length l have at most l * limit / m differences. Of the first `length` segments of such a chain, at most
    b = length * limit // m hold differences, and their places keep to the budgets of the prefixes; so leaving out b
    segments in each such way gives keys of which the pair shares at least one.
    """
    masks, budget = segments(m), [limit * k // m for k in range(m + 1)]
    b, out = budget[length], []
    for start in range(m):
        ring = [masks[(start + i) % m] for i in range(m)]
        prefixes = tuple((sum(ring[:k]), budget[k]) for k in range(1, m + 1) if k == m or budget[k] < budget[k + 1])
        for left_out in combinations(range(length), b):
            if all(sum(j < k for j in left_out) <= budget[k] for k in range(length + 1)):
                out.append((start, sum(ring[i] for i in range(length) if i not in left_out), prefixes))
    return out


def further(mask: int, limit: int) -> list[int]:
    """The bits outside a key in limit + 1 parts, each with the key: fingerprints that agree in the key and differ in at most
    `limit` bits agree in one of them."""
    rest = [1 << i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(rest[i * len(rest) // (limit + 1) : (i + 1) * len(rest) // (limit + 1)]) for i in range(limit + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fp: np.ndarray, key: np.ndarray, begins: np.ndarray, keys: list, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect what links connect inside each bucket: (fingerprint, fingerprint) with one link for all
    but the first of a connected set. begins: where each bucket begins; fingerprints of a bucket stand together."""
    n = len(fp)
    ends = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
    prefixes = [[(np.uint64(bits), most) for bits, most in p] for _, _, p in keys]
    key = key % len(keys)  # a part of a crowded bucket has its key's budgets
    root, active, lag = np.arange(n), np.arange(n), 1
    while len(active := active[active + lag < ends[active]]):
        diff = fp[active] ^ fp[active + lag]
        near = np.ones(len(active), dtype=bool)
        for k in np.unique(key[active]):
            at = np.flatnonzero(key[active] == k)
            for bits, most in prefixes[k]:
                at = at[np.bitwise_count(diff[at] & bits) <= most]
            keep = np.zeros(len(active), dtype=bool)
            keep[at] = True
            near &= keep | (key[active] != k)
        a = active[near]
        a = a[np.bitwise_count(fp[a] ^ fp[a + lag]) <= limit]
        while len(a := a[root[a] != root[a + lag]]):
            hi, lo = np.maximum(root[a], root[a + lag]), np.minimum(root[a], root[a + lag])
            np.minimum.at(root, hi, lo)
            while (root[root] != root).any():
                root = root[root]
        lag += 1
    own = np.flatnonzero(root != np.arange(n))
    return fp[own], fp[root[own]]


def _linker(keys: list, limit: int):
    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def compare(rows: np.ndarray, last: bool):
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:, :4] != rows[:-1, :4]).any(1)
            begins = np.flatnonzero(new)
            cut = len(rows) if last else begins[-1]
            rest, rows, begins = rows[cut:], rows[:cut], begins[begins < cut]
            a, b = _forest(rows[:, 4].view(np.uint64), rows[:, 0], begins, keys, limit) if len(rows) else (np.array([], np.uint64),) * 2
            a, b = np.maximum(a, b), np.minimum(a, b)
            both = np.unique(np.stack([a, b], 1), axis=0).view(np.int64)
            return rest, pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("k", "v", "i", "j", "fp")], 1).astype(np.int64, copy=False))
            size += batch.num_rows
            if size >= GATHER:
                rest, out = compare(np.ascontiguousarray(np.concatenate(held)), False)
                held, size = [rest], len(rest)
                yield out
        if size:
            yield compare(np.ascontiguousarray(np.concatenate(held)), True)[1]

    return run


def links(classes: DataFrame, limit: int = 4, segments_of: tuple[int, int] | None = None) -> DataFrame:
    """(a, b): pairs of fingerprints of `classes` (fp long, no two alike) that connect just what pairs with at most `limit`
    differing bits connect. Inside a bucket each fingerprint is paired with the first that such pairs lead to.

    Each fingerprint goes to a bucket for each key of chain_keys(); a bucket's members are compared with each other,
    by the budgets of the chain's prefixes and then by all bits. A bucket of over BLOCK members gives way to buckets of the
    key and a part of the other bits; one that is still as large is dealt out in blocks, each pair of blocks to a task of its
    own, so no task holds more than two blocks. Inside a bucket only links that connect something new are given. The ladder
    gives more key bits to more fingerprints, so buckets stay short.
    """
    n = classes.count()
    m, length = segments_of or next((m, k) for most, m, k in LADDER if n <= most)
    keys = chain_keys(m, length, limit)
    spread = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("v")) for i, (_, mask, _) in enumerate(keys)]))
    rows = classes.select("fp", spread.alias("e")).select("e.k", "e.v", "fp")
    crowded = lambda r: stored(r.groupBy("k", "v").count().where(F.col("count") > BLOCK), "simhash-large")
    zero, large = F.lit(0).cast("long"), crowded(rows)
    if not large.isEmpty():
        parts = [F.array(*[F.lit(_signed(x)) for x in further(mask, limit)]) for _, mask, _ in keys]
        own = F.element_at(F.array(*parts), (F.col("k") + 1).cast("int"))
        finer = rows.join(large.select("k", "v"), ["k", "v"]).select("k", "fp", F.posexplode(own).alias("part", "bits"))
        finer = finer.select((F.col("k") + len(keys) * (F.col("part") + 1)).alias("k"), F.col("fp").bitwiseAND(F.col("bits")).alias("v"), "fp")
        rows = stored(rows.join(large, ["k", "v"], "left_anti").unionByName(finer), "simhash-buckets")
        large = crowded(rows)
    if large.isEmpty():
        dealt = rows.select("k", "v", zero.alias("i"), zero.alias("j"), "fp")
    else:
        blocks = F.ceil(2 * F.col("count") / BLOCK)
        hot = rows.join(large, ["k", "v"]).withColumn("n", blocks).withColumn("i", F.pmod(F.xxhash64("fp", "k"), F.col("n")))
        hot = hot.withColumn("j", F.explode(F.sequence(zero, F.col("n") - 1)))
        hot = hot.select("k", "v", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")
        dealt = rows.join(large, ["k", "v"], "left_anti").select("k", "v", zero.alias("i"), zero.alias("j"), "fp").unionByName(hot)
    dealt = dealt.repartition(partitions(classes.sparkSession), "k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j")
    return dealt.mapInArrow(_linker(keys, limit), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, limit: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each document: fp is the SimHash of its shingles of `words` words (A-Z in lower
    case; repeats count; fewer words: the whole sequence; none, or a null text: 0), component_id the smallest doc_id
    that links of at most `limit` differing bits reach, through any number of documents.

    Documents with one fingerprint are one class, so copies are never expanded into pairs. Fingerprints are written
    before use. A null doc_id has its row too, but names no component unless all of a component's are null. Repeated
    rows and ties: each row has its own; no rows: no rows. Texts of any length count whole.
    """
    print_of = stored(fingerprints(docs, words), "simhash-fp")
    classes = stored(print_of.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    found = stored(links(classes.select("fp"), limit), "simhash-links")
    root = components(found, "simhash-components")
    named = stored(classes.join(root, classes["fp"] == root["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "simhash-rooted")
    least = stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-least")
    by_class = stored(named.select("fp", "component").join(least, "component").select(F.col("fp").alias("__fp"), "component_id"), "simhash-named")
    return print_of.join(by_class, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 4, limit: int = 4) -> DataFrame:
    """The rows of docs that stay when of each component only the document with the smallest doc_id does. All columns
    stay. Of repeated rows with one doc_id one stays; rows without a doc_id stay, as no result can name them."""
    kept = near_duplicates(docs, words, limit).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("__kept"), "left_semi")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        named = named.dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))


__all__ = ["chain_keys", "fingerprint", "fingerprints", "keep_one", "links", "near_duplicates", "segments"]
