"""SimHash near-duplicates with an exact check of word shingles: the SimHash operator's links, checked by Jaccard similarity, and
after them whatever pairs of that similarity differ in too many bits, through prefixes that two such sets must share."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, few, forget, stored
from .simhash import LOWER, SEED

#: Texts whose shingles are counted to tell frequent ones, how often one must occur there, and how many are told at most.
#: They only settle the order of shingles; no pair depends on them.
SAMPLE, OFTEN, TOLD = 8000, 3, 1 << 18
#: Rounds in which a bucket's members are compared with one of them alone, before all pairs that are left, and how many
#: different ones buckets of the same members choose.
STARS, SPOKES = 1, 4
#: Bits of a set's parities: in how many two sets differ is at most the number of shingles that only one of them has.
PARITIES = 512
#: A pair is left out of a bucket if it has met in one of so many buckets before.
BEFORE = 16
#: Places of the filter that shingles of one set alone are left out by. It only saves moving them: what shares a place with a
#: shingle of two sets passes, and beyond some 10^7 of those most do.
PLACES = 1 << 25
#: Rounds in which only the pairs that look most alike from each class are compared, as long as there are over twice as many.
NEAREST = 4
#: A bucket of more members is compared in blocks of about so many.
BLOCK = 1024


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the different runs of `words` words (A-Z in lower case; fewer words: the whole sequence)."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in range(max(1, len(w) - words + 1))], dtype=np.uint64))


def parities(h: np.ndarray, m: int) -> bytes:
    """m parities of a set, m a power of two: bit i is whether an odd number of its hashes leave i. Halves of them XORed are
    the parities of m / 2."""
    return np.packbits((np.bincount((h % np.uint64(m)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """In how many parities two sets differ, over as many as the shorter has: at least so many shingles are in one of them only."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _classed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, cls, fp, n, bits, sketch, text): texts with one set of n shingles have one cls; fp is the SimHash of the set, bits
    has PARITIES parities of it, sketch at least n and PARITIES."""

    def run(batches):
        for batch in batches:
            cls, fp, n, bits, sketch = [], [], [], [], []
            for x in batch.column("text"):
                h = shingles(x.as_py(), words)
                cls.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                fp.append(simhash.majority(h))
                n.append(len(h))
                bits.append(np.frombuffer(parities(h, PARITIES), np.int64).tolist())
                sketch.append(parities(h, max(PARITIES, 1 << max(0, len(h) - 1).bit_length())))
            whole = [pa.array(np.array(v, dtype=np.uint64).view(np.int64), pa.int64()) for v in (cls, fp)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *whole, pa.array(n, pa.int32()), pa.array(bits, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), batch.column("text")], names=["doc_id", "cls", "fp", "n", "bits", "sketch", "text"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, cls long, fp long, n int, bits array<long>, sketch binary, text string")


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that are frequent in a sample, sorted, and their counts."""

    def run(batches):
        for batch in batches:
            h = [shingles(x.as_py(), words) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *h]).view(np.int64), pa.int64())], names=["h"])

    step = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("cls"), F.lit(step)) == 0).select("text")
    told = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(TOLD).toPandas()
    h, n = told["h"].to_numpy(np.int64).view(np.uint64), told["count"].to_numpy(np.int64)
    by = np.argsort(h)
    return h[by], n[by]


def _places(shared: DataFrame) -> np.ndarray:
    """A bit for each place that a shingle of `shared` (k) has, as 64-bit words; PLACES / 64 rows at most reach the driver."""
    at = F.pmod("k", F.lit(PLACES))
    words = shared.groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(k, {PLACES}) & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(PLACES // 64, dtype=np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def _prefixes(texts: DataFrame, words: int, least: Fraction, frequent: tuple[np.ndarray, np.ndarray], places: np.ndarray | None = None) -> DataFrame:
    """(k, cls, n, at): the first shingles k of each set of n, at their places in an order that begins with rare ones. Two
    sets of enough similarity share one of them. places: only shingles that have one of them."""
    shared = texts.sparkSession.sparkContext.broadcast((*frequent, places))

    def run(batches):
        often, counts, known = shared.value
        for batch in batches:
            k, cls, n, at = [np.zeros(0, np.uint64)], [], [], []
            for c, text in {c: x for c, x in zip(batch.column("cls").to_pylist(), batch.column("text"))}.items():
                h = shingles(text.as_py(), words)
                if not len(h):
                    continue
                place = np.minimum(np.searchsorted(often, h), max(0, len(often) - 1))
                rank = np.where(often[place] == h, counts[place], 0) if len(often) else np.zeros(len(h), np.int64)
                size = len(h) - -(-least.numerator * len(h) // least.denominator) + 1
                first, place = h[np.lexsort((h, rank))[:size]], np.arange(size)
                if known is not None:
                    spot = first.view(np.int64) % PLACES  # not negative, as Spark's pmod
                    kept = (known[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) != 0
                    first, place = first[kept], place[kept]
                k.append(first)
                cls += [c] * len(first)
                n += [len(h)] * len(first)
                at += place.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k).view(np.int64), pa.int64()), pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(at, pa.int32())], names=["k", "cls", "n", "at"])

    return texts.select("cls", "text").mapInArrow(run, "k long, cls long, n int, at int")


def _may(x: str, y: str, least: Fraction) -> Column:
    """Whether sets x and y can be similar enough: by their sizes, and by what follows their shared shingle, which is the
    first that they share in one bucket of each such pair."""
    nx, ny = F.col(f"{x}.n").cast("long"), F.col(f"{y}.n").cast("long")
    most = F.least(nx - F.col(f"{x}.at"), ny - F.col(f"{y}.at"))
    return (F.least(nx, ny) * least.denominator >= F.greatest(nx, ny) * least.numerator) & (most * (least.numerator + least.denominator) >= (nx + ny) * least.numerator)


def _may_by_bits(x: str, y: str, least: Fraction) -> Column:
    """Whether sets x and y can be similar enough by their parities."""
    apart = sum(F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(PARITIES // 64))
    return apart * (least.numerator + least.denominator) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (least.denominator - least.numerator)


def _verified(texts: DataFrame, pairs: DataFrame, words: int, least: Fraction) -> DataFrame:
    """The pairs (a, b), a stored table that goes, of classes whose sets are similar enough. Only the texts of classes that stand in a pair are moved:
    the classes are sent to the tasks where few() bounds them, else both sides are dealt out."""

    def sets(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array([shingles(x.as_py(), words).tobytes() for x in part.column("text")], pa.binary())], names=["cls", "h"])

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both * least.denominator >= (len(x) + len(y) - both) * least.numerator)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    apart = stored(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "jaccard-ends")
    ends = few(apart)
    one = texts.select("cls", "text").join(ends, "cls", "left_semi").groupBy("cls").agg(F.first("text").alias("text"))
    held = stored(one.mapInArrow(sets, "cls long, h binary"), "jaccard-sets")
    both = pairs.join(held.select(F.col("cls").alias("a"), F.col("h").alias("x")), "a").join(held.select(F.col("cls").alias("b"), F.col("h").alias("y")), "b")
    good = stored(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "jaccard-links")
    forget(held, apart, pairs)
    return good


def _likely(classes: DataFrame, pairs: DataFrame, least: Fraction) -> DataFrame:
    """(a, b, far): the pairs (a, b) of classes whose sizes and sketches don't forbid enough similarity, and what share of their
    shingles at least is in one of them only. A sketch has about a bit for each shingle, a 64th of the set, and leaves out nearly
    all pairs of unlike sets however long they are."""

    def check(batches):
        for batch in batches:
            far, good = [], []
            for nx, ny, x, y in zip(*(batch.column(c).to_pylist() for c in ("nx", "ny", "x", "y"))):
                apart = differing(x, y)
                far.append(apart / max(1, nx + ny))
                good.append(min(nx, ny) * least.denominator >= max(nx, ny) * least.numerator and apart * (least.numerator + least.denominator) <= (nx + ny) * (least.denominator - least.numerator))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(far, pa.float64())], names=["a", "b", "far"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(classes.select(F.col("cls").alias("a"), F.col("n").alias("nx"), F.col("sketch").alias("x")), "a")
    both = both.join(classes.select(F.col("cls").alias("b"), F.col("n").alias("ny"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", "nx", "ny", "x", "y").mapInArrow(check, "a long, b long, far double")


def _settled(texts: DataFrame, classes: DataFrame, linked: DataFrame | None, found: DataFrame, words: int, least: Fraction) -> DataFrame:
    """Pairs similar enough of those found, a stored table that goes, that connect with those linked before what all of them do.
    Many classes that are about as like as needed make pairs by the square of their number, so those most alike come first, and
    later rounds need no pair that the links so far connect."""
    left = stored(_likely(classes, found, least), "jaccard-likely")
    forget(found)
    good = None
    for _ in range(NEAREST):
        of_a = left.groupBy("a").agg(F.min(F.struct("far", "b"))["b"].alias("b"))
        of_b = left.groupBy("b").agg(F.min(F.struct("far", "a"))["a"].alias("a")).select("a", "b")
        best = stored(of_a.unionByName(of_b).distinct(), "jaccard-nearest")
        if left.count() <= 2 * best.count():
            forget(best)
            break
        rest = stored(left.join(best, ["a", "b"], "left_anti"), "jaccard-rest")
        forget(left)
        now = _in_slices(texts, classes, best, words, least)
        good = now if good is None else good.unionByName(now)
        root = components(good if linked is None else linked.unionByName(good), "jaccard-components")
        ends = rest.join(root.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(root.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        left = stored(ends.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "far"), "jaccard-likely")
        forget(rest)
    now = _in_slices(texts, classes, left, words, least)
    return now if good is None else good.unionByName(now)


def _in_slices(texts: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, least: Fraction) -> DataFrame:
    """_verified() over all pairs, some of them at a time: each pair takes a whole set to the other, so what is moved at once is
    kept to half of what all sets are."""
    whole = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    moved = pairs.join(classes.select(F.col("cls").alias("a"), "n"), "a").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slices = max(1, -(-2 * moved // max(1, whole)))
    if slices == 1:
        return _verified(texts, pairs, words, least)
    good = None
    for i in range(slices):
        part = stored(pairs.where(F.pmod(F.xxhash64("a"), F.lit(slices)) == i), "jaccard-slice")
        now = _verified(texts, part, words, least)
        good = now if good is None else good.unionByName(now)
    forget(pairs)
    return good


def by_simhash(classes: DataFrame, limit: int = 4) -> DataFrame:
    """(a, b): pairs of classes (cls, fp) that connect just what fingerprints of at most `limit` differing bits connect, as
    simhash.links() finds them, each once however many buckets give it; classes of one fingerprint are paired with the first of
    them."""
    of = stored(classes.groupBy("fp").agg(F.min("cls").alias("one")), "jaccard-prints")
    alike = classes.join(of, "fp").where("cls <> one").select(F.col("cls").alias("a"), F.col("one").alias("b"))
    found = stored(simhash.links(of.select("fp"), limit), "jaccard-print-links")
    near = found.join(of.select(F.col("fp").alias("a"), F.col("one").alias("x")), "a").join(of.select(F.col("fp").alias("b"), F.col("one").alias("y")), "b")
    return alike.unionByName(near.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).distinct()


def links(texts: DataFrame, classes: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(a, b): pairs of classes of `texts` (cls long, text), of which `classes` (cls, fp, n, bits, sketch) has each once, that connect
    just what pairs of a Jaccard similarity of at least `least` connect.

    The SimHash operator's links come first, each checked on whole sets. What they leave out, as 0.8 can mean far more
    differing bits than a chain of segments can hold, is found through prefixes: those of two similar sets meet in some
    bucket under any order of shingles, and each pair of a bucket is checked on its whole sets unless its bounds, parities or
    sketches forbid it or it is connected. In the first rounds each bucket's members meet one of them alone; then all pairs of a bucket that
    are not connected yet, in blocks where a bucket is large. No pair is left to chance.
    """
    part = Fraction(str(least))
    found = _settled(texts, classes, None, stored(by_simhash(classes), "jaccard-pairs"), words, part)
    frequent = _frequent(texts, words)
    many = stored(_prefixes(texts, words, part, frequent).groupBy("k").count().where("count > 1").select("k"), "jaccard-shared")
    first = _prefixes(texts, words, part, frequent, _places(many))
    rows = stored(first.groupBy("k", "cls").agg(F.min("n").alias("n"), F.min("at").alias("at")), "jaccard-buckets")
    forget(many)
    for turn in range(STARS + 1):
        root = components(found, "jaccard-components")
        now = stored(rows.join(root, rows["cls"] == root["node"], "left").select("k", "cls", "n", "at", F.coalesce("component", "cls").alias("c")), "jaccard-members")
        open_ = stored(now.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("many"), F.min(F.struct(F.xxhash64("cls", F.pmod(F.xxhash64("k"), F.lit(SPOKES)), F.lit(turn)).alias("h"), "cls", "n", "at", "c")).alias("one")).where("lo < hi"), "jaccard-open")
        if turn < STARS:
            met = now.alias("x").join(open_.select("k", "one.*").drop("h").alias("y"), "k")
        else:
            live = stored(now.join(open_.select("k", "many"), "k").withColumn("blocks", F.ceil(F.col("many") / BLOCK)), "jaccard-live")
            order = live.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("at", "k"))).alias("order")).select("cls", F.posexplode("order").alias("place", "e"), "order.k")
            place = F.greatest(F.col("place") - BEFORE, F.lit(0))
            order = order.select("cls", F.col("e.k").alias("of"), F.slice("k", place + 1, F.col("place") - place).alias("before"))
            ordered = stored(live.join(order.withColumnRenamed("of", "k"), ["cls", "k"]).join(classes.select("cls", "bits"), "cls"), "jaccard-ordered")
            left = ordered.withColumn("i", F.pmod(F.xxhash64("cls"), F.col("blocks")))
            right = ordered.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            met = left.alias("x").join(right.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.cls") > F.col("y.cls")))
            met = met.where(_may_by_bits("x", "y", part) & ~F.arrays_overlap("x.before", "y.before"))
        pairs = met.where((F.col("x.c") != F.col("y.c")) & _may("x", "y", part)).select(F.greatest("x.cls", "y.cls").alias("a"), F.least("x.cls", "y.cls").alias("b")).distinct()
        found = found.unionByName(_settled(texts, classes, found, stored(pairs, "jaccard-pairs"), words, part))
        forget(now, open_)
    forget(rows, live, ordered)
    return found


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for each document: the smallest doc_id that links of a Jaccard similarity of at least `least`
    reach, through any number of documents. Texts without words are alike. A null doc_id has its row too, but names no
    component unless all of a component's are null. Repeated rows: each has its own; no rows: no rows."""
    texts = stored(_classed(docs, words), "jaccard-texts")
    classes = stored(texts.groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch")), "jaccard-classes")
    root = components(links(texts, classes, words, least), "jaccard-components")
    named = stored(classes.join(root, classes["cls"] == root["node"], "left").select("cls", "first", F.coalesce("component", "cls").alias("component")), "jaccard-rooted")
    by = stored(named.groupBy("component").agg(F.min("first").alias("component_id")), "jaccard-first")
    by_class = stored(named.select("cls", "component").join(by, "component").select(F.col("cls").alias("__cls"), "component_id"), "jaccard-named")
    return texts.select("doc_id", "cls").join(by_class, F.col("cls") == F.col("__cls")).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs that stay when of each component only the document with the smallest doc_id does, as in
    simhash.keep_one()."""
    kept = near_duplicates(docs, words, least).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("__kept"), "left_semi")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        named = named.dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))
