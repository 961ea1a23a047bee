"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of a vector, and the seed of the letters' vectors.
DIMENSIONS, SEED = 2048, 20
#: Symbols: 0 parts words, 1 to 26 are a to z, the others share the rest by their code point.
SYMBOLS, SHIFT = 128, 7
#: Characters of a text counted at a time.
RUN = 1 << 20
#: Vectors of grams that a worker keeps (32 MB); those of any others are bound again.
KEPT = 1 << 14
#: A text is like none of the languages if it scores under this part of the score that all but LOW of the learning rows of
#: its length reach, or all rows; lengths of fewer than ENOUGH rows are taken together with the next ones.
MARGIN, LOW, ENOUGH = 0.4, 0.01, 100


@functools.lru_cache(1)
def _symbols() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        if chr(i).isalpha():
            table[i] = i - 96 if 97 <= i <= 122 else 27 + i % (SYMBOLS - 27)
    return table


def grams(text: str) -> np.ndarray:
    """Codes of the three-letter grams of the words, each word with a mark before and after it; empty without letters."""
    out = []
    for at in range(0, len(text), RUN):
        part = text[max(0, at - 2) : at + RUN].lower()
        s = _symbols()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        s = np.concatenate([[0] if at == 0 else [], s, [0] if at + RUN >= len(text) else []]).astype(np.int32)
        code = (s[:-2] << (2 * SHIFT)) | (s[1:-1] << SHIFT) | s[2:]
        out.append(code[s[1:-1] > 0])
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@functools.lru_cache(1)
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, DIMENSIONS))


@functools.lru_cache(1)
def _permuted() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = letter_vectors()
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """The first letter's vector permuted twice, times the second's permuted once, times the third's."""
    twice, once, v = _permuted()
    mask = SYMBOLS - 1
    return twice[codes >> (2 * SHIFT)] * once[(codes >> SHIFT) & mask] * v[codes & mask]


class _Known:
    """The vectors of the grams that a worker has met, up to KEPT of them."""

    def __init__(self):
        self.place = np.full(SYMBOLS**3, -1, dtype=np.int32)
        self.rows = np.zeros((KEPT, DIMENSIONS), dtype=np.int8)
        self.used = 0

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        at = self.place[codes]
        new = codes[at < 0]
        if len(new):
            if self.used + len(new) > KEPT:
                return gram_vectors(codes)
            self.rows[self.used : self.used + len(new)] = gram_vectors(new)
            self.place[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            at = self.place[codes]
        return self.rows[at]


@functools.lru_cache(1)
def _known() -> _Known:
    return _Known()


def _bundle(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of the codes' vectors, each as often as its weight."""
    out = np.zeros(DIMENSIONS)
    for lo in range(0, len(codes), 4096):
        out += weights[lo : lo + 4096].astype(np.float32) @ _known().vectors(codes[lo : lo + 4096]).astype(np.float32)
    return out


def vector(text: str) -> tuple[np.ndarray, int]:
    """The bundle of a text's grams, each as often as the root of its count, so that no passage that repeats outweighs the
    rest; and the number of grams."""
    codes = grams(text)
    seen, n = np.unique(codes, return_counts=True)
    return _bundle(seen, np.sqrt(n)), len(codes)


@dataclass
class Profiles:
    """The languages and their prototypes."""

    languages: list[str]
    prototypes: np.ndarray


def fit(docs: DataFrame, train: Column, lang: str = "lang", text: str = "text") -> Profiles | None:
    """Profiles from all rows where `train` holds and lang is not null; None without such rows with letters, as where a
    table or a partition is empty.

    Each document adds the root of each gram's count, so that no repeated word outweighs the rest. A language's bundle has a
    gram's vector as often as its share of what the language's documents add, less the mean share in all languages, so that
    what languages have in common doesn't make them alike. Bundles are sums, so each task adds up its own: for each language
    that it has rows of one bundle and one weight go to the shuffle, and DIMENSIONS numbers a language reach the driver.
    """

    def add(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {}
            for name, x in zip(batch.column("lang").to_pylist(), batch.column("text")):
                codes, n = np.unique(grams(x.as_py() or ""), return_counts=True)
                if len(codes):
                    parts.setdefault(name, []).append(np.stack([codes, np.sqrt(n)]))
            for name, found in parts.items():
                both = np.concatenate(found, axis=1)
                codes, where = np.unique(both[0], return_inverse=True)
                weights = np.bincount(where, both[1])
                held[name] = held.get(name, 0) + np.append(_bundle(codes.astype(np.int64), weights), weights.sum())
        for name, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(total), pa.string()), pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["lang", "i", "x"])

    rows = docs.where(train & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    table = rows.mapInArrow(add, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x")).toPandas()
    if not len(table):
        return None
    languages = sorted(table["lang"].unique())
    sums = np.zeros((len(languages), DIMENSIONS + 1))
    sums[[languages.index(x) for x in table["lang"]], table["i"]] = table["x"]
    shares = sums[:, :-1] / sums[:, -1:]
    return Profiles(languages, shares - (shares.mean(0) if len(languages) > 1 else 0))


def scorer(profiles: Profiles | None):
    """A function from texts to (language or und, cosine cut to 0..1, number of grams): the cosine of a text's bundle with
    each prototype, both in full. Ties go to the first language."""
    if profiles is None:
        return lambda text: ("und", 0.0, 0)
    unit = profiles.prototypes / np.maximum(np.linalg.norm(profiles.prototypes, axis=1, keepdims=True), 1e-300)

    def score(text: str | None) -> tuple[str, float, int]:
        bundle, n = vector(text or "")
        if not n:
            return "und", 0.0, 0
        cosine = unit @ bundle / max(float(np.linalg.norm(bundle)), 1e-300)
        best = int(np.argmax(cosine))
        return profiles.languages[best], float(min(1.0, max(0.0, cosine[best]))), n

    return score


def predict(docs: DataFrame, profiles: Profiles | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs with lang_pred and score. `und` and 0 for a null text, one without letters, or without
    profiles; ties go to the first language by name. Whole texts of any length; each row by itself, so null keys and repeated
    rows have theirs; no rows: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        score = scorer(shared.value)
        for batch in batches:
            found = [score(x.as_py()) for x in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def limits(docs: DataFrame, train: Column, profiles: Profiles | None, text: str = "text") -> list[float]:
    """The least score of a text of 2^i grams and more, for each i, from the scores of all rows where `train` holds. What
    reaches the driver is a count for each i and thousandth of the score."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        score = scorer(shared.value)
        for batch in batches:
            found = [(n.bit_length() - 1, int(1000 * value)) for _, value, n in (score(x.as_py()) for x in batch.column("text")) if n]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32())], names=["i", "s"])

    rows = docs.where(train).select(F.col(text).alias("text")).mapInArrow(run, "i int, s int").groupBy("i", "s").count().collect()
    table = np.zeros((32, 1001), dtype=np.int64)
    for r in rows:
        table[r["i"], r["s"]] = r["count"]
    if table.sum() < ENOUGH:
        return [0.0] * len(table)

    def low(counts: np.ndarray) -> float:
        return MARGIN * float(np.searchsorted(np.cumsum(counts), LOW * counts.sum(), side="right")) / 1000

    near = [next(x for k in range(len(table)) if (x := table[max(0, i - k) : i + k + 1].sum(0)).sum() >= ENOUGH) for i in range(len(table))]
    return [min(low(x), low(table.sum(0))) for x in near]


def recognised(docs: DataFrame, profiles: Profiles | None, least_score: float = 0.02, text: str = "text", least_by_length: list[float] | None = None) -> DataFrame:
    """The rows of docs whose text has a language: not `und`, and at least least_score, or what limits() gives for its
    length if that is more. Grams of no learned language lower the score. All columns stay as they are; only the text goes
    to Python, and only a flag comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("boolean")
    def known(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = scorer(shared.value)
        for batch in texts:
            found = [score(x) for x in batch]
            yield pd.Series([name != "und" and value >= max(least_score, least_by_length[n.bit_length() - 1] if least_by_length else 0) for name, value, n in found], dtype=bool)

    return docs.where(known(F.col(text)))
