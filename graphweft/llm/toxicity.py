"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Words of the grammar's classes that hold in general; the insults of a corpus are learned.
TARGETS = "you your yours yourself u ur he him she her they them du dich dir ihr euch sie tu te toi vous ton ta usted ustedes ti vosotros".split()
THREATS = "kill murder hurt destroy beat burn shoot stab strangle slaughter umbringen vernichten schlagen tuer détruire frapper matar destruir golpear".split()
NEGATIONS = "not no never nobody isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais ni nunca".split()
REPORTS = "said says say wrote writes called claims claimed reported according quoted sagte dit dijo".split()
INSULTS = "idiot moron imbecile cretin bastard asshole dumbass".split()
#: Bounds of the sample of labelled rows of either label that the lexicon and the weights are fitted on.
SAMPLE_TOXIC, SAMPLE_CLEAN = 6000, 12000
#: Documents of the sample that must hold an entry of a learned lexicon; the least share of toxic ones among them.
LEAST_DOCS, LEAST_SHARE = 3, 0.8
#: An entry of at least this part of the sample's toxic documents is plain; any other must say something of LEAST_DOCS toxic
#: documents that hold no plain one.
PLAIN = 0.02
#: Copies of a document count once for the lexicon: documents whose runs of so many words have the same least hash.
COPY_WORDS = 3
#: Lengths of word beginnings that can be an entry, written with a star.
STEMS = (4, 5, 6, 7)
#: Tokens that a negation reaches.
REACH = 3

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;:\n]+")
FEATURES = ("plain", "aimed", "negated", "reported", "threat", "stem", "any", "dense")


def terms(text: str) -> set[str]:
    """Words of a text and, with a star, their beginnings."""
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


class Transducer:
    """A deterministic machine: (state, class) to (state, output)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: `other` reads what this one writes. States are pairs, made as they are reached."""
        known: dict = {}

        def step(state, symbol):
            if (state, symbol) not in known:
                a, out = self.step(state[0], symbol)
                b, out = other.step(state[1], out)
                known[state, symbol] = ((a, b), out)
            return known[state, symbol]

        return Transducer((self.start, other.start), step)


def _insult(state, symbol):
    """Marks insults and threats; the others pass as they are. A symbol is (class, marks)."""
    kind, marks = symbol
    return state, (kind, marks | {kind} if kind in ("insult", "stem", "threat") else marks)


def _negation(left, symbol):
    kind, marks = symbol
    if kind == "negation":
        return REACH, symbol
    return max(0, left - 1), (kind, marks | {"negated"} if left else marks)


def _reported(on, symbol):
    kind, marks = symbol
    return on or kind == "report", (kind, marks | {"reported"} if on else marks)


def _target(on, symbol):
    kind, marks = symbol
    return on or kind == "target", (kind, marks | {"aimed"} if on else marks)


GRAMMAR = Transducer(0, _insult) @ Transducer(0, _negation) @ Transducer(False, _reported) @ Transducer(False, _target)
NONE = frozenset()


@dataclass
class Lexicon:
    """Entries (words, and beginnings with a star) with their weights."""

    weights: dict[str, float]
    general: dict[str, str] = field(default_factory=lambda: {**dict.fromkeys(INSULTS, "insult"), **dict.fromkeys(THREATS, "threat"), **dict.fromkeys(TARGETS, "target"), **dict.fromkeys(NEGATIONS, "negation"), **dict.fromkeys(REPORTS, "report")})

    def __post_init__(self):
        self.finder = ahocorasick.Automaton()
        for x in {*(w.rstrip("*") for w in self.weights), *INSULTS, *THREATS}:
            self.finder.add_word(x, x)
        self.finder.make_automaton()
        self.stems = {n: {w[:-1] for w in self.weights if w.endswith("*") and len(w) == n + 1} for n in STEMS}

    def kind(self, word: str) -> tuple[str, float]:
        if word in self.weights:
            return "insult", self.weights[word]
        for n in STEMS:
            if word[:n] in self.stems[n] and len(word) > n:
                return "stem", self.weights[f"{word[:n]}*"]
        kind = self.general.get(word, "other")
        return kind, 1.0 if kind == "insult" else 0.0

    def features(self, text: str | None) -> np.ndarray:
        """Sums over the matched clauses: weights of insults that stand plain, are aimed at someone, negated or reported;
        threats aimed at someone; learned beginnings; whether there is any match; matches among the words."""
        out = np.zeros(len(FEATURES))
        low = (text or "").lower()
        if next(self.finder.iter(low), None) is None:
            return out
        matched = 0
        for clause in CLAUSE.split(low):
            if next(self.finder.iter(clause), None) is None:
                continue
            state, hits, aimed = GRAMMAR.start, [], False
            for word in WORD.findall(clause):
                kind, weight = self.kind(word)
                state, (_, marks) = GRAMMAR.step(state, (kind, NONE))
                aimed |= kind == "target"
                if kind in ("insult", "stem", "threat"):
                    hits.append((kind, marks, weight))
            for kind, marks, weight in hits:
                if kind == "threat":
                    out[4] += aimed
                    matched += aimed
                    continue
                matched += 1
                out[2 if "negated" in marks else 3 if "reported" in marks else 1 if aimed else 0] += weight
                out[5] += kind == "stem"
        out[:6] = np.log1p(out[:6])
        out[6] = matched > 0
        out[7] = min(1.0, 20 * matched / (1 + low.count(" ")))
        return out


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.features(text) @ self.weights))))

    def features(self, text: str | None) -> np.ndarray:
        return self.lexicon.features(text)


def _sample(labelled: DataFrame) -> DataFrame:
    """At most SAMPLE_TOXIC and SAMPLE_CLEAN rows or so of either label, those with the least hashes."""
    n = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    part = {1: min(1.0, SAMPLE_TOXIC / max(1, n.get(1, 0))), 0: min(1.0, SAMPLE_CLEAN / max(1, n.get(0, 0)))}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return labelled.where(draw < F.when(F.col("toxic") == 1, part[1]).otherwise(part[0]))


def _copy_key(texts: pd.Series) -> pd.Series:
    """The least hash of a text's runs of COPY_WORDS words, which near copies mostly share; of the whole if it has fewer."""

    def key(text: str) -> int:
        words = WORD.findall(text.lower())
        return min(xxhash.xxh64_intdigest(" ".join(words[i : i + COPY_WORDS])) for i in range(max(1, len(words) - COPY_WORDS + 1))) >> 1

    return texts.map(key)


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> Model:
    """A model from the labelled rows (doc_id, toxic 0/1) of docs where `train` holds, of which a bounded sample is used.

    The lexicon has the words and beginnings of words of which at least LEAST_SHARE of LEAST_DOCS or more documents are
    toxic; a beginning only where it says more than its words, and a rare entry only where it tells of documents that no
    plain one tells of. Copies of a document count once there, so that a text's own words aren't learned with it. The weights of the grammar's matches are then fitted by
    logistic regression, weighted back to all labelled rows. Without toxic labels, as on empty tables, the general words alone
    count. The lexicon takes every such entry: what the sample's documents hold bounds it, and that alone reaches the driver.
    """
    truth = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    keys = docs.where(train).select("doc_id").distinct().join(truth, "doc_id")
    chosen = _sample(keys).withColumnsRenamed({"doc_id": "__id"})
    # the sample's size is bounded by SAMPLE_TOXIC + SAMPLE_CLEAN rows of two numbers
    rows = docs.where(train).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", "toxic").where("text is not null")

    def counter(plain: set[str]):
        def count(batches):
            held: dict[str, list[int]] = {}
            for batch in batches:
                for x, y in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                    own = terms(x.as_py())
                    for t in own if own.isdisjoint(plain) else ():
                        held.setdefault(t, [0, 0])[y] += 1
            names = list(held)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([held[t][1] for t in names], pa.int64()), pa.array([held[t][0] for t in names], pa.int64())], names=["term", "bad", "good"])

        return count

    once = stored(rows.withColumn("key", F.pandas_udf(_copy_key, "long")("text")).dropDuplicates(["key", "toxic"]).select("text", "toxic"), "toxicity-once")
    size = {r["toxic"]: r["count"] for r in once.groupBy("toxic").count().collect()}
    lift = max(1, size.get(1, 0)) / max(1, size.get(0, 0))
    share = F.col("bad") / (F.col("bad") + F.col("good") * F.lit(lift))
    counted = lambda plain: once.mapInArrow(counter(plain), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    picked = counted(set()).where((F.col("bad") >= LEAST_DOCS) & (share >= LEAST_SHARE) & (F.col("good") <= 0.02 * F.col("bad"))).collect()
    found = {r["term"]: (r["bad"], r["good"]) for r in picked}
    plain = {t for t, (bad, _) in found.items() if bad >= PLAIN * size.get(1, 0)}
    telling = {r["term"] for r in counted(plain).where((F.col("bad") >= LEAST_DOCS) & (share >= LEAST_SHARE)).collect()}
    found = {t: n for t, n in found.items() if t in plain or t in telling}
    weights = {t: float(np.log((b + 0.5) / (g + 0.5))) / 5 for t, (b, g) in found.items()}
    longer: dict[str, int] = {}
    for w, (bad, _) in found.items():
        word = w.rstrip("*")
        for n in STEMS:
            if len(word) > n or (len(word) == n and not w.endswith("*")):
                longer[word[:n]] = max(longer.get(word[:n], 0), bad)
    for t, (bad, _) in found.items():
        # a beginning that a whole word explains, or one that a longer one explains, adds nothing
        if t.endswith("*") and longer.get(t[:-1], 0) >= 0.9 * bad:
            del weights[t]
    lexicon = Lexicon(weights)

    def featured(batches):
        for batch in batches:
            x = [lexicon.features(t.as_py()).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    got = rows.mapInArrow(featured, "x array<double>, toxic int").toPandas()
    prior = {r["toxic"]: r["count"] for r in keys.groupBy("toxic").count().collect()}
    if not prior.get(1) or not len(got):
        return Model(lexicon, np.ones(len(FEATURES)), -3.0)
    x, y = np.stack(got["x"].values), got["toxic"].values.astype(float)
    w = np.where(y == 1, prior[1] / max(1, y.sum()), prior.get(0, 0) / max(1, (1 - y).sum()))
    beta, bias = _logistic(x, y, w / w.mean())
    return Model(lexicon, beta, bias)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps on the weighted, ridge-penalised likelihood."""
    x1 = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x1.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ b, -30, 30)))
        h = (x1 * (w * p * (1 - p))[:, None]).T @ x1 + penalty
        d = np.linalg.solve(h, x1.T @ (w * (y - p)) - penalty @ b)
        b += d
        if np.abs(d).max() < 1e-8:
            break
    return b[:-1], float(b[-1])


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs with score, 0 to 1. Texts of any length are read whole, each row by itself; a null or
    empty text has the score of a text without a match."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon.weights, model.weights, model.bias))

    def run(batches):
        weights, beta, bias = shared.value
        own = Model(Lexicon(weights), beta, bias)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([own.score(x.as_py()) for x in batch.column("__text")], pa.float64())], names=[*keep, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{kinds}, score double")


def below(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon.weights, model.weights, model.bias))

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, beta, bias = shared.value
        own = Model(Lexicon(weights), beta, bias)
        for batch in texts:
            yield pd.Series([own.score(x) for x in batch], dtype=float)

    return docs.where(scored(F.col(text)) < threshold)


__all__ = ["Lexicon", "Model", "Transducer", "below", "fit", "score", "terms"]
