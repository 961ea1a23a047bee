"""Words and patterns in text columns."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Automaton:
    """Finds all of many patterns in one pass."""

    def __init__(self, patterns: list[tuple[int, str]]):
        self.next, self.fail, self.out = [{}], [0], [[]]
        for pid, word in patterns:
            at = 0
            for c in word:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.out.append([])
                at = self.next[at][c]
            if word:
                self.out[at].append(pid)
        queue = deque(self.next[0].values())
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                f = self.fail[u]
                while f and c not in self.next[f]:
                    f = self.fail[f]
                self.fail[v] = self.next[f].get(c, 0)
                self.out[v] = self.out[v] + self.out[self.fail[v]]

    def search(self, text: str) -> list[tuple[int, int]]:
        """(index of the last character, pattern) of each match."""
        at, found = 0, []
        for i, c in enumerate(text):
            while at and c not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(c, 0)
            found += [(i, pid) for pid in self.out[at]]
        return found


def _finder(patterns: list[tuple[int, str]]):
    """A function from texts to matches: a native automaton where the library for it is there, else the one above."""
    try:
        import ahocorasick
    except ImportError:
        return Automaton(patterns).search
    words: dict[str, list[int]] = {}
    for pid, word in patterns:
        if word:
            words.setdefault(word, []).append(pid)
    if not words:
        return lambda text: []
    native = ahocorasick.Automaton()
    for word, pids in words.items():
        native.add_word(word, pids)
    native.make_automaton()
    return lambda text: [(end, pid) for end, pids in native.iter(text) for pid in pids]


def find_patterns(texts: DataFrame, patterns: list[tuple[int, str]], key: str = "id", text: str = "text") -> DataFrame:
    """(key, end, pid) of each match in each text. The automaton goes to every task; patterns are a parameter, not data."""
    shared = texts.sparkSession.sparkContext.broadcast(patterns)

    def run(batches):
        search = _finder(shared.value)
        for pdf in batches:
            rows = [(k, end, pid) for k, t in zip(pdf["k"], pdf["t"]) for end, pid in search(t or "")]
            yield pd.DataFrame(rows, columns=[key, "end", "pid"])

    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, end int, pid int")


def with_prefix(words: DataFrame, prefix: str, word: str = "word") -> DataFrame:
    """Rows whose word starts with a prefix: a filter that reaches the scan."""
    return words.where(F.col(word).startswith(prefix))


def contains_word(words: DataFrame, value: str, word: str = "word") -> bool:
    return not words.where(F.col(word) == value).isEmpty()


def suffix_array(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, rank, start, lcp) for each suffix of each text, in their order; lcp is the common beginning with the suffix
    before. Suffixes of one text are as many bytes as its length squared; long texts belong in an index instead."""
    suffixes = texts.where(F.length(text) > 0).select(F.col(key), F.explode(F.sequence(F.lit(0), F.length(text) - 1)).alias("start"), F.col(text).alias("t"))
    suffixes = suffixes.select(key, "start", F.expr("substring(t, start + 1)").alias("suffix"))
    order = W.partitionBy(key).orderBy("suffix")
    ranked = suffixes.select(key, (F.row_number().over(order) - 1).alias("rank"), "start", "suffix", F.lag("suffix").over(order).alias("before"))
    same = F.zip_with(F.split("suffix", ""), F.split(F.coalesce("before", F.lit("")), ""), lambda a, b: F.coalesce((a == b) & (a != ""), F.lit(False)))
    lcp = F.when(F.col("before").isNull(), 0).otherwise(F.coalesce(F.array_position(same, False) - 1, F.lit(0)))
    lcp = F.when(F.array_position(same, False) == 0, F.size(same)).otherwise(lcp)
    return ranked.select(key, "rank", "start", lcp.cast("int").alias("lcp"))
