"""Quality rules as a ledger of failure bits and measurements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored

#: The measurements of a ledger, all long and 0 for a null text.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct")


@dataclass(frozen=True)
class Rule:
    """One rule: its bit in the ledger, and the condition under which a document fails it."""

    bit: int
    name: str
    fails: str


#: Bits are never given to another rule; a changed rule gets a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeats", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "dup_lines", "n_dup_lines >= 2 and 10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule(5, "shouting", "2 * n_upper > word_chars"),
    Rule(6, "marks", "2 * n_marks > n_words"),
    Rule(7, "poor_vocabulary", "n_words >= 50 and 10 * n_distinct < n_words"),
)
BASE = 0b11
#: Policies by version: the rules that a document must not fail. They are only ever added.
POLICIES = {1: BASE, 2: 0b1111, 3: 0b11111111}


def _measured(text: Column) -> tuple[dict[str, Column], list[dict[str, Column]]]:
    """Columns added step by step, so that each array is made once for a row."""
    word = f"[{SPACE}]+"
    first = {
        "__text": F.coalesce(text, F.lit("")),
    }
    second = {
        "__words": F.array_remove(F.split("__text", word), ""),
        "__lines": F.filter(F.split("__text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
    }
    n = F.size("__words")
    third = {
        # three neighbours as one 64-bit hash: two windows of a text are taken for equal by chance once in 10^11 texts of 20,000 words
        "__windows": F.when(n >= 3, F.transform(F.arrays_zip(F.slice("__words", F.lit(1), n - 2).alias("a"), F.slice("__words", F.lit(2), n - 2).alias("b"), F.slice("__words", F.lit(3), n - 2).alias("c")), lambda z: F.xxhash64(z["a"], z["b"], z["c"]))).otherwise(F.array().cast("array<bigint>")),
    }
    fourth = {"__repeats": F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))}
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    k = F.size("__repeats")
    fifth = {
        "__at": F.sort_array(F.filter(F.transform(F.arrays_zip(F.col("__repeats").alias("c"), F.concat(none, F.slice("__repeats", F.lit(1), k - 1)).alias("p"), F.concat(F.slice("__repeats", F.lit(2), k - 1), none).alias("n")), lambda z: F.when((z["c"]["h"] == z["p"]["h"]) | (z["c"]["h"] == z["n"]["h"]), z["c"]["i"])), lambda i: i.isNotNull())),
    }
    at = F.col("__at")
    covered = F.aggregate(F.arrays_zip(at.alias("c"), F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.lit(2**31 - 1))).alias("n")), F.lit(0).cast("long"), lambda s, z: s + F.least(F.lit(3), z["n"] - z["c"]).cast("long"))
    last = {
        "n_words": F.size("__words"),
        "word_chars": F.char_length(F.array_join("__words", "")),
        "n_symbols": F.regexp_count("__text", F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.coalesce(F.when(F.size("__at") > 0, covered), F.lit(0)),
        "n_lines": F.size("__lines"),
        "n_upper": F.regexp_count("__text", F.lit("[A-Z\\u00C0-\\u00DE]")),
        "n_marks": F.regexp_count("__text", F.lit("[!?]")),
        "n_distinct": F.size(F.array_distinct("__words")),
    }
    return {k: v.cast("long") for k, v in last.items()}, [first, second, third, fourth, fifth]


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the measurements, failed long) for each document: every rule is evaluated once, and bit i of failed is set
    if the document fails the rule of bit i.

    Words are runs of other characters than ASCII white space. n_repeat_words counts the words that stand in a window
    of three words found at least twice in the text; n_dup_lines the lines with a word that equal an earlier one. A null
    or empty text has no words. Rows are independent: no shuffle, no group; whole texts; repeated rows and null keys
    have their rows. Other columns are left out.
    """
    measures, steps = _measured(F.col(text))
    rows = docs.select(F.col(key).alias("__key"), F.col(text))
    done: list[str] = ["__key"]
    for step in steps:
        rows = rows.select(*done, *[c.alias(k) for k, c in step.items()])
        done += list(step)
    rows = rows.select(F.col("__key").alias(key), *[measures[m].alias(m) for m in MEASURES])
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")) for r in RULES[1:]), F.when(F.expr(RULES[0].fails), F.lit(1 << RULES[0].bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.withColumn("failed", bits)


def stored_ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger as a table in the shared folder: any number of policies and ablations read it, and no text again."""
    return stored(ledger(docs, key, text), "quality-ledger")


def verdicts(kept: DataFrame, version: int) -> DataFrame:
    """Adds kept_by_policy: whether a document fails no rule of the policy."""
    return kept.withColumn("kept_by_policy", F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(rows: DataFrame, version: int) -> DataFrame:
    """(rule, n_failed, n_alone, n_kept_without) for each rule of a policy: documents that fail it, that fail no other
    rule of the policy, and that would stay if the policy went without it. Rows with the same bits are counted first,
    so at most 2^rules rows are looked at again, whatever the number of documents."""
    mask = POLICIES[version]
    counted = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).count()
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if mask >> r.bit & 1])
    each = counted.select("bits", "count", F.explode(rules).alias("r")).select("bits", "count", "r.*")
    fails, other = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(total(fails).alias("n_failed"), total(fails & (other == 0)).alias("n_alone"), total(other == 0).alias("n_kept_without"))
