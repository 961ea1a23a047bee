"""Token counts through a digest cache."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, stored

#: A text of more characters is encoded in runs of about so many, cut before white space.
RUN = 1 << 18
#: So many characters go to the library in one call.
CALL = 1 << 19
#: Characters on whose case, classes and composed forms all versions of Unicode agree.
UNSETTLED = re.compile(r"[^\x20-\x7e\t\n\r¡-ɏ]")
#: Word counts remembered by a worker, and the longest word remembered.
MEMO, LONGEST = 1 << 19, 40


def tokenizer_version(path: str) -> str:
    """The digest that names a tokenizer in the cache."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def normalised(text):
    """The text with what can't change its count made equal. Where the tokenizer lower-cases and takes any run of
    white space as one blank, so are A-Z and ASCII white space here; a text with '<|' keeps its case, as a special
    string is found before lower-casing."""
    lower = F.when(F.contains(text, F.lit("<|")), text).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.regexp_replace(lower, r"[ \t\n\r]+", " ")


def _words(spec: dict):
    """Text to the pieces that the tokenizer encodes one by one, where it composes, takes white space as one, lower-cases
    and keeps only the matches of one pattern; else None. Holds for texts without UNSETTLED characters or special strings."""
    import regex

    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
        return None
    split, byte_level = cuts
    if split["behavior"] != "Removed" or not split["invert"] or byte_level["use_regex"] or byte_level["add_prefix_space"]:
        return None
    pattern = regex.compile(split["pattern"]["Regex"])
    return lambda text: pattern.findall(text.lower())


def lowers_and_blanks(path: str) -> bool:
    """Whether normalised() leaves the counts of this tokenizer as they are: it lower-cases and takes runs of white space as one."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as file:
        return _words(json.load(file)) is not None


@functools.lru_cache(4)
def _load(path: str):
    """A function from texts to their counts. Where the tokenizer works word by word, the library encodes each different
    word of a worker once and counts are added up; other texts go through the library whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def whole(texts: list[str]) -> list[int]:
        return [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    words, special = _words(spec), [x["content"] for x in spec["added_tokens"]]
    if words is None:
        return whole
    memo: dict[str, int] = {}
    suffix = spec["model"].get("end_of_word_suffix")
    last = np.zeros(max(spec["model"]["vocab"].values()) + 1, dtype=bool)
    if suffix:
        last[[i for word, i in spec["model"]["vocab"].items() if word.endswith(suffix)]] = True

    def apart(new: list[str]) -> list[int]:
        """Counts of words, encoded together with blanks between them; each word's last token shows its end."""
        out = []
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            ids = np.array(tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.int64)
            ends = np.flatnonzero(last[ids]) + 1 if len(ids) and ids.max() < len(last) else ids[:0]
            out += np.diff(ends, prepend=0).tolist() if len(ends) == len(part) and ends[-1] == len(ids) else whole(part)
        return out

    def counts(texts: list[str]) -> list[int]:
        plain = [not UNSETTLED.search(x) and not any(y in x for y in special) for x in texts]
        cut = [words(x) if ok else [] for x, ok in zip(texts, plain)]
        new = {w for ws in cut for w in ws if w not in memo}
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = {w for ws in cut for w in ws}
        new = list(new)
        memo.update(zip(new, apart(new)))
        out = [sum(map(memo.__getitem__, ws)) for ws in cut]
        for w in new:
            if len(w) > LONGEST:
                del memo[w]
        rest = [i for i, ok in enumerate(plain) if not ok]
        for i, n in zip(rest, whole([texts[i] for i in rest]) if rest else []):
            out[i] = n
        return out

    return counts


def _runs(text: str) -> list[str]:
    """Cuts before ASCII white space, which no token of this tokenizer spans."""
    if len(text) <= RUN:
        return [text]
    out, at = [], 0
    while len(text) - at > RUN:
        cut = max(text.rfind(" ", at + 1, at + RUN), text.rfind("\n", at + 1, at + RUN))
        if cut <= at and (cut := text.find(" ", at + RUN)) < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def _counts(texts: list[str], path: str, cut: bool) -> list[int]:
    encode = _load(path)
    out, call, owner, size = [0] * len(texts), [], [], 0

    def flush():
        nonlocal call, owner, size
        for i, n in zip(owner, encode(call)):
            out[i] += n
        call, owner, size = [], [], 0

    for i, text in enumerate(texts):
        for run in _runs(text) if cut else [text]:
            call.append(run)
            owner.append(i)
            size += len(run)
            if size >= CALL:
                flush()
    if call:
        flush()
    return out


def _encoder(path: str, cut: bool):
    def encode(batches):
        for batch in batches:
            texts = batch.column("norm").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(_counts(texts, path, cut), pa.int64())], names=["digest", "n_tokens"])

    return encode


def cached_counts(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts (tokenizer, digest, n_tokens); none where the cache has not been written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    schema = "tokenizer string, digest binary, n_tokens long"
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, text: str = "text", lower_and_blank: bool | None = None) -> DataFrame:
    """Adds n_tokens, what the tokenizer file's library gives for each whole text without special tokens.

    The digest of each normalised text is joined to the stored counts of this tokenizer version; of the texts without one,
    one for each digest is encoded and appended to the cache (a Parquet folder that all executors reach). Where the cache
    holds counts, digests alone are looked up first, and texts are moved only for those that it misses; where it holds none,
    texts are reduced to one for each digest before the shuffle. Written counts are read again, so a lost executor costs no
    second encoding.
    lower_and_blank: the tokenizer lower-cases and takes runs of white space as one, so texts are keyed that way; None: as its
    file says. Else texts are keyed as they are.
    Null and empty text: 0 tokens. Repeated rows and texts: each row gets its count; no rows: no rows. Other columns stay as
    they are (a column n_tokens is replaced). A text of any length is counted whole, in runs cut at white space.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    if lower_and_blank is None:
        lower_and_blank = lowers_and_blanks(tokenizer)
    whole = F.coalesce(F.col(text), F.lit(""))
    norm = normalised(whole) if lower_and_blank else whole
    digest = F.unhex(F.sha2(norm.cast("binary"), 256))
    known = cached_counts(spark, cache).where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    texts = docs.select(norm.alias("norm")).withColumn("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    if known.isEmpty():
        missing = texts.dropDuplicates(["digest"])
    else:
        wanted = stored(docs.select(digest.alias("digest")).distinct().join(known, "digest", "left_anti"), "token-misses")
        sent = few(wanted)
        # a broadcast leaves texts where they are until one of each is left; else they are dealt out once, one of each from each task
        missing = texts.join(sent, "digest", "left_semi").dropDuplicates(["digest"]) if sent is not wanted else texts.dropDuplicates(["digest"]).join(wanted, "digest", "left_semi")
    fresh = missing.select("digest", "norm").mapInArrow(_encoder(tokenizer, lower_and_blank), "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").option("compression", "zstd").parquet(cache)
    # stored once more without repeats, so that the join below reads it plainly and a hot digest's rows can be split
    known = stored(cached_counts(spark, cache).where(F.col("tokenizer") == version).select(F.col("digest").alias("__digest"), F.col("n_tokens").alias("__n")).dropDuplicates(["__digest"]), "token-counts")
    rest = [c for c in docs.columns if c != "n_tokens"]
    return docs.select(*rest, digest.alias("__key")).join(known, F.col("__key") == F.col("__digest"), "left").select(*rest, F.col("__n").alias("n_tokens"))
