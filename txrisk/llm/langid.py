"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased; every run of non-letters counts as one space; n-grams of 1 to ``ORDER`` characters are
hashed to ``BUCKETS`` numbers. Learning counts n-grams per language over all labelled rows: tasks count their own rows
and Spark adds the counts up, so that only the matrix (languages x buckets) reaches the driver and, as
log-probabilities, the tasks. Scoring is sparse: a text gathers the matrix rows of its n-grams and adds them; a very
long text adds its bucket counts times the matrix instead, so memory is bounded for any length.

Defined cases: a null, empty or letterless text is ``und`` with score 0; rows without a language are not learnt from;
equal scores go to the alphabetically first language; repeated rows count as often as they occur; with nothing learnt
every text is ``und``; further columns are ignored. At most ``MAX_LANGUAGES`` languages keep the matrix small enough to
broadcast; more raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
BUCKETS = 1 << 15
SMOOTHING = 0.5
MAX_LANGUAGES = 1000
CHUNK_CHARS = 1 << 19
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of some texts, and where each text's n-grams start (one more entry at the end)."""
    joined = np.frombuffer("\n".join(t.lower() for t in texts).encode("utf-32-le", "replace"), "<u4")
    lengths = np.array([len(t.lower()) for t in texts], np.int64)
    ends = np.cumsum(lengths + 1) - 1  # the line end after each text
    owner = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[-1], ends])))[: len(joined)]
    letter = letters()[joined]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters only the first
    code = np.where(letter, joined, 32).astype(np.uint64)[keep]
    owner = owner[keep]
    size = len(code)
    held = np.zeros(size, np.uint64)
    parts, owners = [], []
    for n in range(1, ORDER + 1):
        m = size - n + 1
        if m <= 0:
            break
        held = held[:m] * np.uint64(0x100000001B3) + code[n - 1 :]
        whole = owner[:m] == owner[n - 1 :]
        bucket = (held + np.uint64(n)) * _MIX
        bucket ^= bucket >> np.uint64(29)
        bucket *= _MIX
        parts.append((bucket >> np.uint64(49)).astype(np.int32)[whole])
        owners.append(owner[:m][whole])
    if not parts:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    bucket, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


def text_groups(texts: list[str | None]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= CHUNK_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of (text, lang); tasks add up their rows before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            at = 0
            for group in text_groups(batch.column("text").to_pylist()):
                bucket, first = grams(group)
                names = langs[at : at + len(group)]
                at += len(group)
                for lang in set(names):
                    mine = np.array([n == lang for n in names])
                    of = bucket[np.repeat(mine, np.diff(first))]
                    total = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    total += np.bincount(of, minlength=BUCKETS)
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])],
                ["lang", "bucket", "n"],
            )

    partly = labelled.select("text", "lang").mapInArrow(count, "lang string, bucket int, n bigint")
    return partly.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, log-probabilities
    prior: np.ndarray

    def log_scores(self, texts: list[str]) -> np.ndarray:
        bucket, first = grams(texts)
        size = np.diff(first)
        out = np.zeros((len(texts), len(self.languages)))
        step = max(1, (1 << 22) // max(1, len(self.languages)))
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(first, first[low] + step, "right")) - 1)
            mine = bucket[first[low] : first[high]]
            if high == low + 1 and len(mine) > BUCKETS:
                out[low] = np.bincount(mine, minlength=BUCKETS) @ self.weights
            else:
                full = low + np.flatnonzero(size[low:high])
                if len(full):
                    out[full] = np.add.reduceat(self.weights[mine].astype(np.float64), first[full] - first[low])
            low = high
        return out + self.prior

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        score = self.log_scores(texts)
        best = score.argmax(1)  # the first of equals; languages are in alphabetical order
        share = 1 / np.exp(score - score[np.arange(len(best)), best][:, None]).sum(1)
        blank = np.array([not any(map(str.isalpha, t)) for t in texts], bool)
        return [UNKNOWN if b else self.languages[k] for k, b in zip(best, blank)], np.where(blank, 0.0, share)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row of ``docs`` that has a language and a text."""
    labelled = docs.select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).filter("text is not null and lang is not null")
    priors = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(priors) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["lang"] for r in priors]
    total = np.zeros((BUCKETS, len(languages)))
    at = {lang: k for k, lang in enumerate(languages)}
    # One row per language: its counts, as one array of at most BUCKETS entries.
    rows = counts(labelled).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("of"))
    for row in rows.toLocalIterator():
        for bucket, n in row["of"]:
            total[bucket, at[row["lang"]]] = n
    total += SMOOTHING
    weights = np.log(total / total.sum(0)).astype(np.float32)
    docs_per = np.array([r["n"] for r in priors], float)
    return Model(languages, weights, np.log(docs_per / docs_per.sum()) if len(docs_per) else docs_per)


def predict(model: Model, text: Column, spark) -> Column:
    """Struct column (lang, score) for a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def guess(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for column in columns:
            langs, scores = [], []
            for group in text_groups(column.to_pylist()):
                names, share = known.predict(group)
                langs += names
                scores.append(share)
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score)], ["lang", "score"])

    return guess(text.cast("string"))
