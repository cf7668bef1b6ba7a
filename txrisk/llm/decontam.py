"""Benchmark decontamination: a broadcast set of test n-grams, scanned over training token windows.

Contract of the scan. Words are maximal runs of ASCII letters, digits and non-ASCII characters, after A-Z are
lower-cased. A benchmark window is ``n`` consecutive words of an item; an item with fewer words, but at least one,
is one window of all its words. A document word is hit if it lies inside any occurrence of a window.

Defined cases: a null or empty text has no words and no hits and is not contaminated; null and empty items give no
window; repeated items with one id count once, items with a null id mark words but are not named; repeated
document rows are judged alike, each for itself; an empty benchmark hits nothing; further columns are carried along
untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm import text as T
from txrisk.llm.common import fresh, materialise

WINDOW = 13
SHARE = 20  # contaminated: hit words are at least one in this many
BLOCK_WORDS = 2_000_000  # words of benchmark text that go into one broadcast set
PASS_BLOCKS = 4  # such sets that are broadcast at once

_HITS = pa.struct([
    ("n_words", pa.int64()),
    ("hits", pa.list_(pa.struct([("first", pa.int32()), ("length", pa.int32())]))),
    ("items", pa.list_(pa.string())),
])
_HITS_SQL = "struct<n_words:bigint,hits:array<struct<first:int,length:int>>,items:array<string>>"
_FILTER_BITS = 22


class WindowSet:
    """Windows of some benchmark items: hashes for the scan, exact words for the verification."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.exact: dict[bytes, set[str | None]] = {}
        by_length: dict[int, list[np.ndarray]] = {}
        for name, body in items:
            texts = next(T.chunks(pa.array([body or ""], pa.string())))
            word = T.words(texts, T.ALNUM)
            count = len(word.hash)
            if not count:
                continue
            length = min(n, count)
            first, code = T.windows(word, length)
            by_length.setdefault(length, []).append(code)
            for at in first:
                self.exact.setdefault(T.word_bytes(texts, word, at, length), set()).add(name)
        self.codes = {length: np.unique(np.concatenate(c)) for length, c in by_length.items()}
        self.filters = {}
        for length, codes in self.codes.items():
            self.filters[length] = np.zeros(1 << _FILTER_BITS, bool)
            self.filters[length][codes >> np.uint64(64 - _FILTER_BITS)] = True

    def scan(self, texts: T.Texts) -> tuple[np.ndarray, list[list[dict]], list[set[str | None]]]:
        """Words per text, and verified hits (first word, length) and items per text."""
        word = T.words(texts, T.ALNUM)
        hits: list[list[dict]] = [[] for _ in range(len(texts))]
        items: list[set[str | None]] = [set() for _ in range(len(texts))]
        for length, codes in self.codes.items():
            first, code = T.windows(word, length)
            near = np.flatnonzero(self.filters[length][code >> np.uint64(64 - _FILTER_BITS)])
            near = near[np.isin(code[near], codes)]
            for at in first[near]:
                names = self.exact.get(T.word_bytes(texts, word, at, length))
                if names is not None:
                    text = int(np.searchsorted(word.first, at, "right")) - 1
                    hits[text].append({"first": int(at - word.first[text]), "length": length})
                    items[text] |= names
        return word.counts(), hits, items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> Iterator[WindowSet]:
    """The benchmark in sets of bounded size: its words are counted first, and items are dealt to blocks."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("body"))
    total = items.agg(F.sum(F.size(F.split("body", r"\s+"))).alias("n")).first()["n"] or 0
    count = 1 + total // BLOCK_WORDS
    for block in range(count):
        mine = items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(count)) == block)
        yield WindowSet([(r["item"], r["body"]) for r in mine.toLocalIterator()], n)


def _scanner(shared: Broadcast):
    @F.arrow_udf(_HITS_SQL)
    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = shared.value
        for column in columns:
            rows = []
            for texts in T.chunks(column):
                counts, hits, items = found.scan(texts)
                rows += [
                    {"n_words": int(c), "hits": h, "items": sorted(i for i in s if i is not None)}
                    for c, h, s in zip(counts, hits, items)
                ]
            yield pa.array(rows, _HITS)

    return scan


def scan(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", n: int = WINDOW,
) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (n_words, hits, items), and that column's name.

    ``hits`` are (first word, number of words) of verified occurrences, ``items`` the ids of the items found.
    The benchmark reaches the tasks in sets of at most about ``BLOCK_WORDS`` words, and at most ``PASS_BLOCKS`` of them in
    one pass over the documents. After a pass its finds are written and its sets are given back before the next are
    made, so what is broadcast at once does not grow with the benchmark, and nothing of it is left out.
    """
    spark = docs.sparkSession
    name = fresh(docs, "_found")
    out, parts, shared = docs, [], []
    for block in _blocks(benchmark, item_col, item_text_col, n):
        if len(shared) == PASS_BLOCKS:
            out = materialise(out, "scanned")
            for old in shared:
                old.destroy()
            shared = []
        shared.append(spark.sparkContext.broadcast(block))
        parts.append(fresh(docs, f"_found{len(parts)}"))
        out = out.withColumn(parts[-1], _scanner(shared[-1])(F.col(f"`{text_col}`").cast("string")))
    if len(parts) == 1:
        return out.withColumnRenamed(parts[0], name), name
    merged = F.struct(
        F.col(f"{parts[0]}.n_words").alias("n_words"),
        F.flatten(F.array(*[F.col(f"{p}.hits") for p in parts])).alias("hits"),
        F.array_distinct(F.flatten(F.array(*[F.col(f"{p}.items") for p in parts]))).alias("items"),
    )
    return out.withColumn(name, merged).drop(*parts), name


def hit_words(found: str) -> Column:
    """How many words lie in at least one hit: hits in order of their first word, each adds what is new."""
    ordered = F.array_sort(F.col(f"{found}.hits"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, hit):
        stop = hit["first"] + hit["length"]
        new = F.greatest(stop - F.greatest(hit["first"], acc["end"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], stop).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(ordered, start, step, lambda acc: acc["n"])


def is_contaminated(n_hit: Column, n_words: Column, share: int = SHARE) -> Column:
    return (n_hit > 0) & (n_hit * share >= n_words)


def verdicts(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (sorted as strings), contaminated."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanned, found = scan(kept, benchmark)
    rows = scanned.select(
        "doc_id", F.col(f"{found}.n_words").alias("n_words"), hit_words(found).alias("n_hit"),
        F.array_sort(F.col(f"{found}.items")).alias("items"),
    )
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", remove: str = "documents") -> DataFrame:
    """``docs`` without contamination, all columns kept.

    ``remove="documents"`` drops contaminated documents; ``remove="spans"`` cuts the hit words, from the first
    byte of a hit's first word to the last byte of its last, out of every text that has any.
    """
    if remove == "spans":
        return _without_spans(docs, benchmark, text_col)
    scanned, found = scan(docs, benchmark, text_col)
    bad = is_contaminated(hit_words(found), F.col(f"{found}.n_words"))
    return scanned.filter(~bad).drop(found)


def _cutter():
    @F.arrow_udf("string")
    def cut(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, hits in columns:
            out = []
            for body, spans in zip(bodies.to_pylist(), hits.to_pylist()):
                if not spans:
                    out.append(body)
                    continue
                texts = next(T.chunks(pa.array([body], pa.string())))
                word = T.words(texts, T.ALNUM)
                keep = np.ones(len(texts.raw), bool)
                for span in spans:
                    keep[word.begin[span["first"]] : word.end[span["first"] + span["length"] - 1]] = False
                out.append(texts.raw[keep].tobytes().decode())
            yield pa.array(out, pa.string())

    return cut


def _without_spans(docs: DataFrame, benchmark: DataFrame, text_col: str) -> DataFrame:
    scanned, found = scan(docs, benchmark, text_col)
    cut = _cutter()(F.col(text_col), F.col(f"{found}.hits")).alias(text_col)
    return scanned.select(*[cut if c == text_col else F.col(f"`{c}`") for c in docs.columns])
