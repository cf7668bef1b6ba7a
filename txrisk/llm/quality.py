"""Quality rules: base counts, and divergence of a document from what its language looks like.

Divergence. A document's shares of character classes and of a language's common words are two histograms. Each is
compared with the language's reference by the Jensen-Shannon distance (base 2, so between 0 and 1); a document's
divergence is the mean of both distances to the language where that is least. Short documents give no reliable
histogram: below ``MIN_WORDS`` words or ``MIN_CHARS`` characters the verdict is not used.

All of it is one projection over the documents: no shuffle, no Python, and every whole text is read once.

Base counts. Words are runs of anything but ASCII white space. A 5-word window found twice or more in a text makes all
its words repeated; windows are compared by 64-bit hashes.

Defined cases: a null text counts as empty; an empty text has no words and fails the base rule; repeated rows are
judged alike, each for itself; an empty table gives no rows; further columns are ignored by the query and kept by
``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MIN_CHARS = 200
LIMIT = 0.28  # prose labelled good stays below 0.25, symbol-laden and machine text lies around 0.35
SPACE = r"[\x20\x09-\x0D]+"
BREAKS = r'[\x20\x09-\x0D.,;:!?"()]+'

# Common words of each language, per thousand words of ordinary prose.
COMMON_WORDS = {
    "en": {
        "the": 60, "of": 30, "and": 28, "to": 26, "a": 22, "in": 20, "that": 11, "is": 10, "was": 10, "it": 9, "for": 9,
        "he": 7, "on": 7, "with": 7, "as": 7, "be": 6, "by": 5, "are": 5, "this": 5, "not": 5, "from": 4, "or": 4, "at": 4,
        "have": 4, "his": 4,
    },
    "de": {
        "der": 35, "die": 34, "und": 28, "in": 19, "den": 13, "von": 11, "zu": 11, "das": 11, "mit": 9, "sich": 8, "des": 8,
        "auf": 8, "für": 8, "ist": 8, "im": 8, "dem": 7, "nicht": 7, "ein": 7, "eine": 6, "als": 6, "auch": 5, "es": 5,
        "an": 5, "er": 4, "aus": 4,
    },
    "fr": {
        "de": 55, "la": 32, "le": 27, "et": 24, "les": 23, "des": 20, "en": 15, "un": 13, "du": 13, "une": 11, "que": 10,
        "est": 10, "pour": 9, "qui": 9, "dans": 9, "a": 8, "par": 7, "plus": 5, "pas": 5, "au": 5, "sur": 5, "ne": 5,
        "se": 4, "il": 6, "avec": 4,
    },
    "es": {
        "de": 60, "la": 38, "que": 28, "el": 28, "en": 26, "y": 25, "a": 19, "los": 16, "del": 11, "se": 11, "las": 10,
        "por": 9, "un": 9, "para": 8, "con": 8, "no": 8, "una": 7, "su": 6, "al": 6, "lo": 5, "es": 6, "como": 4,
        "más": 4, "o": 3, "sus": 3,
    },
}
# Shares of lower-case letters, upper-case letters, digits, white space, punctuation and all else.
CHARACTER_SHARES = {
    "en": (0.775, 0.025, 0.005, 0.165, 0.025, 0.005),
    "de": (0.765, 0.050, 0.005, 0.150, 0.025, 0.005),
    "fr": (0.775, 0.022, 0.005, 0.165, 0.028, 0.005),
    "es": (0.775, 0.022, 0.005, 0.165, 0.028, 0.005),
}
ALL_COMMON = sorted({w for words in COMMON_WORDS.values() for w in words})


def _without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, "")).cast("long")


def distance(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of counts / total to reference shares."""
    pairs = F.arrays_zip(counts.alias("n"), F.array(*[F.lit(float(q)) for q in reference]).alias("q"))

    def part(pair: Column) -> Column:
        p, q = pair["n"] / total, pair["q"]
        half = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / half)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / half)).otherwise(F.lit(0.0))

    summed = F.aggregate(pairs, F.lit(0.0), lambda acc, pair: acc + part(pair))
    return F.sqrt(F.greatest(summed / 2, F.lit(0.0)))


def word_reference(lang: str) -> list[float]:
    """Shares of the language's common words, in alphabetical order, and of all other words."""
    shares = [COMMON_WORDS[lang][w] / 1000 for w in sorted(COMMON_WORDS[lang])]
    return [*shares, 1 - sum(shares)]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base counts, divergence, base_failed, kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(
        "doc_id", text.alias("text"),
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.array_remove(F.split(F.lower(text), BREAKS), "").alias("tokens"),
    )
    # What is neither a small letter nor white space is a tenth of prose: the other classes are counted in that rest.
    step = step.withColumn("rest", F.regexp_replace("text", r"[\p{Ll}\x20\x09-\x0D]+", ""))
    step = step.select(
        "doc_id", "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("tokens").alias("n_tokens"),
        # The common words by their hashes, which are distinct: numbers are quicker to count than strings.
        F.transform(F.filter("tokens", lambda t: t.isin(ALL_COMMON)), lambda t: F.xxhash64(t)).alias("common"),
        F.char_length("rest").cast("long").alias("n_rest"),
        _without(F.col("rest"), r"[^#*$%&|<>]+").alias("n_symbols"),
        _without(F.col("rest"), r"[^\p{Lu}]+").alias("upper"),
        _without(F.col("rest"), r"[^\p{Nd}]+").alias("digits"),
        _without(F.col("rest"), r"""[^.,;:!?'"()-]+""").alias("marks"),
    )
    shifted = [F.slice("words", k, F.size("words") - 4) for k in range(1, 6)]
    windows = F.transform(F.arrays_zip(*shifted), lambda five: F.xxhash64(five))
    step = step.withColumn("windows", F.when(F.col("n_words") >= 5, windows).otherwise(F.array().cast("array<bigint>")))
    step = step.withColumn(
        "sorted",
        F.when(  # without a repeated window there is nothing to sort
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda c, i: F.struct(c.alias("c"), i.alias("i")))),
        ),
    )
    step = step.withColumn("repeated", F.array_sort(F.transform(
        F.filter(F.sequence(F.lit(1), F.size("sorted")), lambda k: _same(k, k - 1, k > 1) | _same(k, k + 1, k < F.size("sorted"))),
        lambda k: F.element_at("sorted", k)["i"],
    )))
    covered = F.aggregate(
        F.col("repeated"), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct((i + 5).alias("end"), (acc["n"] + i + 5 - F.greatest(i, acc["end"])).alias("n")),
        lambda acc: acc["n"],
    )
    step = step.withColumn("n_repeat_words", F.when(F.col("sorted").isNull(), F.lit(0).cast("long")).otherwise(covered))
    step = step.withColumn("divergence", _divergence())
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    good = F.col("divergence").isNull() | (F.col("divergence") <= LIMIT)
    return step.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "divergence",
        failed.alias("base_failed"), (~failed & good).alias("kept"),
    )


def _same(k: Column, other: Column, there: Column) -> Column:
    """Whether the k-th sorted window equals another one, if there is that one."""
    return F.when(there, F.element_at("sorted", k)["c"] == F.element_at("sorted", other)["c"]).otherwise(F.lit(False))


def _divergence() -> Column:
    """Least mean distance over the languages; null for documents that are too short."""
    lower, spaces = F.col("word_chars") - F.col("n_rest"), F.col("n_chars") - F.col("word_chars")
    others = F.col("n_rest") - F.col("upper") - F.col("digits") - F.col("marks")
    classes = F.array(lower, F.col("upper"), F.col("digits"), spaces, F.col("marks"), others)
    means = []
    for lang, words in COMMON_WORDS.items():
        counts = [F.size("common") - F.size(F.array_remove("common", F.xxhash64(F.lit(w)))) for w in sorted(words)]
        histogram = F.array(*counts, F.col("n_tokens") - sum(counts[1:], counts[0]))
        means.append((
            distance(histogram, F.col("n_tokens"), word_reference(lang))
            + distance(classes, F.col("n_chars"), list(CHARACTER_SHARES[lang]))
        ) / 2)
    long_enough = (F.col("n_words") >= MIN_WORDS) & (F.col("n_chars") >= MIN_CHARS) & (F.col("n_tokens") > 0)
    return F.when(long_enough, F.least(*means))
