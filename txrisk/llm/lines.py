"""Line dedup: lines that many documents share survive only in the document with the largest id.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. Keys of at least ``MIN_CHARS``
code points found in at least ``MIN_DOCS`` documents lose all their lines except in the largest document id.

Lines become (hash of the key, document, position). They are range-partitioned by (hash, cell) and sorted inside by
document and position, so that a window streams over each hash's occurrences, sees the largest document first and counts
each document at its first occurrence. The cell comes from the document, so a line that a third of all documents share
is spread over ``SALTS`` cells, and only one row per cell and hash goes on to be added up. Texts never move for this:
the result is a compressed keep bitmap per document.

Defined cases: a null or empty text is one empty line and loses nothing; a null document id counts as one document that
is smaller than all others; repeated rows count as one document and lose the same lines; an empty table gives no rows;
further columns are carried along by ``drop_shared_lines``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import fresh, materialise, salt_of

MIN_CHARS = 20
MIN_DOCS = 3
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased; a text of ASCII alone takes the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_digest(text: Column) -> Column:
    """Tells rows of one document id apart by their texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hash, cell, doc, digest, position) of all lines whose keys are long enough, written once.

    The texts are split and hashed in one scan; all that follows reads these short rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc"), text_digest(text).alias("digest"),
        F.posexplode(F.split(lower_ascii(text), "\n", -1)).alias("position", "line"),
    ).filter(F.octet_length("line") >= min_chars).select("doc", "digest", "position", F.btrim("line", F.lit(BLANKS)).alias("key"))
    rows = rows.filter(F.char_length("key") >= min_chars).select(
        F.unhex(F.md5("key")).alias("hash"), salt_of(F.col("doc")).alias("cell"), "doc", "digest", "position"
    )
    return materialise(rows, "lines")


def shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(doc, digest, position) of the lines to drop."""
    rows = occurrences(docs, id_col, text_col, min_chars)
    dealt = rows.repartitionByRange(F.col("hash"), F.col("cell"))
    in_cell = Window.partitionBy("hash", "cell").orderBy(F.col("doc").desc_nulls_last(), "position")
    opens = F.row_number().over(in_cell) == 1
    streamed = dealt.select(
        "hash", "cell", "doc", opens.alias("opens"),
        (opens | ~F.col("doc").eqNullSafe(F.lag("doc").over(in_cell))).alias("first_in_doc"),
    )
    cells = streamed.groupBy("hash", "cell").agg(
        F.count_if("first_in_doc").alias("docs"), F.max(F.when(F.col("opens"), F.col("doc"))).alias("largest")
    )
    shared = cells.groupBy("hash").agg(F.sum("docs").alias("docs"), F.max("largest").alias("largest")).filter(
        F.col("docs") >= min_docs
    )
    placed = cells.select("hash", "cell").join(shared.select("hash", "largest"), "hash")
    lost = rows.join(placed, ["hash", "cell"])
    return lost.filter(~F.col("doc").eqNullSafe(F.col("largest"))).select("doc", "digest", "position")


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, digest, n_dropped, keep) for documents that lose lines.

    ``keep`` holds 64-line words (word number, bits; bit b set: line 64 * word + b stays), only those that are not all
    ones, in order: documents that lose few lines have short bitmaps.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("position") % 64).cast("int"))
    words = dropped.groupBy("doc", "digest", F.floor(F.col("position") / 64).cast("int").alias("word")).agg(
        F.bit_or(bit).alias("lost")
    )
    return words.groupBy("doc", "digest").agg(
        F.sum(F.bit_count("lost")).cast("long").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("bits")))).alias("keep"),
    )


def line_count(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps."""
    lost = F.flatten(F.transform(keep, lambda w: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w["bits"], b) == 0),
        lambda b: w["word"] * 64 + b,
    )))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    return F.transform(left, lambda k: F.get(lines, k))


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> tuple[DataFrame, str, str]:
    """``docs`` with the keep bitmap and the number of lost lines of each row, and the names of these two columns.

    Only documents that lose lines have a bitmap. The bitmaps are the small side of a hash join, so texts are moved
    once and not sorted.
    """
    maps = keep_bitmaps(shared_lines(docs, id_col, text_col, **limits))
    doc, digest, keep, lost = (fresh(docs, c) for c in ("_doc", "_digest", "_keep", "_lost"))
    maps = maps.select(F.col("doc").alias(doc), F.col("digest").alias(digest), F.col("keep").alias(keep), F.col("n_dropped").alias(lost))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(doc)) & (text_digest(F.col(f"`{text_col}`").cast("string")) == F.col(digest))
    return docs.join(maps.hint("shuffle_hash"), same, "left").drop(doc, digest), keep, lost


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, the keep bitmap, and the kept text."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found, keep, lost = with_bitmaps(narrow, "doc_id", "text", **limits)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.when(F.col(keep).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept_lines(lines, F.col(keep)), "\n"))
    return found.select(
        "doc_id", line_count(F.coalesce("text", F.lit(""))).alias("n_lines"), F.coalesce(F.col(lost), F.lit(0).cast("long")).alias("n_dropped"),
        F.col(keep).alias("keep"), kept.alias("text"),
    )


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with shared lines taken out of the texts; all columns and rows stay, null texts stay null."""
    found, keep, _ = with_bitmaps(docs, id_col, text_col, **limits)
    text = F.col(f"`{text_col}`")
    cut = F.array_join(kept_lines(F.split(text, "\n", -1), F.col(keep)), "\n")
    new = F.when(F.col(keep).isNull(), text).otherwise(cut).alias(text_col)
    return found.select(*[new if c == text_col else F.col(f"`{c}`") for c in docs.columns])
