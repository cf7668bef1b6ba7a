"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

Toxic documents go; lines that many documents share go, but for one copy; one document of each group of near-duplicates
(five-word shingles, similarity of 0.8 or more) stays; documents that hold benchmark passages go; what is left is packed
into sequences of at most 4096 tokens. All stages but the last return the columns of ``documents``.

Defined cases. Null and empty texts are clean, lose no line, have no near-duplicate and no benchmark passage, and are
packed as one end id. Rows without an id are kept or dropped by their own text; of a group of near-duplicates the row with
the least id stays, all rows if none has an id, and rows that share the least id all stay. Repeated rows are judged alike.
A line that documents share stays in the one with the largest id. Whole texts are read, however long they are. Empty
tables give no rows, and without labels the lexicon holds its general terms only. Further columns, whatever their
names, are carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import decontam, lines, neardup, packing, toxicity
from txrisk.llm.common import materialise, table
from txrisk.llm.queries import learnable_labels, word_tokenizer

ORACLE_SQL = None  # a learnt score and a tokenizer are beyond SQL; tests hold the stages against brute force


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold; the model learns from the labelled documents of the whole table."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), learnable_labels(spark, sf_dir))
    return docs.filter(toxicity.scored(model, F.col("text"), spark) < toxicity.THRESHOLD)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without shared lines; ``n_chars`` follows the new text."""
    cut = lines.drop_shared_lines(docs)
    return cut.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the least id."""
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty lies in a benchmark window."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
