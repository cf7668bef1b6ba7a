"""Small tables with the awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LONG = " ".join(f"word{k % 700} and{k % 11}," for k in range(3_000))
SHARED = "This very line is shared by a number of documents."
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
DOCS = [
    (1, "The cat sat on the mat.\n" + SHARED + "\nA line of its own here, long enough."),
    (2, SHARED + "\n" + SHARED + "\nThe dog lay on the rug and slept all day long."),
    (3, "  " + SHARED.upper() + " \nshort\nshort\n\n"),
    (4, None),
    (5, ""),
    (6, " \t\n "),
    (7, LONG),
    (8, LONG + " tail"),
    (9, "one"),
    (10, "one"),
    (11, "we repeat these five words we repeat these five words we repeat these five words again and again"),
    (12, f"Some text first. {PASSAGE.title()}! And more text after."),
    (13, f"{' '.join(f'filler{k}' for k in range(900))} {PASSAGE}"),
    (14, "short item here"),
    (15, "Ünïcödé — naïve café, 日本語 текст ﬁn <|endoftext|> # $ % & | < >"),
    (15, "the same id with another text, which is a different row of the table"),
    (16, "a repeated row that stands in the table twice, word for word"),
    (16, "a repeated row that stands in the table twice, word for word"),
    (None, "a row without an id\n" + SHARED),
    (17, "\n".join(f"line number {k} of a text with very many lines in it" for k in range(300))),
    (18, "\n".join(f"line number {k} of a text with very many lines in it" for k in range(290))),
    (19, "\n".join(f"line number {k} of a text with very many lines in it" for k in range(280))),
]
# Names that operators use inside, to see that columns of the input do not clash with them.
CLASHES = ["key", "n", "words", "hash", "doc", "digest", "_CELL", "position", "_found", "_found0", "_keep", "_lost", "_drop", "bucket"]


def write(folder, name, columns):
    pq.write_table(pa.table(columns), os.path.join(folder, f"{name}.parquet"))


def tables(folder, rows, pages, benchmark, labels):
    extra = {c: pa.array([f"x{k}" for k in range(len(rows))], pa.string()) for c in CLASHES}
    write(folder, "documents", {
        "doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()),
        "lang": pa.array([None if k % 5 == 4 else "en" for k in range(len(rows))], pa.string()),
        "source": pa.array(["s"] * len(rows), pa.string()),
        "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64()), **extra,
    })
    write(folder, "pages", {
        "page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages], pa.string()),
        "html": pa.array([p[2] for p in pages], pa.string()), "same": pa.array(["x"] * len(pages), pa.string()),
    })
    write(folder, "benchmark", {
        "item_id": pa.array([b[0] for b in benchmark], pa.int64()), "text": pa.array([b[1] for b in benchmark], pa.string()),
        "body": pa.array(["x"] * len(benchmark), pa.string()),
    })
    write(folder, "labels", {
        "doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int32()),
        "toxic": pa.array([x[1] for x in labels], pa.int32()),
    })
    return str(folder)


@pytest.fixture(scope="session")
def awkward(tmp_path_factory):
    pages = [
        (1, "http://a/", "<p>same</p>"), (2, "http://b/?q=%20 ü\r\nX: y", "<p>same</p>"), (3, None, "<p>same</p>"),
        (4, "http://c/", None), (5, "http://d/", ""), (6, "http://e/", "<p>" + "long, text " * 3_000 + "</p>"),
        (None, "http://f/", "<p>same</p>"), (7, "http://g/", "no tags at all"), (8, "http://h/", "<p>same</p>"),
    ]
    benchmark = [
        (1, PASSAGE), (2, "Short item HERE"), (3, None), (4, ""), (5, "!!! ---"), (6, PASSAGE + " upsilon"), (7, "one"),
    ]
    labels = [(1, 0), (2, None), (3, 1), (3, 0), (99, 1), (None, 1)]
    return tables(tmp_path_factory.mktemp("awkward"), DOCS, pages, benchmark, labels)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("empty"), [], [], [], [])
