"""Filter interaction audit: what each of five filters removes in every order of application.

Every document fails some set of the filters. One pass gives that set as five bits, and the documents of a part (a language)
are tabulated by it: at most 32 rows a part, whatever the size. From them come the removals of all 32 coalitions, that is
the documents that some filter of the coalition removes.

* A filter's step in an order is a difference of two coalitions: those before it with and without it.
* Its Shapley value is the solution of a constrained least squares problem: the additive game nearest to the coalition
  removals, each coalition weighted by the Shapley kernel, under the constraint that the shares of all filters add up to
  what all of them remove. The normal equations with that constraint are solved in rationals, so nothing is rounded;
  120 times the value is the sum of the filter's removals over all orders, an integer.

The filters (``MARKS`` etc. are parameters): A too few words; B too many repeated words; C too many capitals; D holds
a mark; E the text of a smaller document id. Identical texts are found by their SHA-256; a text that a third of all
documents share is dealt to cells first.

Defined cases: a null text counts as empty; a null language is the part ''; a null id is smaller and larger than none;
rows that share an id do not make each other copies; a document that has several labels counts once, as good or toxic
if any of them says so; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from functools import cache
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import materialise, salt_of, with_group_facts

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT = 80  # percent of the words
MAX_CAPITALS = 10  # percent of the code points
MARKS = "#$%&*|"
BLANKS = " \t\n\x0b\f\r"

_STEPS_SQL = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)
_STEPS = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())] + [
    (c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
])


# ------------------------------------------------------------ the five bits

def words_of(text: Column) -> Column:
    """Maximal runs of characters that are no ASCII white space."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def own_failures(
    text: Column, min_words: int = MIN_WORDS, min_distinct: int = MIN_DISTINCT, max_capitals: int = MAX_CAPITALS,
    marks: str = MARKS,
) -> Column:
    """Bits 0 to 3: which of the filters A to D a text fails, which it alone decides."""
    def bits(words: Column) -> Column:
        few = F.size(words) < min_words
        repeated = 100 * F.size(F.array_distinct(words)) < min_distinct * F.size(words)
        return few.cast("int") + 2 * repeated.cast("int")

    capitals = 100 * F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")) > max_capitals * F.char_length(text)
    marked = F.translate(text, marks, "") != text
    return F.element_at(F.transform(F.array(words_of(text)), bits), 1) + 4 * capitals.cast("int") + 8 * marked.cast("int")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", **limits) -> DataFrame:
    """(doc_id, part, failed, n): the bits of the filters a document fails; equal rows of one id are counted in ``n``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        own_failures(text, **limits).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    own = materialise(rows.groupBy("doc_id", "part", "own", "digest").agg(F.count(F.lit(1)).alias("n")), "failures")
    with_first = with_group_facts(
        own, ["digest"], salt_of(F.col("doc_id")),
        {"ids": F.count(F.lit(1)), "first": F.min("doc_id")}, {"ids": F.sum("ids"), "first_id": F.min("first")}, F.col("ids") > 1,
    )
    copy = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
    return with_first.select("doc_id", "part", (F.col("own") + 16 * copy.cast("int")).alias("failed"), "n")


def tabulate(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, failed, n, good, toxic): documents by the set of filters they fail; at most 32 rows a part.

    Rows that share an id, or have none, are added up before labels join them, so no id makes a large group.
    """
    known = labels.groupBy(F.col(id_col).alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    ).filter("doc_id IS NOT NULL")
    rows = failed.groupBy("doc_id", "part", "failed").agg(F.sum("n").alias("n"))
    joined = rows.join(known, "doc_id", "left")
    return joined.groupBy("part", "failed").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]
    )


# ---------------------------------------------------- coalitions and Shapley

def coalition_removals(counts: dict[int, int], players: int) -> list[int]:
    """For each set of filters, as bits, the documents that fail some filter in it."""
    return [sum(n for failed, n in counts.items() if failed & who) for who in range(1 << players)]


def kernel(players: int, size: int) -> Fraction:
    """Shapley kernel weight of a coalition that is neither empty nor whole."""
    return Fraction(players - 1, comb(players, size) * size * (players - size))


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The exact solutions of a regular linear system for several right-hand sides (as columns)."""
    rows = [list(a) + list(b) for a, b in zip(matrix, right)]
    n = len(rows)
    for k in range(n):
        pivot = next(r for r in range(k, n) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k])]
    return [row[n:] for row in rows]


@cache
def normal_inverse(players: int) -> tuple[tuple[Fraction, ...], ...]:
    """Inverse of the normal equations of the weighted least squares with the efficiency constraint as a border."""
    size = players + 1
    matrix = [[Fraction(0)] * size for _ in range(size)]
    for who in range(1, (1 << players) - 1):
        members = [i for i in range(players) if who >> i & 1]
        for i in members:
            for j in members:
                matrix[i][j] += kernel(players, len(members))
    for i in range(players):
        matrix[i][players] = matrix[players][i] = Fraction(1)
    unit = [[Fraction(int(i == j)) for j in range(size)] for i in range(size)]
    return tuple(map(tuple, solve(matrix, unit)))


def shapley(value: Sequence[int], players: int) -> list[Fraction]:
    """Shares of a game from the removals of all its coalitions, by constrained least squares in rationals."""
    right = [Fraction(0)] * (players + 1)
    for who in range(1, (1 << players) - 1):
        weighed = kernel(players, who.bit_count()) * value[who]
        for i in range(players):
            if who >> i & 1:
                right[i] += weighed
    right[players] = Fraction(value[-1])
    return [sum(a * b for a, b in zip(row, right)) for row in normal_inverse(players)[:players]]


def steps(part: str, n: dict[int, int], good: dict[int, int], toxic: dict[int, int], filters: str = FILTERS) -> list[tuple]:
    """All orders and steps of one part, from its documents by failed filters."""
    players = len(filters)
    everyone, orders = (1 << players) - 1, factorial(players)
    removed, lost_good, lost_toxic = (coalition_removals(c, players) for c in (n, good, toxic))
    total = sum(n.values())
    shares = [int(s * orders) for s in shapley(removed, players)]
    out = []
    for order in permutations(range(players)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone = removed[after] - removed[before]
            out.append((
                part, "".join(filters[k] for k in order), step, total - removed[after], gone, removed[1 << i] - gone,
                removed[everyone] - removed[everyone & ~(1 << i)], lost_good[after] - lost_good[before],
                lost_toxic[after] - lost_toxic[before], shares[i],
            ))
            before = after
    return out


def audit_table(table: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Steps of all orders for each part of a tabulation; a group is the at most 32 rows of a part."""

    def audit(rows: pa.Table) -> pa.Table:
        failed, part = rows.column("failed").to_pylist(), rows.column("part")[0].as_py()
        counts = [dict(zip(failed, rows.column(c).to_pylist())) for c in ("n", "good", "toxic")]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*steps(part, *counts, filters)), _STEPS)], schema=_STEPS)

    return table.groupBy("part").applyInArrow(audit, _STEPS_SQL)


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", **limits
) -> DataFrame:
    """One row per part, order and step: see ``steps``."""
    return audit_table(tabulate(failures(docs, id_col, text_col, part_col, **limits), labels))
