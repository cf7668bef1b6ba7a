"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted timestamp formats, tried in this order. A fraction of one to
# six digits is accepted; month-first wins over day-first when both can be read.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]",
    "MM/dd/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
]


def safe_divide(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """The quotient, or ``default`` for a zero or missing operand."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(default))


def ratio(a: str | Column, b: str | Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return safe_divide(a.cast("double"), b.cast("double"))


def safe_log(value: Column, default: float = 0.0) -> Column:
    """Natural logarithm, or ``default`` for values that have none."""
    return F.coalesce(F.when(value > 0, F.log(value)), F.lit(default))


def finite_or(value: Column, default: float = 0.0) -> Column:
    """NaN becomes ``default``, +inf 1 and -inf 0."""
    return (
        F.when(F.isnan(value), F.lit(default))
        .when(value == float("inf"), F.lit(1.0))
        .when(value == float("-inf"), F.lit(0.0))
        .otherwise(value)
    )


def probability(value: Column) -> Column:
    """A usable probability: NaN or NULL is 0.5, everything else lies in [0, 1]."""
    known = finite_or(F.coalesce(value.cast("double"), F.lit(float("nan"))), 0.5)
    return F.greatest(F.least(known, F.lit(1.0)), F.lit(0.0))


def parse_timestamp(text: Column) -> Column:
    """The first format that reads the whole text; then Spark's own ISO parser."""
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMATS]
    return F.coalesce(*tries, text.try_cast("timestamp"))


def text_or(name: str, default: str) -> Column:
    """The text, or ``default`` when it is missing or empty."""
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))
