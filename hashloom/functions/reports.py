"""Readable figures (FN-23) and operators (FN-24) as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Operators as written, by name.
COMPARISONS = {"EQ": "==", "NE": "!=", "LT": "<", "GE": ">=", "GT": ">", "LE": "<="}


def duration(ms: Column) -> Column:
    """Milliseconds as hours, minutes, seconds and milliseconds."""
    s = F.floor(ms / 1000)
    return F.format_string("%d h %d m %d s %d ms", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def size(n: Column) -> Column:
    """Bytes in the largest unit of 1024 that keeps the figure at one or more."""
    unit = F.least(F.lit(4), F.when(n < 1, F.lit(0)).otherwise(F.floor(F.log(F.lit(1024.0), n.cast("double")))))
    return F.concat(F.round(n / F.pow(F.lit(1024.0), unit), 2).cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), (unit + 1).cast("int")))


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole != 0, F.round(100.0 * part / whole, digits))


def comparison(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in COMPARISONS.items() for x in kv]), name)
