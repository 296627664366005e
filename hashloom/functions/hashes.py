"""Digests as columns (FN-01..03, FN-27) and the order of their bytes (SRT-01)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Digests by name (UDF-01): each takes a string or binary column and gives lower-case hex.
DIGESTS = {"md5": lambda c: F.md5(c), "sha1": lambda c: F.sha1(c), "sha256": lambda c: F.sha2(c, 256)}


def digest(value: Column, algorithm: str = "md5") -> Column:
    return DIGESTS[algorithm](value)


def to_hex(value: Column, upper: bool = False) -> Column:
    return F.hex(value) if upper else F.lower(F.hex(value))


def from_hex(text: Column) -> Column:
    return F.unhex(text)


def of_children(hashes: Column, algorithm: str = "md5", distinct: bool = False) -> Column:
    """The digest of a node from its children's hex digests, in the order of their bytes (AGG-02).

    Lower-case hex sorts as the unsigned bytes do, so the order of children does not matter.
    """
    hashes = F.array_distinct(hashes) if distinct else hashes
    return digest(F.unhex(F.array_join(F.sort_array(hashes), "")), algorithm)


def same_start(a: Column, b: Column, n: int = 16) -> Column:
    """Whether two binaries agree in their first n bytes (FN-27)."""
    return F.substring(a, 1, n) == F.substring(b, 1, n)


def rendered(values: Column) -> Column:
    """A set of texts as [a, b, c], sorted (AGG-16)."""
    return F.concat(F.lit("["), F.array_join(F.sort_array(F.array_distinct(values)), ", "), F.lit("]"))
