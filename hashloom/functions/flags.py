"""Access flags as columns (FN-17) and the filters made of them (FLT-05, FLT-07, FLT-12, FLT-13)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Access flags of the class file format.
FLAGS = {"public": 0x1, "private": 0x2, "protected": 0x4, "static": 0x8, "final": 0x10, "synchronized": 0x20, "bridge": 0x40, "varargs": 0x80, "native": 0x100, "interface": 0x200, "abstract": 0x400, "strict": 0x800, "synthetic": 0x1000, "annotation": 0x2000, "enum": 0x4000}


def has(flags: Column, *names: str) -> Column:
    """Whether any of the named flags is set."""
    mask = 0
    for n in names:
        mask |= FLAGS[n]
    return flags.bitwiseAND(F.lit(mask)) != 0


def written_by_hand(flags: Column) -> Column:
    """Not generated by a compiler (FLT-05)."""
    return ~has(flags, "bridge", "synthetic")


def public_only(flags: Column) -> Column:
    return has(flags, "public")


def candidate_class(flags: Column, name: Column) -> Column:
    """A class that may be looked up by itself (FLT-12)."""
    return ~has(flags, "interface", "abstract") & ~name.contains("$")


def candidate_method(flags: Column) -> Column:
    """A method that counts as shared in a verification (FLT-13)."""
    return ~has(flags, "synthetic", "bridge", "abstract")


def names_of(flags: Column) -> Column:
    """The set flags' names as an array."""
    return F.filter(F.array(*[F.when(has(flags, n), F.lit(n)) for n in FLAGS]), lambda x: x.isNotNull())
