"""Set operations, range lookup, prefix search and trees of names (SET-*, SRC-17, TOP-08, TR-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names as nm


def range_lookup(keys: DataFrame, key: str, bounds: list) -> DataFrame:
    """keys and bound: the first of a fixed, sorted list of upper bounds at or above key, null beyond the last (SRC-17)."""
    return keys.withColumn("bound", F.get(F.filter(F.lit(sorted(bounds)), lambda b: b >= F.col(key)), F.lit(0)) if len(bounds) <= 64 else _bisect(F.col(key), sorted(bounds)))


def _bisect(value: Column, bounds: list) -> Column:
    table, n = F.lit(bounds), len(bounds)
    steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)]
    below = lambda i: (i <= n) & (F.get(table, (i - 1).cast("int")) < value)
    at = F.aggregate(F.lit(steps), F.lit(0), lambda a, s: F.when(below(a + s), a + s).otherwise(a))
    return F.when(value.isNotNull(), F.get(table, at))


def difference(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Rows of left whose keys right lacks (SET-03)."""
    return left.join(right, [*keys], "left_anti")


def union_distinct(*tables: DataFrame) -> DataFrame:
    """SET-01, SET-02."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def bag_intersection(a: Column, b: Column) -> Column:
    """How many elements of array a array b has, repeats counted (SET-04)."""
    return F.size(F.filter(a, lambda x: F.array_contains(b, x)))


def same_elements(a: Column, b: Column) -> Column:
    """Whether two arrays have the same elements (SET-05)."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def roots(nodes: DataFrame, name: str = "name", group: tuple[str, ...] = ()) -> DataFrame:
    """Names none of whose ancestors is a node (SET-06)."""
    names = nodes.select(*group, name).distinct()
    above = names.select(*group, name, F.explode(F.slice(nm.prefixes(F.col(name)), 1, 1 << 20)).alias("up")).filter(F.col("up") != F.col(name))
    has_above = above.join(names.withColumnRenamed(name, "up"), [*group, "up"], "left_semi").select(*group, name).distinct()
    return names.join(has_above, [*group, name], "left_anti")


def prefix_search(table: DataFrame, name: str, prefix: str, limit: int) -> DataFrame:
    """The first limit names with a prefix; the range reaches the scan's statistics (TOP-08)."""
    return table.filter(F.col(name).startswith(prefix)).orderBy(name).limit(limit)


def completion(table: DataFrame, name: str, prefix: str) -> DataFrame:
    """One row: the longest text that all names with a prefix begin with (TR-07).

    It is what the smallest and the largest of those names have in common.
    """
    ends = table.filter(F.col(name).startswith(prefix)).agg(F.min(name).alias("lo"), F.max(name).alias("hi"))
    cut = F.aggregate(F.sequence(F.lit(1), F.length("lo")), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(F.col("lo"), F.lit(1), i) == F.substring(F.col("hi"), F.lit(1), i)), i).otherwise(n))
    return ends.select(F.when(F.col("lo").isNotNull(), F.substring(F.col("lo"), F.lit(1), cut)).alias("completion"))


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """table without the rows whose key gone has (TR-07: delete)."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with rows replaced or added by changes' (TR-07: insert, replace)."""
    return table.join(changes, key, "left_anti").unionByName(changes)
