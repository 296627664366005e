"""Order-independent hashes of hierarchies (AGG-02..06, AGG-14..16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.hashes import digest, of_children, rendered

#: Stands for an unknown source file, unless told otherwise.
NO_SOURCE = "unknown"


def merkle(nodes: DataFrame, keys: list[str], hash_col: str = "hash", distinct: bool = False, algorithm: str = "md5", counts: dict[str, str] | None = None) -> DataFrame:
    """keys, hash and summed counts: each group's digest from its rows' digests.

    counts names a result column for each column that is summed. Children of
    one parent meet in one row, as the parent's digest needs all of them.
    """
    collected = F.collect_set(hash_col) if distinct else F.collect_list(hash_col)
    sums = [F.sum(c).alias(to) for c, to in (counts or {}).items()]
    return nodes.groupBy(*keys).agg(of_children(collected, algorithm).alias("hash"), *sums)


def roll_up(leaves: DataFrame, levels: list[list[str]], distinct: bool = False) -> list[DataFrame]:
    """One table a level, from the finest: level i has keys levels[i], hash and n_leaves (AGG-03..05)."""
    out, below = [], leaves.withColumn("n_leaves", F.lit(1).cast("long"))
    for keys in levels:
        below = merkle(below, keys, distinct=distinct, counts={"n_leaves": "n_leaves"})
        out.append(below)
    return out


def unit_hash(packages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hash, tree (the sorted names of its packages) and tree_hash of each unit (AGG-14, AGG-16)."""
    made = packages.groupBy(*keys).agg(of_children(F.collect_list("hash")).alias("hash"), rendered(F.collect_list("package")).alias("tree"))
    return made.withColumn("tree_hash", digest(F.col("tree")))


def source_aware(units: DataFrame, app: str = "app_id", unit: str = "unit_id", cumulative: bool = False, no_source: str = NO_SOURCE) -> DataFrame:
    """app, unit, source_hash of units (app, unit, unit_hash, source_files) (AGG-15).

    Each unit has its own files; cumulative lets those of an app's units
    before it, in the order of their names, count too.
    """
    files = F.transform(F.coalesce("source_files", F.array().cast("array<string>")), lambda f: F.coalesce(f, F.lit(no_source)))
    if cumulative:
        so_far = W.partitionBy(app).orderBy(unit).rowsBetween(W.unboundedPreceding, 0)
        files = F.flatten(F.collect_list(files).over(so_far))
    made = units.withColumn("_files", rendered(files))
    return made.select(app, unit, digest(F.unhex(F.concat("unit_hash", digest(F.col("_files"))))).alias("source_hash"))
