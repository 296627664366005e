"""The inverted index of library hashes, and what is counted of units (AGG-09..12, section 1.4 of the model)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import check_warehouse


def build_index(nodes: dict[str, DataFrame], libs: DataFrame) -> dict[str, DataFrame]:
    """Index tables from library fingerprints, whose app_id is the library's hash.

    index_package, index_class, index_method: (hash, lib_hash), one row an
    occurrence, so a hash that a library has twice votes twice; lib_classes:
    (lib_hash, class_key); class_methods: (class_key, hash, simple_hash); libs.
    """
    own = F.col("app_id").alias("lib_hash")
    key = F.concat_ws(":", "app_id", "package", "class_name")
    posting = lambda df: df.select("hash", own)
    return {
        "index_package": posting(nodes["packages"]),
        "index_class": posting(nodes["classes"]),
        "index_method": posting(nodes["methods"]),
        "lib_classes": nodes["classes"].select(own, key.alias("class_key")),
        "class_methods": nodes["methods"].select(key.alias("class_key"), "hash", "simple_hash"),
        "libs": libs.select("lib_hash", "name"),
    }


def write_index(index: dict[str, DataFrame], path: str, buckets: int = 64) -> None:
    """Each table as Parquet; postings sorted by hash, so that row groups can be skipped."""
    for name, df in index.items():
        df = df.repartitionByRange(buckets, "hash").sortWithinPartitions("hash") if name.startswith("index_") else df
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark, path: str) -> dict[str, DataFrame]:
    names = ("index_package", "index_class", "index_method", "lib_classes", "class_methods", "libs")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


#: What the tables of a bucketed index are dealt and sorted by.
BUCKETED = {"index_package": "hash", "index_class": "hash", "index_method": "hash", "lib_classes": "lib_hash", "class_methods": "class_key", "libs": "lib_hash"}


def save_index(index: dict[str, DataFrame], name: str, buckets: int = 64) -> None:
    """The index as tables of the warehouse, `name_table` each, in place of those there (SRC-18).

    Postings are bucketed and sorted by hash, all levels into as many buckets,
    so that a join with them shuffles the rows of apps only, once for rows
    that are bucketed alike. Bloom filters of the key in the files' footers
    leave out files and row groups where single hashes are looked up.
    """
    for table, key in BUCKETED.items():
        df = index[table]
        check_warehouse(df.sparkSession)
        rows = df.repartition(buckets, key)  # one file a bucket
        rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option(f"parquet.bloom.filter.enabled#{key}", "true").saveAsTable(f"{name}_{table}")


def load_index(spark: SparkSession, name: str) -> dict[str, DataFrame]:
    return {table: spark.table(f"{name}_{table}") for table in BUCKETED}


def postings_of(index: dict[str, DataFrame], level: str, hashes: list[str]) -> DataFrame:
    """hash, lib_hash of some hashes: a point read that the buckets and the Bloom filters narrow."""
    return index[f"index_{level}"].filter(F.col("hash").isin(hashes))


def apps_of_units(units: DataFrame) -> DataFrame:
    """unit_hash, apps (sorted), n_apps (AGG-09, AGG-10)."""
    return units.groupBy("unit_hash").agg(F.sort_array(F.collect_list("app_id")).alias("apps"), F.count("*").alias("n_apps"))


def tree_names(units: DataFrame) -> DataFrame:
    """tree_hash, tree (AGG-11)."""
    return units.groupBy("tree_hash").agg(F.min("tree").alias("tree"))


def tree_counts(units: DataFrame) -> DataFrame:
    """unit_hash, tree_hash, n (AGG-12)."""
    return units.groupBy("unit_hash", "tree_hash").agg(F.count("*").alias("n"))


def tree_count_map(units: DataFrame) -> DataFrame:
    """unit_hash and its trees' counts as a map (AGG-12)."""
    return tree_counts(units).groupBy("unit_hash").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tree_hash", "n")))).alias("trees"))
