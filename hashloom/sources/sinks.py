"""What the programs write (SNK-01..08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .runs import Runs

PROFILE = ("apps", "packages", "classes", "methods", "edges")


def write_profile(tables: dict[str, DataFrame], path: str, run: str | None = None) -> bool:
    """Node and edge tables of a run's apps, which take the place of those that they had (SNK-01, SNK-02).

    All tables count at once or not at all; a run whose name was written
    before changes nothing, and False is returned.
    """
    return Runs(tables["apps"].sparkSession, path).write(tables, run)


def read_profile(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a profile: of each app those of the latest run that has it."""
    runs = Runs(spark, path)
    return {n: df for n in PROFILE if (df := runs.read(n, ["app_id"], "apps")) is not None}


def write_unit_hashes(units: DataFrame, path: str, run: str | None = None) -> bool:
    """app_id, unit_hash, source_hash, one row a unit hash of an app: the latest counts (SNK-04)."""
    return Runs(units.sparkSession, path).write({"unit_hashes": units.groupBy("app_id", "unit_hash").agg(F.min("source_hash").alias("source_hash"))}, run)


def read_unit_hashes(spark: SparkSession, path: str) -> DataFrame | None:
    return Runs(spark, path).read("unit_hashes", ["app_id", "unit_hash"])


def write_provenance(found: DataFrame, path: str, run: str | None = None) -> bool:
    """lib_hash, app_id: the app that a library was taken from, the latest counts (SNK-05)."""
    return Runs(found.sparkSession, path).write({"provenance": found.select("lib_hash", "app_id")}, run)


def read_provenance(spark: SparkSession, path: str) -> DataFrame | None:
    return Runs(spark, path).read("provenance", ["lib_hash"])


def report_lines(matches: DataFrame) -> DataFrame:
    """app_id, line of the matches (SNK-06)."""
    start = F.when(F.col("fully"), F.lit("Fully found lib: ")).otherwise(F.lit("found lib: "))
    return matches.select("app_id", F.concat(start, F.col("unit_id"), F.lit("---->"), F.col("name")).alias("line"))


def write_report(matches: DataFrame, path: str) -> None:
    """Lines as text, a folder an app (SNK-07)."""
    report_lines(matches).withColumnRenamed("line", "value").write.mode("overwrite").partitionBy("app_id").text(path)


def node_statistics(nodes: dict[str, DataFrame]) -> DataFrame:
    """kind, n: how many nodes of each kind there are (SNK-08, AGG-20)."""
    out = None
    for kind, df in nodes.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out
