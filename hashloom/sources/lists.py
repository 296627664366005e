"""Lists that name libraries, apps and files (SRC-12..16, SRC-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .sinks import read_profile


def libraries(spark: SparkSession, path: str) -> DataFrame:
    """lib_hash, representative, packages of lines ``hash[,representative],pkg/pkg/...`` (SRC-14)."""
    parts = F.split("value", ",")
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return lines.select(
        parts[0].alias("lib_hash"),
        F.when(F.size(parts) > 2, parts[1]).otherwise(parts[0]).alias("representative"),
        F.filter(F.split(F.element_at(parts, -1), "/"), lambda p: p != "").alias("packages"),
    )


def app_libraries(spark: SparkSession, path: str) -> DataFrame:
    """app_id, pos, lib_hash of lines ``app---lib,lib,...`` (SRC-15)."""
    halves = F.split("value", "---")
    lines = spark.read.text(path).filter(F.col("value").contains("---"))
    return lines.select(halves[0].alias("app_id"), F.posexplode(F.split(halves[1], ",")).alias("pos", "lib_hash")).filter("lib_hash <> ''")


def words(spark: SparkSession, path: str, name: str = "key") -> DataFrame:
    """Lines that are not blank, trimmed: an exclusion list (SRC-16)."""
    return spark.read.text(path).select(F.trim("value").alias(name)).filter(F.length(name) > 0)


def files(spark: SparkSession, path: str, suffix: str, deep: bool = False, content: bool = False) -> DataFrame:
    """path, length and on demand content of the files with a suffix, flat or recursive (SRC-12, SRC-13)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", str(deep).lower()).load(path)
    return found.select("path", "length", *(["content"] if content else []))


def profile(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The node and edge tables that PARSE runs wrote (SRC-11)."""
    return read_profile(spark, path)
