"""The four programs as functions of tables; each returns lazy DataFrames or writes its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashes import digest, of_children, rendered
from ..operators import edges as ed, filters, match as mt, units as un
from ..operators.fingerprint import FingerprintConfig, fingerprint
from ..operators.index import build_index, write_index
from ..operators.merkle import NO_SOURCE, source_aware
from ..sources.runs import UnitState
from ..sources.sinks import read_profile, write_profile, write_provenance, write_report, write_unit_hashes
from ..storage import materialize, scope

INPUT = ("apps", "classes", "methods", "framework_types")


def read_input(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The decoded tables of apps."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in INPUT}


def parse(tables: dict[str, DataFrame], done: DataFrame | None = None, config: FingerprintConfig = FingerprintConfig()) -> dict[str, DataFrame]:
    """Node tables, apps and edges of apps that are not done yet (PARSE), each level written once and read by the next."""
    apps = filters.not_yet_done(tables["apps"], "app_id", done) if done is not None else tables["apps"]
    mine = lambda n: tables[n].join(apps.select("app_id"), "app_id", "left_semi")
    classes, methods = mine("classes"), mine("methods")
    nodes = fingerprint(classes, methods, tables["framework_types"], config, materialize, uses=True)
    hashed = apps.join(nodes["apps"].select("app_id", "hash"), "app_id")
    return {"apps": hashed, "packages": nodes["packages"], "classes": nodes["classes"], "methods": nodes["methods"], "edges": ed.edges_of_uses(classes, nodes["uses"])}


def candidate_units(profile: dict[str, DataFrame], split=None, split_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """app_id, unit_id, packages."""
    classified = materialize(ed.classify(profile["edges"], profile["apps"]), "edges")
    return un.candidate_units(profile["packages"], classified, profile["apps"], split, split_prefixes)


def cluster(profile: dict[str, DataFrame], cumulative: bool = False, no_source: str = NO_SOURCE) -> DataFrame:
    """app_id, unit_id, unit_hash, tree, tree_hash, source_hash of every unit (CLUSTER)."""
    units = candidate_units(profile).select("app_id", "unit_id", F.explode("packages").alias("package"))
    packages = units.join(profile["packages"], ["app_id", "package"])
    sources = profile["classes"].groupBy("app_id", "package").agg(F.collect_set(F.coalesce("source_file", F.lit(no_source))).alias("files"))
    made = packages.join(sources, ["app_id", "package"], "left").groupBy("app_id", "unit_id").agg(
        of_children(F.collect_list("hash")).alias("unit_hash"), rendered(F.collect_list("package")).alias("tree"), F.array_distinct(F.flatten(F.collect_list("files"))).alias("source_files")
    )
    return made.withColumn("tree_hash", digest(F.col("tree"))).join(source_aware(made, cumulative=cumulative, no_source=no_source), ["app_id", "unit_id"]).drop("source_files")


def store(libs: DataFrame, candidates: DataFrame, profile: dict[str, DataFrame]) -> DataFrame:
    """lib_hash, app_id: the first candidate app whose packages reproduce a library's hash (STORE).

    libs: (lib_hash, packages); candidates: (lib_hash, app_id, pos).
    """
    rows = candidates.join(libs.select("lib_hash", F.explode("packages").alias("package")), "lib_hash").join(profile["packages"], ["app_id", "package"])
    return mt.first_app(candidates, rows.groupBy("app_id", "lib_hash").agg(of_children(F.collect_list("hash")).alias("hash")))


def library_profile(found: DataFrame, libs: DataFrame, profile: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Node tables of found libraries, under their hashes: what an index is built from."""
    own = found.join(libs.select("lib_hash", F.explode("packages").alias("package")), "lib_hash")
    take = lambda n: profile[n].join(own, ["app_id", "package"]).drop("app_id").withColumnRenamed("lib_hash", "app_id")
    return {n: take(n) for n in ("packages", "classes", "methods")}


def match(profile: dict[str, DataFrame], index: dict[str, DataFrame], split=None, split_prefixes: tuple[str, ...] = (), passes: tuple[str, ...] = ()) -> DataFrame:
    """The libraries found in every app (MATCH); passes, off by default, look among what is left of it (class, method)."""
    units = materialize(candidate_units(profile, split, split_prefixes), "units")
    return mt.match_globally(units, profile, index, passes) if passes else mt.match_apps(units, profile, index)


def enrich(profile: dict[str, DataFrame], classes: DataFrame, apps: DataFrame) -> dict[str, DataFrame]:
    """profile with source files and main activities from decoded tables (OTHER, JN-12)."""
    named = profile["classes"].drop("source_file").join(classes.select("app_id", "class_desc", "source_file"), ["app_id", "class_desc"], "left")
    started = profile["apps"].drop("main_activity").join(apps.select("app_id", "main_activity"), "app_id", "left")
    return profile | {"classes": named, "apps": started}


def run(spark: SparkSession, mode: str, source: str, target: str, **options) -> None:
    """One program by name, from a folder of tables to a folder of tables.

    Options: run, a name under which nothing is written twice, for PARSE,
    CLUSTER and STORE; tables in place of the source's and resume for PARSE;
    cumulative and state, a folder that counts units over all runs, for
    CLUSTER; passes for MATCH; libs and candidates for STORE, libs and found for INDEX,
    index for MATCH.
    """
    mode = mode.upper()
    if mode == "PARSE":
        done = read_profile(spark, target).get("apps") if options.get("resume") else None
        with scope():
            write_profile(parse(options.get("tables") or read_input(spark, source), done), target, options.get("run"))
        return
    profile = read_profile(spark, source)
    with scope():
        if mode == "CLUSTER":
            found = materialize(cluster(profile, options.get("cumulative", False)), "units")
            write_unit_hashes(found, target, options.get("run"))
            if "state" in options:
                UnitState(spark, options["state"]).add(options["run"], found.select("app_id", "unit_hash", "tree_hash", "tree"))
        elif mode == "STORE":
            write_provenance(store(options["libs"], options["candidates"], profile), target, options.get("run"))
        elif mode == "MATCH":
            write_report(match(profile, options["index"], passes=options.get("passes", ())), target)
        elif mode == "INDEX":
            if "found" in options:  # the libraries lie within apps
                profile = library_profile(options["found"], options["libs"], profile)
            write_index(build_index(profile, options["libs"]), target)
        else:
            raise ValueError(f"no program {mode}")
