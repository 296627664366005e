"""python -m hashloom MODE SOURCE TARGET: the programs over folders of tables, or PARSE over app packages."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from .operators.index import read_index
from .plans.programs import run
from .sources import archives, lists
from .sources.sinks import read_provenance


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="hashloom")
    p.add_argument("mode", choices=["PARSE", "CLUSTER", "STORE", "INDEX", "MATCH"], type=str.upper)
    p.add_argument("source", help="decoded tables, or app packages if --framework is given, for PARSE; else what PARSE wrote")
    p.add_argument("target")
    p.add_argument("--framework", help="folder of framework archives")
    p.add_argument("--resume", action="store_true", help="leave out apps that the target has")
    p.add_argument("--libs", help="library list, for STORE and INDEX")
    p.add_argument("--apps", help="list of apps and their libraries, for STORE")
    p.add_argument("--found", help="what STORE wrote, for INDEX")
    p.add_argument("--index", help="what INDEX wrote, for MATCH")
    p.add_argument("--passes", nargs="*", choices=["class", "method"], default=[], help="passes over what MATCH leaves")
    p.add_argument("--run", help="name of the run, under which nothing is written twice, for PARSE, CLUSTER and STORE")
    p.add_argument("--state", help="folder that counts units over all runs, for CLUSTER with --run")
    a = p.parse_args(argv)
    if a.state and not a.run:
        p.error("--state needs --run")
    spark = SparkSession.builder.appName(f"hashloom {a.mode}").getOrCreate()
    options = {"resume": a.resume, "run": a.run, "passes": tuple(a.passes)} | ({"state": a.state} if a.state else {})
    if a.framework:
        options["tables"] = archives.decoded_apps(spark, a.source, archives.framework_types(spark, a.framework))
    if a.libs:
        options["libs"] = lists.libraries(spark, a.libs).withColumn("name", F.array_min("packages"))
    if a.apps:
        options["candidates"] = lists.app_libraries(spark, a.apps)
    if a.found:
        options["found"] = read_provenance(spark, a.found)
    if a.index:
        options["index"] = read_index(spark, a.index)
    run(spark, a.mode, a.source, a.target, **options)


if __name__ == "__main__":
    main()
