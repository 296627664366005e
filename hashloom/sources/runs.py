"""Folders of tables that are added to in runs, each of which counts wholly or not at all (SNK-01..05).

A run writes its tables into folders of its own and then one small file, the
entry, that names what now belongs to the state. A reader goes by the latest
entry, so what a broken run has left is never read, and the run can be started
again under its name. Of two writers at a time one fails before its entry.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class Entries:
    """The numbered entries below a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._at = self._paths(f"{self.path}/_entries")
        self._files = self._at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def numbers(self) -> list[int]:
        if not self._files.exists(self._at):
            return []
        names = (f.getPath().getName() for f in self._files.listStatus(self._at))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        source = self._files.open(self._paths(f"{self.path}/_entries/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def latest(self) -> tuple[int, dict]:
        """(number, entry), (-1, {}) if there is none."""
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else (-1, {})

    def add(self, number: int, entry: dict) -> None:
        """Write an entry under a number that no other writer has taken: written aside and moved, so that none is read half written."""
        self._files.mkdirs(self._at)
        aside, at = self._paths(f"{self.path}/_entries/.{uuid.uuid4().hex}"), self._paths(f"{self.path}/_entries/{number:012d}.json")
        out = self._files.create(aside, False)
        out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        out.close()
        if self._files.exists(at) or not self._files.rename(aside, at):
            self._files.delete(aside, False)
            raise RuntimeError(f"another writer has added entry {number} to {self.path}")

    def delete(self, folder: str) -> None:
        self._files.delete(self._paths(f"{self.path}/{folder}"), True)

    def folders(self, folder: str) -> list[str]:
        at = self._paths(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._files.listStatus(at)) if self._files.exists(at) else []


class Runs:
    """Tables of several runs, whose rows are replaced by key: of a key the latest run's rows count.

    An entry lists the committed runs in order, with their tables' schemas.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.entries = spark, Entries(spark, path)

    def committed(self) -> list[str]:
        return [r["run"] for r in self.entries.latest()[1].get("runs", [])]

    def write(self, tables: dict[str, DataFrame], run: str | None = None) -> bool:
        """Add a run; one whose name is committed already changes nothing, and False is returned."""
        run = run or uuid.uuid4().hex
        number, entry = self.entries.latest()
        runs = entry.get("runs", [])
        if run in [r["run"] for r in runs]:
            return False
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.entries.path}/{name}/run={run}")
        schemas = {name: df.schema.jsonValue() for name, df in tables.items()}
        self.entries.add(number + 1, {"runs": [*runs, {"run": run, "schemas": schemas}]})
        return True

    def _rows(self, name: str) -> DataFrame | None:
        """The rows of a table of all committed runs, and their runs' numbers as `_run`."""
        parts = []
        for i, r in enumerate(self.entries.latest()[1].get("runs", [])):
            if name in r["schemas"]:
                schema = StructType.fromJson(r["schemas"][name])
                parts.append(self.spark.read.schema(schema).parquet(f"{self.entries.path}/{name}/run={r['run']}").withColumn("_run", F.lit(i)))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def read(self, name: str, keys: list[str], by: str | None = None) -> DataFrame | None:
        """A table's rows: of each key those of the latest run that has it, or that has it in the table `by`.

        One run alone is read as it is; several are told apart by a narrow
        table of keys.
        """
        rows = self._rows(name)
        if rows is None or len(self.committed()) == 1:
            return rows.drop("_run") if rows is not None else None
        latest = self._rows(by or name).groupBy(*keys).agg(F.max("_run").alias("_latest"))
        same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(latest[k]) for k in keys])
        return rows.join(latest, same & (rows["_run"] == latest["_latest"]), "left_semi").drop("_run")

    def clean(self) -> None:
        """Delete what broken runs have left; no run may be under way."""
        kept = {f"run={r}" for r in self.committed()}
        for table in self.entries.folders(""):
            if not table.startswith("_"):
                for folder in self.entries.folders(table):
                    if folder not in kept:
                        self.entries.delete(f"{table}/{folder}")


class UnitState:
    """What is counted of units over all batches: apps, counts, trees, trees' counts (SNK-03, AGG-09..12).

    Rows are dealt into buckets by unit hash. A batch reads the buckets that
    it touches, and writes them anew, apps and trees together, as a generation
    of its own; the entry then says which generation each bucket has. A batch
    that is added again changes nothing, and one that breaks leaves all as it
    was. A unit's apps are rows, as they can be any number.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.entries = spark, Entries(spark, path)
        self.buckets = self.entries.latest()[1].get("buckets", buckets)

    def _read(self, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        generation = self.entries.latest()[1].get("generation", {})
        paths = [f"{self.entries.path}/{table}/generation={g}/bucket={b}" for b, g in generation.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)

    APPS, TREES = "unit_hash string, app_id string, n long", "unit_hash string, tree_hash string, tree string, n long"

    def add(self, batch: str, units: DataFrame) -> bool:
        """Count units (app_id, unit_hash, tree_hash, tree) of a batch; False if it was counted before."""
        number, entry = self.entries.latest()
        if batch in entry.get("batches", []):
            return False
        bucket = F.pmod(F.xxhash64("unit_hash"), F.lit(self.buckets)).cast("int").alias("bucket")
        touched = sorted(r.bucket for r in units.select(bucket).distinct().collect())  # no more than there are buckets
        one = F.lit(1).cast("long").alias("n")
        for table, schema, keys, rest in (("apps", self.APPS, ["unit_hash", "app_id"], []), ("trees", self.TREES, ["unit_hash", "tree_hash"], [F.min("tree").alias("tree")])):
            columns = [c.split()[0] for c in schema.split(", ")]
            rows = self._read(table, schema, touched).unionByName(units.select(*columns[:-1], one))
            made = rows.groupBy(*keys).agg(*rest, F.sum("n").alias("n")).select(*columns, bucket)
            made.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.entries.path}/{table}/generation={batch}")
        generation = entry.get("generation", {}) | {str(b): batch for b in touched}
        self.entries.add(number + 1, {"buckets": self.buckets, "batches": [*entry.get("batches", []), batch], "generation": generation})
        return True

    def apps(self) -> DataFrame:
        """unit_hash, app_id, n: each app of a unit, and how many times it has it."""
        return self._read("apps", self.APPS)

    def counts(self) -> DataFrame:
        """unit_hash, n."""
        return self.apps().groupBy("unit_hash").agg(F.sum("n").alias("n"))

    def trees(self) -> DataFrame:
        """unit_hash, tree_hash, tree, n."""
        return self._read("trees", self.TREES)

    def clean(self) -> None:
        """Delete generations that no bucket has any more; no batch may be under way."""
        kept = {f"generation={g}" for g in self.entries.latest()[1].get("generation", {}).values()}
        for table in ("apps", "trees"):
            for folder in self.entries.folders(table):
                if folder not in kept:
                    self.entries.delete(f"{table}/{folder}")
