"""Dependency edges between packages (GR-01, GR-02, GR-05, AGG-07, AGG-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names as nm
from .filters import app_classes, app_methods, app_prefix, is_top_level, known_destinations


def dependency_edges(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """app_id, src, dst, call_count, getfield_count, inherits (GR-01, AGG-07), ends known packages only (FLT-09)."""
    # what is used is shuffled to the kept classes, not the code; Spark pushes a semi-join below that
    used = app_methods(methods).select("app_id", "class_desc", *used_packages(F.col("code")))
    return edges_of_uses(classes, used.join(app_classes(classes).select("app_id", "class_desc").distinct(), ["app_id", "class_desc"]))


def used_packages(code: Column) -> tuple[Column, Column]:
    """invoked and read: the packages of what a method's code calls and reads, one an instruction."""
    of = lambda kind, name: F.transform(F.filter(code, lambda i: i["kind"] == kind), lambda i: nm.package(nm.dotted(i["ref_class"]))).alias(name)
    return of("invoke", "invoked"), of("getfield", "read")


def edges_of_uses(classes: DataFrame, used: DataFrame) -> DataFrame:
    """dependency_edges of classes and of what methods of the kept ones use: used has app_id, class_desc, invoked, read."""
    kept = app_classes(classes)
    pkg = lambda c: nm.package(nm.dotted(F.col(c)))
    supers = kept.filter("super_desc IS NOT NULL").select("app_id", pkg("class_desc").alias("src"), pkg("super_desc").alias("dst"), F.lit("inherit").alias("kind"))
    as_kind = lambda c, kind: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda dst: F.struct(dst.alias("dst"), F.lit(kind).alias("kind")))
    uses = used.select("app_id", pkg("class_desc").alias("src"), F.inline(F.concat(as_kind("invoked", "invoke"), as_kind("read", "getfield"))))
    return known_destinations(weigh(supers.unionByName(uses)), kept.select("app_id", pkg("class_desc").alias("package")))


def weigh(uses: DataFrame, keys: tuple[str, ...] = ("app_id",)) -> DataFrame:
    """One row an edge from uses (keys, src, dst, kind) (AGG-07)."""
    return uses.groupBy(*keys, "src", "dst").agg(F.count_if(F.col("kind") == "invoke").alias("call_count"), F.count_if(F.col("kind") == "getfield").alias("getfield_count"), F.bool_or(F.col("kind") == "inherit").alias("inherits"))


def score(calls: Column, reads: Column) -> Column:
    """An edge's weight (AGG-08)."""
    return calls * 10 + reads


def classify(edges: DataFrame, apps: DataFrame) -> DataFrame:
    """edges with keep, calls_dst and called_edge (GR-02): the first rule that holds decides.

    1 from the app itself: calls dst, across two-segment prefixes a called edge; 2 into the app: dropped;
    3 from an empty or top-level name: calls dst; 4 into one: dropped; 5 first segments
    differ: a called edge; 6 both below one top-level domain that is no package itself and
    two-segment prefixes differ: a called edge; 7 kept for components.
    """
    short = F.col("vertex").isin("com", "net", "io", "me")
    vertices = edges.select("app_id", F.col("src").alias("vertex")).union(edges.select("app_id", "dst")).distinct().filter(~short & is_top_level(F.col("vertex")))
    rows = edges.join(apps.select("app_id", app_prefix(F.col("package_name")).alias("own")), "app_id", "left") if "own" not in edges.columns else edges
    rows = rows.withColumn("first", nm.first_segments(F.col("src"), 1))
    rows = rows.join(vertices.withColumnRenamed("vertex", "first").withColumn("is_vertex", F.lit(True)), ["app_id", "first"], "left")
    src, dst = F.col("src"), F.col("dst")
    bare = lambda c: (c == "") | is_top_level(c)
    apart = nm.first_segments(src, 2) != nm.first_segments(dst, 2)
    rule = (
        F.when(src.startswith(F.col("own")), F.lit(1))
        .when(dst.startswith(F.col("own")), 2)
        .when(bare(src), 3)
        .when(bare(dst), 4)
        .when(F.col("first") != nm.first_segments(dst, 1), 5)
        .when(is_top_level(F.col("first")) & F.col("is_vertex").isNull() & apart, 6)
        .otherwise(7)
    )
    rows = rows.withColumn("rule", rule)
    return rows.select(*[F.col(c) for c in edges.columns], "rule", (F.col("rule") == 7).alias("keep"), F.col("rule").isin(1, 3, 5, 6).alias("calls_dst"), (F.col("rule").isin(5, 6) | ((F.col("rule") == 1) & apart)).alias("called_edge"))


def called(classified: DataFrame) -> DataFrame:
    """The packages that something outside their component calls (GR-05)."""
    return classified.filter("calls_dst").select("app_id", F.col("dst").alias("package")).distinct()
