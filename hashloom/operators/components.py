"""Weakly connected components of an edge table (GR-03), and what is asked of them (GR-05..08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..storage import discard, materialize, sized


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of edges.

    Large-star and small-star rounds: every round links the neighbours of a
    node to the smallest of them, first those above the node, then those at
    or below it, until the links are stars. Diameter enters by its logarithm. Each
    round pre-aggregates by node before the shuffle and is written to shared
    storage. A self-loop keeps an isolated node; null ends are left out.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    links = e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, before = materialize(links, "links"), None
    while True:
        # large-star: neighbours above a node go to the smallest neighbour or the node itself
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: neighbours below a node, and the node, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        last, links = links, materialize(small, "links")
        discard(last)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def components_of_groups(rows: DataFrame, node: str, group: str) -> DataFrame:
    """Components of the nodes that share a group: a star in each group that has several nodes, each edge once."""
    rows = rows.filter(F.col(node).isNotNull())
    nodes = rows.select(F.col(node).alias("node")).distinct()
    shared = rows.groupBy(group).agg(F.min(node).alias("centre"), F.max(node).alias("last")).filter("centre < last").select(group, "centre")
    edges = rows.join(sized(materialize(shared, "shared")), group).select(F.col(node).alias("a"), F.col("centre").alias("b")).filter("a <> b").distinct()
    parts = connected_components(materialize(edges, "edges"))
    return nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def singletons_of_groups(rows: DataFrame, node: str, group: str) -> DataFrame:
    """Nodes alone in their component of components_of_groups (GR-07): all their rows are in groups of their own.

    Rows may repeat. No component has to be made for that.
    """
    rows = rows.filter(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(group).alias("group"))
    own = rows.groupBy("group").agg(F.min("node").alias("node"), F.max("node").alias("last"), F.count("*").alias("n"))
    own = own.filter("node = last AND group IS NOT NULL").groupBy("node").agg(F.sum("n").alias("alone"))
    return rows.groupBy("node").agg(F.count("*").alias("n")).join(own, "node").filter("n = alone").select("node")


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def singletons(components: DataFrame) -> DataFrame:
    """Nodes alone in their component (GR-07)."""
    return components.join(component_sizes(components).filter("size = 1"), "component", "left_semi").select("node")


def uncalled(components: DataFrame, called: DataFrame) -> DataFrame:
    """Components none of whose nodes is in called(node) (GR-08)."""
    hit = components.join(called, "node", "left_semi").select("component").distinct()
    return components.select("component").distinct().join(hit, "component", "left_anti")


def largest_component(members: DataFrame, prefix: str) -> DataFrame:
    """For each prefix its largest component, ties to the smallest component (TOP-05)."""
    sizes = members.groupBy(prefix, "component").agg(F.count("*").alias("size"))
    order = W.partitionBy(prefix).orderBy(F.desc("size"), "component")
    return sizes.withColumn("rk", F.row_number().over(order)).filter("rk = 1").drop("rk")
