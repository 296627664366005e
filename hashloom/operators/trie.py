"""Trees of dotted names as tables: a row a prefix (TR-01..06, AGG-17, AGG-20..22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import names as nm
from ..functions.hashes import of_children
from ..storage import dealt_join, materialize, sized
from .filters import is_top_level


def build(names: DataFrame, name: str = "name", group: tuple[str, ...] = ()) -> DataFrame:
    """group, prefix, parent, depth, own, below: names that are the prefix, and names at or below it (TR-01, AGG-17)."""
    rows = names.groupBy(*group, name).agg(F.count("*").alias("k"))
    rows = rows.select(*group, F.col(name).alias("n"), "k", F.explode(nm.prefixes(F.col(name))).alias("prefix"))
    made = rows.groupBy(*group, "prefix").agg(F.coalesce(F.sum(F.when(F.col("prefix") == F.col("n"), F.col("k"))), F.lit(0)).alias("own"), F.sum("k").alias("below"))
    return made.select(*group, "prefix", nm.package(F.col("prefix")).alias("parent"), nm.depth(F.col("prefix")).cast("long").alias("depth"), "own", "below")


def summary(trie: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """nodes, names, non_empty, max_depth of each tree (AGG-17, AGG-20, AGG-21)."""
    return trie.groupBy(*group).agg(F.count("*").alias("nodes"), F.sum("own").alias("names"), F.count_if(F.col("own") > 0).alias("non_empty"), F.max("depth").alias("max_depth"))


def subtree(trie: DataFrame, prefix: str) -> DataFrame:
    """The nodes at or below a prefix (TR-02, TR-03)."""
    return trie.filter((F.col("prefix") == prefix) | F.col("prefix").startswith(prefix + "."))


def root_of(names: DataFrame, roots: DataFrame, name: str = "name") -> DataFrame:
    """name, root: the shortest root that a name lies in (TR-02), by equal prefixes."""
    rows = names.select(name).distinct().select(name, F.explode(nm.prefixes(F.col(name))).alias("root"))
    hit = rows.join(roots.withColumnRenamed(name, "root"), "root")
    return hit.groupBy(name).agg(F.min_by("root", F.length("root")).alias("root"))


def siblings(names: DataFrame, name: str = "name") -> DataFrame:
    """name, sibling: the other names that are children of a name's parent or of its grandparent (JN-11).

    Names right below a top-level domain have none, and such a domain is
    nobody's grandparent.
    """
    n, none = F.col("name"), F.lit(None).cast("string")
    up = lambda c: F.when(c.contains("."), nm.package(c))
    rows = materialize(names.select(F.col(name).alias("name")).distinct().withColumn("p", up(n)), "names")
    below = rows.filter("p IS NOT NULL").select(n.alias("sibling"), F.col("p").alias("root"))
    grand = F.when(F.col("p").isNotNull() & ~is_top_level(up(F.col("p"))), up(F.col("p"))).otherwise(none)
    ask = rows.filter(F.col("p").isNotNull() & ~is_top_level(F.col("p"))).select("name", F.explode(F.array_compact(F.array("p", grand))).alias("root"))
    return dealt_join(ask, below, ["root"]).filter("name <> sibling").select("name", "sibling")


def contained(small: DataFrame, large: DataFrame, group: str) -> DataFrame:
    """a, b: trees of small all of whose relative prefixes tree b of large has (TR-04)."""
    n = small.groupBy(group).agg(F.countDistinct("prefix").alias("n"))
    a = small.select(F.col(group).alias("a"), "prefix").distinct()
    b = large.select(F.col(group).alias("b"), "prefix").distinct()
    both = a.join(b, "prefix").groupBy("a", "b").agg(F.count("*").alias("m"))
    return both.join(n.withColumnRenamed(group, "a"), "a").filter("m = n AND a <> b").select("a", "b")


def shapes(trie: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """trie with shape: a digest of the subtree's form, names left out (TR-05): equal shapes match by structure."""
    leaf = trie.withColumn("hash", F.md5(F.lit("")))
    return merkle_trie(leaf, group, own_hash=None).withColumnRenamed("node_hash", "shape")


def dominated(trie: DataFrame, pattern: DataFrame) -> DataFrame:
    """prefix, node: pairs of a trie's node and a pattern's node that it matches by structure (TR-05).

    Both are tries of one group (prefix, parent, depth). A node matches if it
    has at least as many children and as many childless children, and if
    either all children on both sides are childless and equal in number, or
    each of the pattern's children is matched by one of its own; childless
    nodes match childless ones only. Levels go up from the pattern's deepest.
    """

    def counted(t: DataFrame, name: str) -> DataFrame:
        t = t.select(F.col("prefix").alias(name), F.col("parent").alias("up"), "depth")
        inner = t.select(F.col("up").alias(name)).distinct()
        leaf = t.join(inner.withColumn("inner", F.lit(True)), name, "left").withColumn("leaf", F.col("inner").isNull())
        sizes = leaf.groupBy(F.col("up").alias(name)).agg(F.count("*").alias("children"), F.count_if("leaf").alias("leaves"))
        rows = leaf.join(sizes, name, "left").select(name, F.col("up").alias(f"{name}_up"), F.col("depth").alias(f"{name}_depth"), *[F.coalesce(c, F.lit(0)).alias(f"{name}_{c}") for c in ("children", "leaves")])
        return materialize(rows, "counted")

    g, t = counted(trie, "g"), sized(counted(pattern, "t"))
    fits = (F.col("g_children") >= F.col("t_children")) & (F.col("g_leaves") >= F.col("t_leaves"))
    flat = (F.col("g_children") == F.col("t_children")) & (F.col("g_leaves") == F.col("t_leaves")) & (F.col("g_children") == F.col("g_leaves"))
    out, below = None, None
    for level in range(t.agg(F.max("t_depth")).first()[0] or 0, 0, -1):
        # a pattern's level is matched against all depths of the trie, by counts
        here = t.filter(F.col("t_depth") == level)
        pairs = g.join(here, fits)
        done = pairs.filter(flat).select("g", "g_up", "t", "t_up")
        if below is not None:
            hits = below.select(F.col("g_up").alias("g"), F.col("t_up").alias("t"), F.col("t").alias("child")).distinct().groupBy("g", "t").agg(F.count("*").alias("hits"))
            more = pairs.filter(~flat & (F.col("t_children") > 0)).join(hits, ["g", "t"]).filter(F.col("hits") == F.col("t_children"))
            done = done.unionByName(more.select("g", "g_up", "t", "t_up"))
        below = materialize(done, "dominated")
        out = below if out is None else out.unionByName(below)
    empty = trie.sparkSession.createDataFrame([], "prefix string, node string")
    return empty if out is None else out.select(F.col("g").alias("prefix"), F.col("t").alias("node"))


def structural_matches(trie: DataFrame, pattern: DataFrame) -> DataFrame:
    """prefix, round: subtrees of a trie that match a pattern with one root, none inside another (TR-05).

    A round takes the matching nodes that no other matching node lies above,
    and leaves out what overlaps with what was taken, until none is left:
    as subtrees overlap only where one holds the other, the first round takes
    all, and the highest match wins.
    """
    root = pattern.filter("depth = 1").select(F.col("prefix").alias("node"))
    left = materialize(dominated(trie, pattern).join(F.broadcast(root), "node", "left_semi").select("prefix").distinct(), "matches")
    out, k = left.limit(0).withColumn("round", F.lit(0)), 0
    while not left.isEmpty():
        k += 1
        above = left.select("prefix", F.explode(nm.prefixes(F.col("prefix"))).alias("up")).filter("up <> prefix")
        inside = materialize(above.join(left.select(F.col("prefix").alias("up")), "up", "left_semi").select("prefix").distinct(), "inside")
        taken = left.join(inside, "prefix", "left_anti")
        out = out.unionByName(taken.withColumn("round", F.lit(k)))
        held = above.join(taken.select(F.col("prefix").alias("up")), "up", "left_semi").select("prefix").distinct()
        left = materialize(left.join(taken, "prefix", "left_anti").join(held, "prefix", "left_anti"), "matches")
    return out


def merkle_trie(trie: DataFrame, group: tuple[str, ...] = (), own_hash: str | None = "hash") -> DataFrame:
    """group, prefix, node_hash: bottom-up digests of trees (AGG-22, TR-06).

    A leaf has its own hash; an inner node the digest of its children's, or of
    its own hash and that if it has one. Levels go up one at a time, each one
    written, as many rounds as the tree is deep.
    """
    top = trie.agg(F.max("depth")).first()[0] or 0
    own = F.col(own_hash) if own_hash else F.lit(None).cast("string")
    rows = trie.select(*group, "prefix", "parent", "depth", own.alias("own_hash"))
    done, above = None, None
    for level in range(top, 0, -1):
        here = rows.filter(F.col("depth") == level)
        here = here.withColumn("inner", F.lit(None).cast("string")) if above is None else here.join(above, [*group, "prefix"], "left")
        empty = F.md5(F.lit(""))
        made = here.withColumn(
            "node_hash",
            F.when(F.col("inner").isNull(), F.coalesce("own_hash", empty)).when(F.col("own_hash").isNull(), F.col("inner")).otherwise(F.md5(F.unhex(F.concat("own_hash", "inner")))),
        ).select(*group, "prefix", "parent", "node_hash")
        made = materialize(made, "trie")
        done = made.drop("parent") if done is None else done.unionByName(made.drop("parent"))
        above = made.groupBy(*group, F.col("parent")).agg(of_children(F.collect_list("node_hash")).alias("inner")).withColumnRenamed("parent", "prefix")
    return done if done is not None else rows.select(*group, "prefix", F.col("own_hash").alias("node_hash"))
