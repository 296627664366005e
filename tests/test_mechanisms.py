"""Bucketed postings, call graphs from entry points, structure of subtrees, closures: against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hashloom.operators import flow, hierarchy as hi, index as ix, match as mt, trie as tr


def postings(spark, n=3000):
    hashes = spark.range(n).select(F.md5((F.col("id") % 700).cast("string")).alias("hash"), F.concat(F.lit("lib"), F.col("id") % 9).alias("lib_hash"))
    empty = lambda *c: spark.createDataFrame([], ", ".join(f"{x} string" for x in c))
    return {"index_package": hashes.limit(50), "index_class": hashes.limit(500), "index_method": hashes, "lib_classes": empty("lib_hash", "class_key"), "class_methods": empty("class_key", "hash", "simple_hash"), "libs": empty("lib_hash", "name")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_not_shuffled(spark):
    index = postings(spark)
    for _ in range(2):  # saved again, a table takes the place of the one before
        ix.save_index(index, "held", 8)
    got = ix.load_index(spark, "held")
    for name in index:
        assert sorted(map(tuple, got[name].collect())) == sorted(map(tuple, index[name].collect()))
    rows = spark.range(900).select(F.lit("app").alias("app_id"), F.md5(F.col("id").cast("string")).alias("hash"), F.lit(1).cast("long").alias("weight"))
    joined = rows.join(got["index_method"].hint("merge"), "hash")
    assert plan_of(joined).count("Exchange hashpartitioning") == 1  # of the apps' rows
    votes = mt.vote_cascade([rows], [got["index_method"].hint("merge")], [[]], ["app_id"])
    assert {(r.lib_hash, r.votes) for r in votes.collect()} == {(r.lib_hash, r.votes) for r in mt.vote_cascade([rows], [index["index_method"]], [[]], ["app_id"]).collect()}
    # rows that are bucketed alike meet all levels without another shuffle
    rows.repartition(8, "hash").write.mode("overwrite").bucketBy(8, "hash").sortBy("hash").saveAsTable("held_rows")
    mine = spark.table("held_rows")
    for level in ("package", "class", "method"):
        assert "Exchange hashpartitioning" not in plan_of(mine.join(got[f"index_{level}"].hint("merge"), "hash"))
    one = ix.postings_of(got, "method", [index["index_method"].first().hash])
    assert {r.hash for r in one.collect()} == {index["index_method"].first().hash}
    for t in [f"held_{n}" for n in index] + ["held_rows"]:
        spark.sql(f"DROP TABLE {t}")


def plain_calls(entries, calls, dispatch, below, news):
    methods, types, edges = set(entries), set(), set()
    while True:
        before = len(methods), len(types), len(edges)
        types |= {t for m, t in news if m in methods} if news is not None else {t for ts in below.values() for t in ts}
        for m, receiver, s in calls:
            if m in methods:
                edges |= {(m, dispatch[t, s]) for t in below[receiver] & types if (t, s) in dispatch}
        methods |= {d for _, d in edges}
        if (len(methods), len(types), len(edges)) == before:
            return edges


@pytest.mark.parametrize("seed", range(4))
def test_call_graphs_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    above = {f"t{i}": f"t{rng.randrange(i)}" if i else None for i in range(14)}
    declared = {(t, s) for t in above for s in "xyz" if rng.random() < 0.35}
    dispatch = {}
    for t in above:
        for s in "xyz":
            at = t
            while at and (at, s) not in declared:
                at = above[at]
            if at:
                dispatch[t, s] = f"{at}.{s}"
    below = {t: set() for t in above}
    for t in above:
        at = t
        while at:
            below[at].add(t)
            at = above[at]
    methods = [f"{t}.{s}" for t, s in sorted(declared)] + ["main"]
    calls = [(m, rng.choice(list(above)), rng.choice("xyz")) for m in methods for _ in range(2)]
    news = [(m, rng.choice(list(above))) for m in methods if rng.random() < 0.6] + [("main", "t3")]
    reach = hi.closure(spark.createDataFrame(list(above.items()), "type_name string, super_name string"))
    args = (
        spark.createDataFrame([("main",)], "method string"),
        spark.createDataFrame(calls, "method string, receiver string, selector string"),
        spark.createDataFrame([(*k, v) for k, v in dispatch.items()], "type_name string, selector string, target string"),
        reach,
    )
    made = spark.createDataFrame(news, "method string, type_name string")
    assert {tuple(r) for r in flow.call_graph(*args, made).collect()} == plain_calls(["main"], calls, dispatch, below, news)
    assert {tuple(r) for r in flow.call_graph(*args).collect()} == plain_calls(["main"], calls, dispatch, below, None)


def tree_of(names):
    below = defaultdict(set)
    for n in names:
        parts = n.split(".")
        for i in range(len(parts)):
            below[".".join(parts[:i])].add(".".join(parts[: i + 1]))
    return below


def plain_match(g, t, game, pattern):
    a, b = game.get(g, set()), pattern.get(t, set())
    leaves = lambda own, tree: sum(not tree.get(x) for x in own)
    la, lb = leaves(a, game), leaves(b, pattern)
    if len(a) < len(b) or la < lb:
        return False
    if len(a) == len(b) and la == lb and len(a) == la:
        return True
    return all(any(plain_match(x, y, game, pattern) for x in a) for y in b) and (not a) == (not b)


@pytest.mark.parametrize("seed", range(4))
def test_structure_against_plain_recursion(spark, seed):
    rng = random.Random(seed)
    some = lambda n, d: sorted({".".join(["r"] + [rng.choice("abc") for _ in range(rng.randint(1, d))]) for _ in range(n)})
    names, want = some(25, 4), ["p.a", "p.b.c"] if seed % 2 else some(4, 2)
    game, pattern = tree_of(names), tree_of(want)
    trie = tr.build(spark.createDataFrame([(n,) for n in names], "name string"))
    small = tr.build(spark.createDataFrame([(n,) for n in want], "name string"))
    nodes, (root,) = {x for own in game.values() for x in own}, pattern[""]
    hits = {g for g in nodes if plain_match(g, root, game, pattern)}
    pairs = {(r.prefix, r.node) for r in tr.dominated(trie, small).collect()}
    assert pairs == {(g, t) for g in nodes for t in {x for own in pattern.values() for x in own} if plain_match(g, t, game, pattern)}
    got = [r.prefix for r in tr.structural_matches(trie, small).collect()]
    taken = {g for g in hits if not any(g.startswith(h + ".") for h in hits)}
    assert sorted(got) == sorted(taken)


def test_closure_against_search(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(21)] + [(None, 1), (7, 7)]
    got = {(r.a, r.b): r.distance for r in hi.closure(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nxt = defaultdict(set)
    for a, b in edges:
        if a is not None:
            nxt[a].add(b)
    want = {}
    for n in {x for e in edges if e[0] is not None for x in e}:
        far, level, d = {n: 0}, {n}, 0
        while level:
            d += 1
            level = {y for x in level for y in nxt[x]} - set(far)
            far |= dict.fromkeys(level, d)
        want |= {(n, x): d for x, d in far.items()}
    assert got == want
