"""Unit recovery, votes, shortlist, containment, report, components."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hashloom.operators import match as mt, units as un
from hashloom.operators.components import component_sizes, connected_components, largest_component, uncalled
from hashloom.plans import programs


def test_singletons_join_children_then_ancestors():
    got = un.recover([["com.a.b.x", "com.a.b.y"], ["org.q.r", "org.q.s"]], ["com.a.b", "org.q.r.deep.er", "net.z"], [])
    assert got == [["com.a.b", "com.a.b.x", "com.a.b.y"], ["net.z"], ["org.q.r", "org.q.r.deep.er", "org.q.s"]]


def test_uncalled_join_siblings():
    got = un.recover([["com.a.u", "com.a.v"], ["com.a.w", "com.a.x", "com.a.y"]], [], ["com.a.w"])
    assert got == [["com.a.u", "com.a.v", "com.a.w", "com.a.x", "com.a.y"]]
    assert un.recover([["com.a.u", "com.a.v"], ["org.w.x", "org.w.y"]], [], ["org.w.x"]) == [["com.a.u", "com.a.v"], ["org.w.x", "org.w.y"]]


def test_siblings_are_chosen_before_they_are_refused():
    # (a) the largest near component is a called family, so nothing happens, though another one is near
    family = ["x.a.c", "x.a.c.d", "x.a.c.e"]
    assert un.recover([family, ["x.a.f", "x.a.g"]], ["x.a.b"], ["x.a.c", "x.a.f"]) == [["x.a.b"], family, ["x.a.f", "x.a.g"]]
    # (b) a cousin is no child of the parent or the grandparent
    assert un.recover([], ["k.b.c", "k.x.y"], []) == [["k.b.c"], ["k.x.y"]]
    # (c) its own component is the largest near one
    large, small = ["p.q.a", "p.q.b", "p.q.c", "p.q.d"], ["p.q.x", "p.q.y"]
    assert un.recover([large, small], [], ["p.q.x"]) == [large, small]
    # names below a top-level domain have no near relations, and a domain is nobody's grandparent
    assert un.recover([], ["com.a", "com.b"], []) == [["com.a"], ["com.b"]]
    assert un.recover([["com.b", "com.c"]], ["com.a.x"], []) == [["com.a.x"], ["com.b", "com.c"]]


def plain_units(components, alone, called):
    """The rules of unit recovery, one sentence after the other, on lists of numbered sets."""
    sets = sorted([set(c) for c in components] + [{a} for a in alone], key=min)
    called = set(called) - set(alone)
    home = {p: k for k, s in enumerate(sets) for p in s}
    was_single = [len(s) == 1 for s in sets]
    parent = lambda n: n.rpartition(".")[0]
    tld = {"com", "org", "net", "io"}

    def move(k, into):
        home[min(sets[k])] = into
        sets[into] |= sets[k]
        sets[k] = None

    def largest(ids):
        best = None
        for k in sorted(set(ids)):
            if sets[k] is not None and (best is None or len(sets[k]) > len(sets[best])):
                best = k
        return best

    for k in range(len(sets)):
        if was_single[k]:
            (own,) = sets[k]
            into = largest(home[p] for p in home if parent(p) == own and not was_single[home[p]])
            if into is not None:
                move(k, into)
    for k in range(len(sets)):
        if was_single[k] and sets[k] is not None:
            up = min(sets[k])
            for _ in range(3):
                up = parent(up)
                if not up or up in tld:
                    break
                if up in home:
                    if sets[home[up]] is not None:
                        move(k, home[up])
                    break
    quiet = [k for k, s in enumerate(sets) if s is not None and not s & called]
    for k in quiet:
        up = parent(min(sets[k]))
        if up and up not in tld and up in home and sets[home[up]] is not None:
            move(k, home[up])
    for k in quiet:
        if sets[k] is None:
            continue
        first, last = min(sets[k]), max(sets[k])
        single = was_single[k]
        if not single and len(first.split(".")) <= 3 and last.startswith(first + "."):
            continue
        up = parent(first)
        if not up or up in tld:
            continue
        roots = [r for r in (up, parent(up)) if r and r not in tld]
        into = largest(home[p] for p in home if p != first and parent(p) in roots)
        if into is None or into == k:
            continue
        a, z = min(sets[into]), max(sets[into])
        if into not in quiet and z.startswith(a + "."):
            continue
        move(k, into)
    return sorted(sorted(s) for s in sets if s is not None)


def test_units_against_the_rules():
    rng = random.Random(11)
    for _ in range(3000):
        names = sorted({".".join([rng.choice(["com", "x", "io"]), *(rng.choice("abc") for _ in range(rng.randint(0, 4)))]) for _ in range(rng.randint(2, 18))} - {"com", "io"})
        rng.shuffle(names)
        parts = []
        while len(names) > 6 and rng.random() < 0.8:
            n = rng.randint(2, 5)
            parts.append(names[:n])
            names = names[n:]
        called = rng.sample(names + sum(parts, []), rng.randint(0, 5) if len(names) + len(parts) > 5 else 0)
        assert un.recover(parts, names, called) == plain_units(parts, names, called), (parts, names, called)


def test_units_are_a_partition():
    rng = random.Random(7)
    for _ in range(50):
        names = sorted({".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(20)})
        rng.shuffle(names)
        parts, alone = [names[:4], names[4:7]], names[7:]
        found = un.recover([p for p in parts if p], alone, rng.sample(names, len(names) // 2))
        assert sorted(x for u in found for x in u) == sorted(names)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_component_questions(spark):
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, component long")
    assert {(r.component, r.size) for r in component_sizes(c).collect()} == {(1, 2), (3, 1)}
    assert [r.component for r in uncalled(c, spark.createDataFrame([(2,)], "node long")).collect()] == [3]
    rows = c.withColumn("prefix", F.lit("p"))
    assert [(r.component, r["size"]) for r in largest_component(rows, "prefix").collect()] == [(1, 2)]


def test_votes_stop_below_a_hit(spark):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    top = df([("u", "p", "P", 10), ("u", "q", "none", 10)], "unit string, k string, hash string, weight long")
    low = df([("u", "p", "m", 1), ("u", "q", "m", 1), ("u", "q", "m", 1)], "unit string, k string, hash string, weight long")
    index = [df([("P", "lib1"), ("P", "lib1")], "hash string, lib_hash string"), df([("m", "lib2")], "hash string, lib_hash string")]
    votes = mt.vote_cascade([top, low], index, [["k"], ["k"]], ["unit"])
    assert {(r.lib_hash, r.votes) for r in votes.collect()} == {("lib1", 20), ("lib2", 2)}
    once = mt.vote_cascade([top, low], index, [["k"], ["k"]], ["unit"], ["unit"])
    assert {(r.lib_hash, r.votes) for r in once.collect()} == {("lib1", 20), ("lib2", 1)}


def test_six_versions_survive(spark):
    votes = spark.createDataFrame([("u", f"v{i}", i) for i in range(8)], "unit string, lib_hash string, votes long")
    libs = spark.createDataFrame([(f"v{i}", "lib") for i in range(8)], "lib_hash string, name string")
    assert [r.lib_hash for r in mt.shortlist(votes, libs, ["unit"]).orderBy("rk").collect()] == ["v7", "v6", "v5", "v4", "v3", "v2"]


@pytest.mark.parametrize(("shared", "kept"), [(69, False), (70, True), (100, True)])
def test_containment_threshold(spark, shared, kept):
    a = spark.createDataFrame([("a", i) for i in range(100)], "a string, x long")
    b = spark.createDataFrame([("b", i) for i in range(shared)], "b string, x long")
    assert (mt.containment(a, b, "a", "b", "x", 0.7).count() == 1) == kept


def test_report_takes_each_name_once():
    none = dict.fromkeys(["unit_id", "package", "class_name", "lib_hash", "class_key", "name", "shared", "rk", "classes"])
    row = lambda kind, **v: {"app_id": "app", "kind": kind, **none, **v}
    rows = [row("unit", unit_id="u", package="p", class_name=c) for c in "AB"]
    rows += [row("package", package="p", lib_hash="l2"), row("candidate", unit_id="u", lib_hash="l2", name="lib", rk=1, classes=2), row("candidate", unit_id="u", lib_hash="l1", name="lib", rk=2, classes=2)]
    got = mt.report_app(pd.DataFrame(rows))
    assert got.values.tolist() == [["app", "u", "l2", "lib", 2, 2, True]]


def test_a_library_finds_itself(spark, sf_dir):
    """STORE: the first candidate whose packages give the library's hash."""
    from hashloom.functions.hashes import of_children

    packages = spark.createDataFrame([("x", "p", "aa"), ("y", "p", "bb"), ("z", "p", "bb")], "app_id string, package string, hash string")
    lib = packages.filter("app_id = 'y'").groupBy("app_id").agg(of_children(F.collect_list("hash")).alias("lib_hash")).select("lib_hash", F.array(F.lit("p")).alias("packages"))
    candidates = lib.select("lib_hash", F.explode(F.array(*map(F.lit, "xzy"))).alias("app_id")).withColumn("pos", F.instr(F.lit("xyz"), F.col("app_id")))
    assert [r.app_id for r in programs.store(lib, candidates, {"packages": packages}).collect()] == ["y"]
