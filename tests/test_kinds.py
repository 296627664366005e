"""Matching by kinds of classes: rows that do not grow with copies, and what the fold takes, against plain loops."""

import random

import pandas as pd

from hashloom.operators import match as mt

COLUMNS = ["app_id", "kind", "unit_id", "package", "class_name", "lib_hash", "class_key", "name", "shared", "rk", "classes"]


def tables(spark, copies):
    """An app of a unit and a library whose classes come so many times; no class or package of one is the other's."""
    df = spark.createDataFrame
    kinds = {"a": ["m1", "m2", "m3", "m4"], "b": ["m1", "m2", "m5", "m6"]}
    named = [(f"{k}{i}", k) for k in kinds for i in range(copies)]
    classes = df([("app", "p", n, f"own-{k}", 1, 4) for n, k in named], "app_id string, package string, class_name string, hash string, access_flags int, n_methods long")
    methods = df([("app", "p", n, h, f"s{h}", 1) for n, k in named for h in kinds[k]], "app_id string, package string, class_name string, hash string, simple_hash string, access_flags int")
    nodes = {"classes": classes, "methods": methods, "packages": df([("app", "p", "own", 1)], "app_id string, package string, hash string, n_methods long")}
    postings = "hash string, lib_hash string"
    index = {
        "index_package": df([("theirs", "l")], postings),
        "index_class": df([(f"their-{k}", "l") for _, k in named], postings),
        "index_method": df([(h, "l") for _, k in named for h in [*kinds[k][:3], "more"]], postings),
        "lib_classes": df([("l", n) for n, _ in named], "lib_hash string, class_key string"),
        "class_methods": df([(n, h, f"s{h}") for n, k in named for h in [*kinds[k], "more"]], "class_key string, hash string, simple_hash string"),
        "libs": df([("l", "lib")], "lib_hash string, name string"),
    }
    return df([("app", "u", ["p"])], "app_id string, unit_id string, packages array<string>"), nodes, index


def test_copies_add_no_pairs(spark):
    count = lambda n: {r.kind: r["count"] for r in mt._told(*tables(spark, n)).groupBy("kind").count().collect()}
    assert count(5) == count(1)
    assert count(5)["pair"] == 2
    (found,) = mt.match_apps(*tables(spark, 5)).collect()
    assert (found.name, found.matched, found.classes, found.fully) == ("lib", 10, 10, True)


def test_votes_count_postings(spark):
    one, many = ({(r.lib_hash, r.votes) for r in mt.unit_votes(*(tables(spark, n))).collect()} for n in (1, 3))
    assert one == {("l", 6)} and many == {("l", 18)}


def test_a_hash_votes_for_the_first_unit(spark):
    rows = spark.createDataFrame([("app", u, "m", 1) for u in "dcabe" for _ in range(3)], "app_id string, unit_id string, hash string, weight long")
    index = spark.createDataFrame([("m", "l")], "hash string, lib_hash string")
    for parts in (1, 3, 7):
        assert [tuple(r) for r in mt.vote_cascade([rows.repartition(parts)], [index], [[]], ["app_id", "unit_id"], ["app_id"]).collect()] == [("app", "a", "l", 1)]


def plain(order, hits, pairs, candidates):
    """matched of each candidate: classes take the best free key in order."""
    out = {}
    for lib in candidates:
        taken, matched = set(), 0
        for cls, kind in order:
            if (kind, lib) in hits:
                matched += 1
                continue
            free = sorted((-n, at, key) for (k, to, n, keys) in pairs if k == kind and to == lib for at, key in keys if (lib, at) not in taken)
            if free:
                taken.add((lib, free[0][1]))
                matched += 1
        out[lib] = matched
    return out


def test_the_fold_takes_what_plain_loops_take():
    rng = random.Random(5)
    for _ in range(60):
        n, m, kinds, libs = rng.randint(1, 25), rng.randint(1, 25), rng.randint(1, 5), ["l0", "l1"]
        order = [(i, f"k{rng.randrange(kinds)}") for i in range(n)]
        keys = {lib: [(i, f"{lib}:{rng.randrange(4)}") for i in range(m)] for lib in libs}
        group = lambda rows: {k: [i for i, x in rows if x == k] for k in {x for _, x in rows}}
        of, hits, pairs, rows = group(order), set(), [], []
        add = lambda kind, places=None, **v: rows.append({**dict.fromkeys(COLUMNS), "app_id": "app", "kind": kind, "places": places, **v})  # noqa: E731, B023
        for k, at in of.items():
            add("unit", at, unit_id="u", package="p", class_name=k)
        for lib in libs:
            add("candidate", unit_id="u", lib_hash=lib, name=lib, rk=libs.index(lib) + 1, classes=10**6)
            for key, at in group(keys[lib]).items():
                add("key", at, lib_hash=lib, class_key=key)
            for k in of:
                if rng.random() < 0.2:
                    hits.add((k, lib))
                    add("class", package="p", class_name=k, lib_hash=lib)
                for key, at in group(keys[lib]).items():
                    if rng.random() < 0.6:
                        shared = rng.randint(1, 3)
                        pairs.append((k, lib, shared, [(i, key) for i in at]))
                        add("pair", unit_id="u", package="p", class_name=k, lib_hash=lib, class_key=key, shared=shared)
        want = plain(order, hits, pairs, libs)
        for lib in libs:
            mine = pd.DataFrame([{**r, "classes": want[lib] or 1} for r in rows if r["kind"] != "candidate" or r["lib_hash"] == lib])
            assert [r.matched for r in mt.report_app(mine).itertuples()] == ([want[lib]] if want[lib] else [])
