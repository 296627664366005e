"""Nodes alone in their component and the edges of groups, against plain loops, and what they write."""

from hashloom.operators import components as cc
from hashloom.plans.queries import QUERIES
from test_contained import as_table, rows_of


def test_singletons_against_components(spark):
    rows = as_table(spark, rows_of(4)).selectExpr("key", "explode(concat(own, own)) AS e")
    want = sorted(r.node for r in cc.singletons(cc.components_of_groups(rows, "key", "e")).collect())
    assert sorted(r.node for r in cc.singletons_of_groups(rows, "key", "e").collect()) == want
    shared = {}
    for k, own in rows_of(4):
        for x in own:
            shared.setdefault(x, set()).add(k)
    some = {k for k, own in rows_of(4) if own and k is not None}
    assert want == sorted(k for k in some if all(s - {None} == {k} for s in shared.values() if k in s))


def test_singletons_write_no_round(spark, sf_dir, monkeypatch):
    written = []
    monkeypatch.setattr(cc, "materialize", lambda df, tag: written.append(tag) or df)
    assert QUERIES["gr07_singletons"](spark, sf_dir).count() > 0 and not written


def test_only_shared_groups_make_edges(spark, monkeypatch):
    kept, write = {}, cc.materialize
    monkeypatch.setattr(cc, "materialize", lambda df, tag: kept.setdefault(tag, write(df, tag)))
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (1, "d"), (2, "d"), (3, "e"), (None, "e")], "n long, g string")
    monkeypatch.setattr(cc, "connected_components", lambda e: e.selectExpr("a AS node", "b AS component"))
    assert sorted(tuple(r) for r in cc.components_of_groups(rows, "n", "g").collect()) == [(1, 1), (2, 1), (3, 3)]
    assert kept["shared"].count() == 2 and [tuple(r) for r in kept["edges"].collect()] == [(2, 1)]
