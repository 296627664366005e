"""The queries of single operators against their SQL."""

import pytest

from hashloom.plans.details import ORACLES, QUERIES
from hashloom.plans.queries import QUERIES as CORE

from compare import agrees


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    agrees((QUERIES | CORE)[name], ORACLES[name], spark, sf_dir, duck)


def test_all_are_registered():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


def test_calls_of_made_types(spark, sf_dir):
    """Against a loop over rows: suppliers are reached only if someone makes them."""
    rows = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()
    buyer = {r.o_orderkey: r.o_custkey for r in rows("orders")}
    nation = {r.n_nationkey: r.n_regionkey for r in rows("nation")}
    home = {r.c_custkey: nation[r.c_nationkey] for r in rows("customer")}
    supplier = {r.s_suppkey: r.s_nationkey for r in rows("supplier")}
    ship = {s: f"s{s}.ship" if s % 3 else f"n{n}.ship" for s, n in supplier.items()}
    lines = {(buyer[r.l_orderkey], r.l_suppkey, r.l_returnflag) for r in rows("lineitem")}
    methods, made, edges = {f"c{min(buyer.values())}.buy"}, set(), set()
    while True:
        before = len(methods), len(made), len(edges)
        for c, s, f in lines:
            if f"c{c}.buy" in methods:
                made.add(f"s{s}")
            if f == "R" and ship[s] in methods:
                made.add(f"c{c}")
                edges.add((ship[s], f"c{c}.buy"))
        buying = {c for c, _, _ in lines if f"c{c}.buy" in methods}
        edges |= {(f"c{c}.buy", ship[s]) for c in buying for s in supplier if f"s{s}" in made and nation[supplier[s]] == home[c]}
        methods |= {d for _, d in edges}
        if (len(methods), len(made), len(edges)) == before:
            break
    assert {tuple(r) for r in QUERIES["df07_calls_of_made_types"](spark, sf_dir).collect()} == edges
