"""The graph queries over all order lines against plain searches."""

import pytest

from hashloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def lines(duck):
    return duck.execute(
        "SELECT o_custkey, l_suppkey, l_returnflag, n_regionkey::VARCHAR FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
        " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    ).fetchall()


def flood(edges, start):
    out, distance, frontier = {}, {start: 0}, [start]
    for a, b in edges:
        out.setdefault(a, []).append(b)
    while frontier:
        new = {b for a in frontier for b in out.get(a, ())} - distance.keys()
        distance |= {b: distance[frontier[0]] + 1 for b in new}
        frontier = list(new)
    return distance


def trade(lines):
    return {(c, -s) for c, s, _, _ in lines} | {(-s, c) for c, s, f, _ in lines if f == "R"}


def test_slice_and_pruned_calls(lines, spark, sf_dir):
    edges = trade(lines)
    want = flood(edges, -1)
    assert {tuple(r) for r in QUERIES["df13_forward_slice"](spark, sf_dir).collect()} == set(want.items())
    got = [(r.src, r.dst) for r in QUERIES["df11_pruned_calls"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(e for e in edges if e[0] in want)


def test_every_line_enters_the_components(lines, spark, sf_dir):
    both = {((r, f"com.c{c}"), (r, f"org.s{s}")) for c, s, _, r in lines}
    both |= {(b, a) for a, b in both}
    want = {}
    for node in sorted({a for a, _ in both}):
        if node not in want:
            want |= dict.fromkeys(flood(both, node), node[1])
    got = QUERIES["gr04_class_components"](spark, sf_dir).collect()
    assert sorted((r.app_id, r.class_name, r.component) for r in got) == sorted((*n, c) for n, c in want.items())
