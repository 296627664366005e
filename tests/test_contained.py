"""Containment within one table, against plain loops."""

import random

import pytest

from hashloom.operators import match as mt


def rows_of(seed):
    """Rows with copies, near copies, common elements, a key of two rows, a null key and empty sets."""
    rng = random.Random(seed)
    base = [[rng.choice([*range(8), *range(100, 160)]) for _ in range(rng.randint(0, 9))] for _ in range(25)]
    rows = [(i, list(b)) for i, b in enumerate(base)]
    rows += [(100 + i, list(base[i % 25])) for i in range(40)]
    rows += [(200 + i, base[i % 25][1:] + [500 + i]) for i in range(40)]
    return [*rows, (3, [1, 2, 3]), (None, [1, 2, 3]), (300, []), (301, [])]


def as_table(spark, rows):
    return spark.createDataFrame([(k, [bytes([x // 256, x % 256]) for x in own]) for k, own in rows], "key long, own array<binary>")


@pytest.mark.parametrize("lot", [1, 3, 4096])
def test_contained_against_plain_loops(spark, lot):
    for seed in (1, 2):
        sets = {}
        for k, own in rows_of(seed):
            sets.setdefault(k, set()).update(own)
        sets = {k: v for k, v in sets.items() if k is not None and v}
        want = sorted((a, b, len(x & y), len(x & y) / len(x)) for a, x in sets.items() for b, y in sets.items() if a != b and len(x & y) / len(x) >= 0.7)
        got = mt.contained(as_table(spark, rows_of(seed)), "key", "own", 0.7, lot)
        assert sorted(tuple(r) for r in got.collect()) == want and want
