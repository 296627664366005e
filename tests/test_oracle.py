"""Every core query against its SQL twin, and those without one for what must hold of them."""

import pytest

from hashloom.plans.oracle import ORACLES
from hashloom.plans.queries import QUERIES

from compare import agrees


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    agrees(QUERIES[name], ORACLES[name], spark, sf_dir, duck)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_registers_all():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
