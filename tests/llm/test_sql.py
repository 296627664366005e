"""The queries that SQL can express, against SQL."""

import pytest

from compare import agrees
from hashloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    agrees(QUERIES[name], ORACLES[name], spark, sf_dir, duck)
