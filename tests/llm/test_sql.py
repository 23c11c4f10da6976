"""Queries of the operators against their SQL."""

import pytest

from corpusloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_same_rows_as_sql(spark, oracle, rows_of, name, sf):
    got, expected = registry.QUERIES[name](spark, sf).toPandas(), oracle(registry.ORACLES[name], sf)
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


def test_every_operator_is_registered():
    numbers = {int(name[2:].split("_")[0]) for name in registry.QUERIES}
    assert numbers == set(range(1, 11))
