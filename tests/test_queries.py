"""Every query of the tile engine that has SQL, against it; the others are in test_definitions."""

import pytest

from tests.oracle import assert_same
from tilewright.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(name, spark, sf, duck):
    assert_same(registry.QUERIES[name](spark, sf), duck, registry.ORACLES[name])


def test_queries_without_sql_have_tests():
    import pathlib

    text = (pathlib.Path(__file__).parent / "test_definitions.py").read_text()
    assert all(f'"{name}"' in text for name in registry.QUERIES if name not in registry.ORACLES)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
