import pytest

from lodestone.plans import registry

from .conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
