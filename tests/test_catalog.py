"""Every query against its SQL."""

import pytest

from nearfield.plans import catalog
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(name, spark, sf_dir, duck):
    assert_same(catalog.queries()[name](spark, sf_dir), duck, catalog.oracle_sql()[name])
