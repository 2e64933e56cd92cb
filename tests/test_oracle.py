"""Every query of the engine equals its SQL on the smallest tables."""

import pytest
from helpers import DATA, assert_same, connection

from lexigrid import registry

SF = "sf0.001"


@pytest.fixture(scope="module")
def db():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_sql(spark, db, name):
    assert_same(registry.queries()[name](spark, f"{DATA}/{SF}").toPandas(), db.sql(registry.oracle_sql()[name]).df())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
