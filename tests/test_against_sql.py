"""Every registered query against its SQL, whole tables."""

import pytest

from tests.compare import compare, duck
from workload.oracles import oracles
from workload.queries import registered


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(registered()) == set(oracles())


@pytest.mark.parametrize("name", list(registered()))
def test_query(spark, con, sf_dir, name):
    assert compare(spark, con, registered()[name], oracles()[name], sf_dir) == ""


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 24
