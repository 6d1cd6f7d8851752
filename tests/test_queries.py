"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from lexiloom.plans import catalogue
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
#: The language-model scores share their joins; one of them stands for the others here.
SLOW = {"perplexity", "sentence_perplexity", "interpolate_scores"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in SLOW])
def test_query(spark, con, name):
    if name in catalogue.ORACLE:
        assert compare(spark, con, SF, catalogue.QUERIES[name], catalogue.ORACLE[name]) == ""
    else:
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
