import pytest

import __spark_entry__
from namelode import queries as core
from tests.compare import same_rows

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["record_id", "snapshot_no", "change"]


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_as_sql(spark, name):
    same_rows(spark, name, core.queries()[name], core.oracle_sql()[name], DATA)


@pytest.mark.parametrize("name", ["token_weights", "transliterated_names", "boolean_queries", "hydrated_records"])
def test_runs(spark, name):
    assert core.queries()[name](spark, DATA).count() > 0
