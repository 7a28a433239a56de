"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from promptweir import registry
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_its_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(ORACLES) <= set(QUERIES)


def test_stream_numbers_do_not_depend_on_batches(spark, db):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    result = compare(spark, db, SF_DIR, QUERIES["stream_pairs"], ORACLES["stream_pairs"])
    spark.conf.set(name, before)
    assert result["match"] is True, result


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    result = compare(spark, db, SF_DIR, QUERIES[name], ORACLES.get(name))
    assert result["match"] is (True if name in ORACLES else None), result
    assert result["rows"] > 0 or name.startswith("stream_category")


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"category", "prompts", "mean_confidence", "longest_history"} == set(rows[0].asDict())
