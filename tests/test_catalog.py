import pytest

import __spark_entry__ as entry
from claravoz.catalog import ORACLES, QUERIES, files
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, sf, name):
    assert compare(spark, duck, sf, QUERIES[name], ORACLES.get(name)) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["phase", "column", "metric", "value"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_mixed_files_are_whole_when_tasks_differ(spark, sf):
    """One file of a kind and nation, its header first, also when adaptive execution joins the header's tasks but not the rows'."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b")
    try:
        root = files._mixed(spark, sf)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).selectExpr("path", "substr(decode(content, 'ISO-8859-1'), 1, 16) AS head")
    rows = [(r["path"].rsplit("/", 1)[0], r["head"]) for r in found.collect() if "/part-" in r["path"]]
    assert len(rows) == len({p for p, _ in rows})
    assert {h for p, h in rows if "kind=ragged" in p} == {"key,name,segment"}
