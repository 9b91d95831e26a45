import pytest
from sqlcheck import assert_same, duck

from rungs.plans import payload_queries, queries, stream_queries  # noqa: F401  all register


@pytest.fixture(scope="module")
def conn(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_what_its_sql_gives(spark, data, conn, name):
    df = queries.QUERIES[name](spark, data)
    if name in queries.SQL:
        assert_same(df, conn, queries.SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["bracket", "spec_id", "slot", "item_id", "usage_count", "total", "usage_pct"]
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_gems_with_the_ids_of_parts(spark, data, tmp_path):
    """Parts go on to ids from 100,000 and 200,000, which gems and enchant sources have too, as in larger tables."""
    c = duck(data)
    for name, key in (("part", "p_partkey"), ("lineitem", "l_partkey")):
        rows, more = spark.read.parquet(f"{data}/{name}.parquet"), spark.createDataFrame([(0,), (100000,), (200000,)], "more bigint")
        rows.crossJoin(more).withColumn(key, rows[key] + more["more"]).drop("more").write.parquet(f"{tmp_path}/{name}.parquet")
        c.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert c.execute("SELECT count(*) FROM part JOIN supplier ON p_partkey IN (s_suppkey + 100000, s_suppkey + 200000)").fetchone()[0] > 0
    for name in ("ingest_item_dims", "ingest_enchant_dims"):
        assert_same(queries.QUERIES[name](spark, str(tmp_path)), c, queries.SQL[name])
