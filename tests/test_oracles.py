"""A few queries of each family against their SQL on the smallest tables; the driver compares all of them."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = ("classify_chunks", "extract_money", "claim_types", "dedup_nodes", "query_range", "avg_confidence", "traverse_out", "confidence", "incr_plan", "merge_adapter", "diff", "chat_retrieve", "route_source", "adapter_ical")


def plain(v):
    return None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(str([plain(v) for v in r]) for r in cursor.fetchall())
    got = sorted(str([plain(v) for v in r]) for r in df.select(*names).collect())
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
