"""Registered queries agree with their SQL on the smallest data folder."""

from pathlib import Path

import duckdb
import pytest

from quillrec.plans import catalog

FOLDER = "/root/testdata/sf0.001"
CHOSEN = ("win_1_leave_one_out", "agg_2_item_stats", "rec_hot", "rec_itemcf", "rec_merge7", "evl_1_metrics", "qry_cold", "twin_1_matches")


def text(value):
    return repr(0.0 if value == 0 and isinstance(value, float) else value)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    cursor = con.execute(catalog.SQL[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(tuple(text(v) for _, v in sorted(zip(columns, row))) for row in cursor.fetchall())
    df = catalog.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(text(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want
