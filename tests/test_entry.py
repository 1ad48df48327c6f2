import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

BASE = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
@pytest.mark.parametrize("name", ["conversation_counts", "response_latency", "phase_labels", "event_transitions", "segmented_documents", "code_block_counts", "text_advice"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{BASE}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    df = entry.queries()[name](spark, BASE)
    assert sorted(names) == sorted(df.columns)
    assert Counter(repr(tuple(r)) for r in df.select(*names).collect()) == Counter(repr(tuple(r)) for r in cur.fetchall())
