"""Every registered query over the smallest tables against its SQL, a few of each kind."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from checks.compare import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SOME = ["search_styles", "list_products", "nearest_colors", "import_summary", "hsv_histogram", "token_idf", "upsert_cards", "assign_slots"]


def test_names_match():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries()[name](spark, FOLDER)
    cur = con.execute(oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
