from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_each_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


EARLIER = ["composition_at_px", "j6_knn_join", "j1_match_by_radius", "g7_token_overlap", "a8_marker_score", "a23_report", "m6_checkerboard_folds", "x7_cliffs_delta"]
RECENT = ("tessera.plans.inference", "tessera.plans.records", "tessera.plans.shapes")


@pytest.mark.parametrize("name", EARLIER + sorted(n for n, f in entry.queries().items() if f.__module__ in RECENT and n in entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "labels", "documents", "embeddings", "events", "customer", "nation", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda v: round(float(v), 6) if isinstance(v, float | Decimal) else v
    rows = lambda of: sorted(str([plain(v) for v in r]) for r in of)
    assert rows([r[c] for c in columns] for r in got.collect()) == rows(want)
