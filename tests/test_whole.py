"""Queries return the whole result of their operator."""

import duckdb
import numpy as np

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def against_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = [r.asDict() for r in got.collect()]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(str(tuple(r[c] for c in columns)) for r in rows) == sorted(map(str, want))
    return rows


def test_prefer_first_gives_each_customer_a_row(spark):
    rows = against_sql(spark, "w5_prefer_first_each")
    orders = spark.read.parquet(f"{DATA}/orders.parquet").select("o_custkey", "o_orderstatus", "o_orderkey").collect()
    rank = {"P": 0, "O": 1, "F": 2}
    best = {}
    for r in orders:
        best[r["o_custkey"]] = min(best.get(r["o_custkey"], (9, 0)), (rank[r["o_orderstatus"]], r["o_orderkey"]))
    assert rows and {r["c_custkey"]: (rank[r["o_orderstatus"]], r["o_orderkey"]) for r in rows} == best


def test_checkerboard_gives_every_side(spark):
    rows = against_sql(spark, "m6_checkerboard_sides")
    cells = entry.queries()["m6_checkerboard_folds"](spark, DATA).count()
    assert len(rows) == 4 * cells and sum(r["side"] == "test" for r in rows) == cells and {r["side"] for r in rows} == {"train", "val", "test"}


def test_splits_give_own_folds_and_reused_test(spark):
    rows = against_sql(spark, "m3_resolve_splits_all")
    assert {r["split_idx"] for r in rows} == {-1, 0, 1, 2}
    reused = [r for r in rows if r["val_reused_test"]]
    assert reused and all(r["split_idx"] == 0 and r["side"] == "val" for r in reused)  # fold 1 has its own val, fold 2 no test


def test_pca_gives_projected_values(spark):
    vectors = np.array([r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()], float)
    values, axes = np.linalg.eigh(np.cov(vectors.T))
    axes = axes[:, ::-1][:, :4]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(4)])
    got = np.array([[r[f"p{i}"] for i in range(4)] for r in entry.queries()["e6_pca"](spark, DATA).collect()])
    want = (vectors - vectors.mean(axis=0)) @ axes
    assert np.abs(np.sort(got, axis=0) - np.sort(want, axis=0)).max() < 1e-4


def test_queries_use_the_operators_own_settings(spark, monkeypatch):
    from tessera.plans import queries

    seen = {}
    for module, name in ((queries.stats, "block_permutation_spearman"), (queries.models, "logistic_fit")):

        def stop(*args, _name=name, **more):
            seen[_name] = more
            raise StopIteration

        monkeypatch.setattr(module, name, stop)
    for name in ("x3_block_permutation", "e4_classifier"):
        try:
            entry.queries()[name](spark, DATA)
        except StopIteration:
            pass
    assert seen["block_permutation_spearman"].get("n_perm", 2000) == 2000 and seen["logistic_fit"].get("max_iter", 100) == 100
