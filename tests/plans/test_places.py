"""Nearest features where many rows share a place."""

import duckdb

from fieldlamp.operators import spatial as X
from fieldlamp.plans.registry import ORACLES, QUERIES
from fieldlamp.plans import texts  # noqa: F401


def test_places_meet_and_not_rows(spark, tmp_path, monkeypatch):
    """3,000 customers and 600 suppliers on ten and six places: same rows as the SQL, from no more than three suppliers a place and kind."""
    d = str(tmp_path)
    spark.range(3000).selectExpr("(id % 10) * 3 + 1000 * (id div 10) c_custkey").write.parquet(f"{d}/customer.parquet")
    spark.range(600).selectExpr("(id % 6) * 5 + 1000 * (id div 6) s_suppkey", "id % 7 s_nationkey").write.parquet(f"{d}/supplier.parquet")
    met, plain = [], X.near_pairs
    monkeypatch.setattr(X, "near_pairs", lambda a, b, metres: met.append((a.count(), b.count())) or plain(a, b, metres))
    got = QUERIES["o48_nearest_features"](spark, d)
    db = duckdb.connect()
    for t in ("customer", "supplier"):
        db.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    want = db.execute(f"select {', '.join(got.columns)} from ({ORACLES['o48_nearest_features']})").fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
    assert met == [(10, 6 * 3 * 3)]
