import os

import duckdb
import pytest

from fieldlamp.plans import search  # noqa: F401
from fieldlamp.plans.registry import ORACLES, QUERIES

DOCS = 60


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """One query whose word stands in 60 documents, the rarer sources in the longest, which rank last."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, "lantern " + f"word{i} " * (i + 1), "src0" if i < 45 else "src3", "en") for i in range(DOCS)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "the lantern")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def same_as_sql(spark, tables, name):
    db = duckdb.connect()
    for t in os.listdir(tables):
        db.execute(f"create view {t.split('.')[0]} as select * from '{tables}/{t}/*.parquet'")
    df = QUERIES[name](spark, tables)
    cols = ", ".join(df.columns)
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(db.execute(f"select {cols} from ({ORACLES[name]})").fetchall())
    return got


def test_every_scored_document_is_ranked(spark, tables):
    assert len(same_as_sql(spark, tables, "o63_relevance_multiplier_all")) == DOCS
    assert same_as_sql(spark, tables, "o72_facet_counts_all") == [(1, "src0", 45), (1, "src3", 15)]
    rescued = {r[1] for r in same_as_sql(spark, tables, "o74_rescue_cap_all")}
    assert rescued & set(range(45, DOCS)) == {45, 46}
