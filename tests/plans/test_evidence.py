"""Evidence comes from postings, and tokens stay where they are."""

import pytest

from fieldlamp.operators import retrieval as S
from fieldlamp.plans import search, shaping  # noqa: F401
from fieldlamp.plans.registry import QUERIES
from tests.plans.test_search import same_as_sql

ALL = ("o34_furniture", "o60_evidence_order", "o63_relevance_multiplier_all", "o71_diversify_decay_all", "o75_with_evidence", "o75_zero_evidence_drop_all", "o97_weighted_minmax")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Terms in the title, behind it, on its edge, in both and repeated; a text of null and one of nothing."""
    d = str(tmp_path_factory.mktemp("tables"))
    texts = ["lantern a b c d e f storm", "a b c d e f g h lantern storm", "a b c d e f g Lantern storm", "storm " * 12 + "lantern", "lantern", "nothing", "", None]
    docs = [(i, t, f"src{i % 4}", "en") for i, t in enumerate(texts * 3)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "the lantern"), (2, "lantern in a storm of lantern"), (4, "Storm"), (6, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", ALL)
def test_no_text_meets_a_query(spark, tables, name):
    assert same_as_sql(spark, tables, name)
    assert not [f for f in QUERIES[name](spark, tables).inputFiles() if "documents.parquet" in f]


def test_tokens_are_not_shuffled_for_a_small_batch(spark, tables):
    posts = S.wanted_postings(spark.read.parquet(f"{tables}/documents.parquet"), search.terms_of(search.batch(spark, tables)))
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
