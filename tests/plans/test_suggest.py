from fieldlamp.plans import search


def test_prefixes_of_all_parts(spark, tmp_path):
    spark.createDataFrame([(1, "Almond red"), (2, "almond"), (50, "blue")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(7, "Alma")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {tuple(r) for r in search.suggest_all(spark, str(tmp_path)).collect()}
    assert got == {("alm", "almond", 1), ("alm", "almond red", 2), ("alm", "alma", 3), ("blu", "blue", 1)}
