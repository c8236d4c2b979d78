import importlib
import pkgutil

import fieldlamp


def test_every_module_imports():
    names = [m.name for m in pkgutil.walk_packages(fieldlamp.__path__, "fieldlamp.")]
    for name in names:
        importlib.import_module(name)
    assert "fieldlamp.sources.files" in names


def test_every_query_has_columns(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    for name in ("o1_scan_equal_order", "o41_latest_by_key", "o144_strip_tags", "o183_effective"):
        assert queries[name](spark, "/root/testdata/sf0.001").columns
