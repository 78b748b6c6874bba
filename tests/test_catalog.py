import pytest
from tests.oracle import same
from tilesmith.plans.catalog import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert same(spark, "/root/testdata/sf0.01", name, QUERIES, ORACLE)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["bag", "cls", "score"] and df.count() > 0


def test_only_a_missing_module_is_passed_over(tmp_path, monkeypatch):
    import __spark_entry__ as e

    assert e._optional("no_such_package.module") is None
    (tmp_path / "broken_extra.py").write_text("import no_such_package")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ImportError):
        e._optional("broken_extra")
