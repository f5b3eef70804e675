"""Every query of the engine that has SQL, against DuckDB on the smallest tables."""

import pytest
from compare import same

from lanewright.plans import catalog

SQL, RUN = catalog.oracle_sql(), catalog.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    same(RUN[name](spark, sf), SQL[name], sf)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_in_the_engine_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "lanewright"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "lanewright.llm" not in path.read_text(), path
