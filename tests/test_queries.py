import pytest

from lumenframe import catalog

from oracle import assert_same, database


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(name, spark, sf, db):
    result = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLES:
        assert_same(result, catalog.ORACLES[name], db)
    else:
        assert result.count() > 0


def test_entry_and_registry():
    import __spark_entry__ as entry

    assert set(catalog.ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_the_corpus_subpackage_imports_it():
    import pathlib
    import re

    root = pathlib.Path(catalog.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(from|import)\s+[.\w]*\bllm\b", path.read_text()), path
