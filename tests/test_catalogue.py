"""Every registered query of the library against its SQL, or for rows, on the smallest tables."""

import pytest

from quern.plans import catalogue
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    said = compare(spark, con, name, catalogue.QUERIES[name], catalogue.ORACLES.get(name), SF)
    # near-duplicate, clip and marker queries may have no rows on 200 documents
    assert said is None or (name not in catalogue.ORACLES and said == "no rows"), said


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_does_not_need_llm():
    import pathlib
    import re

    for path in pathlib.Path(catalogue.__file__).parent.parent.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path
