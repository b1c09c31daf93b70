"""Every registered query: its SQL twin where there is one, else that it runs."""

import check
import pytest

from canopyframe.plans.catalogue import QUERIES, SQL

# The streaming and per-site queries that take long are run once each below.
NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con(folder):
    return check.connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        assert check.compare(df, con, SQL[name]).startswith("ok")
    else:
        assert len(df.columns) > 0
        df.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_are_clean():
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op")]
