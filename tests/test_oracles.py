"""Every registered query against its SQL, and every other one for rows."""

import oracle
import pytest

from retentia.checks import ORACLES, QUERIES
from retentia.plans import views
from retentia.sources.tables import materialize

# Model fits take tens of seconds each and have their own tests on small frames.
SLOW = {n for n in QUERIES if n not in ORACLES and n not in ("x4_feature_elimination", "m7_model_registry")}


@pytest.fixture(scope="module", autouse=True)
def shared_views(spark, sf_dir):
    """The views that many queries start from are made once for all of them."""
    patch = pytest.MonkeyPatch()
    for name in ("clean_members", "cohort_transactions", "survival"):
        table = materialize(getattr(views, name)(spark, sf_dir), name)
        patch.setattr(views, name, lambda s, d, table=table: table)
    yield
    patch.undo()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    want = con.execute(ORACLES[name]).to_arrow_table()
    assert oracle.differences(got, want) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
