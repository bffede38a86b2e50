import pytest

import __spark_entry__ as app
from tools.compare import connect, difference

# model fits are covered elsewhere
NAMES = sorted(set(app.queries()) - {"gbt_train", "mlp_train", "grid_search", "random_search", "score_saved_model", "boosting_train",
                                     "wide_deep_train"})


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    got = app.queries()[name](spark, sf_dir).toPandas()
    sql = app.oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        assert difference(got, duck.execute(sql).df()) == ""


def test_entry(spark):
    out = app.entry(spark)
    assert out.columns == ["CpG_probe_id", "sum_squares_between_groups"] and out.count() == 132


def test_names_are_plain():
    assert set(app.oracle_sql()) <= set(app.queries())
    assert all(n.isidentifier() for n in app.queries())
