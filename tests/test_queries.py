"""Every query against its DuckDB statement, or against having rows and a stable schema."""

import pytest

from sondage.plans import ORACLES, PLANS


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(name, agree):
    agree(PLANS[name], ORACLES[name])


#: Slow queries that test_operators.py and test_trees.py run.
ELSEWHERE = {"nested_cv", "nested_cv_trees", "grown_forest", "grown_boosted", "tree_shapley", "copula_null", "procedure_bootstrap", "saturation_curve", "containment_check", "provenance_gate", "nested_best_single_auc", "multivariable_lift_interval"}


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(ORACLES) - ELSEWHERE))
def test_has_rows(name, spark, small):
    df = PLANS[name](spark, small)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150
    assert set(ORACLES) <= set(__spark_entry__.queries())
