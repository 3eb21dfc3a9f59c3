"""Registered queries against their SQL on the smallest tables. ``workload.compare`` runs all of them."""

import pytest

import __spark_entry__ as entry
from fluxloom.plans.common import MODELS
from workload import catalogue, registry
from workload.compare import connect, difference
from workload.views import Views

SF = "/root/testdata/sf0.001"
assert catalogue
SAMPLE = (
    "scan_text_csv flatten_grid load_treatments clean_porewater labels transpose_compare missing_issues "
    "latest_issue daily_targets daily_targets_bracketed future_drivers box_summary complete_fixed_months "
    "interpolate_linear colwell series_stats score_all metric_table median_rmse_by_treatment rmse_change_from_averaging "
    "fc_climatology_backfill replicate_mode fc_ets edm_select_dimension gram_entries ensemble_to_normal "
    "fc_elastic_net pooled_fit fc_ets_suppliers fc_climatology_suppliers smap_fit additive_fit forecast_skill_by_treatment"
).split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    problem, _ = difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert problem is None, problem


def test_every_query_has_a_check():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert len(registry.QUERIES) > 150
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("model", ["elasticNet", "svm", "brnn"])
@pytest.mark.parametrize("dates", ["issues", "backfill_issues"])
def test_driver_models_join_no_fits_without_keys(spark, model, dates):
    views = Views(spark, SF)
    forecast = MODELS[model](views.monthly, views.drivers, getattr(views, dates))
    plan = forecast._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
