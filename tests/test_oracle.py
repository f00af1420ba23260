"""Registered queries against their SQL twins. All of them with TEST_ALL_QUERIES=1, else some of each family."""

import os

import oracle_check
import pytest

import __spark_entry__ as entry

SOME = """g5_normalize_trapezoid g7_cdf_at_centers h4_cdf_point_mass h6_ppf h10_histogramize h10_point_mass_on_edge q4_cdf_ties
q10_histogramize q12_trimmed_average m2_pit m4_to_histogram d4_draws p2_peak_mean_trapezoid c1_truth_on_trapezoid c4_crps
c18_summarize j3_interval_overlap j5_nearest_neighbours a1_percentile_by_intervals t1_ranks_by_group w2_first_by_hash
r4_grid_selection r13_bags f1_all_differences f4_quantile_uniform f8_soft_clip e3_hierarchy e3_classifier_hierarchy e8_dithers e13_bagged_levels
k4_geometric_pool k5_quantile_pool x2_residual_quantiles x6_coverage_curve x8_central_range y3_randomized_pit y6_peaks
y9_learning_curve y10_permutation_importance s8_histogram_export s9_histogram_round_trip l1_stream_scores u5_wide_scan""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TEST_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_check.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf_dir, name):
    assert oracle_check.compare(spark, con, sf_dir, entry.queries()[name], entry.oracle_sql()[name], 1e-7) == ""


def test_every_query_is_named_after_an_operator():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 170


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() == 5 and {"crps", "pit_ks", "cde_loss"} <= set(out.columns)
