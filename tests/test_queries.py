"""Queries against their SQL on the smallest tables, where these are present."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from stemwork.plans import catalog
from stemwork.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
FEW = "pool_arms pool_sites deltas_vs_baseline best_config rank_agreement oracle_policy greedy_match score_plots fused point_overlaps instance_cells isotonic crown_errors nearest_event strata_split jittered scalar_numbers box_detections core_labels seed_crowns crown_overlaps project_ranking heldout_optimum credit_grid key_seeds prepared_points matcher_grid rumple out_of_sample match_in_turn fusion_modes monte_carlo checked_detections box_files ply_round_trip frozen_clips geojson_files ground_triangles tin_heights tin_surface pit_free_surface nearest_three canopy_layers layered_tops auto_tops point_tree_scales ladder_pooled las_scan tile_box cloud_treetops height_validation fusion_board site_hulls".split()


@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    pd.testing.assert_frame_equal(got[order].sort_values(order).reset_index(drop=True), want[order].sort_values(order).reset_index(drop=True), check_dtype=False, rtol=1e-12)


def test_guarded_pools_read_the_cells_once(spark):
    for name, scans in (("pool_arms", 4), ("deltas_vs_baseline", 4)):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("FileScan") + plan.count("BatchScan") <= scans


def test_every_query_has_sql_or_a_reason():
    left = set(catalog.QUERIES) - set(catalog.ORACLE_SQL)
    assert left <= {"optimal_match", "soft_match", "crown_diameters", "watershed_crowns", "random_walker_crowns", "grown_crowns", "voronoi_crowns", "li_trees", "shifted_modes", "learned_policy"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_no_cartesian_product_in_spatial_joins(spark):
    plan = catalog.QUERIES["near_or_isolated"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
