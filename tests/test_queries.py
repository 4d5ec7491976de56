"""Registered queries against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from wrackline.plans import registry

NAMES = [
    "scan_scl_stack", "tile_to_pixels", "stac_overpass", "iso_date_normalise", "time_grid", "correct_scl", "scl_legend", "dms_to_coords", "dataset_assemble",
    "scl_scene_quality", "scene_cloud_score", "reference_map_local", "reference_map_clean", "water_frequency", "percentile_stretch_band", "percentile_stretch_rgb",
    "recovery_gain", "distance_transform", "make_grid", "transition_geometry", "contour_cells", "anomaly_join", "nearest_valid_probe", "tide_interpolate", "tide_interpolate_spline",
    "tide_error_metrics", "gap_statistics", "distribution_verdict", "window_metric_table", "tide_predict", "tide_gridded",
]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, float):
        return f"{round(v, 6) + 0.0:.6f}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_duckdb(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    rel = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == sorted([plain(r[i]) for i in at] for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["y", "x", "intertidal"]


def test_every_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pixels_stay_off_the_driver(spark, sf_dir):
    """The quality-to-mask plan is one lazy plan: scan, partial aggregation, exchange, no Python."""
    plan = registry.queries()["intertidal_mask"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan and "Pandas" not in plan
