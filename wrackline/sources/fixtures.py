"""Coastal views over the driver's star-schema tables. One SQL text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "scl_obs": """
WITH k AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS scene_date,
         year(l_shipdate) * 12 + month(l_shipdate) - 1 AS scene_no,
         CAST(l_partkey % 48 AS INT) AS y, CAST(l_orderkey % 64 AS INT) AS x,
         max(l_quantity) AS q, max(l_linenumber) AS ln
  FROM {lineitem} GROUP BY 1, 2, 3, 4)
SELECT scene_date, y, x, CAST(CASE
    WHEN q <= ((scene_no * 7) % 10) * 5 THEN
      CASE ln % 5 WHEN 0 THEN 3 WHEN 1 THEN 8 WHEN 2 THEN 9 WHEN 3 THEN 10 ELSE 11 END
    WHEN x < 24 THEN 6
    WHEN x >= 40 THEN CASE WHEN ln % 2 = 0 THEN 4 ELSE 5 END
    WHEN x - 24 < (scene_no % 16) THEN 6 ELSE 5 END AS INT) AS scl
FROM k""",
    "rgb_obs": """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS scene_date,
       CAST(l_partkey % 48 AS INT) AS y, CAST(l_orderkey % 64 AS INT) AS x,
       CASE WHEN max(l_linenumber) = 7 THEN NULL ELSE max(l_extendedprice) / 10 END AS b04,
       CASE WHEN max(l_linenumber) = 7 THEN NULL ELSE min(l_extendedprice) / 10 END AS b03,
       CASE WHEN max(l_linenumber) = 7 THEN NULL ELSE max(l_quantity) * 100 END AS b02
FROM {lineitem} GROUP BY 1, 2, 3""",
    "tide_reference": "SELECT event_type AS model, ts, (value - 50) / 40 AS height_m FROM {events}",
    "tide_samples": "SELECT event_type AS model, ts, (value - 50) / 40 AS height_m FROM {events} WHERE user_id % 10 = 0",
    "catalogue": """
SELECT event_id AS seq, ts AS dt_utc, CAST(ts AS DATE) AS scene_date,
       CASE WHEN event_type IN ('click', 'view') THEN 'S2MSI2A' ELSE 'S2MSI1C' END AS product_type,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE least(value, 100.0) END AS cloud_cover
FROM {events}""",
    "observed": "SELECT o_orderdate AS datetime, avg(o_totalprice) / 100000 - 2.5 AS height_m FROM {orders} GROUP BY 1",
    "predicted": """
SELECT l_shipdate AS datetime, avg(l_extendedprice) / 20000 - 2.5 AS got410_height_m,
       CASE WHEN count(*) % 7 = 0 THEN NULL ELSE avg(l_quantity) / 10 - 2.5 END AS cmems_height_m
FROM {lineitem} GROUP BY 1""",
    "zos": """
SELECT CAST(o_orderkey % 720 AS INT) AS hour_no,
       CAST(floor(o_orderkey / 720.0) AS INT) % 5 AS lat_i, CAST(floor(o_orderkey / 3600.0) AS INT) AS lon_i,
       CASE WHEN CAST(floor(o_orderkey / 720.0) AS INT) % 3 = 1 THEN NULL
            ELSE round(2 + cos(2 * pi() * (o_orderkey % 720) / 12.42) + 0.01 * floor(o_orderkey / 720.0), 9) END AS zos
FROM {orders}""",
    "constituents": """
SELECT * FROM (VALUES
  ('M2', CAST(1.20 AS DOUBLE), CAST(28.9841042 AS DOUBLE), CAST(90.0 AS DOUBLE)),
  ('S2', CAST(0.42 AS DOUBLE), CAST(30.0 AS DOUBLE), CAST(122.0 AS DOUBLE)),
  ('N2', CAST(0.25 AS DOUBLE), CAST(28.4397295 AS DOUBLE), CAST(71.0 AS DOUBLE)),
  ('K1', CAST(0.07 AS DOUBLE), CAST(15.0410686 AS DOUBLE), CAST(74.0 AS DOUBLE)),
  ('O1', CAST(0.06 AS DOUBLE), CAST(13.9430356 AS DOUBLE), CAST(324.0 AS DOUBLE))
) AS t(constituent, amp_m, speed_deg_h, phase_deg)""",
    "aoi_vertex": "SELECT * FROM (VALUES (0, 4, 4), (1, 60, 6), (2, 52, 44), (3, 8, 40)) AS t(vertex_no, vx, vy)",
}
TABLES = ("lineitem", "orders", "events")
HEIGHT, WIDTH = 48, 64


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **used)


def with_views(*names: str) -> str:
    """The views as the opening of a DuckDB query: WITH name AS (...), ..."""
    text = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return f"WITH {text}"
