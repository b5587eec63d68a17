"""Inputs of the queries, as projections of the driver's tables that Spark and DuckDB evaluate alike.

Each is one SELECT with the names of its tables in braces; spark_table() and duck_sql() put the tables in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()

_CLASS = {"dominant": "l_quantity > 37", "codominant": "l_quantity > 25 AND l_quantity <= 37", "intermediate": "l_quantity > 12 AND l_quantity <= 25", "suppressed": "l_quantity <= 12"}
_BAND = {"h_short": "l_tax < 0.03", "h_mid": "l_tax >= 0.03 AND l_tax < 0.06", "h_tall": "l_tax >= 0.06"}
_COUNTS = ", ".join(f"count_if({t}) AS n_{g}, count_if({t} AND l_discount >= 0.05) AS tp_{g}" for g, t in (_CLASS | _BAND).items())
_RATES = ", ".join(f"n_{g}, CASE WHEN n_{g} > 0 THEN CAST(tp_{g} AS DOUBLE) / n_{g} END AS rec_{g}" for g in _CLASS | _BAND)

SQL = {
    # one row a site x plot x rung x detector with counts, and recall by class and band
    "scored_cells": f"""
SELECT site, plot, plotType, rung, detector, n_ref, TP, n_det, tp_core, fp_credited, frdens,
  CASE WHEN n_det > 0 THEN CAST(tp_core AS DOUBLE) / n_det END AS "precision", CASE WHEN TP > 0 THEN CAST(TP AS DOUBLE) / 8 END AS height_rmse, chm_res, {_RATES}
FROM (SELECT r_name AS site, CAST(l_partkey AS STRING) AS plot, CASE WHEN l_partkey % 3 = 0 THEN 'tower' ELSE 'distributed' END AS plotType,
  CASE l_linenumber WHEN 1 THEN 'native' WHEN 2 THEN '8' WHEN 3 THEN '4' WHEN 4 THEN '2' ELSE '1' END AS rung, l_returnflag AS detector,
  count(*) AS n_ref, count_if(l_discount >= 0.05) AS TP, count_if(l_quantity >= 10) AS n_det, count_if(l_discount >= 0.05 AND l_quantity >= 10) AS tp_core,
  count_if(l_discount < 0.02 AND l_quantity >= 10) AS fp_credited, CAST(sum(l_suppkey % 16) AS DOUBLE) / 4 AS frdens, CASE WHEN l_partkey % 2 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS chm_res, {_COUNTS}
  FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
  GROUP BY r_name, l_partkey, l_linenumber, l_returnflag)""",
    # points in the cells of their label; even ids are stems, odd ones detections
    "points": """
SELECT label AS cell, vec_id AS point, CAST({e1} AS DOUBLE) * 50 AS x, CAST({e2} AS DOUBLE) * 50 AS y, CAST({e3} AS DOUBLE) * 20 + 10 AS z,
  CASE vec_id % 3 WHEN 0 THEN 'chm_vwf' WHEN 1 THEN 'li2012' ELSE 'deepforest' END AS arm, CASE vec_id % 4 WHEN 0 THEN 'dominant' WHEN 1 THEN 'codominant' WHEN 2 THEN 'intermediate' ELSE 'suppressed' END AS crown_class
FROM {embeddings}""",
    # a larger cloud: plots of 100 m a side
    "cloud": """
SELECT CAST(l_suppkey % 50 AS INT) AS cell, l_orderkey * 8 + l_linenumber AS point, CAST((l_partkey * 7919 + l_orderkey * 31) % 10000 AS DOUBLE) / 100 AS x, CAST((l_orderkey * 3571 + l_linenumber * 977) % 10000 AS DOUBLE) / 100 AS y, l_quantity / 2 AS z FROM {lineitem}""",
    # predicted and reference label of each point
    "labelled": """
SELECT l_linenumber AS cell, CASE WHEN l_quantity >= 5 THEN l_partkey % 40 END AS pred, CASE WHEN l_tax <> 0 THEN CASE WHEN l_quantity < 30 THEN l_partkey % 40 ELSE l_suppkey % 40 END END AS ref
FROM {lineitem}""",
    "scored": """
SELECT d.doc_id AS "row", d.lang AS arm, CAST(d.n_chars AS DOUBLE) AS raw, l.quality AS label, CAST(least(d.n_chars, 4000) AS DOUBLE) / 4000 AS prob
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "crowns": """
SELECT p_brand AS algo, CASE l_linestatus WHEN 'O' THEN 'native' ELSE NULL END AS rung, l_extendedprice / l_quantity AS d_eq, l_quantity AS d_caliper, p_retailprice AS ninety_cd, CAST(p_size AS DOUBLE) AS max_cd
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "plots": """
SELECT c_mktsegment AS stratum, c_custkey AS plot, c_acctbal AS metric, 1 + CAST(c_custkey % 7 AS DOUBLE) / 4 AS sigma FROM {customer}""",
    "runs": """
SELECT c_mktsegment AS site, CAST(o_custkey AS STRING) AS plot, 'native' AS rung, o_orderpriority AS arm, max(o_totalprice) AS F1, min(o_orderkey) AS "row"
FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment, o_custkey, o_orderpriority""",
    "events": "SELECT event_id, ts, user_id, event_type, value, props FROM {events}",
    "orders": "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM {orders}",
    "nation": "SELECT n_nationkey, n_name, n_regionkey FROM {nation}",
    "part": "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM {part}",
    "items": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM {lineitem}",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a DataFrame over the Parquet tables of sf_dir."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    text = SQL[name].format(**tables, **{f"e{k}": f"element_at(embedding, {k})" for k in (1, 2, 3)})
    return spark.sql(text.replace('"precision"', "`precision`").replace('"row"', "`row`"))


def ctes(*names: str) -> str:
    """The fixtures as DuckDB common table expressions, without WITH; names that clash with tables get an f_."""
    fill = {t: t for t in TABLES} | {f"e{k}": f"embedding[{k}]" for k in (1, 2, 3)}
    return ", ".join(f"f_{n} AS ({SQL[n].format(**fill)})" for n in names)
