"""Queries of the pooling family: guards, pools, deltas, storeys, ranks, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemwork.functions.scalars import BANDS, CLASSES, rate, rung_order
from stemwork.operators import pooling, selection, statistics

from .fixtures import ctes, fixture

ARMS = ["A", "N", "R"]
GROUPS = [*CLASSES, *[f"h_{b}" for b in BANDS]]
_R = "CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END"
_F1 = "CASE WHEN {r} + {p} > 0 THEN 2 * {r} * {p} / ({r} + {p}) END"


def r(a: str, b: str) -> str:
    return _R.format(a=a, b=b)


def pool_sql(source: str, by: str, extra: str = "") -> str:
    """DuckDB pool of scored cells by the columns `by`."""
    hits = ", ".join(f"CAST(sum(CASE WHEN n_{g} > 0 THEN round_even(rec_{g} * n_{g}, 0) ELSE 0 END) AS BIGINT) AS t_{g}, CAST(sum(n_{g}) AS BIGINT) AS n_{g}" for g in GROUPS)
    recs = ", ".join(f"n_{g}, {r(f't_{g}', f'n_{g}')} AS rec_{g}" for g in GROUPS)
    under = "n_intermediate + n_suppressed"
    return f"""SELECT *, {_F1.format(r='recall', p='precision_cred')} AS F1_cred FROM (
SELECT *, {_F1.format(r='recall', p='"precision"')} AS F1 FROM (
SELECT {by}, n_plots, n_ref, n_det, TP, tp_core, {r('TP', 'n_ref')} AS recall, {r('tp_core', 'n_det')} AS "precision", {recs}, {under} AS n_understory,
{r('(t_intermediate + t_suppressed)', f'({under})')} AS rec_understory, fp_credited, {r('tp_core', 'greatest(n_det - fp_credited, tp_core)')} AS precision_cred{extra}
FROM (SELECT {by}, count(DISTINCT site || '::' || plot || '::' || rung) AS n_plots, CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(n_det) AS BIGINT) AS n_det, CAST(sum(TP) AS BIGINT) AS TP,
CAST(sum(tp_core) AS BIGINT) AS tp_core, CAST(sum(fp_credited) AS BIGINT) AS fp_credited, round_even(avg(frdens), 2) AS mean_frdens, {hits} FROM {source} GROUP BY {by})))"""


GUARD = "guard AS (SELECT site, plot, rung FROM f_scored_cells GROUP BY ALL HAVING count(DISTINCT detector) = 3), kept AS (SELECT c.* FROM f_scored_cells c SEMI JOIN guard USING (site, plot, rung))"
PLACE = "CASE rung WHEN 'native' THEN 1 WHEN '8' THEN 2 WHEN '4' THEN 3 WHEN '2' THEN 4 WHEN '1' THEN 5 ELSE 6 END"


def pool_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled rates by detector and density level over the cells that all detectors have scored."""
    return pooling.pool_arms(fixture(spark, sf_dir, "scored_cells"), ARMS)


def pool_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled rates by site and detector, and over all sites, in one pass over the cells."""
    return pooling.pool_with_all(fixture(spark, sf_dir, "scored_cells"), ["detector"])


def guard_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.equal_set_guard(fixture(spark, sf_dir, "scored_cells"), ARMS)[1]


def deltas_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.deltas(pooling.pool(pooling.equal_set_guard(fixture(spark, sf_dir, "scored_cells"), ARMS)[0], ["detector", "rung"]), "A")


def storeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.storeys(fixture(spark, sf_dir, "scored_cells"), ["site", "rung"])


def weighted_height_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pooling.weighted_rmse(fixture(spark, sf_dir, "scored_cells"), ["detector", "rung"])
    return out.withColumn("height_rmse", F.round("height_rmse", 9))


def pool_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.scopes(pooling.pool(fixture(spark, sf_dir, "scored_cells"), ["site", "detector"]), ["site", "detector"])


def paired_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of two detectors on the cells that both have, and how many cells were left out."""
    kept, dropped = pooling.pair_cells(fixture(spark, sf_dir, "scored_cells"), "A", "R")
    return pooling.pool(kept, ["detector"]).select("detector", "n_plots", "n_ref", "TP", "recall", "precision", "F1").crossJoin(F.broadcast(dropped))


def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win rate and mean difference in recall of two detectors by level, cell by cell."""
    kept, _ = pooling.pair_cells(fixture(spark, sf_dir, "scored_cells"), "A", "R")
    pick = lambda d, n: kept.where(F.col("detector") == d).select("site", "plot", "rung", rate("TP", "n_ref").alias(n))
    rows = pick("A", "a").join(pick("R", "b"), ["site", "plot", "rung"])
    return statistics.win_rate(rows, ["rung"], "a", "b")


def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best resolution of each detector and level by pooled F1, the finest of equal ones."""
    rows = pooling.pool(fixture(spark, sf_dir, "scored_cells"), ["detector", "rung", "chm_res"])
    return selection.best(rows, ["detector", "rung"], F.col("F1").desc_nulls_last(), F.col("chm_res")).select("detector", "rung", "chm_res", "n_ref", "TP", "F1")


def best_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pooling.pool(fixture(spark, sf_dir, "scored_cells"), ["site", "detector", "rung"])
    order = [F.col(c).desc_nulls_last() for c in ("F1", "recall", "precision")]
    return selection.best(rows, ["site", "detector"], *order, rung_order("rung")).select("site", "detector", "rung", "recall", "precision", "F1")


def complete_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled recall by site and level over plots that have every level of their site."""
    rows = selection.complete_cases(fixture(spark, sf_dir, "scored_cells"), "plot", "rung", ["site"])
    return rows.groupBy("site", "rung").agg(F.count_distinct("plot").alias("n_plots"), F.sum("TP").alias("TP"), F.sum("n_ref").alias("n_ref")).withColumn("recall", rate("TP", "n_ref"))


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pooling.pool(fixture(spark, sf_dir, "scored_cells"), ["site", "detector"])
    return statistics.ranks(rows.select("site", "detector", "F1", "recall", "precision"), ["F1", "recall", "precision"], ["site"])


def credit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of detectors by precision before and after crediting, and whether it changes."""
    rows = pooling.pool(fixture(spark, sf_dir, "scored_cells"), ["rung", "detector"])
    order = lambda v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(v)).alias("v"), "detector"))), lambda s: s["detector"]), ",")
    return rows.groupBy("rung").agg(order("precision").alias("before"), order("precision_cred").alias("after")).withColumn("changed", F.col("before") != F.col("after"))


def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau-b and Spearman's rho of pooled recall and precision over detectors and levels by site."""
    rows = pooling.pool(fixture(spark, sf_dir, "scored_cells"), ["site", "detector", "rung"]).withColumn("item", F.concat_ws("/", "detector", "rung"))
    out = statistics.rank_agreement(rows, "recall", "precision", ["site"], "item")
    return out.select("site", "n", F.round("tau", 9).alias("tau"), F.round("rho", 9).alias("rho"))


def oracle_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.oracle(fixture(spark, sf_dir, "runs"), "F1", ["site", "plot", "rung"], "row")


def policy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and summed value by site under the oracle and under each fixed arm."""
    runs = fixture(spark, sf_dir, "runs")
    keys = ["site", "plot", "rung"]
    chosen = selection.policy_rows(runs, selection.oracle(runs, "F1", keys, "row"), keys, "row").withColumn("policy", F.lit("oracle"))
    every = runs.withColumn("policy", F.col("arm")).unionByName(chosen)
    return every.groupBy("site", "policy").agg(F.count("*").alias("cells"), F.round(F.sum("F1"), 4).alias("total"))


def learned_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and summed value by site under a policy that a tree learns on other plots."""
    from stemwork.operators import routing

    runs = fixture(spark, sf_dir, "runs").withColumn("rung", F.lit("native"))
    keys = ["site", "plot", "rung"]
    best = selection.oracle(runs, "F1", keys, "row")
    sizes = runs.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.avg("F1").alias("mean"))
    picks = routing.learned(best.join(sizes, keys), ["n", "mean"], keys)
    return selection.policy_rows(runs, picks, keys, "row").groupBy("site").agg(F.count("*").alias("cells"), F.round(F.sum("F1"), 4).alias("total"))


def site_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled recall by detector and level on even and on odd plots, and the difference."""
    from stemwork.operators import ground_truth

    cells = fixture(spark, sf_dir, "scored_cells")
    half = lambda k: pooling.pool(cells.where(F.col("plot").cast("long") % 2 == k), ["detector", "rung"])
    return ground_truth.vintages(half(0), half(1), ["detector", "rung"], ["n_ref", "recall"])


def population_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.population(fixture(spark, sf_dir, "scored_cells"), ["site", "plot"], 12)
    return rows.groupBy("site").agg(F.count_distinct("plot").alias("plots"), F.sum("n_ref").alias("n_ref"))


def pq_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panoptic rates of accumulators summed by detector and level."""
    cells = fixture(spark, sf_dir, "scored_cells")
    acc = cells.select("detector", "rung", "TP", (F.col("n_det") - F.col("tp_core")).alias("FP"), (F.col("n_ref") - F.col("TP")).alias("FN"), F.col("n_det").alias("n_pred"), "n_ref", (F.col("TP") * 0.75).alias("sum_iou"), (F.col("n_ref") * 0.5).alias("sum_maxiou"))
    return pooling.pool_pq(acc, ["detector", "rung"], ()).withColumn("PQ", F.round("PQ", 12))


def pq_to_sql() -> str:
    s = ", ".join(f"CAST(sum({e}) AS BIGINT) AS {n}" for n, e in (("TP", "TP"), ("FP", "n_det - tp_core"), ("FN", "n_ref - TP"), ("n_pred", "n_det"), ("n_ref", "n_ref")))
    return f"""WITH {ctes('scored_cells')}, a AS (SELECT detector, rung, count(*) AS n_cells, {s}, CAST(sum(TP * 0.75) AS DOUBLE) AS sum_iou, CAST(sum(n_ref * 0.5) AS DOUBLE) AS sum_maxiou FROM f_scored_cells GROUP BY detector, rung),
b AS (SELECT *, {r('sum_iou', 'TP')} AS SQ, TP / (TP + 0.5 * FP + 0.5 * FN) AS RQ, {r('TP', 'n_pred')} AS "precision", {r('TP', 'n_ref')} AS recall, {r('sum_maxiou', 'n_ref')} AS coverage FROM a)
SELECT *, round(coalesce(SQ * RQ, 0), 12) AS PQ, {_F1.format(r='recall', p='"precision"')} AS F1 FROM b"""


QUERIES = {
    "pool_arms": pool_arms, "pool_sites": pool_sites, "guard_dropped": guard_dropped, "deltas_vs_baseline": deltas_vs_baseline, "storeys": storeys, "weighted_height_rmse": weighted_height_rmse, "pool_scopes": pool_scopes,
    "paired_cells": paired_cells, "head_to_head": head_to_head, "best_config": best_config, "best_per_site": best_per_site, "complete_case": complete_case, "leaderboard": leaderboard, "credit_order": credit_order,
    "rank_agreement": rank_agreement, "oracle_policy": oracle_policy, "policy_totals": policy_totals, "population_gate": population_gate, "pq_pool": pq_pool, "learned_policy": learned_policy, "site_vintages": site_vintages,
}

_C = ctes("scored_cells")
_SITE = f"p AS ({pool_sql('f_scored_cells', 'site, detector')})"
_SDR = f"p AS ({pool_sql('f_scored_cells', 'site, detector, rung')})"
_RECALL = "CAST(sum(TP) AS DOUBLE) / sum(n_ref)"
ORACLE_SQL = {
    "pool_arms": f"WITH {_C}, {GUARD} SELECT *, {PLACE} AS rung_place FROM ({pool_sql('kept', 'detector, rung', ', mean_frdens')})",
    "pool_sites": f"WITH {_C}, s AS (SELECT *, site AS scope FROM f_scored_cells UNION ALL SELECT *, 'ALL' AS scope FROM f_scored_cells) {pool_sql('s', 'scope, detector')}",
    "guard_dropped": f"WITH {_C} SELECT site, plot, rung FROM f_scored_cells GROUP BY ALL HAVING count(DISTINCT detector) < 3",
    "deltas_vs_baseline": f"""WITH {_C}, {GUARD}, p AS ({pool_sql('kept', 'detector, rung')})
SELECT a.detector, a.rung, a.recall, a."precision", a.F1, b.recall AS base_recall, b."precision" AS base_precision, b.F1 AS base_F1, a.recall - b.recall AS d_recall, a."precision" - b."precision" AS d_precision, a.F1 - b.F1 AS d_F1
FROM p a JOIN p b ON a.rung = b.rung AND b.detector = 'A' AND a.detector <> 'A'""",
    "storeys": f"""WITH {_C}, p AS ({pool_sql('f_scored_cells', 'site, rung')}), q AS (SELECT site, rung, {', '.join(f'CAST(sum(CASE WHEN n_{c} > 0 THEN round_even(rec_{c} * n_{c}, 0) ELSE 0 END) AS BIGINT) AS t_{c}, CAST(sum(n_{c}) AS BIGINT) AS n_{c}' for c in CLASSES)} FROM f_scored_cells GROUP BY site, rung)
SELECT site, rung, n_dominant + n_codominant AS n_over, n_intermediate + n_suppressed AS n_under, {r('(t_dominant + t_codominant)', '(n_dominant + n_codominant)')} AS rec_over, {r('(t_intermediate + t_suppressed)', '(n_intermediate + n_suppressed)')} AS rec_under FROM q""",
    "weighted_height_rmse": f"WITH {_C} SELECT detector, rung, round(sqrt(sum(TP * height_rmse * height_rmse) FILTER (TP > 0) / sum(TP) FILTER (TP > 0)), 9) AS height_rmse FROM f_scored_cells GROUP BY detector, rung",
    "pool_scopes": f"WITH {_C}, {_SITE} SELECT site, detector, 'all' AS scope, n_ref AS n, recall FROM p" + "".join(f" UNION ALL SELECT site, detector, '{c}', n_{c}, rec_{c} FROM p" for c in CLASSES),
    "paired_cells": f"""WITH {_C}, two AS (SELECT * FROM f_scored_cells WHERE detector IN ('A', 'R')), k AS (SELECT site, plot, rung, count(DISTINCT detector) AS n FROM two GROUP BY ALL), kept AS (SELECT two.* FROM two JOIN k USING (site, plot, rung) WHERE n = 2)
SELECT detector, n_plots, n_ref, TP, recall, "precision", F1, (SELECT count(*) FROM k WHERE n < 2) AS n_drop FROM ({pool_sql('kept', 'detector')})""",
    "head_to_head": f"WITH {_C} SELECT a.rung, count(*) AS n, avg(CASE WHEN CAST(a.TP AS DOUBLE) / a.n_ref > CAST(b.TP AS DOUBLE) / b.n_ref THEN 1.0 ELSE 0.0 END) AS wins FROM f_scored_cells a JOIN f_scored_cells b ON a.site = b.site AND a.plot = b.plot AND a.rung = b.rung AND a.detector = 'A' AND b.detector = 'R' GROUP BY a.rung",
    "best_config": f"WITH {_C}, p AS ({pool_sql('f_scored_cells', 'detector, rung, chm_res')}) SELECT detector, rung, chm_res, n_ref, TP, F1 FROM p QUALIFY row_number() OVER (PARTITION BY detector, rung ORDER BY F1 DESC NULLS LAST, chm_res) = 1",
    "best_per_site": f"WITH {_C}, {_SDR} SELECT site, detector, rung, recall, \"precision\", F1 FROM p QUALIFY row_number() OVER (PARTITION BY site, detector ORDER BY F1 DESC NULLS LAST, recall DESC NULLS LAST, \"precision\" DESC NULLS LAST, {PLACE}) = 1",
    "complete_case": f"""WITH {_C}, need AS (SELECT site, count(DISTINCT rung) AS n FROM f_scored_cells GROUP BY site), ok AS (SELECT site, plot FROM f_scored_cells JOIN need USING (site) GROUP BY site, plot, n HAVING count(DISTINCT rung) = n)
SELECT site, rung, count(DISTINCT plot) AS n_plots, CAST(sum(TP) AS BIGINT) AS TP, CAST(sum(n_ref) AS BIGINT) AS n_ref, {_RECALL} AS recall FROM f_scored_cells SEMI JOIN ok USING (site, plot) GROUP BY site, rung""",
    "leaderboard": f"WITH {_C}, {_SITE} SELECT site, detector, F1, recall, \"precision\", " + ", ".join(f'CAST(rank() OVER (PARTITION BY site ORDER BY "{v}" DESC NULLS LAST) AS INT) AS rank_{v}' for v in ("F1", "recall", "precision")) + " FROM p",
    "credit_order": f"""WITH {_C}, p AS ({pool_sql('f_scored_cells', 'rung, detector')}), o AS (SELECT rung, string_agg(detector, ',' ORDER BY -"precision", detector) AS before, string_agg(detector, ',' ORDER BY -precision_cred, detector) AS after FROM p GROUP BY rung)
SELECT *, before <> after AS changed FROM o""",
    "rank_agreement": f"""WITH {_C}, {_SDR}, s AS (SELECT site, detector || '/' || rung AS item, recall AS a, "precision" AS b FROM p WHERE recall IS NOT NULL AND "precision" IS NOT NULL),
t AS (SELECT x.site, sum(sign(x.a - y.a) * sign(x.b - y.b)) / sqrt(sum(abs(sign(x.a - y.a))) * sum(abs(sign(x.b - y.b)))) AS tau FROM s x JOIN s y ON x.site = y.site AND x.item < y.item GROUP BY x.site),
k AS (SELECT site, rank() OVER (PARTITION BY site ORDER BY a) + (count(*) OVER (PARTITION BY site, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY site ORDER BY b) + (count(*) OVER (PARTITION BY site, b) - 1) / 2.0 AS rb FROM s)
SELECT k.site, count(*) AS n, round(any_value(tau), 9) AS tau, round(covar_pop(ra, rb) / sqrt(var_pop(ra) * var_pop(rb)), 9) AS rho FROM k JOIN t USING (site) GROUP BY k.site""",
    "oracle_policy": f"WITH {ctes('runs')} SELECT site, plot, rung, arm FROM f_runs QUALIFY row_number() OVER (PARTITION BY site, plot, rung ORDER BY F1 DESC, \"row\") = 1",
    "policy_totals": f"""WITH {ctes('runs')}, o AS (SELECT site, 'oracle' AS policy, F1 FROM f_runs QUALIFY row_number() OVER (PARTITION BY site, plot, rung ORDER BY F1 DESC, "row") = 1)
SELECT site, policy, count(*) AS cells, round(sum(F1), 4) AS total FROM (SELECT site, arm AS policy, F1 FROM f_runs UNION ALL SELECT * FROM o) GROUP BY site, policy""",
    "population_gate": f"WITH {_C}, ok AS (SELECT site, plot FROM f_scored_cells GROUP BY site, plot HAVING count(*) >= 12) SELECT site, count(DISTINCT plot) AS plots, CAST(sum(n_ref) AS BIGINT) AS n_ref FROM f_scored_cells SEMI JOIN ok USING (site, plot) GROUP BY site",
    "pq_pool": pq_to_sql(),
    "site_vintages": f"""WITH {_C}, v AS (SELECT detector, rung, CAST(plot AS BIGINT) % 2 AS k, CAST(sum(n_ref) AS BIGINT) AS n_ref, {_RECALL} AS recall FROM f_scored_cells GROUP BY ALL)
SELECT detector, rung, a.n_ref AS n_ref_a, a.recall AS recall_a, b.n_ref AS n_ref_b, b.recall AS recall_b, b.n_ref - a.n_ref AS d_n_ref, b.recall - a.recall AS d_recall FROM (SELECT * FROM v WHERE k = 0) a FULL JOIN (SELECT * FROM v WHERE k = 1) b USING (detector, rung)""",
}
