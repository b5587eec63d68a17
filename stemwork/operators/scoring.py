"""Scores of a cell: matched stems and detections, and overlaps of two labellings of the same points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stemwork.functions.scalars import BANDS, CLASSES, f1, height_band, in_box, rate

from . import matching, spatial
from .keys import joined


def score_plots(stems: DataFrame, dets: DataFrame, plots: DataFrame, keys: list[str], tol: float | str = 4.0, most: float | None = None, method: str = "greedy", up: float = 8.0, near: float = 4.0) -> DataFrame:
    """One row a plot with counts, rates, height error, recall by class and band, and kinds of false positives.

    stems: keys, stem, x, y, z, crown_class; dets: keys, det, x, y, z; plots: keys, cx, cy, half. Detections
    as far as the largest tolerance outside the core can match a stem, which counts for recall; precision is
    of core detections alone. A plot without detections scores 0, one that isn't in plots has no row.
    """
    widest = float(tol) if not isinstance(tol, str) else float(most or 0)
    p = plots.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)], "cx", "cy", "half")
    on = [F.col(k).eqNullSafe(F.col(f"_p{i}")) for i, k in enumerate(keys)]
    placed = dets.join(p, on).drop(*[f"_p{i}" for i in range(len(keys))])
    placed = placed.where(in_box("x", "y", "cx", "cy", F.col("half") + widest)).withColumn("core", in_box("x", "y", "cx", "cy", "half")).drop("cx", "cy", "half")
    if method == "optimal":
        match = matching.optimal(spatial.candidates(stems, placed, keys, tol, up, most), keys)
    else:
        match = matching.nearest_first(stems, placed, keys, tol, up, most, method={"greedy": matching.greedy, "rounds": matching.greedy_rounds}[method])
    match = match.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)], F.col("stem").alias("m_stem"), F.col("det").alias("m_det"))
    on = [F.col(k).eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(keys)]
    gone = [f"_m{i}" for i in range(len(keys))]
    by_det = placed.join(match, [*on, F.col("det") == F.col("m_det")], "left").drop(*gone)
    pairs_z = by_det.where("m_stem is not null").select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)], "m_stem", F.col("z").alias("m_z"), "core")
    by_stem = stems.join(pairs_z, [*on, F.col("stem") == F.col("m_stem")], "left").drop(*gone)
    hit, band = F.col("m_stem").isNotNull(), height_band("z")
    one = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    groups = [(c, F.col("crown_class") == c) for c in CLASSES] + [(f"h_{b}", band == b) for b in BANDS]
    aggs = [F.count("*").alias("n_ref"), one(hit).alias("TP"), one(hit & F.col("core")).alias("tp_core")]
    aggs += [F.sqrt(F.avg(F.when(hit, (F.col("m_z") - F.col("z")) * (F.col("m_z") - F.col("z"))))).alias("height_rmse")]
    aggs += [x for g, test in groups for x in (one(test).alias(f"n_{g}"), one(test & hit).alias(f"_tp_{g}"))]
    left = by_stem.groupBy(*keys).agg(*aggs)
    wrong = by_det.where("core and m_stem is null").select(*keys, "x", "y")
    known = by_stem.where(hit).select(*keys, "x", "y")
    kinds = spatial.isolated(wrong, known, near, keys).groupBy(*keys).agg(F.count_if("near").alias("fp_near"), F.count_if(~F.col("near")).alias("fp_isolated"))
    right = by_det.groupBy(*keys).agg(F.count_if("core").alias("n_det"))
    out = plots.select(*keys)
    for k, df in enumerate((left, right, kinds)):
        names = {c: f"_j{k}_{c}" for c in keys}
        out = out.join(df.withColumnsRenamed(names), [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left").drop(*names.values())
    counts = ["n_ref", "n_det", "TP", "tp_core", "fp_near", "fp_isolated", *[f"{x}_{g}" for g, _ in groups for x in ("n", "_tp")]]
    out = out.na.fill(0, counts).withColumns({"recall": rate("TP", "n_ref"), "precision": rate("tp_core", "n_det")}).withColumn("F1", f1("recall", "precision"))
    for g, _ in groups:
        out = out.withColumn(f"rec_{g}", rate(f"_tp_{g}", f"n_{g}"))
    return out.drop(*[f"_tp_{g}" for g, _ in groups])


def wrong_by_class(wrong: DataFrame, stems: DataFrame, matched: DataFrame, keys: list[str], near: float = 4.0, reach: float = 20.0) -> DataFrame:
    """(keys, crown_class, fp_near, fp_isolated): false positives by the class of the stem nearest to them within
    reach (NULL for none), near a matched stem or not. wrong: keys, point, x, y; stems: keys, stem, x, y, crown_class."""
    kinds = spatial.isolated(wrong, matched, near, keys)
    of = spatial.nearest(wrong, stems, reach, keys, "point", "stem", "crown_class")
    rows = joined(kinds, of, [*keys, "point"])
    return rows.groupBy(*keys, "crown_class").agg(F.count_if("near").alias("fp_near"), F.count_if(~F.col("near")).alias("fp_isolated"))


def point_set_iou(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pred_id, ref_id, inter, pred_size, ref_size, union, iou) of labels that share a point.

    points: keys, pred, ref; NULL is unassigned. Sizes count all points of a label.
    """
    size = lambda c: points.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias(f"{c}_size"))
    both = points.where("pred is not null and ref is not null").groupBy(*keys, "pred", "ref").agg(F.count("*").alias("inter"))
    rows = joined(joined(both, size("pred"), [*keys, "pred"]), size("ref"), [*keys, "ref"])
    rows = rows.withColumn("union", F.col("pred_size") + F.col("ref_size") - F.col("inter"))
    return rows.select(*keys, F.col("pred").alias("pred_id"), F.col("ref").alias("ref_id"), "inter", "pred_size", "ref_size", "union", rate("inter", "union").alias("iou"))


def coverage(points: DataFrame, keys: list[str], overlaps: DataFrame | None = None) -> DataFrame:
    """(keys, ref_id, max_iou) of every reference label, 0 where nothing overlaps it."""
    best = (point_set_iou(points, keys) if overlaps is None else overlaps).groupBy(*keys, "ref_id").agg(F.max("iou").alias("max_iou"))
    refs = points.where("ref is not null").select(*keys, F.col("ref").alias("ref_id")).distinct()
    return joined(refs, best, [*keys, "ref_id"], "left").na.fill(0.0, ["max_iou"])


def panoptic(cells: DataFrame) -> DataFrame:
    """Adds FP, FN, SQ, RQ, PQ, precision, recall and F1 to rows of n_pred, n_ref, TP and sum_iou."""
    out = cells.withColumns({"FP": F.col("n_pred") - F.col("TP"), "FN": F.col("n_ref") - F.col("TP"), "SQ": rate("sum_iou", "TP"), "precision": rate("TP", "n_pred"), "recall": rate("TP", "n_ref")})
    out = out.withColumns({"RQ": rate("TP", F.col("TP") + 0.5 * F.col("FP") + 0.5 * F.col("FN")), "F1": f1("recall", "precision")})
    return out.withColumn("PQ", F.coalesce(F.col("SQ") * F.col("RQ"), F.lit(0.0)))


def instance_cells(points: DataFrame, classes_of: DataFrame, keys: list[str], gate: float = 0.5) -> DataFrame:
    """Accumulators of each cell for pool_pq(): counts, sums of overlaps, the same by class of the reference.

    classes_of: keys, ref_id, crown_class; a reference without one is in the totals alone.
    """
    overlaps = point_set_iou(points, keys)
    matched = matching.iou_match(overlaps, keys, gate)
    refs = joined(coverage(points, keys, overlaps), classes_of.select(*keys, "ref_id", "crown_class"), [*keys, "ref_id"], "left")
    refs = joined(refs, matched.select(*keys, "ref_id", F.col("iou").alias("m_iou")), [*keys, "ref_id"], "left")
    aggs = [F.count("*").alias("n_ref"), F.count("m_iou").alias("TP"), F.coalesce(F.sum("m_iou"), F.lit(0.0)).alias("sum_iou"), F.sum("max_iou").alias("sum_maxiou")]
    for c in CLASSES:
        of = F.col("crown_class") == c
        aggs += [F.count_if(of).alias(f"n_{c}"), F.count(F.when(of, F.col("m_iou"))).alias(f"tp_{c}"), F.coalesce(F.sum(F.when(of, F.col("m_iou"))), F.lit(0.0)).alias(f"sumiou_{c}"), F.coalesce(F.sum(F.when(of, F.col("max_iou"))), F.lit(0.0)).alias(f"sumcov_{c}")]
    preds = points.groupBy(*keys).agg(F.count_distinct("pred").alias("n_pred"))
    counts = ["n_ref", "TP", *[f"{p}_{c}" for c in CLASSES for p in ("n", "tp")]]
    sums = ["sum_iou", "sum_maxiou", *[f"{p}_{c}" for c in CLASSES for p in ("sumiou", "sumcov")]]
    out = joined(preds, refs.groupBy(*keys).agg(*aggs), keys, "left").na.fill(0, counts).na.fill(0.0, sums)
    out = panoptic(out).withColumn("coverage", rate("sum_maxiou", "n_ref"))
    return out.withColumns({f"fn_{c}": F.col(f"n_{c}") - F.col(f"tp_{c}") for c in CLASSES})


def crowns_against_field(diameters: DataFrame, apexes: DataFrame, stems: DataFrame, field: DataFrame, keys: list[str], tol: float = 4.0) -> DataFrame:
    """Matched stems with the diameters of the instance that they match and those of the field.

    diameters: keys, id, d_eq, d_caliper; apexes: keys, id, x, y, z; stems: keys, stem, x, y, z, crown_class;
    field: stem, max_cd, ninety_cd.
    """
    m = matching.nearest_first(stems, apexes.withColumnRenamed("id", "det"), keys, tol).select(*keys, "stem", F.col("det").alias("id"))
    rows = joined(m, stems.select(*keys, "stem", "crown_class"), [*keys, "stem"])
    rows = joined(rows, diameters.select(*keys, "id", "d_eq", "d_caliper"), [*keys, "id"], "left").join(field.dropDuplicates(["stem"]), "stem", "left")
    return rows.withColumn("area", F.pi() * (F.col("d_eq") / 2) * (F.col("d_eq") / 2)).select(*keys, "stem", "crown_class", "d_eq", "d_caliper", "area", "max_cd", "ninety_cd")
