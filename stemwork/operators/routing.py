"""Choosing a detector by a cell's features: a classification tree that never sees the fold it decides on."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from stemwork.sources.scratch import checkpointed

#: Folds that are fitted apart at most; plots beyond that share folds, so the driver's loop is bounded.
MOST_FOLDS = 5


def learned(cells: DataFrame, features: list[str], keys: list[str], label: str = "arm", group: str = "plot", least: int = 8, seed: int = 0) -> DataFrame:
    """(keys, arm) that a tree fitted on the other groups' best arms chooses for each cell.

    cells: keys, features (no NULLs), label: the best arm. Plots go to folds by hash; a tree's leaves hold at
    least `least` cells. Pruning differs from that of other tree packages. Plots that all meet in one fold are dealt
    again by other hashes; a single plot has no others to learn from, and its arm is NULL.
    """
    cells = checkpointed(cells)  # every fit of every fold reads them again
    hashed, dealt = F.xxhash64(F.lit(seed), group), seed
    first, last = cells.agg(F.min(hashed), F.max(hashed)).first()
    if first == last:
        return cells.select(*keys, F.lit(None).cast(cells.schema[label].dataType).alias("arm"))
    while True:
        rows = cells.withColumn("_fold", F.pmod(F.xxhash64(F.lit(dealt), group), F.lit(MOST_FOLDS)))
        low, high = rows.agg(F.min("_fold"), F.max("_fold")).first()
        if low < high:
            break
        dealt += 1
    names = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    out = []
    for (k,) in rows.select("_fold").distinct().sort("_fold").collect():
        fit = rows.where(F.col("_fold") != k)
        tree = DecisionTreeClassifier(labelCol="_y", featuresCol="_x", predictionCol="_p", minInstancesPerNode=least, seed=seed)
        stages = [names, VectorAssembler(inputCols=features, outputCol="_x"), tree, IndexToString(inputCol="_p", outputCol="_arm", labels=names.labels)]
        out.append(Pipeline(stages=stages).fit(fit).transform(rows.where(F.col("_fold") == k)).select(*keys, F.col("_arm").alias("arm")))
    return reduce(DataFrame.union, out)
