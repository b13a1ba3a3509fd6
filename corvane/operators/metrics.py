"""Evaluation: tie-aware average precision, its mean over groups, and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.ranks import running


def average_precision(scored: DataFrame, *by: str) -> DataFrame:
    """(by.., positives, ap) from rows (by.., score, y): rows that tie in score share a threshold.

    Rows are first summed up by score; counts run down the scores over range partitions, so a group
    with most of the rows, all of different scores, is spread too.
    """
    steps = scored.groupBy(*by, "score").agg(F.count("*").alias("_n"), F.sum(F.col("y").cast("bigint")).alias("p"))
    down = running(steps, list(by), ["-score"], _cn=F.col("_n"), _cp=F.col("p"))
    part = down.select(*by, "p", (F.col("p") * F.col("_cp") / F.col("_cn")).alias("a"))
    return part.groupBy(*by).agg(F.sum("p").alias("positives"), F.try_divide(F.sum("a"), F.sum("p")).alias("ap"))


def mean_ap_recall(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(method, mean_ap, recall) from predictions (method, mesh, gene, score) and gold (mesh, gene).

    Predictions that carry their label y, as method_scores gives it, aren't joined with gold again.
    Only diseases in gold count; the mean is over those with a predicted gold gene, recall over all
    gold genes. Nothing to average or to recall gives null.
    """
    gold = gold.select("mesh", "gene").distinct()
    marked = predicted if "y" in predicted.columns else predicted.join(gold.withColumn("y", F.lit(1)), ["mesh", "gene"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    # A disease outside of gold has no positives, so it counts in neither figure, but its method stays.
    got = average_precision(marked, "method", "mesh").groupBy("method").agg(F.avg(F.when(F.col("positives") > 0, F.col("ap"))).alias("mean_ap"), F.sum("positives").alias("found"))
    golds = gold.agg(F.count("*").alias("golds"))
    return got.join(F.broadcast(golds)).select("method", "mean_ap", F.try_divide("found", "golds").alias("recall"))  # golds: one row
