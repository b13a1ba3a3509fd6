"""Direct questions: prompts, answers, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

QUESTION = "Does GENE play a causal role in DISEASE? Answer yes or no."


def questions(pairs: DataFrame, done: DataFrame | None = None, template: str = QUESTION) -> DataFrame:
    """pairs (disease, gene, names) not yet done, with text_in."""
    d = pairs if done is None else pairs.join(done.select("disease", "gene").distinct(), ["disease", "gene"], "left_anti")
    return d.withColumn("text_in", T.question(template, F.col("gene_name"), F.col("disease_name")))


def answered(answers: DataFrame, order: str = "request_end_time", method: str = "direct_ask") -> DataFrame:
    """(method, mesh, gene, score): of repeated answers the last."""
    d = answers.withColumn("score", T.answer_score(F.col("text_out_list"))).where("score is not null")
    return d.groupBy(F.col("disease").alias("mesh"), "gene").agg(F.max_by("score", order).alias("score")).select(F.lit(method).alias("method"), "mesh", "gene", "score")


def histogram(answers: DataFrame) -> DataFrame:
    """(score, answers, ratio)."""
    n = answers.select(T.answer_score(F.col("text_out_list")).alias("score")).where("score is not null").groupBy("score").agg(F.count("*").alias("answers"))
    total = n.agg(F.sum("answers").alias("total"))
    return n.join(F.broadcast(total)).select("score", "answers", F.try_divide("answers", "total").alias("ratio"))  # total: one row
