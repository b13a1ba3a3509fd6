"""Semantic classes of tokens: consistency with the explanation list, ids, and sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(explanations: DataFrame, classes: DataFrame) -> DataFrame:
    """(token, problem): what keeps (token, value) and the classes' (token, explanation) from being one to one; empty if all is well."""
    twice = lambda d, what: d.groupBy("token").count().where("count > 1").select("token", F.lit(what).alias("problem"))
    a, b = explanations.select("token", "value").distinct(), classes.select("token", "explanation").distinct()
    both = a.join(b, "token", "full").where("value is null or explanation is null or value <> explanation")
    what = F.when(F.col("explanation").isNull(), "in no class").when(F.col("value").isNull(), "without explanation").otherwise("explanation differs")
    return both.select("token", what.alias("problem")).unionByName(twice(explanations, "explained twice")).unionByName(twice(classes, "in two classes")).distinct()


def annotated(log: DataFrame) -> DataFrame:
    """(token, value): of a token's lines in an annotation or explanation log (token, value, at) the last one."""
    return log.groupBy("token").agg(F.max_by("value", "at").alias("value"))


def to_annotate(tokens: DataFrame, log: DataFrame | None) -> DataFrame:
    """The tokens that a round of annotation still has to ask about, as they are (with their rank, if they have one)."""
    return tokens if log is None else tokens.join(log.select("token").distinct(), "token", "left_anti")


def to_explain(tokens: DataFrame, annotations: DataFrame, explanations: DataFrame | None) -> DataFrame:
    """The tokens last annotated "1" that have no explanation yet."""
    chosen = tokens.join(annotated(annotations).where("value = '1'").select("token"), "token", "left_semi")
    return to_annotate(chosen, explanations)


def class_ids(classes: DataFrame) -> DataFrame:
    return classes.select("token", "main_id", "sub_id")


def class_samples(classes: DataFrame, samples: DataFrame) -> DataFrame:
    """The classes' tokens with their samples (token, label, mesh, gene, pmid, triplet), ids prefixed."""
    s = samples.select("token", "label", "mesh", F.concat(F.lit("GENE:"), "gene").alias("gene"), F.concat(F.lit("PMID:"), "pmid").alias("pmid"), "triplet")
    return classes.select("main_id", "main_name", "sub_id", "sub_name", "token", "explanation").join(s, "token")


def unsampled(classes: DataFrame, samples: DataFrame) -> DataFrame:
    """Class tokens without samples, which a caller may want to refuse."""
    return classes.select("token").distinct().join(samples.select("token").distinct(), "token", "left_anti")
