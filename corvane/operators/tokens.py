"""Key tokens: counts per pair, statistics against gold, rankings, predictions, evidence, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.ranks import first_rows, numbered
from corvane.session import keep

SUPPORT = 50
TENTHS = tuple(range(1, 10))


def token_triplets(triplets: DataFrame) -> DataFrame:
    """Triplets (with h, r, t, names) and their stemmed tokens, repeats kept."""
    return triplets.withColumn("tokens", T.stems()(F.concat_ws(" ", "h", "r", "t"), F.col("names")))


def stemmed_pair_scores(triplets: DataFrame, least: int = 3) -> DataFrame:
    """(mesh, gene, token, score) as pair_scores(token_triplets(triplets)) gives it, each distinct word stemmed once.

    Words are split, filtered and counted by pair in the JVM; only the vocabulary goes to the stemmer.
    """
    words = F.filter(T.word_list(F.concat_ws(" ", "h", "r", "t")), lambda w: (F.length(w) >= least) & ~F.array_contains(F.coalesce("names", F.array().cast("array<string>")), w))
    n = keep(triplets.select("mesh", "gene", F.explode(words).alias("word")).groupBy("mesh", "gene", "word").agg(F.count("*").alias("score")), "words")
    stems = n.select("word").distinct().withColumn("token", T.stemmed(F.col("word")))
    return n.join(stems, "word").groupBy("mesh", "gene", "token").agg(F.sum("score").alias("score"))


def pair_scores(tokenized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """scores (mesh, gene, token, score) and all pairs (mesh, gene), those without tokens too."""
    scores = tokenized.select("mesh", "gene", F.explode("tokens").alias("token")).groupBy("mesh", "gene", "token").agg(F.count("*").alias("score"))
    return scores, tokenized.select("mesh", "gene").distinct()


def token_stats(scores: DataFrame, gold: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(token, gold_score, score, gold_dgs, dgs) over diseases with gold genes, tokens of at least `support` pairs."""
    own = scores.join(gold.select("mesh").distinct(), "mesh", "left_semi").join(gold.select("mesh", "gene").distinct().withColumn("y", F.lit(1)), ["mesh", "gene"], "left")
    s = own.groupBy("token").agg(F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("score"))), F.lit(0)).alias("gold_score"), F.sum("score").alias("score"), F.count("y").alias("gold_dgs"), F.count("*").alias("dgs"))
    return s.where(F.col("dgs") >= support)


def ranked(stats: DataFrame) -> DataFrame:
    """stats with gold_score_ratio as a percentage and rank: by gold share of the score, gold pairs, gold share of the pairs, all falling; then by token."""
    pct = T.percent(F.col("gold_score") / F.col("score"))
    d = stats.select("token", pct.alias("gold_score_ratio"), "gold_score", "score", "gold_dgs", "dgs", (F.col("gold_score") / F.col("score")).alias("_share"), (F.col("gold_dgs") / F.col("dgs")).alias("_pairs"))
    return numbered(d, [], ["-_share", "-gold_dgs", "-_pairs", "token"], "rank").drop("_share", "_pairs")


def restricted(scores: DataFrame, tokens: DataFrame) -> DataFrame:
    """Scores of the given tokens; pairs left without any stay in the pair table."""
    return scores.join(tokens.select("token").distinct(), "token", "left_semi")


def threshold_sets(stats: DataFrame, tenths: tuple[int, ...] = TENTHS) -> DataFrame:
    """(method, token): tokens whose gold share is at least k tenths, for all k in one pass; shares are of the counts, not of the rounded percentage."""
    ks = F.explode(F.array(*map(F.lit, tenths))).alias("k")
    d = stats.select("token", "gold_score", "score", ks).where(F.col("gold_score") / F.col("score") >= F.col("k") / 10)
    return d.select(F.concat(F.lit("token_"), (F.col("k") * 10).cast("string")).alias("method"), "token")


def curated_set(curation: DataFrame) -> DataFrame:
    """(method, token): tokens annotated "1"."""
    return curation.where("value = '1'").select(F.lit("token_curated").alias("method"), "token").distinct()


def predictions(scores: DataFrame, sets: DataFrame) -> DataFrame:
    """(method, mesh, gene, score): per set the sum of a pair's scores of its tokens; sums of 0 go."""
    return scores.join(sets, "token").groupBy("method", "mesh", "gene").agg(F.sum("score").cast("double").alias("score")).where("score <> 0")


def run_token_methods(scores: DataFrame, stats: DataFrame, curation: DataFrame | None, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    from corvane.operators.metrics import mean_ap_recall

    sets = threshold_sets(stats)
    if curation is not None:
        sets = sets.unionByName(curated_set(curation))
    out = predictions(scores, sets)
    return out, mean_ap_recall(out, gold)


def token_evidence(tokenized: DataFrame, gold: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, label, mesh, gene, pmid, h, r, t): a row an occurrence of a token, in diseases with gold genes; with its rank, if tokens has one."""
    rank = [c for c in ("rank",) if c in tokens.columns]
    d = tokenized.join(gold.select("mesh").distinct(), "mesh", "left_semi").select("pmid", "mesh", "gene", "h", "r", "t", F.explode("tokens").alias("token"))
    d = d.join(tokens.select("token", *rank).distinct(), "token").join(gold.select("mesh", "gene").distinct().withColumn("y", F.lit(1)), ["mesh", "gene"], "left")
    return d.select("token", F.coalesce("y", F.lit(0)).alias("label"), "mesh", "gene", "pmid", "h", "r", "t", *rank)


def nested_evidence(evidence: DataFrame, stats: DataFrame) -> DataFrame:
    """One row a token with its counts and its evidence per label, for the sink that wants it nested."""
    n = evidence.groupBy("token", "label", "mesh", "gene").agg(F.collect_list(F.struct("pmid", "h", "r", "t")).alias("triplets"))
    g = n.groupBy("token").agg(F.sum(F.size("triplets")).alias("triplets"), *(F.collect_list(F.when(F.col("label") == y, F.struct("mesh", "gene", "triplets"))).alias(k) for y, k in ((1, "gold"), (0, "other"))))
    return stats.join(g, "token")


def stratified(evidence: DataFrame, pairs: int, seed: int = 0) -> DataFrame:
    """Per token and label so many pairs, and of each one triplet, by md5 order: the same for any partitioning. Small strata give all they have."""
    h = lambda *c: F.md5(F.concat_ws("|", *c, F.lit(str(seed))))
    one = evidence.groupBy("token", "label", "mesh", "gene").agg(F.min_by(F.struct("pmid", "h", "r", "t"), F.struct(h("pmid", "h", "r", "t"), "pmid", "h", "r", "t")).alias("x"))
    return first_rows(one.withColumn("_h", h("mesh", "gene")), ["token", "label"], ["_h", "mesh", "gene"], pairs).select("token", "label", "mesh", "gene", "x.pmid", F.concat_ws(" ", "x.h", "x.r", "x.t").alias("triplet"))
