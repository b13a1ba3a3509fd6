"""Evidence tables: gold sets, labels, feature scores, odds ratios, scaling, feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.ranks import numbered, percentiles

# The evidence features, in the order of the feature vector.
FEATURES = ("paper", "sentence", "cre_Cause-associated", "cre_Appositive", "cre_In-patient", "spacy_ore", "openie_ore", "tagore_positive", "tagore_mutation", "tagore_mutations", "tagore_glof", "gpt_paper", "gpt_triplet")
# Thresholds and percentiles of odds ratios.
THRESHOLDS = (0, 1, 5, 10)
PERCENTILES = (25, 50, 75)
OR_LIST = "or_list"
#: Training groups are cut to so many genes, positives first.
MOST_GENES = 10_000


def last_line(ann: DataFrame) -> DataFrame:
    """One row a disease: of repeated lines the last."""
    if "line_no" not in ann.columns:
        return ann
    last = ann.groupBy(F.col("mesh").alias("_m")).agg(F.max_by(F.struct(*ann.columns), "line_no").alias("r"))
    return last.select("r.*")


def normalized(ann: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """gold (mesh, gene), pairs (mesh, gene), evidence (mesh, gene, feature, score), odds (mesh, gene, odds_ratio) of annotation rows."""
    gold = ann.select("mesh", F.explode("gold").alias("gene")).distinct()
    genes = ann.select("mesh", F.explode("ann").alias("gene", "features"))
    cells = genes.select("mesh", "gene", F.explode("features").alias("feature", "value"))
    evidence = cells.where(F.col("feature") != OR_LIST).select("mesh", "gene", "feature", F.expr("try_cast(value AS double)").alias("score"))
    odds = cells.where(F.col("feature") == OR_LIST).select("mesh", "gene", F.explode(F.from_json("value", "array<string>")).alias("o")).select("mesh", "gene", F.expr("try_cast(o AS double)").alias("odds_ratio"))
    return gold, genes.select("mesh", "gene"), evidence, odds


def in_papers(evidence: DataFrame) -> DataFrame:
    """Pairs that share a paper."""
    return evidence.where("feature = 'paper' and score > 0").select("mesh", "gene").distinct()


def co_paper_gold(gold: DataFrame, evidence: DataFrame) -> DataFrame:
    """All gold pairs of the diseases of which some gold gene shares a paper."""
    seen = gold.join(in_papers(evidence), ["mesh", "gene"], "left_semi").select("mesh").distinct()
    return gold.join(seen, "mesh", "left_semi")


def pair_table(gold: DataFrame, evidence: DataFrame, features: tuple[str, ...] = ()) -> DataFrame:
    """(mesh, gene, y, f:<feature>..) of pairs that share a paper, for diseases with a gold gene among them.

    Gold is one more mark of a pair, so evidence and gold meet in one aggregation, most of which
    happens before its shuffle, and no pair is joined with its features later.
    """
    wanted = list(dict.fromkeys(["paper", *(f for f in features if f != "gold")]))
    marks = evidence.where(F.col("feature").isin(wanted)).select("mesh", "gene", "feature", "score").unionByName(gold.select("mesh", "gene", F.lit("gold").alias("feature"), F.lit(1.0).alias("score")))
    g = marks.groupBy("mesh", "gene").agg(F.max((F.col("feature") == "gold").cast("int")).alias("y"), *(F.max(F.when(F.col("feature") == f, F.col("score"))).alias(f"f:{f}") for f in wanted))
    co = g.where(F.col("`f:paper`") > 0)
    return co.join(co.where("y = 1").select("mesh").distinct(), "mesh", "left_semi")


def wide_pairs(facts: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """The same table from one that already has a row a pair: mesh, gene, gold (boolean) and a column a feature, paper among them."""
    wanted = list(dict.fromkeys(["paper", *(f for f in features if f != "gold")]))
    co = facts.where(F.col("paper") > 0).select("mesh", "gene", F.coalesce(F.col("gold"), F.lit(False)).cast("int").alias("y"), *(F.col(f"`{f}`").alias(f"f:{f}") for f in wanted))
    return co.join(co.where("y = 1").select("mesh").distinct(), "mesh", "left_semi")


def labelled(gold: DataFrame, evidence: DataFrame) -> DataFrame:
    """(mesh, gene, y) of the pair table."""
    return pair_table(gold, evidence).select("mesh", "gene", "y")


def method_scores(pairs: DataFrame, methods: dict[str, list[str]]) -> DataFrame:
    """(method, mesh, gene, y, score): per method the sum of its features (absent: 0, "gold": the label); sums of 0 go.

    pairs is a pair table that has the features. All methods are scored in the row.
    """
    value = lambda f: F.col("y").cast("double") if f == "gold" else F.coalesce(F.col(f"`f:{f}`"), F.lit(0.0))
    total = lambda fs: sum((value(f) for f in fs[1:]), value(fs[0]))
    by = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), total(fs).alias("score")) for m, fs in methods.items())))
    return pairs.select("mesh", "gene", "y", by.alias("m")).select("m.method", "mesh", "gene", "y", "m.score").where("score <> 0")


def feature_scores(gold: DataFrame, evidence: DataFrame, methods: dict[str, list[str]]) -> DataFrame:
    """(method, mesh, gene, score) of feature methods, straight from the evidence."""
    return method_scores(pair_table(gold, evidence, tuple(f for fs in methods.values() for f in fs)), methods).drop("y")


def odds_stats(odds: DataFrame, *more: str, with_percentiles: bool = True) -> DataFrame:
    """(mesh, gene, more.., or_count_N.., or_log_mean, or_percentile_N..): positive odds ratios at or above each threshold; logs of the positive ones, 0 if none.

    The percentiles are exact for a pair with any number of ratios (ranks.percentiles).
    """
    good = (F.col("odds_ratio") > 0) & ~F.isnan("odds_ratio")
    log = F.when(good, F.ln("odds_ratio"))
    by, names = ["mesh", "gene", *more], [f"or_percentile_{p}" for p in PERCENTILES]
    g = odds.groupBy(*by).agg(*(F.count_if(good & (F.col("odds_ratio") >= t)).alias(f"or_count_{t}") for t in THRESHOLDS), F.coalesce(F.avg(log), F.lit(0.0)).alias("or_log_mean"))
    if not with_percentiles:
        return g
    p = percentiles(odds.select(*by, log.alias("_log")), by, "_log", dict(zip(names, (p / 100 for p in PERCENTILES), strict=True)))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    both = g.join(p.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), *names), same, "left")
    return both.select(*g.columns, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))


def odds_scores(pairs: DataFrame, odds: DataFrame, *features: str) -> DataFrame:
    """(method, mesh, gene, y, score) of odds-ratio features of the pairs: counts above 0; logs where any ratio is positive.

    A name of neither kind gives no rows; a threshold or percentile that isn't kept is a KeyError.
    """
    known = {*(f"or_count_{t}" for t in THRESHOLDS), "or_log_mean", *(f"or_percentile_{p}" for p in PERCENTILES)}
    for f in features:
        if f not in known and f.startswith(("or_count_", "or_percentile_")):
            raise KeyError(f)
    s = odds_stats(odds.join(pairs.select("mesh", "gene", "y"), ["mesh", "gene"]), "y", with_percentiles=any(f.startswith("or_percentile_") for f in features))
    cell = lambda f: F.struct(F.lit(f).alias("method"), F.when(F.col(f if f.startswith("or_count_") else "or_count_0") > 0, F.col(f).cast("double")).alias("score"))
    cells = [cell(f) for f in features if f in known] or [F.struct(F.lit("").alias("method"), F.lit(None).cast("double").alias("score"))]
    return s.select("mesh", "gene", "y", F.explode(F.array(*cells)).alias("m")).select("m.method", "mesh", "gene", "y", "m.score").where("score is not null")


def run_feature_methods(gold: DataFrame, evidence: DataFrame, odds: DataFrame, methods: dict[str, list[str]] | None = None, odds_features: tuple[str, ...] = ("or_count_0", "or_log_mean")) -> tuple[DataFrame, DataFrame]:
    """Predictions of every feature and odds-ratio method, and their mean average precision and recall."""
    from corvane.operators.metrics import mean_ap_recall

    methods = methods or {f: f.split("+") for f in ("gold", *FEATURES, "sort_score")}
    pairs = pair_table(gold, evidence, tuple(f for fs in methods.values() for f in fs))
    out = method_scores(pairs, methods).unionByName(odds_scores(pairs, odds, *odds_features))
    return out.drop("y"), mean_ap_recall(out, co_paper_gold(gold, evidence))


def min_max(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """The columns scaled to 0..1 within by; a constant column becomes 0.

    The limits are aggregated before their shuffle and joined back, so a group with a large share of
    the rows isn't gathered in one task, as a window would do.
    """
    ends = df.groupBy(*(F.col(k).alias(f"_{k}") for k in by)).agg(*(f(c).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))))
    same = [df[k].eqNullSafe(ends[f"_{k}"]) for k in by]
    span = lambda i: F.col(f"_hi{i}") - F.col(f"_lo{i}")
    return df.join(ends, same).select(*df.columns, *(((F.col(c) - F.col(f"_lo{i}")) / F.when(span(i) == 0, 1).otherwise(span(i))).alias(f"{c}_scaled") for i, c in enumerate(columns)))


def feature_matrix(gold: DataFrame, evidence: DataFrame, odds: DataFrame, vectors: DataFrame | None, dimension: int, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(mesh, gene, y, pos, x): 13 features and the odds-ratio count, these scaled per disease, and the pair's vector (zeros if none).

    pos counts a disease's genes with the gold ones first.
    """
    return matrix_of(pair_table(gold, evidence, features), odds, vectors, dimension, features)


def matrix_of(pairs: DataFrame, odds: DataFrame, vectors: DataFrame | None, dimension: int, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """The feature matrix of a pair table that has the features. Genes are counted among keys and numbers; vectors join after that."""
    names = [f"f{i}" for i in range(len(features) + 1)]
    wide = gold_first(pairs.select("mesh", "gene", "y", *(F.col(f"`f:{f}`").alias(n) for f, n in zip(features, names, strict=False))))
    d = wide.join(odds_stats(odds, with_percentiles=False).select("mesh", "gene", F.col("or_count_0").cast("double").alias(names[-1])), ["mesh", "gene"], "left")
    d = min_max(d.select("mesh", "gene", "y", "pos", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names)), names, "mesh")
    zero = F.array_repeat(F.lit(0.0), dimension)
    d = d.join(vectors.select("mesh", "gene", "vector"), ["mesh", "gene"], "left") if vectors is not None else d.withColumn("vector", F.lit(None).cast("array<double>"))
    return d.select("mesh", "gene", "y", "pos", F.concat(F.array(*names, *(f"{n}_scaled" for n in names)), F.coalesce("vector", zero)).alias("x"))


def gold_first(pairs: DataFrame) -> DataFrame:
    """pairs with pos, the place of a gene in its disease, the gold ones first."""
    return numbered(pairs, ["mesh"], ["-y", "gene"], "pos")


def capped(matrix: DataFrame, most: int = MOST_GENES) -> DataFrame:
    """What a ranker trains on: at most so many genes of a disease, the gold ones first. The tested disease is not cut."""
    return matrix.where(F.col("pos") <= most)


def sizes(pairs: DataFrame) -> DataFrame:
    """One row: how many diseases, genes and pairs there are."""
    return pairs.agg(F.countDistinct("mesh").alias("diseases"), F.countDistinct("gene").alias("genes"), F.countDistinct("mesh", "gene").alias("pairs"))
