"""The registered queries and, beside each, its SQL.

The driver's tables stand in for the engine's records: supplier = disease, part = gene, distinct
orders = papers, lines = sentences, returned lines of high discount = gold, quantities = odds
ratios; documents by (lang, source) = papers by (disease, gene); embeddings by label = vectors.
Floats are rounded on both sides, since sums run in another order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import asking, curation, embed, evidence, metrics, ore, rankers, tokens
from corvane.plans.registry import QUERIES, SQL, query
from corvane.session import keep, table

# ---- the evidence analogue -------------------------------------------------------------------


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("mesh"), F.col("l_partkey").cast("string").alias("gene"), "l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_extendedprice")


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """One row a pair with all that the evidence queries derive from the lines, odds ratios aside: one scan, one shuffle, then a compact table."""
    gold = F.max((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)).alias("gold")
    return keep(_lines(spark, sf).groupBy("mesh", "gene").agg(F.countDistinct("l_orderkey").cast("double").alias("paper"), F.count("*").cast("double").alias("sentence"), F.sum(F.when(F.col("l_quantity") > 40, 1.0)).alias("spacy_ore"), F.sum(F.when(F.col("l_discount") > 0.05, 1.0)).alias("gpt_paper"), gold), "facts")


def _gold_of(facts: DataFrame) -> DataFrame:
    return facts.where("gold").select("mesh", "gene")


def _evidence_of(facts: DataFrame) -> DataFrame:
    return facts.unpivot(["mesh", "gene"], ["paper", "sentence", "spacy_ore", "gpt_paper"], "feature", "score").where("score is not null")


def _odds(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("mesh", "gene", (F.col("l_quantity") - 5).alias("odds_ratio"))


E = """li AS (SELECT CAST(l_suppkey AS VARCHAR) AS mesh, CAST(l_partkey AS VARCHAR) AS gene, l_orderkey, l_quantity, l_discount, l_returnflag FROM lineitem),
gold AS (SELECT DISTINCT mesh, gene FROM li WHERE l_returnflag = 'R' AND l_discount >= 0.09),
ev AS (SELECT mesh, gene, count(DISTINCT l_orderkey)::DOUBLE AS paper, count(*)::DOUBLE AS sentence, coalesce(sum(CASE WHEN l_quantity > 40 THEN 1.0 END), 0)::DOUBLE AS spacy_ore,
       coalesce(sum(CASE WHEN l_discount > 0.05 THEN 1.0 END), 0)::DOUBLE AS gpt_paper FROM li GROUP BY 1, 2),
golddis AS (SELECT DISTINCT mesh FROM gold),
cg AS (SELECT * FROM gold),
pairs AS (SELECT ev.mesh, ev.gene, CASE WHEN g.gene IS NULL THEN 0 ELSE 1 END AS y FROM ev JOIN golddis USING (mesh) LEFT JOIN gold g ON ev.mesh = g.mesh AND ev.gene = g.gene),
odds AS (SELECT mesh, gene, l_quantity - 5 AS o FROM li)"""
METHODS = {"gold": ["gold"], "paper": ["paper"], "sentence": ["sentence"], "paper+spacy_ore": ["paper", "spacy_ore"], "gpt_paper": ["gpt_paper"]}
PRED = """pred AS (SELECT 'gold' AS method, mesh, gene, y::DOUBLE AS score FROM pairs UNION ALL SELECT 'paper', mesh, gene, paper FROM ev JOIN pairs USING (mesh, gene)
UNION ALL SELECT 'sentence', mesh, gene, sentence FROM ev JOIN pairs USING (mesh, gene) UNION ALL SELECT 'paper+spacy_ore', mesh, gene, paper + spacy_ore FROM ev JOIN pairs USING (mesh, gene)
UNION ALL SELECT 'gpt_paper', mesh, gene, gpt_paper FROM ev JOIN pairs USING (mesh, gene)
UNION ALL SELECT 'or_count_0', mesh, gene, sum(CASE WHEN o > 0 THEN 1 ELSE 0 END)::DOUBLE FROM odds JOIN pairs USING (mesh, gene) GROUP BY 2, 3
UNION ALL SELECT 'or_log_mean', mesh, gene, round(avg(CASE WHEN o > 0 THEN ln(o) END), 9) FROM odds JOIN pairs USING (mesh, gene) GROUP BY 2, 3 HAVING sum(CASE WHEN o > 0 THEN 1 ELSE 0 END) > 0),
p AS (SELECT * FROM pred WHERE method = 'or_log_mean' OR score <> 0)"""
AP = """st AS (SELECT method, p.mesh, score, count(*) AS n, sum(CASE WHEN cg.gene IS NULL THEN 0 ELSE 1 END) AS k FROM p LEFT JOIN cg ON p.mesh = cg.mesh AND p.gene = cg.gene GROUP BY 1, 2, 3),
cu AS (SELECT method, mesh, k, sum(k) OVER w AS ck, sum(n) OVER w AS cn FROM st WINDOW w AS (PARTITION BY method, mesh ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT method, mesh, sum(k)::BIGINT AS positives, sum(k * ck / cn) / sum(k) AS ap FROM cu GROUP BY 1, 2 HAVING sum(k) > 0)"""


@query(f"WITH {E} SELECT mesh, count(*) AS golds FROM gold GROUP BY mesh")
def q_gold_set(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf)
    return evidence.co_paper_gold(_gold_of(f), _evidence_of(f)).groupBy("mesh").agg(F.count("*").alias("golds"))


@query(f"WITH {E} SELECT mesh, gene, y FROM pairs")
def q_labelled_evidence(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf)
    return evidence.labelled(_gold_of(f), _evidence_of(f))


@query(f"WITH {E}, {PRED} SELECT method, mesh, gene, score FROM p WHERE method NOT LIKE 'or_%'")
def q_feature_score(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf)
    return evidence.feature_scores(_gold_of(f), _evidence_of(f), METHODS)


@query(f"WITH {E}, {PRED}, {AP} SELECT mesh, positives, round(ap, 8) AS ap FROM ap WHERE method = 'sentence'")
def q_ap_per_group(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf)
    pairs = evidence.pair_table(_gold_of(f), _evidence_of(f), ("sentence",))
    scored = evidence.method_scores(pairs, {"sentence": ["sentence"]})
    return metrics.average_precision(scored, "mesh").where("positives > 0").select("mesh", "positives", F.round("ap", 8).alias("ap"))


@query(f"WITH {E}, {PRED}, {AP} SELECT round(avg(ap), 8) AS mean_ap, round(sum(positives) / (SELECT count(*) FROM cg), 8) AS recall FROM ap WHERE method = 'gpt_paper'")
def q_map_recall(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf)
    e, gold = _evidence_of(f), _gold_of(f)
    p = evidence.feature_scores(gold, e, {"gpt_paper": ["gpt_paper"]})
    return metrics.mean_ap_recall(p, evidence.co_paper_gold(gold, e)).select(F.round("mean_ap", 8).alias("mean_ap"), F.round("recall", 8).alias("recall"))


@query(f"WITH {E}, {PRED}, {AP} SELECT method, round(avg(ap), 6) AS mean_ap, round(sum(positives) / (SELECT count(*) FROM cg), 6) AS recall FROM ap GROUP BY method")
def q_multi_method_map(spark: SparkSession, sf: str) -> DataFrame:
    """How well does each kind of evidence rank the gold genes of a disease? All methods in one plan."""
    f = _facts(spark, sf)
    gold, e = _gold_of(f), _evidence_of(f)
    pairs = keep(evidence.wide_pairs(f, tuple(x for fs in METHODS.values() for x in fs)), "pairs")
    odds = evidence.odds_scores(pairs, _odds(spark, sf), "or_count_0", "or_log_mean")
    logs = F.when(F.col("method") == "or_log_mean", F.round("score", 9)).otherwise(F.col("score"))
    out = evidence.method_scores(pairs, METHODS).unionByName(odds.withColumn("score", logs))
    m = metrics.mean_ap_recall(out, evidence.co_paper_gold(gold, e))
    return m.select("method", F.round("mean_ap", 6).alias("mean_ap"), F.round("recall", 6).alias("recall"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS mesh, CAST(l_partkey AS VARCHAR) AS gene, " + ", ".join(f"sum(CASE WHEN l_quantity - 5 > 0 AND l_quantity - 5 >= {t} THEN 1 ELSE 0 END)::BIGINT AS or_count_{t}" for t in evidence.THRESHOLDS) + " FROM lineitem GROUP BY 1, 2")
def q_or_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.odds_stats(_odds(spark, sf)).select("mesh", "gene", *(f"or_count_{t}" for t in evidence.THRESHOLDS))


@query(
    "SELECT mesh, gene, round(coalesce(avg(l), 0), 8) AS or_log_mean, "
    + ", ".join(f"round(coalesce(quantile_cont(l, {p / 100}), 0), 8) AS or_percentile_{p}" for p in evidence.PERCENTILES)
    + " FROM (SELECT CAST(l_suppkey AS VARCHAR) AS mesh, CAST(l_partkey AS VARCHAR) AS gene, CASE WHEN l_quantity - 5 > 0 THEN ln(l_quantity - 5) END AS l FROM lineitem) GROUP BY 1, 2"
)
def q_or_log_stats(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.odds_stats(_odds(spark, sf)).select("mesh", "gene", *(F.round(c, 8).alias(c) for c in ("or_log_mean", *(f"or_percentile_{p}" for p in evidence.PERCENTILES))))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, round((l_extendedprice - min(l_extendedprice) OVER w) / CASE WHEN max(l_extendedprice) OVER w = min(l_extendedprice) OVER w THEN 1 ELSE max(l_extendedprice) OVER w - min(l_extendedprice) OVER w END, 8) AS scaled
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""")
def q_minmax(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return evidence.min_max(d, ["l_extendedprice"], "l_suppkey").select("l_suppkey", "l_orderkey", "l_linenumber", F.round("l_extendedprice_scaled", 8).alias("scaled"))


@query(f"""WITH {E}, f AS (SELECT pairs.mesh, pairs.gene, y, paper, sentence, spacy_ore, gpt_paper FROM pairs JOIN ev USING (mesh, gene)),
oc AS (SELECT mesh, gene, sum(CASE WHEN o > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS c FROM odds GROUP BY 1, 2),
u AS (SELECT mesh, gene, y, unnest(['paper', 'sentence', 'spacy_ore', 'gpt_paper', 'or_count_0']) AS feature, unnest([paper, sentence, spacy_ore, gpt_paper, c]) AS v FROM f JOIN oc USING (mesh, gene)),
s AS (SELECT mesh, gene, y, feature, v, (v - min(v) OVER w) / CASE WHEN max(v) OVER w = min(v) OVER w THEN 1 ELSE max(v) OVER w - min(v) OVER w END AS sc, row_number() OVER (PARTITION BY mesh, feature ORDER BY y DESC, gene) AS pos FROM u WINDOW w AS (PARTITION BY mesh, feature))
SELECT mesh, gene, y, pos::INTEGER AS pos, feature, round(v, 8) AS value, round(sc, 8) AS scaled FROM s WHERE pos <= 10000""")
def q_feature_matrix_cap(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf)
    absent = [F.lit(None).cast("double").alias(x) for x in evidence.FEATURES if x not in f.columns]
    m = evidence.capped(evidence.matrix_of(evidence.wide_pairs(f.select("*", *absent), evidence.FEATURES), _odds(spark, sf), None, 0))
    n = len(evidence.FEATURES) + 1
    names = F.array(*(F.lit(x) for x in (*evidence.FEATURES, "or_count_0")))
    cells = m.select("mesh", "gene", "y", "pos", F.explode(F.transform(names, lambda x, i: F.struct(x.alias("feature"), F.get("x", i).alias("value"), F.get("x", i + n).alias("scaled")))).alias("c"))
    return cells.select("mesh", "gene", "y", "pos", "c.feature", F.round("c.value", 8).alias("value"), F.round("c.scaled", 8).alias("scaled")).where(F.col("feature").isin("paper", "sentence", "spacy_ore", "gpt_paper", "or_count_0"))


_SHARES = ", ".join(f"sum(CASE WHEN (l_orderkey * 7 + l_linenumber) % 13 = {j} THEN 1 ELSE 0 END)::DOUBLE" for j in range(1, 13))


@query(f"""WITH {E}, v AS (SELECT CAST(l_suppkey AS VARCHAR) AS mesh, CAST(l_partkey AS VARCHAR) AS gene, [count(*)::DOUBLE, {_SHARES}, sum(CASE WHEN l_quantity - 5 > 0 THEN 1 ELSE 0 END)::DOUBLE] AS v FROM lineitem GROUP BY 1, 2),
u AS (SELECT mesh, gene, y, i, v[i + 1] AS x FROM v JOIN pairs USING (mesh, gene), (SELECT unnest(range(0, 14)) AS i)),
s AS (SELECT *, (x - min(x) OVER w) / CASE WHEN max(x) OVER w = min(x) OVER w THEN 1 ELSE max(x) OVER w - min(x) OVER w END AS z FROM u WINDOW w AS (PARTITION BY mesh, i))
SELECT mesh, y, (i + k)::INTEGER AS i, count(*) AS genes, round(sum(CASE k WHEN 0 THEN x ELSE z END), 6) AS total, round(max(CASE k WHEN 0 THEN x ELSE z END), 8) AS most FROM s, (SELECT unnest([0, 14]) AS k) GROUP BY 1, 2, 3""")
def q_full_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """All thirteen features and the odds-ratio count, raw and scaled, of every pair; summed up by disease, label and place."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("mesh"), F.col("l_partkey").cast("string").alias("gene"), "l_orderkey", "l_linenumber", "l_discount", "l_returnflag")
    share = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 13
    wide = li.groupBy("mesh", "gene").agg(F.count("*").cast("double").alias("paper"), *(F.count_if(share == j).cast("double").alias(f) for j, f in enumerate(evidence.FEATURES) if j))
    ev = keep(wide, "wide").unpivot(["mesh", "gene"], [f"`{f}`" for f in evidence.FEATURES], "feature", "score")
    gold = li.where("l_returnflag = 'R' and l_discount >= 0.09").select("mesh", "gene").distinct()
    m = evidence.feature_matrix(gold, ev, _odds(spark, sf), None, 0).select("mesh", "y", F.posexplode("x").alias("i", "x"))
    return m.groupBy("mesh", "y", "i").agg(F.count("*").alias("genes"), F.round(F.sum("x"), 6).alias("total"), F.round(F.max("x"), 8).alias("most"))


# ---- the token analogue ----------------------------------------------------------------------


def _length_class():
    """source and the power of two of the length: the analogue of a gene."""
    return F.concat("source", F.lit("/"), F.floor(F.log2(F.col("n_chars").cast("double") + 1)).cast("string")).alias("gene")


def _token_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("lang").alias("mesh"), _length_class(), F.col("doc_id").cast("string").alias("pmid"), F.coalesce("text", F.lit("")).alias("h"), F.lit("").alias("r"), F.lit("").alias("t"))
    return d.withColumn("tokens", F.filter(F.split("h", "[^a-z]+"), lambda w: F.length(w) > 2))


def _token_gold(spark: SparkSession, sf: str) -> DataFrame:
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    d = table(spark, sf, "documents").join(toxic, "doc_id", "left_semi")
    return d.select(F.col("lang").alias("mesh"), _length_class()).distinct()


TK = """d AS (SELECT lang AS mesh, source || '/' || CAST(floor(log2(n_chars + 1))::BIGINT AS VARCHAR) AS gene, CAST(doc_id AS VARCHAR) AS pmid, doc_id, coalesce(text, '') AS h FROM documents),
tg AS (SELECT DISTINCT mesh, gene FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
tok AS (SELECT mesh, gene, pmid, h, unnest(regexp_extract_all(h, '[a-z]{3,}')) AS token FROM d),
sc AS (SELECT mesh, gene, token, count(*) AS score FROM tok GROUP BY 1, 2, 3),
ts AS (SELECT token, coalesce(sum(CASE WHEN g.gene IS NOT NULL THEN score END), 0)::BIGINT AS gold_score, sum(score)::BIGINT AS score, count(g.gene) AS gold_dgs, count(*) AS dgs
       FROM sc LEFT JOIN tg g ON sc.mesh = g.mesh AND sc.gene = g.gene WHERE sc.mesh IN (SELECT mesh FROM tg) GROUP BY token HAVING count(*) >= 50)"""


@query(f"WITH {TK} SELECT mesh, gene, token, score FROM sc")
def q_token_scores(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.pair_scores(_token_rows(spark, sf))[0]


@query(f"WITH {TK} SELECT token, gold_score, score, gold_dgs, dgs FROM ts")
def q_token_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_stats(tokens.pair_scores(_token_rows(spark, sf))[0], _token_gold(spark, sf))


@query(f"""WITH {TK} SELECT token, CAST(CAST(round_even(gold_score / score * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS gold_score_ratio, gold_score, score, gold_dgs, dgs,
row_number() OVER (ORDER BY gold_score / score DESC, gold_dgs DESC, gold_dgs / dgs DESC, token)::INTEGER AS rank FROM ts""")
def q_token_rank(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.ranked(tokens.token_stats(tokens.pair_scores(_token_rows(spark, sf))[0], _token_gold(spark, sf)))


@query(f"WITH {TK} SELECT 'token_' || CAST(k * 10 AS VARCHAR) AS method, mesh, gene, sum(sc.score)::DOUBLE AS score FROM sc JOIN ts USING (token) JOIN (SELECT unnest(range(1, 10)) AS k) ON ts.gold_score / ts.score >= k / 10 GROUP BY 1, 2, 3")
def q_token_prediction(spark: SparkSession, sf: str) -> DataFrame:
    scores = keep(tokens.pair_scores(_token_rows(spark, sf))[0], "scores")  # the statistics and the predictions read it
    return tokens.predictions(scores, tokens.threshold_sets(tokens.token_stats(scores, _token_gold(spark, sf))))


@query(f"WITH {TK}, r AS (SELECT mesh, gene, count(*) AS kept, sum(score)::BIGINT AS score FROM sc SEMI JOIN ts USING (token) GROUP BY 1, 2) SELECT d2.mesh, d2.gene, coalesce(kept, 0)::BIGINT AS kept, coalesce(score, 0)::BIGINT AS score FROM (SELECT DISTINCT mesh, gene FROM d) d2 LEFT JOIN r USING (mesh, gene)")
def q_top_token_restrict(spark: SparkSession, sf: str) -> DataFrame:
    scores, pairs = tokens.pair_scores(_token_rows(spark, sf))
    scores = keep(scores, "scores")
    kept = tokens.restricted(scores, tokens.token_stats(scores, _token_gold(spark, sf))).groupBy("mesh", "gene").agg(F.count("*").alias("kept"), F.sum("score").alias("score"))
    return pairs.join(kept, ["mesh", "gene"], "left").select("mesh", "gene", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("score", F.lit(0)).alias("score"))


@query(f"WITH {TK} SELECT tok.token, CASE WHEN g.gene IS NULL THEN 0 ELSE 1 END AS label, tok.mesh, tok.gene, pmid, count(*) AS occurrences FROM tok SEMI JOIN ts USING (token) LEFT JOIN tg g ON tok.mesh = g.mesh AND tok.gene = g.gene WHERE tok.mesh IN (SELECT mesh FROM tg) GROUP BY 1, 2, 3, 4, 5")
def q_token_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows, gold = keep(_token_rows(spark, sf).withColumn("h", F.lit("")), "tokens"), _token_gold(spark, sf)  # split once for statistics and evidence
    e = tokens.token_evidence(rows, gold, tokens.token_stats(tokens.pair_scores(rows)[0], gold))
    return e.groupBy("token", "label", "mesh", "gene", "pmid").agg(F.count("*").alias("occurrences"))


@query("""WITH e AS (SELECT DISTINCT event_type AS token, CAST(user_id % 2 AS INTEGER) AS label, CAST(user_id AS VARCHAR) AS mesh, CAST(event_id AS VARCHAR) AS gene FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY token, label ORDER BY md5(mesh || '|' || gene || '|0'), mesh, gene) AS n FROM e)
SELECT token, label, mesh, gene, gene AS pmid, 'h r t' AS triplet FROM r WHERE n <= 10""")
def q_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("token"), (F.col("user_id") % 2).cast("int").alias("label"), F.col("user_id").cast("string").alias("mesh"), F.col("event_id").cast("string").alias("gene"), F.col("event_id").cast("string").alias("pmid"), F.lit("h").alias("h"), F.lit("r").alias("r"), F.lit("t").alias("t"))
    return tokens.stratified(e, 10)


def _treebank_sql(text: str) -> str:
    """The rules of functions.text as nested calls; what RE2 lacks (looking ahead, letters beyond ASCII in a class) is spelt out."""
    spelt = {
        T._OPENING[1][0]: (r"(?i)(')([a-ce-lo-ru-z0-9_]|[^\x00-\x7F\P{L}])([^\p{L}\p{N}_]|$)", r"\1 \2\3"),
        r"(?i)\b(wan)(na)(?=\s)": (r"(?i)\b(wan)(na)(\s)", r" \1 \2 \3"),
    }
    call = lambda t, p, r: f"regexp_replace({t}, '{p.replace(chr(39), chr(39) * 2)}', '{r.replace(chr(39), chr(39) * 2)}', 'g')"
    text = call(f"coalesce({text}, '')", r"^\s+|\s+$", "")
    for part, pad in ((T._OPENING + T._POINTS, " "), (T._CLOSING + T._CONTRACTIONS, "")):
        for pattern, by in part:
            text = call(text, *spelt.get(pattern, (pattern, by)))
        text = f"('{pad}' || {text} || '{pad}')"
    return text


@query(f"""SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array({_treebank_sql("text")}, '\\s+')) AS word FROM documents) WHERE length(word) > 2 GROUP BY ALL""")
def q_treebank_words(spark: SparkSession, sf: str) -> DataFrame:
    """The words that q_stem_tokens stems, of all documents."""
    d = table(spark, sf, "documents").select("lang", F.explode(T.word_list(F.col("text"))).alias("word"))
    return d.where(F.length("word") > 2).groupBy("lang", "word").agg(F.count("*").alias("n"))


@query()
def q_stem_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Stemmed words of all documents by pair; there is no stemmer in SQL, so tests hold it against the published examples."""
    d = _token_rows(spark, sf).drop("tokens").withColumn("names", F.array(F.lit("the")))
    return tokens.stemmed_pair_scores(d)


# ---- the embedding analogue ------------------------------------------------------------------

VEC = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings"


@query(f"""WITH v AS (SELECT vec_id, e[1:16] AS h FROM ({VEC})), n AS (SELECT vec_id, h, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS n FROM v)
SELECT vec_id, i::INTEGER AS i, round(h[i + 1] / CASE WHEN n = 0 THEN 1 ELSE n END, 8) AS x FROM n, (SELECT unnest(range(0, 16)) AS i)""")
def q_prefix_renorm(spark: SparkSession, sf: str) -> DataFrame:
    v = embed.reduce_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"), 16)
    return v.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.round("x", 8).alias("x"))


def _pooled(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    base = v.select(F.col("label").cast("string").alias("d"), (F.col("vec_id") % 3).cast("string").alias("g"), F.col("vec_id").alias("pos"), F.col("vec_id").alias("embedding_id"), (F.col("vec_id") % 5 + 1).alias("tokens"))
    items = base.select("*", F.explode(F.array(*map(F.lit, embed.KINDS))).alias("kind"))
    return embed.pooled(items, v.select(F.col("vec_id").alias("embedding_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))


def _pool_sql(kind: str, weight: str) -> str:
    return f"WITH v AS ({VEC}), u AS (SELECT CAST(label AS VARCHAR) AS d, CAST(vec_id % 3 AS VARCHAR) AS g, {weight} AS w, i, e[i + 1] AS x FROM v, (SELECT unnest(range(0, 64)) AS i)) SELECT d, g, '{kind}' AS kind, i::INTEGER AS i, round(sum(x * w) / sum(w), 6) AS x FROM u GROUP BY d, g, i"


def _long(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("kind") == kind).select("d", "g", "kind", F.posexplode("vector").alias("i", "x")).select("d", "g", "kind", "i", F.round("x", 6).alias("x"))


@query(_pool_sql("triplet", "1.0::DOUBLE"))
def q_pool_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _long(_pooled(spark, sf), "triplet")


@query(_pool_sql("paper", "(vec_id % 5 + 1)::DOUBLE"))
def q_pool_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _long(_pooled(spark, sf), "paper")


@query(f"WITH v AS ({VEC}), m AS (SELECT min(vec_id) AS vec_id FROM v GROUP BY label, vec_id % 3) SELECT CAST(label AS VARCHAR) AS d, CAST(vec_id % 3 AS VARCHAR) AS g, 'one' AS kind, i::INTEGER AS i, round(e[i + 1], 6) AS x FROM v SEMI JOIN m USING (vec_id), (SELECT unnest(range(0, 64)) AS i)")
def q_pool_first(spark: SparkSession, sf: str) -> DataFrame:
    return _long(_pooled(spark, sf), "one")


@query("WITH l AS (SELECT text, max(doc_id) AS embedding_id FROM documents GROUP BY text) SELECT CAST(lang AS VARCHAR) AS d, source AS g, doc_id AS pos, embedding_id FROM documents JOIN l USING (text)")
def q_text_to_id_lastwins(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    meta = docs.select("text", F.col("doc_id").alias("embedding_id"), F.col("n_chars").alias("tokens"))
    texts = docs.select(F.col("lang").alias("d"), F.col("source").alias("g"), F.lit("text").alias("kind"), F.col("doc_id").alias("pos"), "text", F.col("n_chars").alias("tokens"))
    return embed.text_ids(texts, meta).select("d", "g", "pos", "embedding_id")


# ---- relation extraction ---------------------------------------------------------------------


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def q_resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    from corvane.streaming.model_client import remaining

    return remaining(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


PROMPT = "Title: TITLE; text: TEXT; how does GENE relate to DISEASE?"


@query("SELECT n_nationkey, replace(replace(replace(replace('Title: TITLE; text: TEXT; how does GENE relate to DISEASE?', 'TITLE', n_name), 'TEXT', r_name), 'GENE', 'TEXT ' || n_name), 'DISEASE', r_name) AS prompt, replace(replace('Does GENE play a causal role in DISEASE? Answer yes or no.', 'GENE', n_name), 'DISEASE', r_name) AS question FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    n, r = F.col("n_name"), F.col("r_name")
    return d.select("n_nationkey", T.render(PROMPT, TITLE=n, TEXT=r, GENE=F.concat(F.lit("TEXT "), n), DISEASE=r).alias("prompt"), T.question(asking.QUESTION, n, r).alias("question"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS g, CASE WHEN p_size % 3 = 0 THEN [p_brand, p_type, p_type] ELSE [p_type, p_name] END AS v FROM part),
h AS (SELECT p_partkey, CASE WHEN g <> '' AND NOT list_contains(v, g) THEN list_concat([g], v) ELSE v END AS h FROM p)
SELECT p_partkey, (i - 1)::INTEGER AS pos, h[i] AS head FROM h, LATERAL (SELECT unnest(range(1, len(h) + 1)) AS i)""")
def q_head_list(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    v = F.when(F.col("p_size") % 3 == 0, F.array("p_brand", "p_type", "p_type")).otherwise(F.array("p_type", "p_name"))
    g = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand"))
    return p.select("p_partkey", F.posexplode(T.heads(g, v)).alias("pos", "head"))


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Model outputs made of part names: good lines, a bad one, a repeat, an end, and what follows it."""
    q = lambda *x: F.concat(*(F.concat(F.lit('"'), c, F.lit('"')) if i == 0 else F.concat(F.lit(', "'), c, F.lit('"')) for i, c in enumerate(x)))
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    end = F.when(F.col("p_size") % 2 == 0, "\n\nOther:\n- ").otherwise("\n- ")
    text = F.concat(q(n, F.lit("is made by"), b), F.lit("\r\n- "), q(b, F.lit("sells"), t), F.lit("\n- broken line\n -  \"x\"\n- "), q(n, F.lit("is made by"), b), end, q(t, F.lit("follows"), n))
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_name", "p_brand", "p_type", text.alias("out"))


@query("""WITH o AS (SELECT p_partkey, '"' || p_name || '", "is made by", "' || p_brand || '"' || chr(13) || chr(10) || '- "' || p_brand || '", "sells", "' || p_type || '"' || chr(10) || '- broken line' || chr(10) || ' -  "x"' || chr(10) || '- "' || p_name || '", "is made by", "' || p_brand || '"'
 || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || 'Other:' || chr(10) || '- "' ELSE chr(10) || '- "' END || p_type || '", "follows", "' || p_name || '"' AS out FROM part),
l AS (SELECT p_partkey, string_split('- ' || out, chr(10)) AS ls FROM o),
n AS (SELECT p_partkey, i, trim(ls[i], ' ' || chr(13)) AS x FROM l, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
s AS (SELECT p_partkey, i, x, min(CASE WHEN x NOT LIKE '- %' THEN i END) OVER (PARTITION BY p_partkey) AS stop FROM n),
g AS (SELECT p_partkey, i, regexp_extract(x, '^- "([^"]+)", "([^"]+)", "([^"]+)"$', ['h', 'r', 't']) AS m FROM s WHERE (stop IS NULL OR i < stop) AND regexp_matches(x, '^- "([^"]+)", "([^"]+)", "([^"]+)"$')),
d AS (SELECT p_partkey, m.h AS h, m.r AS r, m.t AS t, min(i) AS i FROM g GROUP BY ALL)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1)::INTEGER AS pos, h, r, t FROM d""")
def q_parse_output(spark: SparkSession, sf: str) -> DataFrame:
    return _outputs(spark, sf).select("p_partkey", F.posexplode(T.parsed(F.col("out"))).alias("pos", "x")).select("p_partkey", "pos", "x.*")


def _papers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Papers of the triplets above: brands are genes, type words diseases; two model choices a head."""
    o = _outputs(spark, sf)
    word = F.element_at(F.split("p_type", " "), -1)
    nested = lambda k, n: F.create_map(k, F.create_map(n, F.lit(1).cast("bigint")))
    stats = lambda n: F.create_map(n, F.array(F.lit(1).cast("bigint")))
    vid, name = F.lit("v1"), F.element_at(F.split("p_name", " "), 1)
    papers = o.select(F.col("p_partkey").alias("dgp_id"), word.alias("mesh"), F.col("p_brand").alias("gene"), F.col("p_partkey").cast("string").alias("pmid"), stats(word).alias("mesh_name_to_stats"), stats(F.col("p_brand")).alias("gene_name_to_stats"), nested(vid, name).alias("vid_name_count"), nested(name, vid).alias("name_vid_count"))
    two = F.array("out", F.regexp_replace("out", "sells", "sells much"))
    outputs = o.select(F.col("p_partkey").alias("dgp_id"), F.when(F.col("p_size") % 3 == 0, name).otherwise(F.col("p_brand")).alias("head"), two.alias("text_out_list"), F.lit("2024").alias("request_end_time"))
    return papers, outputs


def _matched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    papers, outputs = _papers(spark, sf)
    rows = ore.parse(ore.raw(papers, outputs))
    return rows, ore.match(ore.facts(rows))


MT = """f AS (SELECT p_partkey AS dgp_id, choice, t.h AS h, t.r AS r, t.t AS t, word, p_brand AS gene, name, CASE WHEN p_size % 3 = 0 THEN name ELSE p_brand END AS head
 FROM (SELECT p_partkey, p_size, p_name, p_brand, p_type, string_split(p_type, ' ')[-1] AS word, string_split(p_name, ' ')[1] AS name FROM part) p, (SELECT unnest([0, 1]) AS choice),
 LATERAL (SELECT unnest(CASE WHEN p_size % 2 = 0 THEN [{'h': p_name, 'r': 'is made by', 't': p_brand}, {'h': p_brand, 'r': CASE choice WHEN 0 THEN 'sells' ELSE 'sells much' END, 't': p_type}]
  ELSE [{'h': p_name, 'r': 'is made by', 't': p_brand}, {'h': p_brand, 'r': CASE choice WHEN 0 THEN 'sells' ELSE 'sells much' END, 't': p_type}, {'h': p_type, 'r': 'follows', 't': p_name}] END) AS t)),
m AS (SELECT *, contains(t, word) AS mh, head = gene AND contains(h, gene) AS gh, head = name AND contains(h, name) AS vh FROM f)"""


@query(f"WITH {MT} SELECT dgp_id, choice::INTEGER AS choice, h, r, t, mh::INTEGER AS diseases, gh::INTEGER AS genes, vh::INTEGER AS variants, mh AND (gh OR vh) AS is_match FROM m")
def q_match_triplets(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf)[1].select("dgp_id", "choice", "h", "r", "t", F.size("mesh_names").alias("diseases"), F.size("gene_names").alias("genes"), F.size("vids").alias("variants"), "is_match")


@query(f"WITH {MT}, g AS (SELECT * FROM m WHERE mh AND (gh OR vh)) SELECT dgp_id, 'disease' AS kind, word AS name, count(*) AS matches FROM g GROUP BY 1, 3 UNION ALL SELECT dgp_id, 'gene', gene, count(*) FROM g WHERE gh GROUP BY 1, 3 UNION ALL SELECT dgp_id, 'variant', name, count(*) FROM g WHERE vh GROUP BY 1, 3")
def q_match_counters(spark: SparkSession, sf: str) -> DataFrame:
    c = keep(ore.counters(_matched(spark, sf)[1]), "counters")
    flat = lambda kind, m: c.select("dgp_id", F.lit(kind).alias("kind"), F.explode(m).alias("name", "matches"))
    v = c.select("dgp_id", F.explode("vid_name_matches").alias("vid", "names")).select("dgp_id", F.lit("variant").alias("kind"), F.explode("names").alias("name", "matches"))
    return flat("disease", "mesh_name_to_matches").unionByName(flat("gene", "gene_name_to_matches")).unionByName(v)


@query(f"""WITH {MT}, g AS (SELECT DISTINCT dgp_id, h, r, t, gh, vh, choice FROM m WHERE mh AND (gh OR vh)), one AS (SELECT dgp_id, h, r, t, gh, vh, min(choice) AS choice FROM g GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY dgp_id ORDER BY CASE WHEN gh THEN -1 ELSE 0 END, CASE WHEN vh THEN 'v1' ELSE '' END, choice, CASE r WHEN 'is made by' THEN 0 WHEN 'follows' THEN 2 ELSE 1 END) AS n FROM one)
SELECT dgp_id, (n - 1)::INTEGER AS pos, h, r, t FROM k""")
def q_combine_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Nothing is alike enough at a limit of 1 but equal clauses, which SQL can tell."""
    rows, matched = _matched(spark, sf)
    return ore.combined(rows, matched, 1.0).select("dgp_id", F.posexplode("extractions").alias("pos", "x")).select("dgp_id", "pos", "x.h", "x.r", "x.t")


@query()
def q_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    """As above with a limit of 0.9; tests hold it against the pairwise definition."""
    rows, matched = _matched(spark, sf)
    return ore.combined(rows, matched, 0.9).select("dgp_id", F.posexplode("extractions").alias("pos", "x")).select("dgp_id", "pos", "x.h", "x.r", "x.t")


@query(f"""WITH {MT}, g AS (SELECT DISTINCT dgp_id, h, r, t FROM m WHERE mh AND (gh OR vh))
SELECT (SELECT count(*) FROM part) AS papers, (SELECT count(DISTINCT dgp_id) FROM g) AS papers_with_triplets, (SELECT count(*) FROM g) AS kept_triplets, (SELECT count(*) FROM m) AS triplets, (SELECT count(*) FROM m WHERE mh AND (gh OR vh)) AS good_triplets""")
def q_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What an extraction reports in the end. Two counts and the extractions read the matched triplets, so they are kept."""
    rows, matched = _matched(spark, sf)
    matched = keep(matched, "matched")
    return ore.totals(ore.combined(rows, matched, 1.0), matched)


@query()
def q_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs of clauses the bounds leave to compare letter by letter; tests hold the outcome against all pairs."""
    return ore.comparisons(_matched(spark, sf)[1], 0.9)


@query("SELECT CASE WHEN lower(text) LIKE 'e%' THEN 1.0 WHEN false THEN 0.0 ELSE 0.5 END::DOUBLE AS score, count(*) AS answers, round(count(*) / sum(count(*)) OVER (), 8) AS ratio FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY 1")
def q_answer_classify(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").where("role = 'assistant' and text is not null")
    said = F.when(F.lower("text").startswith("e"), F.concat(F.lit("YES "), "text")).otherwise(F.concat(F.lit("Perhaps "), "text"))
    return asking.histogram(t.select(F.array(said).alias("text_out_list"))).select("score", "answers", F.round("ratio", 8).alias("ratio"))


@query("SELECT CAST(user_id AS VARCHAR) AS mesh, event_type AS gene, CASE arg_max(event_id % 3, event_id) WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS score FROM events GROUP BY 1, 2")
def q_answer_lastwins(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    said = F.element_at(F.array(F.lit("Yes, it does"), F.lit("not sure"), F.lit("It may")), (F.col("event_id") % 3 + 1).cast("int"))
    return asking.answered(e.select(F.col("user_id").cast("string").alias("disease"), F.col("event_type").alias("gene"), "event_id", F.array(said).alias("text_out_list")), "event_id").drop("method")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,bigint>")["k"].alias("k"))


@query("""WITH a AS (SELECT p_brand AS token, min(p_size) AS v FROM part GROUP BY 1), b AS (SELECT p_brand AS token, min(CASE WHEN p_size > 1 THEN p_size END) AS v FROM part WHERE p_size <= 25 GROUP BY 1)
SELECT coalesce(a.token, b.token) AS token, CASE WHEN b.v IS NULL THEN 'in no class' WHEN a.v IS NULL THEN 'without explanation' ELSE 'explanation differs' END AS problem
FROM a FULL JOIN b ON a.token = b.token WHERE a.v IS NULL OR b.v IS NULL OR a.v <> b.v""")
def q_bijection_violations(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    a = p.groupBy(F.col("p_brand").alias("token")).agg(F.min("p_size").cast("string").alias("value"))
    b = p.where("p_size <= 25").groupBy(F.col("p_brand").alias("token")).agg(F.min(F.when(F.col("p_size") > 1, F.col("p_size"))).cast("string").alias("explanation"))
    return curation.violations(a, b)


# ---- rankers ---------------------------------------------------------------------------------


@query("""WITH d AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, (vec_id % 4 = 0)::INTEGER::DOUBLE AS y FROM embeddings),
o AS (SELECT label, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM d GROUP BY label),
t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM o),
r AS (SELECT o.label, t.n - o.n AS n, t.sx - o.sx AS sx, t.sy - o.sy AS sy, t.sxx - o.sxx AS sxx, t.sxy - o.sxy AS sxy FROM o, t),
b AS (SELECT label, sx / n AS mx, sy / n AS my, (sxy - sx * sy / n) / (sxx - sx * sx / n + 1) AS b FROM r)
SELECT label, vec_id, round(my + (x - mx) * b, 8) AS score FROM d JOIN b USING (label)""")
def q_ridge_loo_1d(spark: SparkSession, sf: str) -> DataFrame:
    return _ridge(spark, sf, 1).select(F.col("mesh").alias("label"), F.col("gene").alias("vec_id"), F.round("score", 8).alias("score"))


def _ridge(spark: SparkSession, sf: str, dimension: int) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("label").alias("mesh"), F.col("vec_id").alias("gene"), (F.col("vec_id") % 4 == 0).cast("int").alias("y"), F.slice("embedding", 1, dimension).alias("vector"))
    return rankers.ridge_loo(v)


@query("""WITH RECURSIVE d AS (SELECT label, vec_id, list_transform(list_concat([1.0], embedding), lambda x: x::DOUBLE) AS v, (vec_id % 4 = 0)::INTEGER::DOUBLE AS y FROM embeddings),
a AS (SELECT label, vec_id, v, list_concat(v, [y]) AS r FROM d),
c AS (SELECT label, vec_id, i, r[i] AS x FROM a, (SELECT unnest(range(1, 67)) AS i)),
o AS (SELECT p.label, p.i, q.i AS j, sum(p.x * q.x) AS s FROM c p JOIN c q USING (label, vec_id) GROUP BY ALL),
t AS (SELECT i, j, sum(s) AS s FROM o GROUP BY ALL),
m AS (SELECT label, i, list(t.s - o.s + CASE WHEN i = j AND i > 1 THEN 1.0 ELSE 0.0 END ORDER BY j) AS row FROM o JOIN t USING (i, j) WHERE i <= 65 GROUP BY ALL),
e AS (SELECT label, 1 AS k, list(row ORDER BY i) AS m FROM m GROUP BY label
      UNION ALL SELECT label, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k]) ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END) FROM e WHERE k <= 65),
b AS (SELECT label, list_transform(m, lambda r: r[66]) AS b FROM e WHERE k = 66)
SELECT label AS mesh, vec_id AS gene, round(list_dot_product(v, b), 6) AS score FROM d JOIN b USING (label)""")
def q_ridge_loo(spark: SparkSession, sf: str) -> DataFrame:
    """Over whole vectors. The SQL solves each fold's normal equations, 65 unknowns, by elimination."""
    return _ridge(spark, sf, 64).withColumn("score", F.round("score", 6))


@query()
def q_lambdamart_loo(spark: SparkSession, sf: str) -> DataFrame:
    """Over whole vectors, few small trees; tests hold its mean average precision against single features."""
    v = table(spark, sf, "embeddings").select(F.col("label").alias("mesh"), F.col("vec_id").alias("gene"), (F.col("vec_id") % 4 == 0).cast("int").alias("y"), "embedding")
    return rankers.lambdamart_loo(evidence.gold_first(v).withColumnRenamed("embedding", "x"), trees=6, leaves=8, bins=64)


@query()
def q_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """Texts cut to 200 tokens; tests hold the budget against the counter."""
    d = table(spark, sf, "documents").select("doc_id", T.truncated(200)(F.col("text")).alias("text"))
    return d.select("doc_id", F.length("text").alias("chars"), T.token_count()(F.col("text")).alias("tokens"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def q_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of streaming.incremental.event_counts, which the tests run as a stream."""
    from corvane.streaming.incremental import event_counts

    d = event_counts(table(spark, sf, "events"))
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


from corvane.plans import records  # noqa: E402, F401  registers the queries of sources, sinks and services
