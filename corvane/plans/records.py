"""Queries of sources, sinks and services: what is written through a sink is read back through its reader.

The files lie in the session's shared folder. SQL says what must come back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import asking, curation, embed, evidence, ore, tokens
from corvane.plans.registry import query
from corvane.session import keep, shared_dir, table
from corvane.sources import readers, sinks
from corvane.streaming import model_client


def _at(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, for formats that Spark's own writers don't have."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()


# ---- formats ---------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_size FROM part")
def q_json_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Written in two shards, one of them in two goes; read as one."""
    p, path = table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), _at(spark, "objects")
    sinks.json_lines(p.where("p_size % 3 = 0"), f"{path}/a")
    sinks.json_lines(p.where("p_size % 3 = 1"), f"{path}/b")
    sinks.json_lines(p.where("p_size % 3 = 2"), f"{path}/b", append=True)
    return readers.json_objects(spark, f"{path}/*", "p_partkey bigint, p_name string, p_size int").select("p_partkey", "p_name", F.col("p_size").cast(dict(p.dtypes)["p_size"]).alias("p_size"))


@query("SELECT p_name AS name, CAST(p_size AS VARCHAR) AS size, p_brand || '\"' AS brand FROM part")
def q_array_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = _at(spark, "arrays")
    sinks.array_lines(table(spark, sf, "part").select("p_name", "p_size", F.concat("p_brand", F.lit('"')).alias("b")), path, ["p_name", "p_size", "b"])
    return readers.numbered(spark, path).select(readers.item(0).alias("name"), readers.item(1).alias("size"), readers.item(2).alias("brand"))


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS mesh, CAST(l_partkey AS VARCHAR) AS gene, unnest(['paper', 'sentence']) AS feature, unnest([count(DISTINCT l_orderkey), count(*)])::DOUBLE AS score,
max(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 1 ELSE 0 END) AS gold FROM lineitem GROUP BY 1, 2""")
def q_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """[mesh, [gold], {gene: {feature: value}}] lines to evidence rows."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("mesh"), F.col("l_partkey").cast("string").alias("gene"), "l_orderkey", ((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)).alias("g"))
    pair = li.groupBy("mesh", "gene").agg(F.countDistinct("l_orderkey").cast("string").alias("paper"), F.count("*").cast("string").alias("sentence"), F.max("g").alias("g"))
    features = F.create_map(F.lit("paper"), "paper", F.lit("sentence"), "sentence", F.lit("or_list"), F.lit('["1.5", "0"]'))
    lines = pair.groupBy("mesh").agg(F.collect_list(F.when(F.col("g"), F.col("gene"))).alias("gold"), F.map_from_entries(F.collect_list(F.struct("gene", features))).alias("ann"))
    path = _at(spark, "annotations")
    sinks.array_lines(lines, path, ["mesh", "gold", "ann"])
    gold, _, ev, _ = evidence.normalized(evidence.last_line(readers.annotations(spark, path)))
    return ev.join(gold.withColumn("gold", F.lit(1)), ["mesh", "gene"], "left").select("mesh", "gene", "feature", "score", F.coalesce("gold", F.lit(0)).alias("gold"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS pmid, p_name AS h, 'is made by' AS r, p_brand AS t, string_split(p_type, ' ')[-1] AS mesh, p_brand AS gene, 2::INTEGER AS names FROM part")
def q_triplet_lines(spark: SparkSession, sf: str) -> DataFrame:
    """[pmid, [h, r, t], {id: {name: n}} x 3] lines: the first ids and all names."""
    p, one = table(spark, sf, "part"), F.lit(1).cast("bigint")
    word = F.element_at(F.split("p_type", " "), -1)
    of = lambda c: F.create_map(c, F.create_map(F.concat(F.lit("name of "), c), one))
    d = p.select(F.col("p_partkey").cast("string").alias("pmid"), F.array("p_name", F.lit("is made by"), "p_brand").alias("hrt"), of(word).alias("d"), of(F.col("p_brand")).alias("g"), F.create_map().cast("map<string,map<string,bigint>>").alias("v"))
    path = _at(spark, "triplets")
    sinks.array_lines(d, path, ["pmid", "hrt", "d", "g", "v"])
    return readers.triplets(spark, path).select("pmid", "h", "r", "t", "mesh", "gene", F.size("names").alias("names"))


@query("SELECT n_nationkey AS text_id, n_name || chr(10) || '\"é' AS text FROM nation")
def q_json_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are JSON strings, numbered over several files in their order."""
    d = table(spark, sf, "nation").select("n_nationkey", F.to_json(F.array(F.concat("n_name", F.lit('\n"é')))).alias("j"))
    path = _at(spark, "strings")
    line = F.expr("substring(j, 2, length(j) - 2)").alias("value")
    d.repartitionByRange(4, "n_nationkey").sortWithinPartitions("n_nationkey").select(line).write.text(path)
    return readers.json_strings(spark, path).select(F.col("text_id"), "text")


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name || ', \"' || p_brand || '\"' || chr(10) || 'x' END AS said FROM part UNION ALL SELECT -p_partkey, p_name || ',\"' FROM part WHERE p_size < 10")
def q_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV with header in order, and one appended to: quotes, commas, line breaks, empty fields."""
    p = table(spark, sf, "part")
    said = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\nx')))
    path, more = _at(spark, "ordered"), p.where("p_size < 10").select((-F.col("p_partkey")).alias("p_partkey"), F.concat("p_name", F.lit(',"')).alias("said"))
    p.select("p_partkey", said.alias("said")).createOrReplaceTempView("_said")
    sinks.append_csv(spark.table("_said").where("p_partkey % 2 = 0"), f"{path}/a")
    sinks.append_csv(spark.table("_said").where("p_partkey % 2 = 1"), f"{path}/a")
    sinks.append_csv(more, f"{path}/b")
    shape = "p_partkey bigint, said string"
    return readers.delimited(spark, f"{path}/a", shape).unionByName(readers.delimited(spark, f"{path}/b", shape))


@query("SELECT n_nationkey, n_name FROM nation")
def q_ordered_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = _at(spark, "ordered")
    sinks.ordered_csv(table(spark, sf, "nation").select("n_nationkey", "n_name"), path, [F.desc("n_name")])
    return readers.delimited(spark, path, "n_nationkey bigint, n_name string", header=True)


@query("SELECT vec_id, (i - 1)::INTEGER AS i, embedding[i]::DOUBLE AS x, (8 * len(embedding))::INTEGER AS bytes FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)")
def q_vector_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors appended to Parquet, and as float64 bytes for other programs."""
    e, path = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), _at(spark, "vectors")
    sinks.vectors(e.where("vec_id % 2 = 0"), path)
    sinks.vectors(e.where("vec_id % 2 = 1"), path, append=True)
    back = spark.read.schema(e.schema).parquet(path)
    size = sinks.float64_bytes(back.withColumn("copy", F.col("embedding")), "copy").select("vec_id", F.octet_length("copy").alias("bytes"), F.posexplode("embedding").alias("i", "x"))
    return size.select("vec_id", "i", "x", "bytes")


@query("SELECT embedding_id, (i - 1)::INTEGER AS i, embedding[i]::DOUBLE AS x FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS embedding_id, embedding FROM embeddings), LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)")
def q_float64_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Headerless float64 vectors, written by several tasks in order and read back in ranges of 64 vectors."""
    e, path = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), _at(spark, "blocks")
    sinks.float64_files(e.repartitionByRange(5, "vec_id").sortWithinPartitions("vec_id"), path, 64)
    return readers.float64_blocks(spark, path, 64, partition=64 * 64 * 8).select("embedding_id", F.posexplode("embedding").alias("i", "x"))


@query("""SELECT CAST(r_regionkey AS VARCHAR) || ' ' || r_name AS main, CAST(r_regionkey AS VARCHAR) || '.' || CAST(row_number() OVER (PARTITION BY r_regionkey, s_suppkey ORDER BY n_nationkey) AS VARCHAR) || ' ' || n_name AS sub,
n_name || ' token' AS token, 'is, ' || r_name AS explanation, (s_suppkey % 2)::INTEGER AS label, s_name AS disease, 'GENE:' || s_suppkey AS gene, 'PMID:' || s_nationkey AS pmid, 'a "b", c' AS triplet
FROM supplier, nation JOIN region ON n_regionkey = r_regionkey QUALIFY n_nationkey = s_nationkey""")
def q_class_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Class files (here of the five regions) to a tree of sample files, read back."""
    path = _at(spark, "classes")
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    for r in n.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns")).collect():
        _put(spark, f"{path}/{r.r_regionkey} {r.r_name}.txt", "\n\n".join(f"[{x.n_name}]\n{x.n_name} token,is, {r.r_name}" for x in r.ns).encode())
    s = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))  # 25 nations
    samples = s.select(F.concat("n_name", F.lit(" token")).alias("token"), (F.col("s_suppkey") % 2).cast("int").alias("label"), F.col("s_name").alias("mesh"), F.col("s_suppkey").cast("string").alias("gene"), F.col("s_nationkey").cast("string").alias("pmid"), F.lit('a "b", c').alias("triplet"))
    sinks.class_tree(curation.class_samples(readers.class_folder(spark, path), samples), f"{path}-tree")
    got = spark.read.schema("`key token` string, `key semantics` string, `pair-in-clinvar` int, disease string, gene string, PMID string, triplet string, main string, sub string").option("header", True).csv(f"{path}-tree/full")
    return got.select("main", "sub", F.col("key token").alias("token"), F.col("key semantics").alias("explanation"), F.col("pair-in-clinvar").alias("label"), "disease", "gene", F.col("PMID").alias("pmid"), "triplet")


@query("SELECT o_orderstatus AS method, CAST(o_custkey AS VARCHAR) AS mesh, o_orderpriority AS gene, count(*)::DOUBLE AS score FROM orders GROUP BY 1, 2, 3")
def q_predictions_sink(spark: SparkSession, sf: str) -> DataFrame:
    o, path = table(spark, sf, "orders"), _at(spark, "predictions")
    sinks.predictions(o.groupBy(F.col("o_orderstatus").alias("method"), F.col("o_custkey").cast("string").alias("mesh"), F.col("o_orderpriority").alias("gene")).agg(F.count("*").cast("double").alias("score")), path)
    return spark.read.schema("mesh string, gene string, score double, method string").parquet(path).select("method", "mesh", "gene", "score")


@query("SELECT s_suppkey, replace(replace('Of GENE:' || chr(10) || '\"TEXT\"' || chr(10), 'TEXT', 'GENE ' || s_name), 'GENE', 'x') AS prompt FROM supplier")
def q_template(spark: SparkSession, sf: str) -> DataFrame:
    """A template of several lines, read whole; what fills a slot may be filled again."""
    path = _at(spark, "template")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    s.limit(1).select(F.lit('Of GENE:\n"TEXT"').alias("value")).write.text(path)
    return s.select("s_suppkey", T.render(readers.template(spark, path), TEXT=F.concat(F.lit("GENE "), "s_name"), GENE=F.lit("x")).alias("prompt"))


@query("SELECT DISTINCT p_type AS token FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size % 7 = 0 AND p_retailprice > 1000)")
def q_unsampled(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of classes without samples."""
    p = table(spark, sf, "part")
    return curation.unsampled(p.select(F.col("p_type").alias("token")), p.where("p_size % 7 = 0 and p_retailprice > 1000").select(F.col("p_type").alias("token")))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN '1' WHEN c_custkey % 5 = 0 THEN '0' ELSE CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END END AS value FROM customer)
SELECT 'token, "' || c_custkey || '"' AS token, value, value IS NULL AS ask, coalesce(value = '1' AND c_custkey % 2 = 1, false) AS explain FROM c""")
def q_annotation_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds of annotations appended to a log, the last one of a token counts; what is still to be asked, and to be explained."""
    c, path = table(spark, sf, "customer").withColumn("token", F.concat(F.lit('token, "'), F.col("c_custkey").cast("string"), F.lit('"'))), _at(spark, "annotations")
    said = c.where("c_custkey % 7 <> 0")
    sinks.append_csv(said.select("token", F.when(F.col("c_acctbal") > 0, "1").otherwise("0").alias("value")), path)
    sinks.append_csv(said.where("c_custkey % 5 = 0").select("token", F.lit("0").alias("value")), path)
    sinks.append_csv(said.where("c_custkey % 3 = 0").select("token", F.lit("1").alias("value")), path)
    log, tokens_ = readers.annotation_log(spark, path), c.select("token")
    explained = c.where("c_custkey % 2 = 0").select("token", F.lit("said").alias("value"))
    ask, explain = (d.withColumn(n, F.lit(True)) for n, d in (("ask", curation.to_annotate(tokens_, log)), ("explain", curation.to_explain(tokens_, log, explained))))
    d = tokens_.join(curation.annotated(log), "token", "left").join(ask, "token", "left").join(explain, "token", "left")
    return d.select("token", "value", F.coalesce("ask", F.lit(False)).alias("ask"), F.coalesce("explain", F.lit(False)).alias("explain"))


@query("SELECT p_partkey AS dgp_id, p_name FROM part WHERE p_partkey BETWEEN 10 AND 150")
def q_line_range(spark: SparkSession, sf: str) -> DataFrame:
    return readers.line_range(table(spark, sf, "part").select(F.col("p_partkey").alias("dgp_id"), "p_name"), 10, 150)


@query("SELECT count(*) AS n, count(CASE WHEN p_size > 25 THEN 1 END) AS large FROM part")
def q_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Counts observed while something else is written."""
    df, seen = sinks.observed(table(spark, sf, "part"), f"progress-{uuid.uuid4().hex}", n=F.count("*"), large=F.count_if(F.col("p_size") > 25))
    keep(df.select("p_partkey"), "observed")
    return spark.createDataFrame([(seen.get["n"], seen.get["large"])], "n bigint, large bigint")


# ---- tasks, questions, services ---------------------------------------------------------------

_PIECES = "'[\\p{L}]{1,6}|[0-9]{1,3}|[^\\p{L}\\p{N}_\\s]|_'"


@query(f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), {_PIECES}))::BIGINT AS tokens FROM documents")
def q_token_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.token_count()(F.col("text")).alias("tokens"))


@query(f"""SELECT p_partkey AS dgp_id, h AS head, 'T ' || p_name || ' / a text / ' || h || ' / ' || p_type AS prompt FROM (SELECT *, 'of ' || p_brand AS maker, unnest(CASE WHEN p_size % 2 = 0 THEN [p_brand, 'of ' || p_brand] ELSE ['of ' || p_brand] END) AS h FROM part)
WHERE len(regexp_extract_all(p_name, {_PIECES})) <= 3 AND NOT (p_size % 3 = 0 AND h = maker)""")
def q_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts still to be asked: titles within their limit, heads not done."""
    p = table(spark, sf, "part").withColumn("maker", F.concat(F.lit("of "), "p_brand"))
    papers = p.select(F.col("p_partkey").alias("dgp_id"), F.lit("m").alias("mesh"), F.lit("g").alias("gene"), F.lit("1").alias("pmid"), F.col("p_name").alias("title"), F.lit("a text").alias("abstract"), F.col("p_type").alias("mesh_gpt_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("gene_gpt_name"), F.array("maker").alias("variant_gpt_name_list"))
    done = p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("dgp_id"), F.col("maker").alias("head"))
    return ore.tasks(papers, "T TITLE / TEXT / GENE / DISEASE", done, title_tokens=3, text_tokens=50).select("dgp_id", "head", "prompt")


@query("SELECT n_name AS disease, r_name AS gene, 'Does ' || r_name || ' play a causal role in ' || n_name || '? Answer yes or no.' AS text_in FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0")
def q_questions(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    pairs = n.select(F.col("n_name").alias("disease"), F.col("r_name").alias("gene"), F.col("n_name").alias("disease_name"), F.col("r_name").alias("gene_name"), "n_nationkey")
    return asking.questions(pairs, pairs.where("n_nationkey % 4 = 0")).select("disease", "gene", "text_in")


class Echo:
    """A service that answers at once, fails on words that end in A the first time, and for good on words that begin with C."""

    def __init__(self) -> None:
        self.asked: set[str] = set()

    def _may_fail(self, text: str) -> None:
        again = text in self.asked
        self.asked.add(text)
        if text.startswith("C") or (text.endswith("A") and not again):
            raise ConnectionError("no answer")

    def complete(self, prompt: str, n: int) -> list[str]:
        self._may_fail(prompt)
        return [f"yes {prompt}"] * n

    def embed(self, text: str) -> list[float]:
        self._may_fail(text)
        return [float(len(text)), 1.0]


@query(f"""SELECT n_nationkey, n_name AS prompt, CASE WHEN n_name NOT LIKE 'C%' THEN 'yes ' || n_name END AS answer, CASE WHEN n_name NOT LIKE 'C%' THEN 3 END::INTEGER AS answers, k AS in_tokens, CASE WHEN n_name LIKE 'C%' THEN 0 ELSE 3 * (k + 1) END AS out_tokens,
CASE WHEN n_name LIKE 'C%' THEN 4 WHEN n_name LIKE '%A' THEN 2 ELSE 1 END::BIGINT AS runs, CASE WHEN n_name LIKE 'C%' THEN 'ConnectionError: no answer' END AS error FROM (SELECT *, len(regexp_extract_all(n_name, {_PIECES}))::BIGINT AS k FROM nation)""")
def q_completions(spark: SparkSession, sf: str) -> DataFrame:
    """Calls under a quota, tried again, failures kept."""
    d = model_client.completions(table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("prompt")), Echo, n=3, runs=4)
    return d.select("n_nationkey", "prompt", F.get("text_out_list", F.lit(0)).alias("answer"), F.when(F.col("text_out_list").isNotNull(), F.size("text_out_list")).alias("answers"), "in_tokens", "out_tokens", "runs", "error")


@query(f"SELECT n_nationkey AS text_id, n_name AS text, CASE WHEN n_name NOT LIKE 'C%' THEN length(n_name) END::DOUBLE AS first, len(regexp_extract_all(n_name, {_PIECES}))::BIGINT AS tokens FROM nation")
def q_embedding_calls(spark: SparkSession, sf: str) -> DataFrame:
    d = model_client.embeddings(table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("text_id"), F.col("n_name").alias("text")), Echo, runs=3)
    return d.select("text_id", "text", F.get("embedding", F.lit(0)).alias("first"), "tokens")


@query("SELECT DISTINCT text FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def q_missing_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return embed.missing_texts(d.select("text"), d.where("doc_id % 3 = 0").select("text"))


# ---- evidence and tokens ------------------------------------------------------------------------


@query("SELECT CAST(user_id AS VARCHAR) AS mesh, max(event_id) AS line_no, arg_max(event_type, event_id) AS gold FROM events GROUP BY 1")
def q_last_line(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return evidence.last_line(e.select(F.col("user_id").cast("string").alias("mesh"), F.col("event_id").alias("line_no"), F.col("event_type").alias("gold")))


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Line states as diseases, orders as genes: groups of many thousand genes."""
    li = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("mesh"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0").alias("gene"), "l_discount")
    ev = li.groupBy("mesh", "gene").agg(F.count("*").cast("double").alias("score")).select("mesh", "gene", F.lit("paper").alias("feature"), "score")
    return li.where("l_discount >= 0.09").select("mesh", "gene").distinct(), ev


_ORDERS = "lo AS (SELECT l_linestatus AS mesh, lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS gene, max(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END) AS y, count(*)::DOUBLE AS paper FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY mesh ORDER BY y DESC, gene) AS pos FROM lo) SELECT mesh, y, count(*) AS genes, max(pos) AS last, min(gene) AS low, max(gene) AS high FROM r WHERE pos <= {evidence.MOST_GENES} GROUP BY 1, 2")
def q_gene_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Training groups cut to 10,000 genes, the gold ones first (groups here have more from sf0.01 on)."""
    gold, ev = _orders(spark, sf)
    odds = ev.select("mesh", "gene", F.lit(1.0).alias("odds_ratio")).limit(0)
    m = evidence.capped(evidence.feature_matrix(gold, ev, odds, None, 0))
    return m.groupBy("mesh", "y").agg(F.count("*").alias("genes"), F.max("pos").cast("bigint").alias("last"), F.min("gene").alias("low"), F.max("gene").alias("high"))


@query(f"WITH {_ORDERS} SELECT count(DISTINCT mesh) AS diseases, count(DISTINCT gene) AS genes, count(*) AS pairs FROM lo")
def q_sizes(spark: SparkSession, sf: str) -> DataFrame:
    gold, ev = _orders(spark, sf)
    return evidence.sizes(evidence.pair_table(gold, ev))


@query("""WITH v AS (SELECT CAST(label AS VARCHAR) AS mesh, CAST(vec_id AS VARCHAR) AS gene, CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END AS y, (1 + vec_id % 3)::DOUBLE AS paper, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
k AS (SELECT DISTINCT mesh FROM v WHERE y = 1), s AS (SELECT *, (paper - min(paper) OVER w) / CASE WHEN max(paper) OVER w = min(paper) OVER w THEN 1 ELSE max(paper) OVER w - min(paper) OVER w END AS sc FROM v SEMI JOIN k USING (mesh) WINDOW w AS (PARTITION BY mesh))
SELECT mesh, gene, y, i::INTEGER AS i, round(CASE WHEN i = 0 THEN paper WHEN i = 14 THEN sc WHEN i < 28 OR vec_id % 5 = 0 THEN 0 ELSE e[i - 27] END, 8) AS x FROM s, (SELECT unnest(range(0, 92)) AS i)""")
def q_feature_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Fourteen features, raw and scaled, then the pair's pooled vector; pairs without one have zeros."""
    e = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("mesh"), F.col("vec_id").cast("string").alias("gene"), "vec_id", "embedding")
    ev = e.select("mesh", "gene", F.lit("paper").alias("feature"), (1 + F.col("vec_id") % 3).cast("double").alias("score"))
    items = e.where("vec_id % 5 <> 0").select(F.col("mesh").alias("d"), F.col("gene").alias("g"), F.lit("triplet").alias("kind"), F.lit(0).alias("pos"), F.col("vec_id").alias("embedding_id"), F.lit(1).alias("tokens"))
    pooled = embed.pooled(items, e.select(F.col("vec_id").alias("embedding_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))
    m = evidence.feature_matrix(e.where("vec_id % 4 = 0").select("mesh", "gene"), ev, ev.select("mesh", "gene", F.lit(1.0).alias("odds_ratio")).limit(0), embed.vectors_of(pooled, "triplet"), 64)
    return m.select("mesh", "gene", "y", F.posexplode("x").alias("i", "x")).select("mesh", "gene", "y", "i", F.round("x", 8).alias("x"))


def _typed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Words of part types as tokens of (size class, brand) pairs."""
    p = table(spark, sf, "part").select((F.col("p_size") % 40).cast("string").alias("mesh"), F.col("p_brand").alias("gene"), F.col("p_partkey").cast("string").alias("pmid"), F.col("p_name").alias("h"), F.lit("is").alias("r"), F.col("p_type").alias("t"), F.split("p_type", " ").alias("tokens"), "p_size")
    return p, p.where("p_size > 45").select("mesh", "gene").distinct()


_TYPED = """tp AS (SELECT CAST(p_size % 40 AS VARCHAR) AS mesh, p_brand AS gene, CAST(p_partkey AS VARCHAR) AS pmid, unnest(string_split(p_type, ' ')) AS token FROM part),
tgold AS (SELECT DISTINCT CAST(p_size % 40 AS VARCHAR) AS mesh, p_brand AS gene FROM part WHERE p_size > 45), tsc AS (SELECT mesh, gene, token, count(*) AS score FROM tp GROUP BY 1, 2, 3),
tst AS (SELECT token, coalesce(sum(CASE WHEN g.gene IS NOT NULL THEN score END), 0)::BIGINT AS gold_score, sum(score)::BIGINT AS score, count(g.gene) AS gold_dgs, count(*) AS dgs FROM tsc LEFT JOIN tgold g ON tsc.mesh = g.mesh AND tsc.gene = g.gene
        WHERE tsc.mesh IN (SELECT mesh FROM tgold) GROUP BY token HAVING count(*) >= 5),
trk AS (SELECT *, row_number() OVER (ORDER BY gold_score / score DESC, gold_dgs DESC, gold_dgs / dgs DESC, token)::INTEGER AS rank FROM tst)"""


@query(f"WITH {_TYPED} SELECT tp.token, rank, CASE WHEN g.gene IS NULL THEN 0 ELSE 1 END AS label, tp.mesh, tp.gene, pmid FROM tp JOIN trk USING (token) LEFT JOIN tgold g ON tp.mesh = g.mesh AND tp.gene = g.gene WHERE tp.mesh IN (SELECT mesh FROM tgold)")
def q_ranked_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence of the ranked tokens, their rank with it."""
    p, gold = _typed(spark, sf)
    top = tokens.ranked(tokens.token_stats(tokens.pair_scores(p)[0], gold, 5))
    return tokens.token_evidence(p, gold, top).select("token", "rank", "label", "mesh", "gene", "pmid")


@query(f"WITH {_TYPED} SELECT token, gold_score, dgs, count(*)::BIGINT AS triplets, count(DISTINCT CASE WHEN g.gene IS NOT NULL THEN (tp.mesh, tp.gene) END)::INTEGER AS gold, count(DISTINCT CASE WHEN g.gene IS NULL THEN (tp.mesh, tp.gene) END)::INTEGER AS other FROM tp JOIN tst USING (token) LEFT JOIN tgold g ON tp.mesh = g.mesh AND tp.gene = g.gene WHERE tp.mesh IN (SELECT mesh FROM tgold) GROUP BY 1, 2, 3")
def q_nested_evidence(spark: SparkSession, sf: str) -> DataFrame:
    p, gold = _typed(spark, sf)
    stats = tokens.token_stats(tokens.pair_scores(p)[0], gold, 5)
    return tokens.nested_evidence(tokens.token_evidence(p, gold, stats), stats).select("token", "gold_score", "dgs", "triplets", F.size("gold").alias("gold"), F.size("other").alias("other"))


@query("SELECT 'token_curated' AS method, CAST(p_size % 40 AS VARCHAR) AS mesh, p_brand AS gene, count(*)::DOUBLE AS score FROM (SELECT *, unnest(string_split(p_type, ' ')) AS token FROM part) WHERE length(token) % 2 = 1 GROUP BY 2, 3")
def q_curated_prediction(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions from tokens that an annotator marked."""
    p, _ = _typed(spark, sf)
    marks = p.select(F.explode("tokens").alias("token")).distinct().withColumn("value", (F.length("token") % 2).cast("string"))
    return tokens.predictions(tokens.pair_scores(p)[0], tokens.curated_set(marks))
