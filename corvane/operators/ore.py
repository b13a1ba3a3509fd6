"""Relation extraction: from model outputs to matched, de-duplicated, ordered triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions import text as T


def tasks(papers: DataFrame, template: str, done: DataFrame | None = None, title_tokens: int = 200, text_tokens: int = 2500, counter=T.count_pieces) -> DataFrame:
    """(dgp_id, mesh, gene, pmid, head, tail, prompt): one row a head still to be asked about.

    Titles over the limit drop the paper, abstracts are cut to theirs; done (dgp_id, head) is skipped.
    """
    d = papers.where(T.token_count(counter)(F.col("title")) <= title_tokens)
    d = d.withColumn("_text", T.truncated(text_tokens, counter)(F.col("abstract")))
    d = d.select("dgp_id", "mesh", "gene", "pmid", "title", "_text", F.col("mesh_gpt_name").alias("tail"), F.explode(T.heads(F.col("gene_gpt_name"), F.col("variant_gpt_name_list"))).alias("head"))
    if done is not None:
        d = d.join(done.select("dgp_id", "head").distinct(), ["dgp_id", "head"], "left_anti")
    return d.select("dgp_id", "mesh", "gene", "pmid", "head", "tail", T.render(template, TITLE=F.col("title"), TEXT=F.col("_text"), GENE=F.col("head"), DISEASE=F.col("tail")).alias("prompt"))


def raw(papers: DataFrame, outputs: DataFrame, order: str | None = None) -> DataFrame:
    """papers with their outputs: array of (head, outputs). Of a repeated (dgp_id, head) the last counts, in the first's place.

    order names the column that tells outputs apart in time; without it, request_end_time does.
    Both sides grow with the corpus, and texts and maps take many times what their compressed files
    do, by which the planner judges: the join is by sorting, never by broadcast.
    """
    o = F.col(order) if order else F.col("request_end_time")
    one = outputs.groupBy("dgp_id", "head").agg(F.min(o).alias("_at"), F.max_by("text_out_list", o).alias("outputs"))
    nested = one.groupBy("dgp_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "head", "outputs"))), lambda x: F.struct(x.head.alias("head"), x.outputs.alias("outputs"))).alias("heads"))
    return papers.join(nested.hint("merge"), "dgp_id")


def parse(rows: DataFrame) -> DataFrame:
    """heads: array of (head, choices array<array<triplet>>)."""
    return rows.withColumn("heads", F.transform("heads", lambda h: F.struct(h.head.alias("head"), F.transform(h.outputs, T.parsed).alias("choices"))))


def facts(rows: DataFrame) -> DataFrame:
    """The flat table of triplets: dgp_id, mesh, gene, pmid, head_pos, head, choice, pos, h, r, t, with the paper's names.

    tail_names and head_names are those that t and h hold as written: of the diseases' names, of the
    genes' and variants'. They are sought for all triplets of a paper at once. No filter stands on the
    triplets: the planner would push it below the join and parse the outputs there once more.
    """
    names = ["dgp_id", "mesh", "gene", "pmid", "gene_name_to_stats", "vid_name_count", "name_vid_count"]
    each = lambda h, i: F.flatten(F.transform(h.choices, lambda c, j: F.transform(c, lambda x, k: F.struct(i.alias("head_pos"), h.head.alias("head"), j.alias("choice"), k.alias("pos"), x.h.alias("h"), x.r.alias("r"), x.t.alias("t")))))
    keys = lambda *maps: F.array_distinct(F.concat(*(F.coalesce(F.map_keys(m), F.array().cast("array<string>")) for m in maps)))
    d = rows.select(*names, keys("mesh_name_to_stats").alias("_m"), keys("gene_name_to_stats", "name_vid_count").alias("_g"), F.flatten(F.transform("heads", each)).alias("_x"))
    d = d.withColumn("_t", T.held()(F.col("_m"), F.transform("_x", lambda x: x.t))).withColumn("_h", T.held()(F.col("_g"), F.transform("_x", lambda x: x.h)))
    one = F.transform("_x", lambda x, i: F.struct(x.alias("x"), F.get("_t", i).alias("tail_names"), F.get("_h", i).alias("head_names")))
    return d.select(*names, F.explode(one).alias("z")).select(*names, "z.x.*", "z.tail_names", "z.head_names")


def match(triplets: DataFrame) -> DataFrame:
    """The facts with mesh_names, gene_names, vids (map id -> names) and is_match.

    Diseases are sought in the tail, genes in the head if the input head is a gene name, variants in
    the head if they share an id with the input head. A variant name without ids is no hit.
    """
    none = F.array().cast("array<string>")
    vids = F.coalesce(F.map_keys(F.try_element_at("name_vid_count", F.col("head"))), none)
    siblings = F.array_distinct(F.flatten(F.transform(vids, lambda v: F.coalesce(F.map_keys(F.try_element_at("vid_name_count", v)), none))))
    d = triplets.withColumns({"mesh_names": F.col("tail_names"), "gene_names": F.when(F.map_contains_key("gene_name_to_stats", F.col("head")), F.filter("head_names", lambda n: F.map_contains_key("gene_name_to_stats", n))).otherwise(none), "_v": F.filter(siblings, lambda n: F.array_contains("head_names", n))})
    pairs = F.flatten(F.transform("_v", lambda n: F.transform(F.coalesce(F.map_keys(F.try_element_at("name_vid_count", n)), none), lambda v: F.struct(v.alias("vid"), n.alias("name")))))
    d = d.withColumn("_p", pairs)
    ids = F.array_distinct(F.transform("_p", lambda p: p["vid"]))
    d = d.withColumn("vids", F.map_from_arrays(ids, F.transform(ids, lambda i: F.transform(F.filter("_p", lambda p: p["vid"] == i), lambda p: p["name"]))))
    return d.withColumn("is_match", (F.size("mesh_names") > 0) & ((F.size("gene_names") > 0) | (F.size("_p") > 0))).drop("_v", "_p", "tail_names", "head_names", "gene_name_to_stats", "vid_name_count", "name_vid_count")


def counters(matched: DataFrame) -> DataFrame:
    """(dgp_id, mesh_name_to_matches, gene_name_to_matches, vid_name_matches) over the matching triplets."""
    hit = lambda kind, i, name: F.struct(F.lit(kind).alias("kind"), i.alias("id"), name.alias("name"))
    plain = lambda kind, names: F.transform(names, lambda n: hit(kind, F.lit(""), n))
    variants = F.flatten(F.transform(F.map_entries("vids"), lambda e: F.transform(e.value, lambda n: hit("v", e.key, n))))
    each = matched.where("is_match").select("dgp_id", F.explode(F.concat(plain("m", F.col("mesh_names")), plain("g", F.col("gene_names")), variants)).alias("x"))
    n = each.groupBy("dgp_id", "x.kind", "x.id", "x.name").count()
    by = n.groupBy("dgp_id", "kind", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "count")))).alias("names"))
    pick = lambda k: F.max_by("names", F.when(F.col("kind") == k, 1))
    entries = F.array_sort(F.collect_list(F.when(F.col("kind") == "v", F.struct("id", F.map_entries("names").alias("e")))))
    g = by.groupBy("dgp_id").agg(pick("m").alias("mesh_name_to_matches"), F.max(F.col("kind") == "g").alias("_g"), pick("g").alias("gene_name_to_matches"), entries.alias("_v"))
    empty = F.create_map().cast(schemas.COUNTS)
    return g.select("dgp_id", F.coalesce("mesh_name_to_matches", empty).alias("mesh_name_to_matches"), F.when(F.col("_g"), F.col("gene_name_to_matches")).otherwise(empty).alias("gene_name_to_matches"), F.map_from_entries(F.transform("_v", lambda x: F.struct(x.id, F.map_from_entries(x.e)))).alias("vid_name_matches"))


def combined(rows: DataFrame, matched: DataFrame, most: float) -> DataFrame:
    """One row a paper: its counters and the triplets that stay, most gene names first, then by variant ids.

    rows are the papers, so those without a match are kept, with nothing in them.
    The joins are by sorting, as in raw.
    """
    ones = lambda names: F.map_from_arrays(names, F.transform(names, lambda _: F.lit(1).cast("bigint")))
    item = F.struct("pos", "h", "r", "t", "gene_names", "mesh_names", F.map_entries("vids").alias("v"))
    good = matched.where("is_match").groupBy("dgp_id", "head_pos", "choice").agg(F.array_sort(F.collect_list(item)).alias("items"))
    head = good.groupBy("dgp_id", "head_pos").agg(F.array_sort(F.collect_list(F.struct("choice", "items"))).alias("c"))
    clauses = F.transform("c", lambda x: F.transform(x["items"], T.clause))
    head = head.withColumn("_s", T.near_duplicates(most)(clauses)).withColumn("stay", F.col("_s.stay"))
    kept = F.flatten(F.transform("c", lambda x, i: F.filter(F.transform(x["items"], lambda y, j: F.struct(F.get(F.get("stay", i), j).alias("ok"), x.choice.alias("choice"), y.alias("y"))), lambda z: z.ok)))
    key = lambda p, z: F.struct((-F.size(z.y.gene_names)).alias("k1"), F.array_sort(F.transform(z.y.v, lambda e: e.key)).alias("k2"), p.alias("head_pos"), z.choice.alias("choice"), z.y.pos.alias("pos"), z.y.alias("y"))
    head = head.select("dgp_id", F.transform(kept, lambda z: key(F.col("head_pos"), z)).alias("k"))
    paper = head.groupBy("dgp_id").agg(F.array_sort(F.flatten(F.collect_list("k"))).alias("k"))
    vid = lambda e: F.struct(e.key, ones(e.value))
    out = F.transform("k", lambda x: F.struct(x.y.h.alias("h"), x.y.r.alias("r"), x.y.t.alias("t"), ones(x.y.mesh_names).alias("m"), ones(x.y.gene_names).alias("g"), F.map_from_entries(F.transform(x.y.v, vid)).alias("v")))
    paper = paper.select("dgp_id", out.alias("extractions"))
    d = rows.select("dgp_id", "mesh", "gene", "pmid").join(counters(matched).hint("merge"), "dgp_id", "left").join(paper.hint("merge"), "dgp_id", "left")
    some = F.create_map().cast(schemas.COUNTS)
    return d.select("dgp_id", "mesh", "gene", "pmid", F.coalesce("mesh_name_to_matches", some).alias("mesh_name_to_matches"), F.coalesce("gene_name_to_matches", some).alias("gene_name_to_matches"), F.coalesce("vid_name_matches", F.create_map().cast(schemas.NESTED)).alias("vid_name_matches"), F.coalesce("extractions", F.array().cast(f"array<{schemas.EXTRACTION}>")).alias("extractions"))


def comparisons(matched: DataFrame, most: float) -> DataFrame:
    """One row: how many matching clauses there are, how many pairs of a later and a kept one of a head, and how many of those had to be compared letter by letter."""
    good = matched.where("is_match").groupBy("dgp_id", "head_pos", "choice").agg(F.array_sort(F.collect_list(F.struct("pos", "h", "r", "t"))).alias("items"))
    head = good.groupBy("dgp_id", "head_pos").agg(F.array_sort(F.collect_list(F.struct("choice", "items"))).alias("c"))
    done = head.select(T.near_duplicates(most)(F.transform("c", lambda x: F.transform(x["items"], T.clause))).alias("s"))
    return done.agg(*(F.coalesce(F.sum(f"s.{c}"), F.lit(0)).alias(c) for c in ("clauses", "pairs", "compared")))


def extract(papers: DataFrame, outputs: DataFrame, most: float, order: str | None = None) -> DataFrame:
    """Outputs to combined rows in one plan."""
    rows = parse(raw(papers, outputs, order))
    return combined(rows, match(facts(rows)), most)


def triplet_table(rows: DataFrame) -> DataFrame:
    """One row a triplet: pmid, h, r, t and d, g, v as {id: {name: count}}, what the token stage reads."""
    d = rows.select("mesh", "gene", "pmid", F.explode("extractions").alias("x"))
    of = lambda i, m: F.create_map(i, m)
    return d.select("pmid", "x.h", "x.r", "x.t", of(F.col("mesh"), F.col("x.m")).alias("d"), of(F.col("gene"), F.col("x.g")).alias("g"), F.col("x.v").alias("v"))


def totals(rows: DataFrame, matched: DataFrame) -> DataFrame:
    """Papers and triplets, all, good and kept: one row."""
    t = matched.agg(F.count("*").alias("triplets"), F.count_if("is_match").alias("good_triplets"))
    p = rows.agg(F.count("*").alias("papers"), F.count_if(F.size("extractions") > 0).alias("papers_with_triplets"), F.coalesce(F.sum(F.size("extractions")), F.lit(0)).alias("kept_triplets"))
    return p.join(F.broadcast(t))  # one row each
