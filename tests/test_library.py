"""Operators on hand-made rows, and against brute force."""

import difflib
import json
import random
import struct
import threading
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions import text as T
from corvane.functions.stem import stem
from corvane.operators import asking, boosting, curation, embed, evidence, metrics, ore, rankers, ranks, tokens
from corvane.sources import readers, sinks
from corvane.streaming import incremental, model_client


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ---- text


def test_strip_is_python_strip(spark):
    cases = ["  a ", "\x1c- x\x1f", " é ", "\r\n", "", "a\x1cb"]
    got = spark.createDataFrame([(c,) for c in cases], "s string").select("s", T.strip(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in got} == {c: c.strip() for c in cases}


@pytest.mark.parametrize(
    ("output", "want"),
    [
        ("", []),
        ('"a", "b", "c"', [("a", "b", "c")]),
        ('"a", "b", "c"\r\n- "d", "e", "f"\r', [("a", "b", "c"), ("d", "e", "f")]),
        ('"a", "b", "c"\n- bad\n- "d", "e", "f"', [("a", "b", "c"), ("d", "e", "f")]),
        ('"a", "b", "c"\n\n- "d", "e", "f"', [("a", "b", "c")]),
        ('"a", "b", "c"\n- \n- "d", "e", "f"', [("a", "b", "c")]),
        ('"a", "b", "c"\n- "a", "b", "c"', [("a", "b", "c")]),
        ('"a "x"", "b", "c"', []),
        ('"a", "b", "c"\n - "d", "e", "f"\x1c', [("a", "b", "c"), ("d", "e", "f")]),
        ('"a", "b", "c"\nThe end\n- "d", "e", "f"', [("a", "b", "c")]),
    ],
)
def test_parse(spark, output, want):
    got = spark.createDataFrame([(output,)], "o string").select(T.parsed(F.col("o")).alias("p")).first().p
    assert [tuple(x) for x in got] == want


def test_render_is_sequential(spark):
    assert spark.range(1).select(T.render("TITLE/GENE", TITLE=F.lit("a GENE"), GENE=F.lit("g")).alias("x")).first().x == "a g/g"


def test_heads(spark):
    d = spark.createDataFrame([("g", ["v", "v"]), ("", ["v"]), ("v", ["v"])], "g string, v array<string>")
    assert [r.h for r in d.select(T.heads(F.col("g"), F.col("v")).alias("h")).collect()] == [["g", "v", "v"], ["v"], ["v"]]


@pytest.mark.parametrize(
    ("word", "want"),
    [line.split() for line in """consign consign|consigned consign|consigning consign|consignment consign|consist consist|consisted consist|consistency consist|consistent consist|consistently consist|consisting consist|consists consist|consolation consol|consolations consol|consolatory consolatori|console consol|consoled consol|consoles consol|consolidate consolid|consolidated consolid|consolidating consolid|consoling consol|consolingly consol|consols consol|consonant conson|consort consort|consorted consort|consorting consort|conspicuous conspicu|conspicuously conspicu|conspiracy conspiraci|conspirator conspir|conspirators conspir|conspire conspir|conspired conspir|conspiring conspir|constable constabl|constables constabl|constance constanc|constancy constanc|constant constant|knack knack|knackeries knackeri|knacks knack|knag knag|knave knave|knaves knave|knavish knavish|kneaded knead|kneading knead|knee knee|kneel kneel|kneeled kneel|kneeling kneel|kneels kneel|knees knee|knell knell|knelt knelt|knew knew|knick knick|knif knif|knife knife|knight knight|knightly knight|knights knight|knit knit|knits knit|knitted knit|knitting knit|knives knive|knob knob|knobs knob|knock knock|knocked knock|knocker knocker|knockers knocker|knocking knock|knocks knock|knopp knopp|knot knot|knots knot|generate generat|generates generat|general general|hopping hop|hoping hope|luxuriated luxuri|cries cri|ties tie|gas gas|this this|gaps gap|kiwis kiwi|skies sky|dying die|news news|exceed exceed|happily happili|sensational sensat|national nation|rational ration|youth youth|say say|by by|cry cri""".replace("generate generat|generates generat", "generate generat|generates generat").split("|")],
)
def test_stem_published(word, want):
    assert stem(word) == want


def test_near_duplicates_match_the_definition():
    r = random.Random(1)

    def brute(choices, most):
        kept, first, out = [], True, []
        for c in choices:
            stay = []
            for x in c:
                ok = first or not any(x == k or difflib.SequenceMatcher(None, x, k, autojunk=False).ratio() > most for k in kept)
                stay.append(ok)
                if ok:
                    kept.append(x)
            first = first and not c
            out.append(stay)
        return out

    for _ in range(300):
        choices = [["".join(r.choice("abc ") for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 3))] for _ in range(r.randint(1, 4))]
        for most in (0.3, 0.5, 0.8, 1.0):
            assert T.survivors(choices, most) == brute(choices, most)
    assert T.survivors([[], ["ab", "ab"], ["ab", "xy"]], 0.9) == [[], [True, True], [False, True]]
    assert T.survivors([["abcd"], ["abxx"]], 0.5) == [[True], [True]]  # exactly at the limit stays
    r = random.Random(3)
    many = [[" ".join(r.choice(["gene", "mutated", "in", "disease", "causes", "p53", "x"]) for _ in range(r.randint(1, 12))) for _ in range(40)] for _ in range(4)]
    stay, kept = T.survived(many, 0.9)
    assert stay == brute(many, 0.9) and 0 < kept.compared < kept.pairs / 4


def test_names_are_found_in_one_pass():
    r = random.Random(5)
    for _ in range(300):
        names = list(dict.fromkeys("".join(r.choice("abé") for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 8))))
        text = "".join(r.choice("abé ") for _ in range(r.randint(0, 30)))
        assert T.finder(names)(text) == [n for n in names if n in text]


def test_truncate():
    text = "word " * 900
    assert T.count_pieces(T.truncate(text, 200)) <= 200 and T.truncate("a b", 5) == "a b"
    assert T.truncate("!", 0) == "!"


def test_answers_and_percent(spark):
    d = spark.createDataFrame([(["Yes."],), (["not sure"],), (["None"],), (["maybe"],), ([],)], "a array<string>")
    assert [r.s for r in d.select(T.answer_score(F.col("a")).alias("s")).collect()] == [1.0, 0.0, 0.0, 0.5, None]
    p = spark.createDataFrame([(0.125,), (0.375,), (1.0,), (0.0,)], "x double").select(T.percent(F.col("x")).alias("p"))
    assert [r.p for r in p.collect()] == ["12%", "38%", "100%", "0%"]


# ---- relation extraction


def paper(spark):
    row = ("D1", "G1", "77", "Mystery disease", "GENA", ["p.V1", "p.V1"], "A title", "A text", {"Mystery disease": [1]}, {"GENA": [1], "GENA-alt": [2]}, {"rs1": {"p.V1": 1, "V1X": 1}}, {"p.V1": {"rs1": 1}})
    return spark.createDataFrame([(1, *row)], "dgp_id bigint, " + schemas.PAPER_PAIR.replace("\n", " "))


def outputs(spark, *texts, head="GENA", end="2"):
    return spark.createDataFrame([(1, "D1", "G1", "77", head, "Mystery disease", list(texts), "1", end, 1, 1)], schemas.MODEL_OUTPUT.replace("\n", " "))


THREE = ('"GENA", "mutated in", "Mystery disease"\n- "Mystery disease", "leads to", "pain"\n\nOther:\n- "GENA", "x", "Mystery disease"', '"GENA", "is mutated in", "Mystery disease"\n- "Mystery disease", "causes", "pain"', '"GENA", "is mutated in", "Mystery disease"')


@pytest.mark.parametrize(("most", "kept"), [(0.9, 1), (0.99, 2)])
def test_golden_shape(spark, most, kept):
    got = rows(ore.extract(paper(spark), outputs(spark, *THREE), most))[0]
    assert got["mesh_name_to_matches"] == {"Mystery disease": 3} and got["gene_name_to_matches"] == {"GENA": 3} and got["vid_name_matches"] == {}
    assert len(got["extractions"]) == kept
    assert got["extractions"][0] == {"h": "GENA", "r": "mutated in", "t": "Mystery disease", "m": {"Mystery disease": 1}, "g": {"GENA": 1}, "v": {}}


def test_match_rules(spark):
    said = '"p.V1 and V1X", "in", "Mystery disease"\n- "GENA-alt", "in", "Mystery disease"\n- "gena", "in", "Mystery disease"\n- "p.V1", "in", "mystery disease"'
    rows_ = ore.parse(ore.raw(paper(spark), outputs(spark, said, head="p.V1")))
    got = {r["h"]: r for r in rows(ore.match(ore.facts(rows_)))}
    assert got["p.V1 and V1X"]["vids"] == {"rs1": ["p.V1"]} and got["p.V1 and V1X"]["is_match"]  # V1X has no ids of its own: no hit
    assert not got["GENA-alt"]["is_match"] and not got["p.V1"]["is_match"]
    none = rows(ore.extract(paper(spark), outputs(spark, "nothing"), 0.9))[0]
    assert none["extractions"] == [] and none["mesh_name_to_matches"] == {}


def test_raw_last_output_wins(spark):
    both = outputs(spark, "old", end="1").unionByName(outputs(spark, "new", end="2")).unionByName(outputs(spark, "v", head="p.V1", end="1.5"))
    got = rows(ore.raw(paper(spark), both))[0]["heads"]
    assert got == [{"head": "GENA", "outputs": ["new"]}, {"head": "p.V1", "outputs": ["v"]}]


#: Queries over the extraction's tables, which the planner judges by small compressed files.
LARGE_JOINS = ["q_match_triplets", "q_comparisons", "q_match_counters", "q_combine_sorted", "q_totals", "q_near_dup"]


@pytest.mark.parametrize("name", LARGE_JOINS)
def test_papers_and_outputs_are_not_broadcast(spark, monkeypatch, name):
    """However small the files look: what is broadcast is gathered by the driver first."""
    from corvane.plans import catalogue

    monkeypatch.setattr(catalogue, "keep", lambda df, *_: df)  # so that the plan has everything
    done = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    done.collect()
    shown = done._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in shown and "BroadcastHashJoin" not in shown


#: The same queries, whose outputs are parsed by one regular expression, in one place.
PARSED_ONCE = ["q_comparisons", "q_near_dup"]


@pytest.mark.parametrize("name", PARSED_ONCE)
def test_outputs_are_parsed_once(spark, monkeypatch, name):
    """A filter on the triplets would be pushed below the join, and parse there once more."""
    from corvane.plans import catalogue

    monkeypatch.setattr(catalogue, "keep", lambda df, *_: df)  # so that the plan has everything
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("RLIKE"), plan.count("(?U)^")) == (1, 1)


@pytest.mark.parametrize("name", ["q_totals", "q_match_counters"])
def test_kept_triplets_are_matched_once(spark, monkeypatch, name):
    """What is kept and what is left to do hold one parse between them, though three parts read what is kept."""
    from corvane.plans import catalogue

    plans, of = [], lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    kept = catalogue.keep
    monkeypatch.setattr(catalogue, "keep", lambda df, *names: (plans.append(of(df)), kept(df, *names))[1])
    plans.append(of(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")))
    assert sum(p.count("RLIKE") for p in plans) == 1


def test_papers_without_triplets(spark):
    for texts in ([None], ["nothing"], [None, "nothing"], []):
        assert ore.facts(ore.parse(ore.raw(paper(spark), outputs(spark, *texts)))).count() == 0


def test_tasks_and_triplets(spark):
    t = ore.tasks(paper(spark), "TITLE TEXT GENE DISEASE")
    assert sorted(r["head"] for r in rows(t)) == ["GENA", "p.V1", "p.V1"]
    assert [r["head"] for r in rows(ore.tasks(paper(spark), "x", t.where("head = 'p.V1'")))] == ["GENA"]
    assert ore.tasks(paper(spark), "x", title_tokens=1).count() == 0
    flat = readers.with_first_ids(ore.triplet_table(ore.extract(paper(spark), outputs(spark, *THREE), 0.9)))
    r = rows(tokens.token_triplets(flat))[0]
    assert (r["mesh"], r["gene"]) == ("D1", "G1") and r["tokens"] == ["mutat", "mysteri", "diseas"]
    total = rows(ore.totals(ore.extract(paper(spark), outputs(spark, *THREE), 0.9), ore.match(ore.facts(ore.parse(ore.raw(paper(spark), outputs(spark, *THREE)))))))[0]
    assert total == {"papers": 1, "papers_with_triplets": 1, "kept_triplets": 1, "triplets": 5, "good_triplets": 3}


# ---- evidence and metrics


def test_average_precision_against_brute_force(spark):
    r = random.Random(3)
    data = [(str(g), str(i), float(r.randint(0, 4)), r.randint(0, 1)) for g in range(12) for i in range(r.randint(1, 25))]

    def brute(part):
        ap, tp, n, pos = 0.0, 0, 0, sum(y for _, y in part)
        for s in sorted({s for s, _ in part}, reverse=True):
            here = [y for t, y in part if t == s]
            n += len(here)
            tp += sum(here)
            ap += sum(here) / pos * tp / n if pos else 0
        return ap if pos else None

    got = {x["mesh"]: x["ap"] for x in rows(metrics.average_precision(spark.createDataFrame(data, "mesh string, gene string, score double, y int"), "mesh"))}
    for g in {d[0] for d in data}:
        want = brute([(s, y) for a, _, s, y in data if a == g])
        assert got[g] == (None if want is None else pytest.approx(want, abs=1e-12))


def test_map_recall_edges(spark):
    gold = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "9")], "mesh string, gene string")
    p = spark.createDataFrame([("m", "a", "1", 1.0), ("m", "a", "3", 1.0), ("m", "z", "1", 5.0), ("none", "b", "8", 1.0)], "method string, mesh string, gene string, score double")
    got = {r["method"]: r for r in rows(metrics.mean_ap_recall(p, gold))}
    assert got["m"]["mean_ap"] == 0.5 and got["m"]["recall"] == pytest.approx(1 / 3)
    assert got["none"]["mean_ap"] is None and got["none"]["recall"] == 0
    assert rows(metrics.mean_ap_recall(p, gold.limit(0)))[0]["recall"] is None


@pytest.fixture(scope="module")
def ann_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("ann") / "a.jsonl"
    lines = [
        ["D1", ["1", "5"], {"1": {"paper": 2, "sentence": 3, "or_list": ["2.5", 0, -1, "nan", 10]}, "2": {"paper": 1, "or_list": []}, "3": {"sentence": 4}}],
        ["D2", ["7"], {"8": {"paper": 1}}],
        ["D3", [], {"1": {"paper": 1}}],
        ["D4", ["1"], {}],
        ["D5", ["1"], {"1": {"paper": 1, "sentence": -1}, "2": {"paper": 1, "sentence": 1, "or_list": [0.5]}}],
    ]
    path.write_text("".join(json.dumps(x) + "\n" for x in lines))
    return str(path)


def test_annotations(spark, ann_file):
    gold, pairs, ev, odds = evidence.normalized(readers.annotations(spark, ann_file))
    assert {(r["mesh"], r["gene"], r["y"]) for r in rows(evidence.labelled(gold, ev))} == {("D1", "1", 1), ("D1", "2", 0), ("D5", "1", 1), ("D5", "2", 0)}
    assert {(r["mesh"], r["gene"]) for r in rows(evidence.co_paper_gold(gold, ev))} == {("D1", "1"), ("D1", "5"), ("D5", "1")}
    lab = evidence.labelled(gold, ev)
    s = {(r["mesh"], r["gene"]): r["score"] for r in rows(evidence.feature_scores(gold, ev, {"paper+sentence": ["paper", "sentence"]}))}
    assert s == {("D1", "1"): 5, ("D1", "2"): 1, ("D5", "2"): 2}  # a sum of 0 goes
    o = {(r["mesh"], r["gene"]): r for r in rows(evidence.odds_stats(odds))}
    logs = np.log([2.5, 10])
    assert [o["D1", "1"][f"or_count_{t}"] for t in (0, 1, 5, 10)] == [2, 2, 1, 1]
    assert o["D1", "1"]["or_log_mean"] == pytest.approx(logs.mean()) and o["D1", "1"]["or_percentile_25"] == pytest.approx(np.percentile(logs, 25))
    assert rows(evidence.odds_scores(lab, odds, "or_log_mean"))[-1]["score"] is not None
    assert evidence.odds_scores(lab, odds, "unknown").count() == 0
    with pytest.raises(KeyError):
        evidence.odds_scores(lab, odds, "or_count_3")
    assert {r["method"]: r["mean_ap"] for r in rows(evidence.run_feature_methods(gold, ev, odds)[1])}["gold"] == 1.0
    m = rows(evidence.feature_matrix(gold, ev, odds, None, 2))
    assert all(len(r["x"]) == 30 for r in m) and {r["pos"] for r in m if r["y"] == 1} == {1}


def test_min_max_constant(spark):
    d = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("b", 1.0)], "m string, x double")
    assert {r["x_scaled"] for r in rows(evidence.min_max(d, ["x"], "m"))} == {0.0}


# ---- tokens, curation, embeddings


def test_token_rules(spark):
    d = spark.createDataFrame([("Gene runs running ab the Gene",  ["Gene"])], "t string, n array<string>")
    assert d.select(T.stems()(F.col("t"), F.col("n")).alias("x")).first().x == ["run", "run", "the"]
    scores = spark.createDataFrame([("D", str(g), "t49", 1) for g in range(49)] + [("D", str(g), "t50", 2) for g in range(50)] + [("X", "1", "t50", 9)], "mesh string, gene string, token string, score bigint")
    gold = spark.createDataFrame([("D", "0"), ("D", "1")], "mesh string, gene string")
    s = tokens.token_stats(scores, gold)
    assert rows(s) == [{"token": "t50", "gold_score": 4, "score": 100, "gold_dgs": 2, "dgs": 50}]
    assert rows(tokens.ranked(s))[0]["gold_score_ratio"] == "4%"
    cur = spark.createDataFrame([("t50", "1"), ("t49", "0")], "token string, value string")
    out, m = tokens.run_token_methods(scores, s, cur, gold)
    assert {r["method"] for r in rows(m)} == {"token_curated"} and out.where("mesh = 'X'").count() == 1


def test_sampling_is_stable(spark):
    e = spark.createDataFrame([("t", y, "m", str(g), str(k), "h", "r", "t") for y in (0, 1) for g in range(8 * y + 3) for k in range(3)], "token string, label int, mesh string, gene string, pmid string, h string, r string, t string")
    a, b = (sorted(map(str, rows(tokens.stratified(x, 5, 7)))) for x in (e.repartition(1), e.repartition(8)))
    assert a == b and len(a) == 3 + 5
    assert a != sorted(map(str, rows(tokens.stratified(e, 5, 8))))


def test_curation(spark, tmp_path):
    (tmp_path / "1 Main class.txt").write_text("[sub one]\nmutat,changes, in sequence\ncaus,causes\n\n[sub two]\nrisk,raises risk\n")
    (tmp_path / "12 Other.txt").write_text("[last]\nlink,is linked\n")
    c = readers.class_folder(spark, str(tmp_path))
    got = {(r["main_id"], r["main_name"], r["sub_id"], r["sub_name"], r["token"], r["explanation"]) for r in rows(c)}
    assert got == {(1, "Main class", 1, "sub one", "mutat", "changes, in sequence"), (1, "Main class", 1, "sub one", "caus", "causes"), (1, "Main class", 2, "sub two", "risk", "raises risk"), (12, "Other", 1, "last", "link", "is linked")}
    x = spark.createDataFrame([("mutat", "changes, in sequence"), ("caus", "other"), ("risk", "raises risk"), ("risk", "raises risk"), ("more", "m")], "token string, value string")
    assert {(r["token"], r["problem"]) for r in rows(curation.violations(x, c))} == {("caus", "explanation differs"), ("more", "in no class"), ("link", "without explanation"), ("risk", "explained twice")}
    s = spark.createDataFrame([("risk", 1, "D", "5", "77", "a b c")], "token string, label int, mesh string, gene string, pmid string, triplet string")
    one = rows(curation.class_samples(c, s))[0]
    assert (one["gene"], one["pmid"]) == ("GENE:5", "PMID:77") and curation.unsampled(c, s).count() == 3
    sinks.class_tree(curation.class_samples(c, s), str(tmp_path / "out"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "1 x.txt").write_text("no header\n")
    with pytest.raises(Exception, match="begin with"):
        readers.class_folder(spark, str(tmp_path / "bad")).count()


def test_pooling(spark):
    v = spark.createDataFrame([(0, [3.0, 4.0, 9.0]), (1, [0.0, 0.0, 1.0]), (2, [1.0, 1.0, 1.0])], "embedding_id bigint, embedding array<double>")
    red = {r["embedding_id"]: r["embedding"] for r in rows(embed.reduce_vectors(v, 2))}
    assert red[0] == [0.6, 0.8] and red[1] == [0.0, 0.0]
    items = spark.createDataFrame([("d", "g", "triplet", 0, 0, 5), ("d", "g", "triplet", 1, 2, 1), ("d", "g", "paper", 0, 0, 3), ("d", "g", "paper", 1, 2, 1), ("d", "g", "text", 1, 0, 0), ("d", "g", "text", 0, 2, 0)], "d string, g string, kind string, pos int, embedding_id bigint, tokens bigint")
    got = {r["kind"]: r["vector"] for r in rows(embed.pooled(items, v))}
    assert got["triplet"] == [2.0, 2.5, 5.0] and got["paper"] == [2.5, 3.25, 7.0] and got["text"] == [None] * 3 and got["one"] == [1.0] * 3
    meta = spark.createDataFrame([("t", 1, 5), ("t", 4, 6)], "text string, embedding_id bigint, tokens bigint")
    texts = spark.createDataFrame([("d", "g", "text", 0, "t", 5), ("d", "g", "text", 1, "?", 5)], "d string, g string, kind string, pos int, text string, tokens bigint")
    assert [r["embedding_id"] for r in rows(embed.text_ids(texts, meta))] == [4] and rows(embed.missing_texts(texts, meta)) == [{"text": "?"}]


# ---- rankers


@pytest.mark.parametrize("most_rows", [None, 4, 15])  # every disease small, every one large, both
def test_ridge_equals_refit(spark, monkeypatch, most_rows):
    monkeypatch.setattr(rankers, "TILE", 3)  # several tiles and levels of sums
    monkeypatch.setattr(rankers, "FAN", 2)
    r = np.random.default_rng(0)
    x, y, mesh = r.normal(size=(80, 5)) * 3 + 7, r.integers(0, 2, 80), r.choice(6, 80, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1])
    df = spark.createDataFrame([(int(m) or None, i, int(t), v.tolist()) for i, (m, t, v) in enumerate(zip(mesh, y, x))], "mesh int, gene int, y int, vector array<double>").repartition(5)
    got = {a["gene"]: a["score"] for a in rows(rankers.ridge_loo(df, most_rows=most_rows))}
    assert len(got) == 80
    for m in set(mesh):
        a, b = x[mesh != m], y[mesh != m]
        w = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + np.eye(5), (a - a.mean(0)).T @ (b - b.mean()))
        for i in np.flatnonzero(mesh == m):
            assert got[int(i)] == pytest.approx(b.mean() + (x[i] - a.mean(0)) @ w, abs=1e-9)


def test_ridge_of_one_disease_and_of_none(spark):
    one = spark.createDataFrame([(1, i, i % 2, [float(i), 1.0]) for i in range(9)], "mesh int, gene int, y int, vector array<double>")
    assert {a["score"] for a in rows(rankers.ridge_loo(one))} == {0.0} == {a["score"] for a in rows(rankers.ridge_loo(one, most_rows=3))}
    assert rows(rankers.ridge_loo(one.limit(0))) == []


def _ranking_data(spark, diseases=6, genes=60):
    r = np.random.default_rng(1)
    data = []
    for m in range(diseases):
        for g in range(genes):
            v = r.normal(size=4)
            data.append((m or None, g, int(v[0] * v[1] > 0.9), [float(a) for a in v]))
    return evidence.gold_first(spark.createDataFrame(data, "mesh int, gene int, y int, x array<double>").repartition(4))


def test_lambdamart_learns(spark, monkeypatch):
    monkeypatch.setattr(boosting, "PARTITION", 300)  # a disease or two a partition
    monkeypatch.setattr(boosting, "FAN", 2)  # histograms added in levels
    df = _ranking_data(spark).cache()
    s = rankers.lambdamart_loo(df, trees=12, rate=0.3, leaves=8, least=5, at_once=4)
    scored = s.withColumn("m", F.coalesce("mesh", F.lit(0))).drop("mesh").join(df.select(F.coalesce("mesh", F.lit(0)).alias("m"), "gene", "y"), ["m", "gene"]).cache()
    assert scored.count() == 360
    ap = lambda d: np.mean([x["ap"] for x in rows(metrics.average_precision(d, "m")) if x["ap"] is not None])
    alone = max(ap(df.select(F.coalesce("mesh", F.lit(0)).alias("m"), "y", (F.col("x")[f] * sign).alias("score"))) for f in range(4) for sign in (1, -1))
    assert ap(scored) > 0.6 > alone


def test_histogram_cuts_equal_a_search(spark, monkeypatch):
    """The first tree's cut is the best of all features and places, as plain loops find it."""
    monkeypatch.setattr(boosting, "BLOCK", 1)  # a feature a block
    df = _ranking_data(spark, 4, 30).cache()
    pdf = df.toPandas()
    pdf["mesh"] = pdf.mesh.fillna(0)
    pdf = pdf.sort_values(["mesh", "pos"])
    x = np.array(pdf.x.tolist())
    cuts = boosting.quantiles(df, 4, 16)
    bins = boosting.binned(x, cuts)
    groups = boosting._grouped(df, spark.sparkContext.broadcast(cuts), 4, "int")
    state = boosting._moved(groups, [2, None], None, "int", 0.1, 30, 4)
    got = boosting._grown(state, [2, None], 4, 16, 2, -1, 5, 1e-3)
    for fold, tree in zip((2, 0), got):
        g, h = np.zeros(len(x)), np.zeros(len(x))
        for m in set(pdf.mesh) - {fold}:
            own = (pdf.mesh == m).to_numpy()
            g[own], h[own] = boosting.lambdas(pdf.y.to_numpy(float)[own], np.zeros(own.sum()), 30)
        use = (pdf.mesh != fold).to_numpy()
        best = (0.0, None)
        for f in range(4):
            for c in range(16):
                left = use & (bins[:, f] <= c)
                right = use & ~left
                if min(left.sum(), right.sum()) >= 5:
                    gain = sum(g[p].sum() ** 2 / (h[p].sum() + 1e-3) for p in (left, right)) - g[use].sum() ** 2 / (h[use].sum() + 1e-3)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, c))
        assert tuple(tree.nodes[0][:2]) == best[1]


def test_lambdamart_of_one_disease_and_of_none(spark):
    df = _ranking_data(spark, 1, 20)
    assert {r["score"] for r in rows(rankers.lambdamart_loo(df, trees=2, least=2))} == {0.0}
    assert rows(rankers.lambdamart_loo(df.limit(0), trees=2)) == []


# ---- ranks of groups of any size


def _hot(spark):
    r = random.Random(4)
    data = [("hot" if i % 2 else random.Random(i).choice([None, "a", "b"]), i % 7 == 0, float(r.randint(0, 40)) if i % 5 else None, i) for i in range(3000)]
    return spark.createDataFrame(data, "mesh string, y boolean, value double, id int").repartition(6), data


def _wide(spark):
    return {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}


def test_running_sums_equal_a_window(spark):
    old = _wide(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df, _ = _hot(spark)
        w = Window.partitionBy("mesh").orderBy(F.desc("value"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        key = lambda d: sorted((tuple(x.values()) for x in rows(d)), key=repr)
        want = df.select("*", F.sum(F.lit(1)).over(w).alias("n"), F.sum("id").over(w).alias("s"))
        got = ranks.running(df, ["mesh"], ["-value", "id"], n=F.lit(1), s=F.col("id"))
        assert key(got) == key(want)
        assert key(ranks.numbered(df, [], ["-value", "id"], "n")) == key(df.withColumn("n", F.row_number().over(Window.orderBy(F.desc("value"), "id"))))
        assert key(ranks.first_rows(df, ["mesh"], ["value", "id"], 7)) == key(df.withColumn("_n", F.row_number().over(Window.partitionBy("mesh").orderBy("value", "id"))).where("_n <= 7").drop("_n"))
        hot = ranks.running(df, ["mesh"], ["-value", "id"], n=F.lit(1)).where("mesh = 'hot'")
        assert hot.select(F.max("n")).first()[0] == 1500
        spread = ranks.keep(df.repartitionByRange("mesh", F.desc("value"), "id").withColumn("p", F.spark_partition_id()), "t").where("mesh = 'hot'").groupBy("p").count()
        assert spread.count() > 4 and spread.agg(F.max("count")).first()[0] < 700  # the hot group lies in many tasks
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_percentiles_equal_the_aggregate(spark):
    df, _ = _hot(spark)
    got = {r["mesh"]: (r["a"], r["b"], r["c"]) for r in rows(ranks.percentiles(df, ["mesh"], "value", {"a": 0.25, "b": 0.5, "c": 1.0}))}
    want = {r["mesh"]: tuple(r["p"]) for r in rows(df.groupBy("mesh").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0))).alias("p")))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert rows(ranks.percentiles(df, [], "value", {"a": 0.3}))[0]["a"] == pytest.approx(df.agg(F.percentile("value", F.lit(0.3))).first()[0])
    assert rows(ranks.percentiles(df.where("value is null"), ["mesh"], "value", {"a": 0.3})) == []


def test_average_precision_of_a_hot_group(spark):
    r = random.Random(6)
    data = [("hot" if i % 2 else f"m{i % 9}", r.random(), int(r.random() < 0.2)) for i in range(2000)]
    got = {a["mesh"]: a["ap"] for a in rows(metrics.average_precision(spark.createDataFrame(data, "mesh string, score double, y int"), "mesh"))}
    for m in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == m), key=lambda d: -d[1])
        hits, total = 0, 0.0
        for k, d in enumerate(own, 1):
            hits += d[2]
            total += d[2] * hits / k
        assert got[m] == pytest.approx(total / hits)


# ---- sources, sinks, clients, streams


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('["77", ["h", "r", "t"], {"Dz": {"n2": 1, "n1": 2}, "Da": {"n3": 1}}, {"9": {"g": 1}}, {}]\n')
    t = rows(readers.triplets(spark, str(tmp_path / "t.jsonl")))[0]
    assert (t["pmid"], t["mesh"], t["gene"], t["names"]) == ("77", "Dz", "9", ["n2", "n1", "n3", "g"])
    (tmp_path / "s.jsonl").write_text('"a \\"b\\""\n"é"\n')
    assert rows(readers.json_strings(spark, str(tmp_path / "s.jsonl"))) == [{"text_id": 0, "text": 'a "b"'}, {"text_id": 1, "text": "é"}]
    (tmp_path / "c.csv").write_text('tok,"a ""q"", b"\nx,\n')
    assert rows(readers.delimited(spark, str(tmp_path / "c.csv"), schemas.TWO_COLUMNS)) == [{"token": "tok", "value": 'a "q", b'}, {"token": "x", "value": ""}]
    (tmp_path / "v.bin").write_bytes(struct.pack("<6d", *range(6)))
    v = readers.float64_blocks(spark, str(tmp_path / "v.bin"), 3)
    assert {r["embedding_id"]: r["embedding"] for r in rows(v)} == {0: [0, 1, 2], 1: [3, 4, 5]}
    assert bytes(rows(sinks.float64_bytes(v))[0]["embedding"]) in (struct.pack("<3d", 0, 1, 2), struct.pack("<3d", 3, 4, 5))
    with pytest.raises(Exception, match="whole number"):
        readers.float64_blocks(spark, str(tmp_path / "v.bin"), 4).collect()
    assert rows(readers.float64_blocks(spark, str(tmp_path / "v.bin"), 4, first=7, tail="drop")) == [{"embedding_id": 7, "embedding": [0.0, 1.0, 2.0, 3.0]}]
    (tmp_path / "e.bin").write_bytes(b"")
    assert rows(readers.float64_blocks(spark, str(tmp_path / "e.bin"), 4)) == []
    many = spark.createDataFrame([(i, [float(i), -float(i)]) for i in range(1000)], "id int, embedding array<float>")
    for k, append in enumerate((False, True, False)):
        sinks.float64_files(many.repartitionByRange(4, "id").sortWithinPartitions("id"), str(tmp_path / "vecs"), 2, append=append)
        back = readers.float64_blocks(spark, "file://" + str(tmp_path / "vecs"), 2, partition=16 * 100)
        assert back.count() == (2000 if append else 1000) and back.rdd.getNumPartitions() >= 10
    assert [(r["embedding_id"], r["embedding"]) for r in rows(back.orderBy("embedding_id"))] == [(i, [i, -i]) for i in range(1000)]
    with pytest.raises(Exception, match="a vector of 3"):
        sinks.float64_files(many, str(tmp_path / "bad"), 3)
    assert not [f for f in (tmp_path / "bad").iterdir() if f.suffix == ".f64"]
    d = spark.createDataFrame([("D", ["g"], {"g": {"paper": 1}}, None)], "mesh string, gold array<string>, ann map<string,map<string,bigint>>, n int")
    sinks.array_lines(d, str(tmp_path / "out"), ["mesh", "gold", "ann", "n"])
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [["D", ["g"], {"g": {"paper": 1}}, None]]
    (tmp_path / "o.jsonl").write_text('{"disease": "D", "gene": "G", "disease_name": "d", "gene_name": "g"}\n' * 3)
    n = readers.numbered_objects(spark, str(tmp_path / "o.jsonl"), schemas.DIRECT_ASK)
    assert [r["dgp_id"] for r in rows(readers.line_range(n, 2, 3))] == [2, 3]
    seen_df, seen = sinks.observed(n, "lines", n=F.count(F.lit(1)))
    seen_df.count()
    sinks.json_lines(n, str(tmp_path / "j"))
    sinks.json_lines(n, str(tmp_path / "j"), append=True)
    assert seen.get["n"] == 3 and spark.read.json(str(tmp_path / "j")).count() == 6
    sinks.predictions(spark.createDataFrame([("m", "a", "b", 1.0)], "method string, mesh string, gene string, score double"), str(tmp_path / "p"))
    sinks.ordered_csv(n, str(tmp_path / "oc"), [F.desc("dgp_id")])
    sinks.append_csv(n, str(tmp_path / "ac"))
    sinks.vectors(v, str(tmp_path / "vec"))
    assert spark.read.option("header", True).csv(str(tmp_path / "oc")).first().dgp_id == "3"


def test_questions(spark):
    pairs = spark.createDataFrame([("D", "G", "dis", "gen"), ("D", "H", "dis", "hen")], schemas.DIRECT_ASK)
    done = pairs.where("gene = 'G'")
    assert [r["text_in"] for r in rows(asking.questions(pairs, done))] == ["Does hen play a causal role in dis? Answer yes or no."]
    a = spark.createDataFrame([("D", "G", ["no"], "1"), ("D", "G", ["yes"], "2")], "disease string, gene string, text_out_list array<string>, request_end_time string")
    assert [r["score"] for r in rows(asking.answered(a))] == [1.0]


def test_quota_and_retries(spark):
    now = [0.0]
    q = model_client.Quota(2, 100, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    q.admit(60)
    q.done(60, 90)
    q.admit(10)
    q.done(10, 10)
    assert now[0] == 0
    q.admit(5)
    assert now[0] >= 60
    with pytest.raises(ValueError, match="never fits"):
        q.admit(101)
    c = model_client.Recorded({"p": ["a", "b"]}, failures=2)
    assert model_client.called(lambda: c.complete("p", 1), 3)[:2] == (["a"], 3)
    prompts = spark.createDataFrame([(1, "p"), (2, "unknown")], "dgp_id int, prompt string")
    got = {r["dgp_id"]: r for r in rows(model_client.completions(prompts, lambda: model_client.Recorded({"p": ["a", "b"]}), n=2, runs=2))}
    assert got[1]["text_out_list"] == ["a", "b"] and got[1]["error"] is None and got[2]["error"].startswith("KeyError") and got[2]["runs"] == 2
    log = spark.createDataFrame([(1, None), (2, "x")], "dgp_id int, error string")
    assert [r["dgp_id"] for r in rows(model_client.remaining(prompts, log, "dgp_id"))] == [2]
    texts = spark.createDataFrame([(0, "t")], "text_id bigint, text string")
    assert rows(model_client.embeddings(texts, lambda: model_client.Recorded({}, {"t": [1.0]})))[0]["embedding"] == [1.0]


def test_requests_in_flight():
    """Several at a time, in order, never above the quota; one too large for it gives its error."""
    lock, open_, most = threading.Lock(), [0], [0]

    def call(i):
        with lock:
            open_[0] += 1
            most[0] = max(most[0], open_[0])
        time.sleep(0.02)
        with lock:
            open_[0] -= 1
        return i * 10, 1

    got = model_client.pumped([1, 1, 99, *[1] * 20], call, model_client.Quota(100, 50), 4)
    assert [x for i, x in enumerate(got) if i != 2] == [i * 10 for i in range(23) if i != 2] and isinstance(got[2], ValueError) and 1 < most[0] <= 4


def test_log_resumes(spark, tmp_path):
    todo = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "dgp_id int, prompt string")
    path = str(tmp_path / "log")

    def call(df):
        return df.withColumn("error", F.when(F.col("dgp_id") % 5 == 0, "failed"))

    model_client.logged(todo.where("dgp_id < 10"), ["dgp_id"], call, path, 3)
    model_client.logged(todo, ["dgp_id"], call, path, 4)
    log = [(r["dgp_id"], r["error"]) for r in rows(spark.read.json(path))]
    assert sorted(i for i, e in log if e is None) == [i for i in range(20) if i % 5] and sorted(i for i, e in log if e) == [0, 0, 5, 5, 10, 15]


def test_treebank_tokens():
    """The published examples of the rules."""
    for text, want in {
        "Good muffins cost $3.88\nin New York.  Please buy me\ntwo of them.\nThanks.": "Good muffins cost $ 3.88 in New York. Please buy me two of them. Thanks .",
        "They'll save and invest more.": "They 'll save and invest more .",
        "hi, my name can't hello,": "hi , my name ca n't hello ,",
        'He said, "it\'s 5:30, isn\'t it?" (Yes) -- I cannot wait...': "He said , `` it 's 5:30 , is n't it ? '' ( Yes ) -- I can not wait ...",
        "gonna wanna go 'tis": "gon na wan na go 't is",
        "«y» Alice’s": "« y » Alice ’ s",
        "": "", " \t\n": "",
    }.items():
        assert T.words(text) == want.split(), text


def test_words_of_the_jvm(spark):
    """The column and the plain function split alike; words stemmed once count like words stemmed one by one."""
    texts = ["It's a well-known fact: don't stop... 3.5% of U.S. -- naïve café's n't", "", None, "a_b 'll \u3000x\x1cy Ünïcode-Wört/eins", "CAN'T won't it 'S"]
    r = random.Random(12)
    signs = ["a", "Bé", "can", "not", "n't", "'s", "'ll ", "'", '"', "``", ".", "...", ",", ":", "7", " ", "  ", "\n", "(", "]", "--", "?", "$", "*", "«", "’", "漢", "wanna", "'tis", "\x1d", "\u2003", "<", "{", "&"]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(1, 25))) for _ in range(800)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.w for r in d.select(T.word_list(F.col("t")).alias("w")).collect()] == [T.words(t or "") for t in texts]
    tr = spark.createDataFrame([("D", "G", t, "causes", "running dogs", ["fact"]) for t in texts], "mesh string, gene string, h string, r string, t string, names array<string>")
    want = sorted(map(tuple, tokens.pair_scores(tokens.token_triplets(tr))[0].collect()))
    assert sorted(map(tuple, tokens.stemmed_pair_scores(tr).collect())) == want


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    outputs(spark, *THREE).write.mode("append").json(str(src))
    incremental.matched_triplets(incremental.output_stream(spark, str(src)), paper(spark), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert incremental.latest(spark, str(tmp_path / "out")).where("is_match").count() == 3
    outputs(spark, "nothing", end="3").write.mode("append").json(str(src))  # a later output replaces an earlier batch's
    incremental.matched_triplets(incremental.output_stream(spark, str(src)), paper(spark), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert incremental.latest(spark, str(tmp_path / "out")).count() == 0
    path = "/root/testdata/sf0.001/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    q = incremental.event_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(path).count()


def test_outputs_merge_by_key(spark, tmp_path):
    """Late outputs change nothing, repeated ones replace, over a restart and a batch that is run again; old versions go."""
    src, target = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([], schemas.MODEL_OUTPUT).write.json(str(src))

    def run():
        q = incremental.matched_triplets(incremental.output_stream(spark, str(src)), paper(spark), target, str(tmp_path / "cp"), buckets=2)
        q.awaitTermination(60)
        assert q.exception() is None
        return incremental.latest(spark, target).count()

    ends = outputs(spark, *THREE).select(F.max("request_end_time")).first()[0]
    outputs(spark, *THREE).write.mode("append").json(str(src))
    full = run()
    assert full > 0
    outputs(spark, "nothing", end="").write.mode("append").json(str(src))  # ended before what is there
    assert run() == full
    outputs(spark, "nothing", end=ends + "1").write.mode("append").json(str(src))
    assert run() == 0
    for _ in range(3):
        outputs(spark, *THREE, end=ends + "1").write.mode("append").json(str(src))  # at once with the last: the later batch counts
        assert run() == full
    versions = list((tmp_path / "out" / "table").glob("batch=*/bucket=*"))
    assert len(versions) <= 2 * 2  # two a bucket at most
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "notes").iterdir())
    before = sorted(map(repr, rows(incremental.latest(spark, target))))
    (tmp_path / "cp" / "commits" / str(last)).unlink()  # as if the job had died before its last batch was noted
    for f in (tmp_path / "cp" / "commits").glob(f".{last}.*"):
        f.unlink()
    run()
    assert sorted(map(repr, rows(incremental.latest(spark, target)))) == before


def test_ranker_runs(spark):
    r = random.Random(8)
    cells = [(str(m), str(g), f, float(r.randint(1, 9) + (5 if g < 4 else 0))) for m in range(5) for g in range(30) for f in ("paper", "sentence", "gpt_paper")]
    ev = spark.createDataFrame(cells, "mesh string, gene string, feature string, score double")
    gold = spark.createDataFrame([(str(m), str(g)) for m in range(5) for g in range(4)] + [("9", "1")], "mesh string, gene string")
    odds = spark.createDataFrame([("0", "1", 2.0)], "mesh string, gene string, odds_ratio double")
    vec = spark.createDataFrame([(str(m), str(g), [float(g < 4), 1.0]) for m in range(4) for g in range(30)], "mesh string, gene string, vector array<double>")
    assert rows(evidence.sizes(gold)) == [{"diseases": 6, "genes": 4, "pairs": 21}]
    _, m = rankers.run_ridge(gold, ev, vec)
    assert rows(m) == [{"method": "ridge", "mean_ap": 1.0, "recall": 16 / 20}]
    out, m = rankers.run_lambdamart(gold, ev, odds, vec, 2, trees=15, leaves=4, least=5)
    assert out.count() == 150 and rows(m)[0]["recall"] == 1.0 and rows(m)[0]["mean_ap"] > 0.8
