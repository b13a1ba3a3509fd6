"""URL filters: prefix rules, and naive Bayes over segmented host words and path tokens.

Host labels are split into words by the Viterbi path of a unigram model. Its vocabulary is learned
from the corpus: words of three letters or more that stand alone, as a host label or a path word,
under at least `fewest` hosts and in `share` of all (host, word) pairs, so there are at most
1 / share of them, whatever the corpus; a hot host counts each word once. Seeds and some plain words
are added. A page is weakly labelled "block" if a segmented host or path word is a block seed, else
"allow"; the counts of the tokens of all pages, by label, make a multinomial naive Bayes model, to
which each seed adds one page. The counts are a table, a row a token, joined to the pages' tokens
(where they are, for tokens that many pages have), so no token shares its counts with another and the
model may grow with the corpus. Tokens are segmented host words and path words; digits count as one
token. Odds of exactly one, a tie, allow.

The weak labels come from the seeds, so the model generalizes as far as words keep company: it
learns which other words pages with seeds have.

A null url, or one without ://, has an empty host and path, no rule, and the model's verdict on no
tokens. Repeated rows are each judged; null page_ids are kept. A very long url is read whole. Further
columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LETTERS_LOW, LETTERS_UP, arrow_batches, join_by_class, keep

# The rules (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

# Words that mark a host as unwanted.
BLOCK_SEEDS = "spam farm casino poker bet bets betting gambling slots jackpot lottery win porn sex xxx adult nude cams escort pills pharma viagra cialis drugs ads adserver track tracker tracking clickbait popup malware virus phishing warez crack keygen torrent loan loans payday cheap replica fake hack cheats".split()

# Words for the segmentation that mark nothing, among them those that hold a seed.
PLAIN_WORDS = "the and for of in on to my our your best top new free news blog shop store online web site page home world life daily times post press media book books read library school college science research health doctor city travel hotel food recipe music film photo art design game games sport sports team club code cloud data tech digital mobile app apps group global network forum wiki help guide learn kids family garden house green blue red box hub lab labs live tv radio video mail chat store market trade bank money work job jobs law public open source project test example dev api docs static cdn img www adults pharmacy essex sussex middlesex better alphabet between".split()

LEXICON = frozenset((*BLOCK_SEEDS, *PLAIN_WORDS))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), LETTERS_UP, LETTERS_LOW)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def viterbi(label: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The cheapest split of a label into words; a stretch without words costs `unknown` and more for each letter."""
    longest, n = max(map(len, cost), default=1), len(label)
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, n + 1):
        known = [(best[i][0] + cost[w], i) for i in range(max(0, j - longest), j) if (w := label[i:j]) in cost]
        best.append(min([*known, (best[j - 1][0] + unknown, j - 1)]))
    words, j, loose = [], n, ""
    while j:
        i = best[j][1]
        if label[i:j] in cost:
            words += [loose] * bool(loose) + [label[i:j]]
            loose = ""
        else:
            loose = label[i:j] + loose
        j = i
    return [*words, *[loose] * bool(loose)][::-1]


def costs(counts: dict[str, int]) -> tuple[dict[str, float], float]:
    """-log probability of each word, and of one letter outside of any."""
    words = {**counts, **{w: 1 + counts.get(w, 0) for w in LEXICON}}
    total = sum(words.values()) + 1
    least = max(-math.log(n / total) for n in words.values())
    return {w: -math.log(n / total) for w, n in words.items()}, max(least, 6.0)


def segmenter(counts: dict[str, int]):
    cost, unknown = costs(counts)

    @lru_cache(1 << 16)
    def of(label: str) -> tuple[str, ...]:
        return tuple(w for part in re.findall("[a-z]+|[0-9]+|[^a-z0-9-]+", label) for w in (viterbi(part, cost, unknown) if part.isalpha() else ["#" if part.isdigit() else part]))

    return of


def tokens(host: str, path: str, segment) -> list[str]:
    """h: words of the host less its last label; p: words of the path."""
    labels = host.rsplit(".", 1)[0].split(".") if "." in host else [host]
    return ["h:" + w for x in labels if x for w in segment(x)] + ["p:" + ("#" if w.isdigit() else w) for w in re.findall("[a-z]+|[0-9]+", path.lower())]


def is_seeded(found: list[str]) -> bool:
    return any(t[2:] in _SEEDS for t in found)


_SEEDS = frozenset(BLOCK_SEEDS)


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


def standing_alone(pages: DataFrame, share: float = 1 / 50_000, fewest: int = 3) -> dict[str, int]:
    """Under how many hosts each word of the lexicon, or met often enough, is a host label or a path word of its own."""
    host = F.regexp_replace("host", "[.][^.]*$", "")
    parts = F.filter(F.split(F.concat_ws("/", host, F.lower("path")), "[^a-z]+"), lambda w: F.length(w) >= 3)
    pairs = _pages(pages).select("host", F.explode(F.array_distinct(parts)).alias("w")).distinct()
    counts = keep(pairs.groupBy("w").count(), "words")
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") >= max(fewest, share * total)
    return dict(map(tuple, counts.where(often | F.col("w").isin(sorted(LEXICON))).collect()))  # at most 1 / share words and the lexicon


def segmented(pages: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(row, page_id, host, path, words, tokens, seeded): every page's tokens, and whether a seed is among them."""
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = segmenter(counts)
        for batch in batches:
            found = [tokens(h, p, segment) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            words = pa.array([[t[2:] for t in f if t[0] == "h"] for f in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, words, pa.array(found, pa.list_(pa.string())), pa.array([is_seeded(f) for f in found], pa.bool_())], ["row", "page_id", "host", "path", "words", "tokens", "seeded"])

    arrow_batches(pages.sparkSession)
    rows = _pages(pages).select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path")
    return keep(rows.mapInArrow(run, f"row long, page_id {kind}, host string, path string, words array<string>, tokens array<string>, seeded boolean"), "segmented")


def model(found: DataFrame, alpha: float = 0.5) -> tuple[float, DataFrame, int]:
    """The log odds of "block" before any token, those of each token (token, odds, _n: how often it is met), and how many tokens there are in all."""
    spark = found.sparkSession
    seeds = spark.createDataFrame([("h:" + w, label) for label, words in ((1, BLOCK_SEEDS), (0, PLAIN_WORDS)) for w in words], "token string, label int")
    each = found.select(F.explode("tokens").alias("token"), F.col("seeded").cast("int").alias("label")).unionByName(seeds)
    counted = keep(each.groupBy("token").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")), "tokens")
    sums = counted.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count("*").alias("v")).first()
    pages = found.agg(F.count_if("seeded").alias("n1"), F.count_if(~F.col("seeded")).alias("n0")).first()
    share = lambda c: F.ln((F.col(c) + alpha) / (sums[c] + alpha * sums["v"]))
    odds = counted.select("token", (share("n1") - share("n0")).alias("odds"), (F.col("n1") + F.col("n0")).alias("_n"))
    return math.log((pages["n1"] + len(BLOCK_SEEDS)) / (pages["n0"] + len(PLAIN_WORDS))), odds, sums["n1"] + sums["n0"]


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, words, odds, rule, verdict)."""
    found = segmented(pages, standing_alone(pages))
    prior, odds, total = model(found)
    met = join_by_class(found.select("row", F.explode("tokens").alias("token")), odds, "token", total).groupBy("row").agg(F.sum("odds").alias("_sum"))
    done = found.join(met, "row", "left").withColumn("odds", F.round(F.lit(prior) + F.coalesce("_sum", F.lit(0.0)), 9))  # sums run in any order
    by = rule_of(F.col("host"), F.col("path"), rules)
    return done.withColumn("_r", by).select("page_id", "host", "path", "words", "odds", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", F.when(F.col("odds") > 0, "block").otherwise("allow")).alias("verdict"))
