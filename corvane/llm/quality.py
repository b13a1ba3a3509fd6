"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule scores a document (higher is worse) and has a grid of cutoffs, the mildest last. Cutoffs are
chosen by stratum on labelled documents that the base rules keep. The bad ones (labels.quality = 0)
say which rules take part: those whose strictest cutoff rejects at least the share `gain` of them;
the others would spend risk for nothing. All rules that take part move together along a fixed sequence,
from their mildest cutoffs to their strictest. Each step is tested on the good documents
(labels.quality = 1), which had no say in the sequence: if any rule of the step rejects k of n of them,
the step is admitted when the exact binomial probability of k or fewer at the allowed `rate` is at most
delta / number of strata. The first step that isn't ends the sequence, so its tests need no correction
among themselves, and the last step admitted applies: with confidence 1 - delta, over all strata at
once, all rules together reject less than `rate` of a stratum's good documents. A stratum of too few
labels (with rate 0.02 and four strata: 217 good ones) admits none, and there only the base decides.

Null text has no words and fails the base. A null stratum is a stratum of its own. Repeated rows
are each judged; null doc_ids are never labelled but judged like others. A document that several
label rows call good is one trial, for the bound needs independent ones; one called both is good.
A very long text is measured whole, within its row. Empty tables give no rows, or no cutoffs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import few, keep, once, words_of

WINDOW = 8

#: Rule -> cutoffs, strictest first. The first value of each is the published rule of thumb.
GRIDS = {
    "symbols": (0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0),
    "dup_lines": (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "repeats": (0.1, 0.15, 0.2, 0.25),
    "word_length": (0.7, 0.9, 1.1, 1.3, 1.6, 2.0),
}


def stats(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, `more`, and per document n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    All of it within the row: the windows of a document are hashed, and only where some hash
    occurs twice are they sorted and their cover counted. Hashes have 64 bits and are compared
    within one document.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = docs.select("doc_id", *more, once(words_of(F.col("text"))).alias("_w"), F.expr("regexp_count(coalesce(text, ''), '[#*$%&|<>]')").cast("long").alias("n_symbols"), once(lines).alias("_l"))
    hashes = F.when(F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    d = d.select("doc_id", *more, "n_symbols", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), once(hashes).alias("_h"))
    pairs = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    keepers = [c for c in d.columns if c != "_h"]
    d = d.select(*keepers, once(pairs).alias("_s"))
    same = lambda i, j: F.coalesce(F.get("_s", i).h == F.get("_s", j).h, F.lit(False))
    twice = F.transform(F.filter("_s", lambda s, i: same(i, i - 1) | same(i, i + 1)), lambda s: s.i)
    d = d.select(*keepers, F.size("_s").alias("_n"), once(F.sort_array(twice)).alias("_p"))
    cover = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1), p + WINDOW) - p)), F.lit(0), lambda a, x: a + x)
    return d.select(*keepers, F.when(F.size("_p") > 0, cover).otherwise(0).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def scores() -> dict[str, Column]:
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    mean = per("word_chars", "n_words")
    return {"symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "word_length": F.when(mean > 0, F.abs(F.ln(mean / 5.5))).otherwise(0.0)}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ B(n, p): from the term at k downwards, exact up to double rounding.

    The terms shrink by the factor i (1-p) / ((n-i+1) p) below n p; after 4096 of them a geometric
    bound stands for the rest, which can only raise the probability, so the guarantee holds.
    """
    if not 0 < p < 1:
        raise ValueError("the rate must lie between 0 and 1")

    def lgamma1(x: Column) -> Column:  # ln x!, by Stirling's series above 15
        x = x.cast("double")
        exact = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(x, F.lit(16.0)), F.lit(1.0)).cast("int")), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))
        return F.when(x <= 15, exact).otherwise(x * F.ln(x) - x + 0.5 * F.ln(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))))

    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)
    top = lgamma1(n) - lgamma1(k) - lgamma1(n - k) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p))
    steps = F.least(k, F.lit(4096)).cast("int")
    down = F.aggregate(F.filter(F.sequence(F.lit(0), steps), lambda j: j > 0), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, j: F.struct((a.t * ratio(k - j + 1)).alias("t"), (a.s + a.t * ratio(k - j + 1)).alias("s")))
    last = ratio(k - steps)
    rest = F.when(k <= steps, F.lit(0.0)).when(last < 1, down.t * last / (1 - last)).otherwise(F.lit(1e300))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * (down.s + rest)))


#: Steps of the sequence: a rule with a shorter grid stays at its strictest cutoff.
STEPS = max(map(len, GRIDS.values()))


def cutoff(rule: str, step: int) -> float:
    """The cutoff of a rule at a step, from 0, the mildest."""
    return float(GRIDS[rule][max(0, len(GRIDS[rule]) - 1 - step)])


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good): good if any of a document's labels says so."""
    return labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"))


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", rate: float = 0.02, delta: float = 0.05, gain: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff, step, n, k): what applies in each stratum; the step rejects k of its n good documents."""
    name = F.coalesce(F.col(stratum).cast("string"), F.lit("\0")).alias("stratum")
    held = keep(measured.where(~base_failed()).select("doc_id", name, *(s.alias(r) for r, s in scores().items())).join(labelled(labels), "doc_id"), "held")
    bad = held.where("not good").groupBy("stratum").agg(*((F.count_if(F.col(r) > cutoff(r, STEPS)) >= gain * F.count("*")).alias(f"in_{r}") for r in GRIDS))
    good = held.where("good").join(bad, "stratum")
    over = lambda step: reduce(Column.__or__, (F.col(f"in_{r}") & (F.col(r) > cutoff(r, step)) for r in GRIDS))
    counts = good.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(over(i)).alias(f"k{i}") for i in range(STEPS)), *(F.first(f"in_{r}").alias(f"in_{r}") for r in GRIDS))
    strata = held.where("good").select("stratum").distinct().count()
    steps = F.posexplode(F.array(*(f"k{i}" for i in range(STEPS)))).alias("step", "k")
    long = keep(counts, "counts").select("stratum", "n", *(f"in_{r}" for r in GRIDS), steps)
    tested = long.withColumn("fine", binomial_tail(F.col("k"), F.col("n"), rate) <= delta / max(1, strata))
    upto = tested.groupBy("stratum").agg(F.coalesce(F.min(F.when(~F.col("fine"), F.col("step"))), F.lit(STEPS)).alias("_end"))
    chosen = keep(tested.join(upto, "stratum").where(F.col("step") == F.col("_end") - 1), "chosen")
    rule = lambda r: F.when(F.col(f"in_{r}"), F.struct(F.lit(r).alias("rule"), F.element_at(F.array(*(F.lit(cutoff(r, i)) for i in range(STEPS))), F.col("step") + 1).alias("cutoff")))
    each = chosen.select("stratum", F.explode(F.array_compact(F.array(*map(rule, GRIDS)))).alias("r"), "step", "n", "k")
    return each.select("stratum", "r.rule", "r.cutoff", "step", "n", "k")


def judged(measured: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured with base_failed and kept. The cutoffs come as one row a stratum; Spark broadcasts them while they are small."""
    by = chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in GRIDS))
    over = F.lit(False)
    for r, s in scores().items():
        over = over | F.coalesce(s > F.col(f"_{r}"), F.lit(False))
    both = measured.join(by, F.coalesce(measured[stratum].cast("string"), F.lit("\0")) == by["stratum"], "left")
    return both.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over).drop("stratum", *(f"_{r}" for r in GRIDS))


def rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rate: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row a document: its statistics, base_failed and kept. The texts are read once."""
    measured = keep(stats(docs, stratum), "stats")
    return judged(measured, keep(cutoffs(measured, labels, stratum, rate, delta), "cutoffs"), stratum)


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rate: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The documents that the rules keep, as they were. The statistics are computed beside each text, not joined to it.

    For the cutoffs only labelled texts are read in full, if the labels are few enough to broadcast.
    """
    known = labelled(labels)
    measured = stats(docs.join(F.broadcast(known), "doc_id", "left_semi") if few(known) else docs, stratum)
    chosen = keep(cutoffs(measured, labels, stratum, rate, delta), "cutoffs")
    beside = stats(docs.withColumn("_row", F.struct(*docs.columns)), stratum, "_row")
    return judged(beside, chosen, stratum).where("kept").select("_row.*")
