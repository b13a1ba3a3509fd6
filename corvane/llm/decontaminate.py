"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every 7 consecutive 7-word grams the ones with the least hash are kept as fingerprints, in
documents and items alike, so two texts that share 13 consecutive words share a fingerprint at the
same place of the span. Document fingerprints are joined with item fingerprints; each hit carries
the 6 words on either side, and is extended while the words agree: it counts if 13 or more agree.
Items of fewer than 13 words are one window each: their whole word sequence is looked up among the
document's grams of that length. Words are compared by 64-bit hashes.

The documents are read once and their texts never shuffled: a row per document and its few hits are.
An index too large to broadcast is first cut to the fingerprints that some document has, found by
their keys alone; only if that, too, is too large do fingerprints go to their index entries with the
words around them.
Null texts have no words; items without words have no windows. Repeated document rows are each
judged. Items of one id count once; hits of items with a null id count as hit words, not as items.
A very long text is fingerprinted whole, within its row. Further columns change nothing; empty
tables give no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import alnum_words_of, bounded, few, keep, once, without

WINDOW, GRAM = 13, 7
SIDE = WINDOW - GRAM


def _hashed(rows: DataFrame, *names: str) -> DataFrame:
    """names, n_words and _h, the hashes of the words."""
    words = once(F.transform(alnum_words_of(F.col("text")), lambda w: F.xxhash64(w))).alias("_h")
    return rows.select(*names, words).select(*names, F.size("_h").alias("n_words"), "_h", F.size("_h").alias("_n"))


def _grams(h: str, size: int) -> Column:
    """Hashes of all grams of a size, from position 1; empty where there are too few words."""
    return F.when(F.col("_n") >= size, F.transform(F.sequence(F.lit(1), F.col("_n") - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, size)))).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(rows: DataFrame, pad: int, lengths: list[int], whole_only: bool) -> DataFrame:
    """rows with _f: array of (size, key, pos, around). size is 13 for winnowed grams, else the length of a short item.

    around: the gram's words and 6 on either side, pad beyond the ends. whole_only: short items, not all their places.
    """
    names = [c for c in rows.columns if c != "_h"]
    enough = F.col("_n") >= WINDOW
    none = F.array().cast("array<bigint>")
    d = rows.select(*names, "_h", once(F.when(enough, _grams("_h", GRAM)).otherwise(none)).alias("_g"))
    # The least of 7 in three steps: of 2, of 4, of two overlapping 4. least() passes over what lies beyond the end.
    for name, of, by in (("_m2", "_g", 1), ("_m4", "_m2", 2), ("_m7", "_m4", 3)):
        d = d.select(*names, "_h", "_g", once(F.zip_with(of, F.slice(of, by + 1, F.greatest(F.size(of) - by, F.lit(0))), lambda x, y: F.least(x, y))).alias(name))
    d = d.select(*names, "_h", "_g", once(F.slice("_m7", 1, F.greatest(F.size("_g") - SIDE, F.lit(0)))).alias("_m"))
    # The leftmost least gram of a window is another one than before where the least changes or where it just left.
    moved = lambda v, i: (F.get("_m", i - 1) != v) | (F.get("_g", i - 1) == F.get("_m", i - 1))
    least = F.transform("_m", lambda v, i: F.when(F.coalesce(moved(v, i), F.lit(True)), F.struct(v.alias("key"), (i + F.array_position(F.slice("_g", i + 1, WINDOW - GRAM + 1), v).cast("int")).alias("pos"))))
    chosen = F.filter(least, lambda x: x.isNotNull())
    edge = F.array_repeat(F.lit(pad).cast("bigint"), SIDE)
    d = d.select(*names, "_h", once(chosen).alias("_c"), once(F.concat(edge, F.col("_h"), edge)).alias("_p"))
    fp = lambda size, key, pos, around: F.struct(F.lit(size).alias("size"), key.alias("key"), pos.alias("pos"), around.alias("around"))
    parts = [F.transform("_c", lambda c: fp(WINDOW, c.key, c.pos, F.slice("_p", c.pos, WINDOW + SIDE)))]
    for size in lengths:
        if whole_only:
            parts.append(F.when(F.col("_n") == size, F.array(fp(size, F.xxhash64("_h"), F.lit(1), F.col("_h")))).otherwise(F.array().cast("array<struct<size:int,key:bigint,pos:int,around:array<bigint>>>")))
        else:
            parts.append(_short(size, fp))
    return d.select(*names, once(F.concat(*parts)).alias("_f"))


def _short(size: int, fp) -> Column:
    return F.transform(_grams("_h", size), lambda g, i: fp(size, g, i + 1, F.slice("_h", i + 1, size)))


def item_index(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """The items' fingerprints (size, key, item_id, around), and the lengths below 13 that items have."""
    hashed = keep(_hashed(items, "item_id").where("n_words > 0"), "items")
    lengths = sorted(r[0] for r in hashed.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect())
    f = _fingerprints(hashed, -2, lengths, True).select("item_id", F.explode("_f").alias("f"))
    return keep(f.select("item_id", "f.size", "f.key", F.col("f.around").alias("_ia")).distinct(), "index"), lengths


def _reach(order: list[int]) -> Column:
    """How many of the positions (0-based, in this order) agree before the first that doesn't."""
    agree = lambda i: F.get("_da", F.lit(i)) == F.get("_ia", F.lit(i))
    out = F.lit(len(order))
    for n in reversed(range(len(order))):
        out = F.when(agree(order[n]), out).otherwise(n)
    return out


def _met(index: DataFrame, named: DataFrame, lengths: list[int]) -> DataFrame:
    """The index, if it can be broadcast; else its entries that some document has, by narrow keys that are made distinct before they move."""
    if few(index):
        return index
    own = _fingerprints(_hashed(named, "_row"), -1, lengths, False).select(F.explode("_f").alias("f")).select("f.size", "f.key").distinct()
    return keep(index.join(own, ["size", "key"], "left_semi"), "met")


def judged(docs: DataFrame, items: DataFrame, *more: str) -> DataFrame:
    """doc_id, `more`, n_words, n_hit, n_items, items_sha256, contaminated: one row a document."""
    index, lengths = item_index(items)
    named = docs.select("doc_id", "text", *more, F.monotonically_increasing_id().alias("_row"))
    f = _fingerprints(_hashed(named, "_row", "doc_id", *more), -1, lengths, False)
    mark = F.array(F.struct(F.lit(0).alias("size"), F.xxhash64("_row").alias("key"), F.lit(0).alias("pos"), F.array().cast("array<bigint>").alias("around")))
    f = f.select("_row", "doc_id", *more, "n_words", F.explode(F.concat(mark, F.col("_f"))).alias("f")).select("_row", "doc_id", *more, "n_words", "f.size", "f.key", "f.pos", F.col("f.around").alias("_da"))
    met = f.join(bounded(_met(index, named, lengths)), ["size", "key"], "left").where((F.col("size") == 0) | F.col("_ia").isNotNull())
    left = F.when(F.col("size") == WINDOW, _reach(list(range(SIDE - 1, -1, -1)))).otherwise(0)
    right = F.when(F.col("size") == WINDOW, _reach(list(range(WINDOW, WINDOW + SIDE)))).otherwise(0)
    inner = F.when(F.col("size") == WINDOW, F.slice("_da", SIDE + 1, GRAM) == F.slice("_ia", SIDE + 1, GRAM)).otherwise(F.col("_da") == F.col("_ia"))
    hit = met.select("_row", "doc_id", *more, "n_words", "size", "item_id", "pos", inner.alias("same"), left.alias("l"), right.alias("r"))
    good = (F.col("size") > 0) & F.col("same") & ((F.col("size") < WINDOW) | (F.col("l") + F.col("r") >= SIDE))
    span = F.struct((F.col("pos") - F.col("l")).alias("s"), (F.col("pos") + F.when(F.col("size") == WINDOW, F.lit(GRAM) + F.col("r")).otherwise(F.col("size"))).alias("e"))
    by = hit.groupBy("_row").agg(*(F.first(c).alias(c) for c in ("doc_id", *more, "n_words")), F.collect_set(F.when(good, F.col("item_id").cast("string"))).alias("_i"), F.sort_array(F.collect_set(F.when(good, span))).alias("_s"))
    walk = F.aggregate("_s", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, x: F.struct(F.greatest(a.end, x.e).alias("end"), (a.n + F.greatest(F.lit(0), x.e - F.greatest(x.s, a.end))).alias("n"))).n
    done = by.select("doc_id", *more, F.col("n_words").cast("long").alias("n_words"), walk.cast("long").alias("n_hit"), F.size("_i").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("_i"), ","), 256).alias("items_sha256"))
    return done.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, as they were."""
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"))
    bad = judged(hashed, items, "_th").where("contaminated").select(F.col("doc_id").alias("_id"), "_th").distinct()
    return without(docs, keep(bad, "contaminated"))
