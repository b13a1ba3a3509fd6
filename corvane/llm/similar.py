"""Near copies at a stated similarity: SimHash decides which pairs are worth it, shingle sets verify them.

Texts are alike if the Jaccard similarity of their sets of 5-word shingles is `least` or more (A-Z
lowered; words, fewer than five as one shingle). Candidates come from op5's index first: texts whose
64-bit SimHash fingerprints of these sets differ in at most 4 bits, by byte positions with count
filtering. At 0.8 two fingerprints differ in 15 % of their bits, 9.7 of 64 on average, so the index
alone would lose most such pairs; they come from `BANDS` lists of `ROWS` minima of hashed shingles,
which miss a pair of similarity 0.8 once in 330,000 and nearer ones less. The texts of a list are one coarse class with its
smallest, whatever their number: a posting is two numbers, minima are aggregated before the shuffle and
a list that holds much of all postings is joined where its texts are. Then each text's shingles go to
its class once. There pairs whose 256-bit SimHash fingerprints differ in more than `FAR` bits, and
both of whose sets have SMALL shingles or more, go: of such pairs of similarity 0.8 the distance is 39
on average with a deviation of 5.7, so one in 300 million is beyond it; smaller sets, whose fingerprints
vary more, are never judged by them. The others are decided by exact intersections.
In a class of many texts each is first compared with up to `HUBS` of them; those linked
to the hub that has most links are one already, so only the others, cut into blocks, still meet each
other and these, two blocks a task. No candidate is dropped and no pair of equal texts compared.

Texts without words are alike. Null doc_ids, repeated rows and further columns are as in simhash.
A very long text is hashed whole, 4096 shingles at a time. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import arrow_batches, bounded, components, join_by_class, keep, released
from corvane.llm.simhash import first_of, links

BANDS, ROWS, FAR, SMALL = 32, 5, 72, 64
#: Hubs of a class at most, and the bytes of a set that may be one: with common.HEAVY this bounds what is broadcast to 64 MB.
HUBS, HUB_BYTES = 8, 1 << 14
_RNG = np.random.default_rng(29)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_FOLD = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _RNG.integers(0, 1 << 63, 4, dtype=np.uint64)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only \x20 and \x09-\x0D split
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if n > size:
        starts, ends = starts[: n - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:] if n else np.zeros(1, np.int64)
    of = xxhash.xxh64_intdigest
    h = np.sort(np.array([of(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def bands(h: np.ndarray) -> np.ndarray:
    """The keys of the lists of a set of shingle hashes."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for lo in range(0, len(h), 4096):
        least = np.minimum(least, ((h[lo : lo + 4096, None] ^ _FLIP) * _ODD).min(axis=0))
    keys = (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def fingerprint(h: np.ndarray) -> np.ndarray:
    """Four words of SimHash: a bit is 1 if set in over half the hashes, mixed once more."""
    ones = np.zeros(256, np.int64)
    for lo in range(0, len(h), 4096):
        mixed = (h[lo : lo + 4096, None] ^ _SEEDS) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed = np.ascontiguousarray((mixed ^ (mixed >> np.uint64(32))).astype("<u8"))
        ones += np.unpackbits(mixed.view(np.uint8).reshape(len(mixed), 32), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).view("<u8")


def short_print(h: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash that the index of byte positions takes: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 4096):
        part = np.ascontiguousarray(h[lo : lo + 4096].astype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).view("<i8")


def _postings(docs: DataFrame, size: int) -> DataFrame:
    """(tid, keys, fp): a text's hash, its lists and its 64-bit fingerprint; copies in one batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            if one:
                sets = [shingles(text, size) for text in one.values()]
                keys, prints = np.concatenate([bands(h) for h in sets]), np.concatenate([short_print(h) for h in sets])
                lists = pa.ListArray.from_arrays(np.arange(0, BANDS * len(one) + 1, BANDS, dtype=np.int32), keys.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(list(one), pa.int64()), lists, pa.array(prints)], ["tid", "keys", "fp"])

    arrow_batches(docs.sparkSession)
    return docs.select(F.xxhash64("text").alias("tid"), "text").mapInArrow(released(run), "tid long, keys array<long>, fp long")


def spanning(n: int, near, one: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Edges that join what is near: near(i, others) says which of the others, of another class so far, are near i. What is in one is joined already."""
    label, a, b = np.arange(n), [], []
    if one is not None and one.any():
        label[one] = np.argmax(one)
    for i in range(n) if one is None else np.flatnonzero(~one).tolist():
        others = np.flatnonzero(label != label[i])
        if not len(others):
            break
        hit = others[near(i, others)]
        if len(hit):
            _, first = np.unique(label[hit], return_index=True)
            a += [i] * len(first)
            b += hit[first].tolist()
            label[np.isin(label, label[hit])] = label[i]
    return a, b


def _indexed(texts: DataFrame, total: int) -> DataFrame:
    """(a, b): each text with the smallest of those whose fingerprints the index of byte positions, with its count filter, joins."""
    prints = keep(texts.groupBy("fp").agg(F.min("tid").alias("low"), F.count("*").alias("_rows")), "prints")
    of = keep(components(keep(links(prints), "near_prints")).withColumnRenamed("node", "fp"), "print_roots")
    rooted = keep(prints.join(of, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted_prints")
    least = rooted.groupBy("root").agg(F.min("low").alias("a"), F.count("*").alias("_n"))
    named = join_by_class(rooted, least, "root", rooted.count()).select("fp", "a", F.col("_rows").alias("_n"))
    return join_by_class(texts.select("fp", "tid"), named, "fp", total).select("a", F.col("tid").alias("b"))


def _coarse(texts: DataFrame) -> DataFrame:
    """(a, b): each text with the smallest of those that SimHash's index joins it to, and of every list that it shares. texts must be kept."""
    postings = texts.select(F.explode("keys").alias("key"), "tid")
    shared = postings.groupBy("key").agg(F.min("tid").alias("a"), F.max("tid").alias("z"), F.count("*").alias("_n")).where("a <> z").drop("z")
    total = texts.count()
    listed = join_by_class(postings, shared, "key", total * BANDS).select("a", F.col("tid").alias("b"))
    return keep(_indexed(texts, total).unionByName(listed).where("a <> b").distinct(), "candidates")


def packed(h: np.ndarray) -> bytes:
    """A fingerprint and the set it is of."""
    return fingerprint(h).tobytes() + h.astype("<u8").tobytes()


def linked(tids: list[int], sets: list[bytes], least: float, one: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Edges that join the texts whose sets are alike, by exact intersections; those in one are joined already."""
    h = [np.frombuffer(x, "<u8") for x in sets]
    prints, h = np.array([x[:4] for x in h]), [x[4:] for x in h]
    size = np.array([len(x) for x in h])
    flat, owner = np.concatenate(h), np.repeat(np.arange(len(h)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]

    def near(i: int, others: np.ndarray) -> np.ndarray:
        worth = np.flatnonzero((np.minimum(size[i], size[others]) < SMALL) | (np.bitwise_count(prints[others] ^ prints[i]).sum(axis=1) <= FAR))
        alike = np.zeros(len(others), bool)
        if len(worth):
            alike[worth] = shares(i, others[worth])
        return alike

    def shares(i: int, others: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(flat, h[i], "left"), np.searchsorted(flat, h[i], "right")
        many = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        shared = np.bincount(owner[at], minlength=len(h))[others]
        return shared * (1 + least) >= least * (size[i] + size[others]) - 1e-9

    a, b = spanning(len(h), near, one)
    return [tids[i] for i in a], [tids[i] for i in b]


def _near_hubs(sets: DataFrame, many: DataFrame, total: int, least: float) -> DataFrame:
    """(root, tid, bytes, set, near) of the classes in many (root, _n): near has the hubs that the text is linked to, a hub itself.

    A hub is the smallest text hash of a residue, among sets of at most HUB_BYTES; a class without such has none.
    """
    picks = sets.where(F.col("bytes") <= HUB_BYTES).groupBy("root", F.pmod(F.xxhash64("tid"), F.lit(HUBS)).alias("part")).agg(F.min("tid").alias("tid"))
    picks = keep(picks.join(many.select("root"), "root").select("root", "tid"), "hubs")
    hubs = sets.join(bounded(picks), ["root", "tid"]).groupBy("root", "tid").agg(F.first("set").alias("set")).groupBy("root").agg(F.collect_list(F.struct("tid", "set")).alias("hubs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: dict[int, list[tuple[int, np.ndarray]]] = {}
            near = []
            for n, (root, x) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if root not in of:
                    of[root] = [(h["tid"], np.frombuffer(h["set"], "<u8")[4:]) for h in batch.column(4)[n].as_py() or []]
                x = np.frombuffer(x, "<u8")[4:]
                shared = [(tid, len(h), np.count_nonzero(h[np.minimum(np.searchsorted(h, x), len(h) - 1)] == x)) for tid, h in of[root]]
                near.append([tid for tid, size, both in shared if both * (1 + least) >= least * (size + len(x)) - 1e-9])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(near, pa.list_(pa.int64()))], ["root", "tid", "bytes", "set", "near"])

    arrow_batches(sets.sparkSession)
    met = join_by_class(sets, many.join(hubs, "root", "left"), "root", total).select("root", "tid", "bytes", "set", "hubs")
    return keep(met.mapInArrow(released(run), "root long, tid long, bytes long, set binary, near array<long>"), "near")


def _dealt(near: DataFrame, total: int, blocks) -> DataFrame:
    """(root, i, j, tid, set, one): the groups (i, j) in which what is not yet one by its hub meets all of its class."""
    each = near.select("root", F.explode_outer("near").alias("hub")).groupBy("root", "hub").agg(F.count("*").alias("n"))
    best = each.groupBy("root").agg(F.max_by("hub", F.struct(F.col("hub").isNotNull(), "n", "hub")).alias("hub"))
    best = best.join(near.groupBy("root").agg(F.count("*").alias("_n")), "root")
    split = keep(join_by_class(near, best, "root", total).select("root", "tid", "bytes", "set", F.coalesce(F.array_contains("near", F.col("hub")), F.lit(False)).alias("one")), "split")
    per = split.groupBy("root").agg(blocks(~F.col("one")).alias("k"), blocks(F.col("one")).alias("m"), F.count("*").alias("_n"))
    placed = join_by_class(split, per, "root", total).where("k > 0").withColumn("at", F.pmod(F.xxhash64("tid"), F.when(F.col("one"), F.col("m")).otherwise(F.col("k"))).cast("int"))
    upto = lambda n: F.filter(F.sequence(F.lit(-1), n - 1), lambda x: x >= 0)
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    k, m, at = F.col("k"), F.col("m"), F.col("at")
    others = F.filter(upto(k), lambda x: (x != at) | ((k == 1) & (m == 0)))
    free = F.concat(F.transform(others, lambda x: pair(F.least(x, at), F.greatest(x, at))), F.transform(upto(m), lambda y: pair(at, k + y)))
    held = F.transform(upto(k), lambda x: pair(x, k + at))
    return placed.select("root", "tid", "set", "one", F.explode(F.when(F.col("one"), held).otherwise(free)).alias("_g")).select("root", "_g.i", "_g.j", "tid", "set", "one")


def near_classes(docs: DataFrame, size: int = 5, least: float = 0.8, texts: int = 2048, set_bytes: int = 1 << 26) -> DataFrame:
    """(doc_id, text_hash, component): component is a text hash of the class. Coarse classes of more texts, or bytes of shingles, are cut into blocks."""
    kind = dict(docs.dtypes)["doc_id"]
    each = keep(docs.select("doc_id", F.xxhash64("text").alias("text_hash")), "each")
    coarse = keep(components(_coarse(keep(_postings(docs, size), "postings"))).withColumnRenamed("node", "text_hash"), "coarse")
    one = keep(each.groupBy("text_hash").agg(F.min("doc_id").alias("_id"), F.count("*").alias("_n")), "texts")
    members = keep(one.join(coarse, "text_hash").select("_id", F.col("text_hash").alias("_th"), "root"), "members")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [packed(shingles(t, size)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.binary())], ["root", "tid", "bytes", "set"])

    arrow_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"), "text")
    met = own.join(bounded(members), F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")))
    sets = keep(met.select("root", F.col("_t").alias("tid"), "text").mapInArrow(released(cut), "root long, tid long, bytes long, set binary"), "sets")
    total = sets.count()

    def blocks(which):  # a class of some hundred texts is cut, too, into up to 16 blocks, so that it doesn't stay in one task
        n, b = F.count_if(which), F.coalesce(F.sum(F.when(which, F.col("bytes"))), F.lit(0))
        return F.greatest(F.ceil(n / texts), F.ceil(b / set_bytes), F.least(F.lit(16), F.ceil(8 * n / texts))).cast("int")

    per = keep(sets.groupBy("root").agg(blocks(F.lit(True)).alias("k"), F.count("*").alias("_n")), "sizes")
    none = F.lit(0)
    dealt = join_by_class(sets, per.where("k = 1"), "root", total).select("root", none.alias("i"), none.alias("j"), "tid", "set", F.lit(False).alias("one"))
    links = None
    if not per.where("k > 1").isEmpty():
        near = _near_hubs(sets, per.where("k > 1").select("root", "_n"), total, least)
        links = near.select(F.explode("near").alias("a"), F.col("tid").alias("b"))
        dealt = dealt.unionByName(_dealt(near, total, blocks))

    def exact(t: pa.Table) -> pa.Table:
        a, b = linked(t.column("tid").to_pylist(), t.column("set").to_pylist(), least, t.column("one").to_numpy())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    more = dealt.groupBy("root", "i", "j").applyInArrow(exact, "a long, b long")
    found = keep(components(keep(more if links is None else more.unionByName(links), "links")), "classes")
    named = one.join(found, F.col("text_hash") == F.col("node"), "left").select("text_hash", "_n", F.coalesce("root", "text_hash").alias("component"))
    return join_by_class(each, named, "text_hash", each.count()).select(F.col("doc_id").cast(kind).alias("doc_id"), "text_hash", "component")


def first_of_near(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """The documents less all but one of each class: the one with the smallest doc_id (nulls last), then text hash."""
    return first_of(docs, near_classes(docs, size, least))
