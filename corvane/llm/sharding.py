"""Sharding by a k-d tree: leaves of equal bytes, split at distributed weighted medians.

Each document is a point (source, language, length, text hash), each dimension scaled to 16 bits.
From the root, a node that must give n leaves is split along its widest dimension at the place
that leaves floor(n/2)/n of its bytes on the left, until every node is one leaf. The place is found
in a 63-bit order: the dimension's value, then a hash of text, id and a stored row number, so
documents that agree in all metadata (a hot source, a group of copies, repeated rows) are split like
others: the law is `bytes`, and a group of equal texts is a group that must not fill a shard, so it
is spread over as many as its bytes need. The place is found by refining a histogram of each node,
all nodes of a level at once, until the bin holds less than `tolerance` of a leaf or one key; the
histograms are aggregated before they are shuffled, and the nodes of a level share 2^16 bins, eight
a node at least, so the sums that reach the driver grow with the shards alone. Texts are read once,
for size and hash; what is split after that is a narrow table in the shared folder.

Slots are gapless prefix sums: the rows of a shard in each partition are counted, the counts are
summed up over the partitions, and each partition numbers its own rows.

Null text has no bytes (size 16, crc of nothing). Null metadata is a value like another. Null ids and
repeated rows are placed one by one, since the row number tells them apart. A very long text counts
by its bytes; one above a shard's share makes its shard too large, for texts aren't cut. Further
columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import bounded, keep, once

BINS = 16  # bits of a level's histograms, all nodes together


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions _d0.._d3 (0 to 65535) and _tie, which the row's number enters: to be written before use."""
    text = F.coalesce("text", F.lit(""))
    named = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(65536)).cast("int") if c in docs.columns else F.lit(0)
    size = (F.octet_length(text) + 16).cast("bigint")
    long = F.least(F.lit(65535), F.floor(F.log2(size.cast("double")) * 2048)).cast("int")
    same = F.pmod(F.xxhash64("text"), F.lit(65536)).cast("int")
    return docs.select("doc_id", size.alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), named("source").alias("_d0"), named("lang").alias("_d1"), long.alias("_d2"), same.alias("_d3"), F.pmod(F.xxhash64("text", "doc_id", F.monotonically_increasing_id()), F.lit(1 << 47)).alias("_tie"))


DIMS = ("_d0", "_d1", "_d2", "_d3")


def _of(values: list[int | None], kind: str = "bigint") -> Column:
    """The value that belongs to the row's node: a literal array, as long as the tree has nodes."""
    return F.get(F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>"), F.col("_node"))


def _order(dim: Column) -> Column:
    """63 bits: the value along dimension number dim, then the tie."""
    return F.shiftleft(F.get(F.array(*DIMS), dim).cast("bigint"), 47).bitwiseOR(F.col("_tie"))


def tree(pts: DataFrame, leaves: int, tolerance: float = 0.001) -> list[dict]:
    """The splits in order: {id, dim, cut, left, right, n}; a row of node id goes left if its key is below cut. Leaves are negative ids: -1 - shard."""
    total = pts.agg(F.sum("size")).first()[0] or 0
    near = max(1.0, tolerance * total / leaves)
    splits: list[dict] = []
    level, next_id, next_leaf = [{"id": 0, "n": leaves}], 1, 0
    while level := [x for x in level if x["n"] > 1]:
        at = assigned(pts, splits).where(F.col("_node").isin([x["id"] for x in level]))
        wide = {r[0]: r for r in at.groupBy("_node").agg(*(F.max(d) - F.min(d) for d in DIMS), F.sum("size")).collect()}
        for x in level:
            r = wide.get(x["id"], (x["id"], 0, 0, 0, 0, 0))
            x |= {"dim": max(range(len(DIMS)), key=lambda d: r[1 + d]), "want": (r[5] or 0) * (x["n"] // 2) / x["n"], "low": 0, "bits": 63, "below": 0}
        keyed = at.select("_node", once(_order(_of(_by_id(level, "dim", next_id), "int"))).alias("_k"), "size")
        todo = list(level)
        while todo:
            step = max(3, BINS - (len(todo) - 1).bit_length())
            width = {x["id"]: max(0, x["bits"] - step) for x in todo}
            low, bits = _by_id(todo, "low", next_id), _by_id(todo, "bits", next_id)
            parts = keyed.select("_node", "size", "_k", once(_of(low)).alias("_low"), once(_of(bits, "int")).alias("_bits"), once(_of([width.get(i) for i in range(next_id)], "int")).alias("_width"))
            bin_ = F.expr("CASE WHEN shiftright(_k, _bits) = shiftright(_low, _bits) THEN shiftright(_k - _low, _width) END")
            sums: dict[int, list] = {x["id"]: [] for x in todo}
            for node, b, s in parts.select("_node", bin_.alias("_b"), "size").where("_b is not null").groupBy("_node", "_b").agg(F.sum("size")).collect():
                sums[node].append((b, s))
            left = []
            for x in todo:
                have = x["below"]
                for b, s in sorted(sums[x["id"]]):
                    if have + s > x["want"]:
                        break
                    have += s
                else:
                    b, s = (1 << (x["bits"] - width[x["id"]])), 0
                x |= {"low": min(x["low"] + (b << width[x["id"]]), (1 << 63) - 1), "bits": width[x["id"]], "below": have}
                if s > near and x["bits"] > 0:
                    left.append(x)
                elif s and x["bits"] == 0 and x["want"] - have > s / 2:
                    x["low"] += 1
            todo = left
        after = []
        for x in level:
            halves = []
            for n in (x["n"] // 2, x["n"] - x["n"] // 2):
                if n == 1:
                    halves.append(-1 - next_leaf)
                    next_leaf += 1
                else:
                    after.append({"id": next_id, "n": n})
                    halves.append(next_id)
                    next_id += 1
            splits.append({"id": x["id"], "dim": x["dim"], "cut": x["low"], "left": halves[0], "right": halves[1], "n": x["n"]})
        level = after
    return splits


def _by_id(nodes: list[dict], name: str, size: int) -> list[int | None]:
    got = {x["id"]: x[name] for x in nodes}
    return [got.get(i) for i in range(size)]


def assigned(pts: DataFrame, splits: list[dict]) -> DataFrame:
    """pts with _node: one step a level of the tree, each looking up its row's split."""
    out, size = pts.withColumn("_node", F.lit(0)), max([x["id"] for x in splits], default=-1) + 1
    deep, depth = {0: 1}, 0
    for x in splits:
        depth = max(depth, deep[x["id"]])
        deep |= {x["left"]: deep[x["id"]] + 1, x["right"]: deep[x["id"]] + 1}
    dim, cut, left, right = (_by_id(splits, n, size) for n in ("dim", "cut", "left", "right"))
    for _ in range(depth):
        to = F.when(_order(_of(dim, "int")) < _of(cut), _of(left, "int")).otherwise(_of(right, "int"))
        out = out.withColumn("_node", once(F.when(F.col("_node") < 0, F.col("_node")).otherwise(F.coalesce(to, F.col("_node")))))
    return out


def shards(docs: DataFrame, count: int = 40, tolerance: float = 0.001) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of nearly equal bytes."""
    pts = keep(points(docs), "points")
    placed = keep(assigned(pts, tree(pts, count, tolerance)).select("doc_id", "size", "text_crc32", (-1 - F.col("_node")).alias("shard") if count > 1 else F.lit(0).alias("shard"), F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_n")), "placed")
    counts = placed.groupBy("shard", "_pid").agg(F.count("*").alias("_c"))
    before = counts.select("shard", "_pid", (F.sum("_c").over(Window.partitionBy("shard").orderBy("_pid")) - F.col("_c")).alias("_from"))
    own = F.row_number().over(Window.partitionBy("shard", "_pid").orderBy("_n")) - 1
    numbered = placed.withColumn("_own", own).join(bounded(keep(before, "before")), ["shard", "_pid"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("_from") + F.col("_own")).cast("bigint").alias("slot"))
