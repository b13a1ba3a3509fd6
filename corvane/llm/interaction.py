"""Filter interaction audit: what each of five filters removes at each place of every order.

Failure conditions: A few words, B few distinct words, C many capitals, D a mark, E the text of a
smaller doc_id anywhere in the table. A to D are told from the row. For E each task chains the texts
it reads by their xxhash: of equal texts it keeps the smallest id, once, with the counts of its rows,
and settles the others at once, so a text that holds a third of all rows leaves a task as one row.
The kept ones are routed by xxhash and sorted by (hash, id); the chain of one hash at a time, full
texts and smallest ids, tells which ids are not the smallest. Texts are compared, not only hashes.

All filters together are a mask of five bits a row, and every figure follows from how many rows of a
part have each mask, so orders are never run: masks are counted as vectors of 128 cells (mask, good,
toxic), combined by part within the tasks first, and a part's vector becomes its 600 rows.

Null text counts as empty, null lang as the part ''. A row without doc_id is never smaller than any
other and has none smaller, so it passes E and marks nobody; no label belongs to it. Repeated rows of
one id and text are judged alike and each counted. Several label rows of a document count as one
that is good, or toxic, if any is. Very long texts go through whole; further columns are not read.
An empty table gives no rows. doc_id must be an integer.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"

#: Bytes of text that a task chains before it passes on what it has, and bytes of all texts a partition that they are routed to.
HELD, ROUTED = 32 << 20, 64 << 20

_MARK = re.compile("[#$%&*|]")
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failed(text: str) -> int:
    """The bits of A to D that the text fails."""
    raw = text.encode()
    words = raw.split()  # of bytes, splits at \x20 and \x09-\x0D only
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * len(text)) << 2 | (_MARK.search(text) is not None) << 3


def settled(doc_id: int | None, part: str, mask: int, n: int = 1) -> tuple:
    """Rows that need no text any more; they are routed by their id, so the copies of one text spread."""
    return (xxhash.xxh64_intdigest(str(doc_id)), -1 if doc_id is None else doc_id), (doc_id, None, [(part, mask, n)])


def chained(rows: Iterator) -> Iterator[tuple]:
    """((hash, id), (doc_id, text or None, [(part, mask, n)])) of rows (doc_id, part, text): a text once, until HELD bytes are held."""
    chains: dict[int, list] = {}
    held = 0

    def passed_on() -> Iterator[tuple]:
        for fingerprint, chain in chains.items():
            for text, doc_id, cells in chain:
                yield (fingerprint, doc_id), (doc_id, text, [(*cell, n) for cell, n in cells.items()])
        chains.clear()

    for doc_id, part, text in rows:
        cell = (part, failed(text))
        if doc_id is None:
            yield settled(None, *cell)
            continue
        chain = chains.setdefault(xxhash.xxh64_intdigest(text.encode()), [])
        entry = next((e for e in chain if e[0] == text), None)
        if entry is None:
            chain.append([text, doc_id, {cell: 1}])
            held += len(text) + 200
            if held > HELD:
                yield from passed_on()
                held = 0
        elif doc_id > entry[1]:
            yield settled(doc_id, part, cell[1] | 16)
        elif doc_id == entry[1]:
            entry[2][cell] = entry[2].get(cell, 0) + 1
        else:
            for (its_part, mask), n in entry[2].items():
                yield settled(entry[1], its_part, mask | 16, n)
            entry[1:] = doc_id, {cell: 1}
    yield from passed_on()


def judged(rows: Iterator) -> Iterator[tuple]:
    """(doc_id, part, mask, n) of what chained gives, sorted by (hash, id): the first of a text has its smallest id."""
    now, chain = None, []
    for (fingerprint, _), (doc_id, text, cells) in rows:
        later = 0
        if text is not None:
            if fingerprint != now:
                now, chain = fingerprint, []
            first = next((i for t, i in chain if t == text), None)
            if first is None:
                chain.append((text, doc_id))
            later = 16 if first is not None and doc_id > first else 0
        for part, mask, n in cells:
            yield doc_id, part, mask | later, n


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): the bits of the filters that fail, counted by document."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).rdd
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(size // ROUTED, int(spark.conf.get("spark.sql.shuffle.partitions")))
    routed = rows.mapPartitions(chained).repartitionAndSortWithinPartitions(parts, lambda key: key[0] % parts)
    return spark.createDataFrame(routed.mapPartitions(judged), "doc_id long, part string, mask int, n long")


def report(part: str, cells: np.ndarray) -> Iterator[tuple]:
    """The 600 rows of a part, from its counts by (mask, good, toxic)."""
    by = cells.reshape(32, 2, 2)
    n, good, toxic = by.sum((1, 2)), by[:, 1].sum(1), by[:, :, 1].sum(1)
    fails = {f: np.array([m >> i & 1 == 1 for m in range(32)]) for i, f in enumerate(FILTERS)}
    only = {f: int(n[1 << i]) for i, f in enumerate(FILTERS)}
    lines, total = [], dict.fromkeys(FILTERS, 0)
    for order in itertools.permutations(FILTERS):
        left = np.ones(32, bool)
        for step, f in enumerate(order, 1):
            here, before = left & fails[f], ~left & fails[f]
            left = left & ~fails[f]
            removed = int(n[here].sum())
            total[f] += removed
            lines.append((f, "".join(order), step, int(n[left].sum()), removed, int(n[before].sum()), only[f], int(good[here].sum()), int(toxic[here].sum())))
    for f, *line in lines:
        yield (part, *line, total[f])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(flag("quality"), flag("toxic"))
    counted = masks(docs).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(known, F.col("doc_id") == F.col("_id"), "left")
    cell = F.col("mask") * 4 + F.coalesce("quality", F.lit(0)) * 2 + F.coalesce("toxic", F.lit(0))

    def with_(vector: np.ndarray, item: tuple[int, int]) -> np.ndarray:
        vector[item[0]] += item[1]
        return vector

    pairs = counted.select("part", cell.cast("int"), "n").rdd.map(lambda r: (r[0], (r[1], r[2])))
    vectors = pairs.combineByKey(lambda item: with_(np.zeros(128, np.int64), item), with_, lambda a, b: a + b)
    numbers = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda kv: report(*kv)), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in numbers))
