"""SimHash near copies: fingerprints, and links found by an inverted index of byte positions.

Fingerprints that differ in at most four of 64 bits differ in at most four of their eight bytes,
so they share at least four positional bytes (position, value): the guaranteed minimum. Then they
share at least three of the first seven positions, too. A posting list of one positional byte holds
a 256th of all fingerprints and would pair them all, so the index keeps its postings by three of
those seven positions at a time: a distinct fingerprint stands in 35 lists, and every pair that can
reach the minimum meets in at least one. In a list the shared positional bytes of each pair are
tallied over all eight positions; pairs below the minimum are dropped (of random ones that share
three, 49 in 50 are), each pair is left to the first list it meets in, and only then its bits are
verified.

Only distinct fingerprints are indexed, so exact copies cost nothing here. A long list gives a
spanning forest of its links, not all pairs. Lists longer than `block` are cut into blocks that are
compared two at a time in tasks of their own, so no list has to fit in one task and no candidate is
dropped.

Null text has no words: fingerprint zero, linked like any other. Repeated rows share a class.
Null doc_ids are ignored when the smallest id is sought; a class of nothing else has a null id.
A very long text is fingerprinted whole, 65536 shingles at a time. Further columns change nothing;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import arrow_batches, components, join_by_class, keep, released, without

BYTES, BITS = 8, 4
SHARED = BYTES - BITS  # bytes that linked fingerprints share at least
COMBOS = tuple(combinations(range(BYTES - 1), SHARED - 1))
_LOW7, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
#: Of each combination the high bits of its bytes, as `shared_bytes` marks them.
_MARKS = np.array([sum(1 << (8 * c + 7) for c in combo) for combo in COMBOS], np.uint64)


def fingerprint(text: str | None, size: int = 4) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only \x20 and \x09-\x0D split
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if n > size:
        starts, ends = starts[: n - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    of = xxhash.xxh64_intdigest
    h = np.array([of(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp long): text_hash tells different texts of one id apart."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str | None, int] = {}
            got = []
            for text in batch.column(2).to_pylist():
                if (fp := seen.get(text)) is None:
                    fp = seen[text] = fingerprint(text, size)
                got.append(fp)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(got, np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"])

    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(released(run), f"doc_id {kind}, text_hash long, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is zero in the exclusive or of two fingerprints."""
    return ~(((x & _LOW7) + _LOW7) | x) & _HIGH


def first_shared(marks: np.ndarray) -> np.ndarray:
    """The marks of the first three shared bytes: the list a pair is left to."""
    out = np.zeros_like(marks)
    for _ in range(SHARED - 1):
        lowest = marks & (~marks + np.uint64(1))
        out |= lowest
        marks = marks ^ lowest
    return out


def linked(x: np.ndarray, combo: np.ndarray | np.uint64) -> np.ndarray:
    """Which of the exclusive ors are links to be found in this list: enough bytes shared, by tally; the pair's first list; few bits."""
    marks = shared_bytes(x)
    out = np.bitwise_count(marks) >= SHARED
    at = np.nonzero(out)
    out[at] = (first_shared(marks[at]) == (combo if np.ndim(combo) == 0 else combo[at])) & (np.bitwise_count(x[at]) <= BITS)
    return out


def forest(fps: np.ndarray, combo: np.uint64, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked within fps, or between fps and more; at most one less than there are members."""
    both = fps if more is None else np.concatenate([fps, more])
    first, label, a, b = 0 if more is None else len(fps), np.arange(len(both)), [], []
    for lo in range(0, len(fps), 256):
        i, j = np.nonzero(linked(fps[lo : lo + 256, None] ^ both[None, first:], combo))
        i, j = i + lo, j + first
        i, j = i[i < j], j[i < j]
        rows, starts = np.unique(i, return_index=True)
        for row, near in zip(rows.tolist(), np.split(j, starts[1:])):  # one empty part if there are no rows
            other, at = np.unique(label[near], return_index=True)
            at = at[other != label[row]]
            if len(at):
                a.append(np.full(len(at), both[row]))
                b.append(both[near[at]])
                label[np.isin(label, label[near[at]])] = label[row]
    empty = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


EDGE = "a long, b long, key int, chunk int, fps binary"


def _rows(a: np.ndarray, b: np.ndarray, chunks: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Edges, then blocks of long lists."""
    e, c = len(a), len(chunks)
    signed = lambda x: pa.concat_arrays([pa.array(x.view(np.int64)), pa.nulls(c, pa.int64())])
    after = lambda values, kind: pa.concat_arrays([pa.nulls(e, kind), pa.array(values, kind)])
    return pa.RecordBatch.from_arrays([signed(a), signed(b), after([k for k, _, _ in chunks], pa.int32()), after([n for _, n, _ in chunks], pa.int32()), after([x for _, _, x in chunks], pa.binary())], ["a", "b", "key", "chunk", "fps"])


def postings(fps: DataFrame) -> DataFrame:
    """(key, fp): the 35 lists that each distinct fingerprint stands in; the key holds the combination's number and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            by = fp.astype("<i8").view(np.uint8).reshape(-1, 8).astype(np.int32)
            for n, (x, y, z) in enumerate(COMBOS):
                yield pa.RecordBatch.from_arrays([pa.array((n << 24) | (by[:, x] << 16) | (by[:, y] << 8) | by[:, z]), pa.array(fp)], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key int, fp long")


class _Lists:
    """Reads sorted (key, fp) rows: links of the lists that end, blocks of those that grow too long."""

    SMALL = 16  # up to here a list's pairs are taken by their distance in the list, all lists at once

    def __init__(self, block: int) -> None:
        self.block, self.sent = block, 0
        self.key, self.fp = np.empty(0, np.int32), np.empty(0, np.uint64)  # of the list still open

    def add(self, key: np.ndarray, fp: np.ndarray, last: bool = False) -> pa.RecordBatch | None:
        key, fp = np.concatenate([self.key, key]), np.concatenate([self.fp, fp])
        bounds = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        size, chunks, a, b = np.diff(bounds), [], [], []
        closed = len(size) - (0 if last else 1)
        for r in np.flatnonzero((size > self.SMALL) | ((np.arange(len(size)) == 0) & (self.sent > 0)) | (np.arange(len(size)) >= closed)).tolist():
            lo, hi, k = int(bounds[r]), int(bounds[r + 1]), int(key[bounds[r]]) if len(key) else 0
            while hi - lo > self.block:
                chunks.append((k, self.sent, fp[lo : lo + self.block].tobytes()))
                self.sent, lo = self.sent + 1, lo + self.block
            if r >= closed:
                self.key, self.fp = key[lo:hi], fp[lo:hi]
            elif self.sent:
                chunks.append((k, self.sent, fp[lo:hi].tobytes()))
                self.sent = 0
            elif hi - lo > self.SMALL:
                for ends, found in zip((a, b), forest(fp[lo:hi], _MARKS[k >> 24]), strict=True):
                    ends.append(found)
        small = np.repeat((size > 1) & (size <= self.SMALL) & (np.arange(len(size)) < closed), size)
        k, f = key[small], fp[small]
        i = np.arange(len(k))
        for apart in range(1, self.SMALL):
            i = i[: np.searchsorted(i, len(k) - apart)]
            i = i[k[i] == k[i + apart]]
            if not len(i):
                break
            hit = i[linked(f[i] ^ f[i + apart], _MARKS[k[i] >> 24])]
            a.append(f[hit])
            b.append(f[hit + apart])
        if last:
            self.key, self.fp = key[:0], fp[:0]
        if chunks or any(map(len, a)):
            empty = np.empty(0, np.uint64)
            return _rows(np.concatenate([empty, *a]), np.concatenate([empty, *b]), chunks)
        return None


def links(fps: DataFrame, block: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints that join whatever is linked."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Lists(block)
        for batch in batches:
            if (out := state.add(batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64))) is not None:
                yield out
        if (out := state.add(np.empty(0, np.int32), np.empty(0, np.uint64), True)) is not None:
            yield out

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, m, n, x, y in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                yield _rows(*forest(x, _MARKS[k >> 24], None if m == n else y), [])

    arrow_batches(fps.sparkSession, 20000)
    met = keep(postings(fps).repartition("key").sortWithinPartitions("key").mapInArrow(released(lists), EDGE), "links")
    found, blocks = met.where("key is null").select("a", "b"), met.where("key is not null")
    if blocks.isEmpty():
        return found
    # Each two blocks of a list meet by (list, block), so a long list's comparisons spread over tasks.
    many = blocks.groupBy("key").agg(F.max("chunk").alias("top"))
    two = many.select("key", "top", F.explode(F.sequence(F.lit(0), "top")).alias("m")).select("key", "m", F.explode(F.sequence("m", "top")).alias("n"))
    x, y = blocks.select("key", F.col("chunk").alias("m"), F.col("fps").alias("x")), blocks.select("key", F.col("chunk").alias("n"), F.col("fps").alias("y"))
    long = two.join(x, ["key", "m"]).join(y, ["key", "n"]).select("key", "m", "n", "x", "y").mapInArrow(pairs, EDGE)
    return found.unionByName(long.select("a", "b"))


def classes(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id): one row a document.

    component is the smallest fingerprint reachable, component_id the smallest doc_id.
    """
    each = keep(fingerprints(docs, size), "fingerprints")
    distinct = keep(each.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("_n")), "distinct")
    of = keep(components(links(distinct)).withColumnRenamed("node", "fp"), "roots")
    rooted = keep(of.join(distinct, "fp"), "rooted")
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("_n"))
    alone = distinct.join(of, "fp", "left_anti").select("fp", F.col("fp").alias("component"), F.col("low").alias("component_id"), F.col("_n").alias("_rows"))
    named = join_by_class(rooted.withColumnRenamed("_n", "_rows"), low, "root", rooted.count()).select("fp", F.col("root").alias("component"), "component_id", "_rows")
    return join_by_class(each, named.unionByName(alone).withColumnRenamed("_rows", "_n"), "fp", each.count())


def first_of_each(docs: DataFrame, size: int = 4) -> DataFrame:
    """The documents less all but one of each class: the one with the smallest doc_id (nulls last), then text hash.

    What goes is found among ids and hashes; the texts are only filtered, unless whole rows repeat.
    """
    return first_of(docs, classes(docs, size).select("doc_id", "text_hash", "component"))


def first_of(docs: DataFrame, of: DataFrame) -> DataFrame:
    """The same for classes found otherwise: of has doc_id, text_hash and component for each document."""
    of = keep(of, "classes")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_hash").alias("t"))
    first = of.groupBy("component").agg(F.min(order).alias("o"), F.count("*").alias("_n")).where("_n > 1")
    gone = join_by_class(of, first, "component", of.count()).where(order != F.col("o"))
    gone = keep(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).distinct(), "gone")
    left = without(docs, gone)
    again = keep(of.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id", "_th"), "again")
    if again.isEmpty():
        return left
    whole = left.select(F.struct(*left.columns).alias("_d"))
    repeated = whole.join(again, F.col("_d.doc_id").eqNullSafe(again["_id"]) & (F.xxhash64("_d.text") == again["_th"]))
    one = repeated.withColumn("_turn", F.row_number().over(Window.partitionBy("_id", "_th").orderBy(F.lit(0)))).where("_turn = 1")
    return without(left, again).unionByName(one.select("_d.*"))
