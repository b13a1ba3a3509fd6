"""Substring dedup: a merged count-min sketch picks windows that may repeat, an exact pass decides.

Texts are packed into blocks of a few MB in a table bucketed by block, so nothing after that moves
a text. Each block hashes its windows of `size` words. Pass 1: a block's partial sketch is the set
of cells its windows fall in, by sketch row; the cells are cut into slices, a slice of all blocks'
sketches is merged in one task, and each block gets back which of its cells more than one block
counted. The width follows the number of windows, so the sketch is as sharp for any input, and no
task or driver ever holds all of it. Counts can only be too high, so no repeated window is lost.
Pass 2: windows whose cells all say so go, once a block with the smallest doc_id there, to exact
groups by their 96-bit hash; a group tells each block which windows also start in a smaller doc_id
elsewhere. Pass 3: the block adds what repeats within itself and removes the covered words.

Messages are as many as blocks times slices, what a shuffle of the cells would have in blocks: 4 MB
of text and 2^25 cells a side keep them above a hundred cells up to some 350 GB, and above ten up to
3.5 TB. For more give larger blocks and slices (`block_bytes`, `slice_bits`), as the executors'
memory allows: a cell of a slice takes a byte, a block some twenty times its text.

doc_id must be of an integer type. Null text has no words. Rows with a null doc_id are kept whole and
own nothing. Rows that share a doc_id don't remove each other's words. A very long text makes a block
of its own size. Further columns change nothing; empty tables give no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corvane.llm.common import arrow_batches, drop_at_exit, keep, released, shared_dir

_RNG = np.random.default_rng(13)
_MULT = [_RNG.integers(0, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_SEEDS = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def squeezed(*columns: np.ndarray) -> bytes:
    """Numbers of a width each, byte by byte across the rows, then zstandard."""
    import zstandard

    planes = b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueezed(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        w = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).reshape(n))
        at += n * w
    return out


def gaps(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first from 0."""
    return np.diff(x, prepend=x.dtype.type(0))


def distinct(x: np.ndarray) -> np.ndarray:
    """The values in order, once each; sorting beats np.unique here by far."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))[: len(x)]]


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many equal ranges each hash lies in; parts < 2^32."""
    return ((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


class Block:
    """The windows of a block's documents; documents with an id only, in order of the id."""

    def __init__(self, ids: list, texts: list, size: int) -> None:
        import xxhash

        self.ids, self.size = ids, size
        self.words = [(t or "").encode().split() for t in texts]  # bytes: split at \x20 and \x09-\x0D only
        n = np.fromiter(map(len, self.words), np.int64, len(ids))
        self.first = np.concatenate(([0], np.cumsum(n)))
        coded = pa.array([w for ws in self.words for w in ws], pa.binary()).dictionary_encode()
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist()), "<u8").reshape(-1, 2)
        codes = coded.indices.to_numpy()
        many = np.where([i is None for i in ids], 0, np.maximum(n - size + 1, 0)).astype(np.int64)
        self.doc = np.repeat(np.arange(len(ids)), many)
        self.at = np.arange(len(self.doc)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[:-1], many)
        sums = []
        for row, mult in enumerate(_MULT):
            column = digest[:, row][codes] if len(codes) else np.empty(0, np.uint64)
            total = np.zeros(max(0, len(codes) - size + 1), np.uint64)
            for k in range(size):
                total += column[k : k + len(total)] * mult[k]
            sums.append(mixed(total)[self.at] if len(self.at) else np.empty(0, np.uint64))
        self.hash, self.check = sums[0], (sums[1] >> np.uint64(32)).astype(np.uint32)
        self.doc_id = np.array([i if i is not None else 0 for i in ids], np.int64)[self.doc]

    def cells(self, row: int, slices: int, within: int) -> np.ndarray:
        """The windows' cells in a sketch row of so many slices of 2^within cells."""
        x = mixed(self.hash ^ _SEEDS[row])
        return (_part(x, slices) << np.uint64(within)) | (x & np.uint64((1 << within) - 1))

    def groups(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, group): the given windows, which must ascend, by hash, then doc_id; group numbers along that order.

        Windows lie in order of their doc_id, so a stable sort by hash will do, unless two hashes agree in
        their first 64 bits alone.
        """
        order = of[np.argsort(self.hash[of], kind="stable")]
        h, c = self.hash[order], self.check[order]
        if ((h[1:] == h[:-1]) & (c[1:] != c[:-1])).any():
            order = of[np.lexsort((self.doc_id[of], self.check[of], self.hash[of]))]
            h, c = self.hash[order], self.check[order]
        return order, np.cumsum(np.concatenate(([False], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))))[: len(order)]


def blocks(docs: DataFrame, size: int, block_bytes: int) -> DataFrame:
    """The table (block, n_windows, docs): packed documents, bucketed by block."""
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be of an integer type, for windows belong to the smallest one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        import zstandard

        pid, k, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def full() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
            t = pa.table({"id": pa.array([ids[i] for i in order], pa.int64()), "text": pa.array([texts[i] for i in order], pa.string())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
            many = sum(max(0, len((x or "").encode().split()) - size + 1) for x in texts)
            return pa.RecordBatch.from_arrays([pa.array([(pid << 24) | k], pa.int64()), pa.array([many], pa.int64()), pa.array([zstandard.ZstdCompressor(level=3).compress(sink.getvalue())], pa.binary())], ["block", "n_windows", "docs"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                held += len(t or "") + 64
                if held >= block_bytes:
                    yield full()
                    k, ids, texts, held = k + 1, [], [], 0
        if ids:
            yield full()

    arrow_batches(spark)
    name = f"corvane_blocks_{uuid.uuid4().hex}"
    packed = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "block long, n_windows long, docs binary")
    # A task writes a file only into the buckets of its own blocks, so there are no more files than blocks.
    packed.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("compression", "none").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    drop_at_exit(spark, name)
    return spark.table(name)


def _block(data: bytes, size: int) -> Block:
    import zstandard

    t = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()
    return Block(t.column("id").to_pylist(), t.column("text").to_pylist(), size)


MESSAGE = "part int, block long, data binary"


def _batch(rows: list[tuple], names: tuple[str, ...] = ("part", "block", "data"), kinds=(pa.int32(), pa.int64(), pa.binary())) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


def repeated_cells(packed: DataFrame, size: int, rows: int, slices: int, within: int) -> DataFrame:
    """(block, parts array<(part, data)>): for each slice and row, bits for the block's distinct cells there, in order."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b, out = _block(data, size), []
                for row in range(rows):
                    cells = distinct(b.cells(row, slices, within))
                    bounds = np.searchsorted(cells, (np.arange(slices + 1, dtype=np.uint64) << np.uint64(within)))
                    for s in np.flatnonzero(np.diff(bounds)).tolist():
                        inside = (cells[bounds[s] : bounds[s + 1]] & np.uint64((1 << within) - 1)).astype("<u4")
                        out.append((row * slices + s, block, squeezed(gaps(inside))))
                yield _batch(out)

    def merge(t: pa.Table) -> pa.Table:
        counts, cells = np.zeros(1 << within, np.uint8), []
        for data in t.column("data").to_pylist():
            cells.append(np.cumsum(unsqueezed(data, "<u4")[0], dtype=np.uint32))
            counts[cells[-1]] = np.minimum(counts[cells[-1]] + 1, 2)
        said = [squeezed(np.packbits(counts[c] > 1)) for c in cells]
        return pa.table({"part": t.column("part"), "block": t.column("block"), "data": pa.array(said, pa.binary())})

    sent = packed.select("block", "docs").mapInArrow(released(sketch), MESSAGE)
    back = sent.groupBy("part").applyInArrow(merge, MESSAGE)
    return keep(back.groupBy("block").agg(F.collect_list(F.struct("part", "data")).alias("parts")), "cells")


def owned_elsewhere(packed: DataFrame, cells: DataFrame, size: int, rows: int, slices: int, within: int) -> DataFrame:
    """(block, parts array<binary>): of a block's windows, one of each kind that also starts in a smaller doc_id in another block."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                b, out = _block(data, size), []
                may, got = np.ones(len(b.hash), bool), {p["part"]: p["data"] for p in parts or ()}
                for row in range(rows):
                    own, back = np.unique(b.cells(row, slices, within), return_inverse=True)
                    many = np.diff(np.searchsorted(own, np.arange(slices + 1, dtype=np.uint64) << np.uint64(within)))
                    flags = [np.unpackbits(unsqueezed(got[row * slices + s], "u1")[0])[: many[s]] for s in np.flatnonzero(many).tolist()]
                    may &= np.concatenate([np.empty(0, np.uint8), *flags]).astype(bool)[back]
                order, group = b.groups(np.flatnonzero(may))
                one = order[np.concatenate(([True], group[1:] != group[:-1]))[: len(order)]]
                bounds = np.searchsorted(_part(b.hash[one], slices), np.arange(slices + 1, dtype=np.uint64))
                for s in np.flatnonzero(np.diff(bounds)).tolist():
                    w = one[bounds[s] : bounds[s + 1]]
                    low = int(b.doc_id[w].min())
                    ids = (b.doc_id[w] - low).astype("<u8")
                    out.append((s, block, low.to_bytes(8, "little", signed=True) + squeezed(gaps(b.hash[w]), b.check[w], w.astype("<u4"), ids)))
                if out:
                    yield _batch(out)

    def decide(t: pa.Table) -> pa.Table:
        h, c, w, doc, of = [], [], [], [], []
        for n, data in enumerate(t.column("data").to_pylist()):
            a, b, i, d = unsqueezed(data[8:], "<u8", "<u4", "<u4", "<u8")
            h.append(np.cumsum(a, dtype=np.uint64))
            c.append(b)
            w.append(i)
            doc.append(d.astype(np.int64) + int.from_bytes(data[:8], "little", signed=True))
            of.append(np.full(len(b), n))
        h, c, w, doc, of = map(np.concatenate, (h, c, w, doc, of))
        order = np.lexsort((doc, c, h))
        start = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])))
        least = doc[order][np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))]
        lost = np.empty(len(order), bool)
        lost[order] = least < doc[order]
        blocks_, said = [], []
        for n, block in enumerate(t.column("block").to_pylist()):
            own = _range(of, n)
            if len(x := np.sort(w[own][lost[own]])):
                blocks_.append(block)
                said.append(squeezed(gaps(x)))
        return pa.table({"block": pa.array(blocks_, pa.int64()), "data": pa.array(said, pa.binary())})

    sent = packed.join(cells, "block", "left").select("block", "docs", "parts").mapInArrow(released(candidates), MESSAGE)
    back = sent.groupBy("part").applyInArrow(decide, "block long, data binary")
    return keep(back.groupBy("block").agg(F.collect_list("data").alias("parts")), "owned")


def _range(of: np.ndarray, n: int) -> slice:
    lo, hi = np.searchsorted(of, [n, n + 1])
    return slice(int(lo), int(hi))


def dedup(docs: DataFrame, size: int = 13, rows: int = 2, block_bytes: int = 1 << 22, slice_bits: int = 25) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed): kept is the words left, joined by spaces; removed the word ranges [start, end)."""
    packed = blocks(docs, size, block_bytes)
    total = packed.agg(F.sum("n_windows")).first()[0] or 0
    slices = (4 * total >> slice_bits) + 1  # four cells a window
    within = slice_bits if slices > 1 else min(slice_bits, max(10, math.ceil(math.log2(4 * total + 1))))
    owned = owned_elsewhere(packed, repeated_cells(packed, size, rows, slices, within), size, rows, slices, within)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for data, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = _block(data, size)
                order, group = b.groups(np.arange(len(b.hash)))
                lost = np.zeros(len(order), bool)
                if len(order):
                    start = np.concatenate(([True], group[1:] != group[:-1]))
                    least = b.doc_id[order][np.flatnonzero(start)]
                    away = np.zeros(len(b.hash), bool)
                    for p in parts or ():
                        away[np.cumsum(unsqueezed(p, "<u4")[0], dtype=np.int64)] = True
                    gone = np.zeros(len(least), bool)
                    gone[group[away[order]]] = True
                    lost[order] = gone[group] | (b.doc_id[order] > least[group])
                edge = np.zeros(int(b.first[-1]) + 1, np.int64)
                np.add.at(edge, b.at[lost], 1)
                np.add.at(edge, b.at[lost] + size, -1)
                out = np.cumsum(edge)[:-1] > 0
                kept, removed, ranges = [], [], []
                for k, words in enumerate(b.words):
                    mask = out[b.first[k] : b.first[k + 1]]
                    removed.append(int(mask.sum()))
                    if removed[-1]:
                        flips = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
                        ranges.append([{"start": int(x), "end": int(y)} for x, y in zip(flips[::2], flips[1::2], strict=True)])
                        words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                    else:
                        ranges.append([])
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([pa.array(b.ids, pa.int64()), pa.array(np.diff(b.first)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(ranges, shape)], ["doc_id", "n_words", "n_removed", "kept", "removed"])

    arrow_batches(docs.sparkSession)
    shape = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start: long, end: long>>"
    return packed.join(owned, "block", "left").select("docs", "parts").mapInArrow(released(cut), shape)
