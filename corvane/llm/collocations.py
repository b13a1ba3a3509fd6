"""Phrase collocations per language: exact counts of phrases of 2 to 4 words by minimal perfect hashing.

One pass over the texts turns words into 64-bit numbers, a number a (language, word), in chunks of
about a million words, and counts them. Should two words share a number, which is looked for among
all of them, the pass is made again with another seed; so numbers stand for words exactly.

Then, for phrases of 2, 3 and 4 words in turn, over the chunks:

1. Candidates. A phrase can only reach the least count if both phrases of one word less inside it
   may. Tasks hash the phrases of which that is so into buckets (32 bits within a shard), count them
   and send (bucket, count) to the shard, which sums up. A bucket below the least count holds no
   frequent phrase. What is left is a superset of the frequent phrases: nothing is lost.
2. Keys. Tasks send each distinct phrase of the buckets left, as its word numbers, to its shard.
3. Counts. The keys of consecutive shards, at most BLOCK of them, get a minimal perfect hash function
   with the key stored at its slot. It is broadcast (of bounded size: BLOCK keys), tasks look up the
   phrases of their chunks, compare the stored key, count slots in an array, and the arrays are
   summed in a tree, slice by slice. There is one pass for each block.

What may be frequent is passed on to the next length as a bitmap of at most 2^FILTER bits; where that
is too small for a corpus it lets more phrases through to the counts, and changes no result.
The counts of the parts of a candidate's cuts are read by slot from the frequent phrases, block by
block. Scores are integer divisions of decimals, for products pass 64 bits.

Each chunk pass is linear in the words; the passes of step 2 and 3 number frequent phrases / BLOCK.
A phrase that is a third of all words is one number a task and slice. Nothing is capped or sampled.

Null text is empty, null lang is `und`. Repeated rows count each. A very long text is cut into chunks
at ends of pieces, where no phrase crosses. Null or repeated doc_ids and further columns don't
matter, they are not read. Ties are ordered by the phrase's bytes. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import arrow_batches, keep, released
from corvane.llm.substring import distinct, gaps, mixed, squeezed, unsqueezed

#: Words of a chunk, phrases that a task collects before it sends them, keys of a broadcast block, most bits of a filter (as a power of two), slots of a slice, tasks whose arrays are added at a time.
CHUNK, HELD, BLOCK, FILTER, SLICE, FAN = 1 << 20, 1 << 22, 1 << 19, 26, 1 << 16, 64

_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)
_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WEIGHTS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


# ---- texts to chunks -------------------------------------------------------------------------


def _segments(raw: bytes, most: int = 4 << 20) -> Iterator[bytes]:
    """A text whose pieces end at dots, in parts that end there too."""
    at = 0
    while len(raw) - at > most:
        end = raw.find(b".", at + most)
        if end < 0:
            break
        yield raw[at:end]
        at = end
    yield raw[at:] if at else raw


def encoded(docs: DataFrame, seed: int) -> DataFrame:
    """Rows of two kinds: chunks (ids: numbers of their words, codes: places in ids, 0 at a piece's end) and word counts (lang, word, id, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            number = itertools.count(1)
            return defaultdict(lambda: defaultdict(number.__next__, {b".": 0})), [], 0

        def closed(words: dict, codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(codes)
            said = [(lang, w) for lang, of in words.items() for w in itertools.islice(of, 1, None)]
            place = np.fromiter((c for of in words.values() for c in itertools.islice(of.values(), 1, None)), np.int64, len(said))
            head = {lang: len(lang.encode()).to_bytes(4, "little") + lang.encode() for lang in words}
            own = np.fromiter((xxhash.xxh64_intdigest(head[lang] + w, seed) for lang, w in said), np.uint64, len(said))
            ids = np.zeros(len(said) + 1, np.uint64)
            ids[place] = np.maximum(own, np.uint64(1))
            n = np.bincount(flat, minlength=len(ids))
            yield batch_of(ids=pa.array([ids.tobytes()]), codes=pa.array([flat.astype(np.int32).tobytes()]))
            for lo in range(0, len(said), 1 << 16):
                part, at = said[lo : lo + (1 << 16)], place[lo : lo + (1 << 16)]
                yield batch_of(lang=pa.array([x for x, _ in part]), word=pa.array([w.decode() for _, w in part]), id=pa.array(ids[at].view(np.int64)), n=pa.array(n[at].astype(np.int64)))

        words, codes, held = fresh()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py().encode().lower().translate(_ENDS).replace(b".", b" . ")
                of = words[lang.as_py()]
                for part in _segments(raw):
                    own = list(map(of.__getitem__, part.split()))
                    codes.append(np.array([*own, 0], np.int64))
                    held += len(own) + 1
                    if held >= CHUNK:
                        yield from closed(words, codes)
                        words, codes, held = fresh()
                        of = words[lang.as_py()]
        if held:
            yield from closed(words, codes)

    kinds = {"ids": pa.binary(), "codes": pa.binary(), "lang": pa.string(), "word": pa.string(), "id": pa.int64(), "n": pa.int64()}

    def batch_of(**columns: pa.Array) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(rows, t) for c, t in kinds.items()], list(kinds))

    arrow_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce("text", F.lit("")))
    return texts.mapInArrow(released(run), "ids binary, codes binary, lang string, word string, id long, n long")


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks (ids, codes), and the words (id, lang, word, n) of all languages, each with a number of its own."""
    for seed in itertools.count():
        both = keep(encoded(docs, seed), "encoded")
        word = F.struct("lang", "word")
        counted = both.where("id is not null").groupBy("id").agg(F.min(word).alias("w"), F.max(word).alias("z"), F.sum("n").alias("n"))
        words = keep(counted.select("id", "w.lang", "w.word", "n", (F.col("w") != F.col("z")).alias("shared")), "words")
        if words.where("shared").isEmpty():
            return both.where("codes is not null").select("ids", "codes"), words.drop("shared")


# ---- hashing ---------------------------------------------------------------------------------


def longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word; that of a single word is its number."""
    return mixed(h * _STEP + word)


def hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row of word numbers, zeros at the end left out."""
    h = keys[:, 0].copy()
    for j in range(1, keys.shape[1]):
        h = np.where(keys[:, j] > 0, longer(h, keys[:, j]), h)
    return h, mixed((keys * _WEIGHTS[: keys.shape[1]]).sum(1))


class Slots:
    """A minimal perfect hash function over rows of word numbers, each row stored at its slot.

    Keys that are alone at their place of a level get the next slots; the others go to the next
    level, half of whose places are free. A key without a slot is told by the stored ones.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[np.ndarray] = []
        self.slot = np.zeros(len(keys), np.int64)
        h, g = hashes(keys) if len(keys) else (np.zeros(0, np.uint64),) * 2
        left, used = np.arange(len(keys)), 0
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("a key is repeated")
            at = self._at(h[left], g[left], len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(at, minlength=2 * len(left) + 1)[at] == 1
            table = np.full(2 * len(left) + 1, -1, np.int32)
            table[at[alone]] = self.slot[left[alone]] = np.arange(used, used + alone.sum())
            self.levels.append(table)
            used, left = used + int(alone.sum()), left[~alone]
        self.keys = np.empty_like(keys)
        self.keys[self.slot] = keys

    @staticmethod
    def _at(h: np.ndarray, g: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(h + g * np.uint64(2 * level + 1) + np.uint64(int(_TURN) * level & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each row, -1 where it is no key."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys) or not len(keys):
            return out
        h, g = hashes(keys)
        left = np.arange(len(keys))
        for level, table in enumerate(self.levels):
            got = table[self._at(h[left], g[left], level, len(table))]
            hit = np.flatnonzero(got >= 0)
            same = (self.keys[got[hit]] == keys[left[hit]]).all(1)
            out[left[hit[same]]] = got[hit[same]]
            left = left[got < 0]
        return out


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(62 - len(bits).bit_length())).astype(np.int64)  # 8 bits a byte
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def phrases(batch: pa.RecordBatch, size: int, filters: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word numbers of a chunk, starts, hashes) of the phrases of so many words all of whose parts pass the (broadcast) filters, and they too if there is one for them."""
    for own, codes in zip(batch.column(0), batch.column(1), strict=True):
        table, at = np.frombuffer(own.as_py(), np.uint64), np.frombuffer(codes.as_py(), np.int32)
        fine = has(filters[0].value, table)
        fine[0] = False
        ids, ok = table[at], fine[at]
        h = ids
        for k in range(2, size + 1):
            if len(ok) < 2:
                ok = ok[:0]
            start = np.flatnonzero(ok[:-1] & ok[1:])
            found = longer(h[start], ids[start + k - 1])
            if k <= len(filters):
                passed = has(filters[k - 1].value, found)
                start, found = start[passed], found[passed]
            if k < size:
                ok = np.zeros(max(len(ok) - 1, 0), bool)
                ok[start] = True
                h = np.zeros(len(ok), np.uint64)
                h[start] = found
        yield ids, start, found


def rows_of(ids: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    return np.stack([ids[start + j] for j in range(size)], 1)


def only(keys: np.ndarray) -> np.ndarray:
    """The distinct rows."""
    if not len(keys):
        return keys
    h, _ = hashes(keys)
    order = np.argsort(h, kind="stable")
    keys, h = keys[order], h[order]
    first = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1))
    of = np.repeat(first, np.diff(np.append(first, len(h))))
    other = (keys != keys[of]).any(1)  # another phrase with the hash of the first
    return np.concatenate([keys[first], np.unique(keys[other], axis=0)]) if other.any() else keys[first]


# ---- the three steps of a length -------------------------------------------------------------


def _filter_bits(shard: int, shards: int, power: int, h: np.ndarray) -> bytes:
    """The shard's part of a filter of 2^power bits; h: leading bits of hashes, moved to the top."""
    own = power - shards
    bits = np.zeros(1 << own, bool)
    bits[(h >> np.uint64(64 - power)).astype(np.int64) - (shard << own)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def collected_filter(df: DataFrame, shards: int, power: int):
    """The filter from its shards' parts (shard, bits), broadcast: 2^power bits, whatever the corpus."""
    own = 1 << (power - shards - 3)
    bits = np.zeros(own << shards, np.uint8)
    t = df.select("shard", "bits").toArrow()
    for shard, part in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
        bits[shard * own : (shard + 1) * own] = np.frombuffer(part, np.uint8)
    return df.sparkSession.sparkContext.broadcast(bits)


def word_filter(words: DataFrame, least: int, shards: int, power: int):
    def bits(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), "bits": pa.array([_filter_bits(shard, shards, power, t.column("id").to_numpy().astype(np.int64).view(np.uint64))], pa.binary())})

    frequent = words.where(F.col("n") >= least).select(F.shiftrightunsigned("id", 64 - shards).cast("int").alias("shard"), "id")
    return collected_filter(frequent.groupBy("shard").applyInArrow(bits, "shard int, bits binary"), shards, power)


def buckets(chunks: DataFrame, size: int, filters: list, least: int, shards: int, power: int) -> DataFrame:
    """(shard, n, codes, bits): the buckets that at least so many phrases fall in, and the shard's part of their filter."""
    low = np.uint64(32 - shards)  # a code is the shard, then 32 bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            all_ = np.sort(np.concatenate(codes))
            if not len(all_):
                return
            first = np.concatenate(([0], np.flatnonzero(all_[1:] != all_[:-1]) + 1))
            code, n = all_[first], np.diff(np.append(first, len(all_))).astype(np.uint32)
            ends = np.searchsorted(code, np.arange(1 << shards, dtype=np.uint64) << np.uint64(32))
            for shard, (a, b) in enumerate(zip(ends, np.append(ends[1:], len(code)), strict=True)):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([squeezed(gaps(code[a:b].astype(np.uint32)), n[a:b])], pa.binary())], ["shard", "data"])

        codes, count = [], 0
        for batch in batches:
            for _, _, h in phrases(batch, size, filters):
                codes.append(h >> low)
                count += len(h)
                if count >= HELD:
                    yield from sent(codes)
                    codes, count = [], 0
        if count:
            yield from sent(codes)

    def summed(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        parts = [unsqueezed(d.as_py(), "u4", "u4") for d in t.column("data")]
        code, n = np.concatenate([np.cumsum(g, dtype=np.uint32) for g, _ in parts]), np.concatenate([c for _, c in parts]).astype(np.int64)
        order = np.argsort(code)
        code, n = code[order], n[order]
        first = np.concatenate(([0], np.flatnonzero(code[1:] != code[:-1]) + 1))
        code = code[first][np.add.reduceat(n, first) >= least].astype(np.uint64) | np.uint64(shard) << np.uint64(32)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(code)], pa.int64()), "codes": pa.array([code.tobytes()], pa.binary()), "bits": pa.array([_filter_bits(shard, shards, power, code << low)], pa.binary())})

    return keep(chunks.mapInArrow(released(run), "shard int, data binary").groupBy("shard").applyInArrow(summed, "shard int, n long, codes binary, bits binary"), "buckets")


def shard_blocks(df: DataFrame) -> list[tuple[int, int]]:
    """Ranges of shards that hold at most BLOCK of df's n together, or one shard."""
    sizes = sorted(tuple(r) for r in df.groupBy("shard").agg(F.sum("n")).collect())  # a row a shard
    out, total = [], 0
    for shard, n in sizes:
        if out and total + n <= BLOCK:
            out[-1], total = (out[-1][0], shard + 1), total + n
        else:
            out.append((shard, shard + 1))
            total = n
    return out


def block_of(df: DataFrame, column: str, block: tuple[int, int]) -> np.ndarray:
    t = df.where(F.col("shard").between(block[0], block[1] - 1)).select("shard", column).toArrow().sort_by("shard")
    return np.frombuffer(b"".join(t.column(1).to_pylist()), np.uint64)


def candidate_keys(chunks: DataFrame, size: int, filters: list, found: DataFrame, shards: int) -> DataFrame:
    """(shard, n, keys): the distinct phrases that fall in the buckets found."""
    sc, low, schema = chunks.sparkSession.sparkContext, np.uint64(32 - shards), "shard int, n long, keys binary"

    def of(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        shard = (hashes(keys)[0] >> np.uint64(64 - shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        keys, shard = keys[order], shard[order]
        first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))[: len(shard)]
        for a, b in zip(first, np.append(first[1:], len(shard)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([shard[a]], pa.int32()), pa.array([b - a], pa.int64()), pa.array([np.ascontiguousarray(keys[a:b]).tobytes()], pa.binary())], ["shard", "n", "keys"])

    def seen_in(codes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, count = [], 0
            for batch in batches:
                for ids, start, h in phrases(batch, size, filters):
                    code = h >> low
                    at = np.minimum(np.searchsorted(codes.value, code), len(codes.value) - 1)
                    keys.append(only(rows_of(ids, start[codes.value[at] == code], size)))
                    count += len(keys[-1])
                    if count >= HELD:
                        keys = [only(np.concatenate(keys))]
                        count = len(keys[0])
                        if count >= HELD // 2:
                            yield from of(keys[0])
                            keys, count = [], 0
            if count:
                yield from of(only(np.concatenate(keys)))

        return run

    def merged(t: pa.Table) -> pa.Table:
        keys = only(np.concatenate([np.frombuffer(k.as_py(), np.uint64).reshape(-1, size) for k in t.column("keys")]))
        return pa.table({"shard": t.column("shard").slice(0, 1), "n": pa.array([len(keys)], pa.int64()), "keys": pa.array([keys.tobytes()], pa.binary())})

    def pass_of(block: tuple[int, int]) -> DataFrame:
        codes = sc.broadcast(block_of(found, "codes", block))
        done = keep(chunks.mapInArrow(released(seen_in(codes)), schema).groupBy("shard").applyInArrow(merged, schema), "keys")
        codes.destroy()
        return done

    return _all(chunks, [pass_of(b) for b in shard_blocks(found.where("n > 0"))], schema)


def _all(like: DataFrame, parts: list[DataFrame], schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else like.sparkSession.createDataFrame([], schema)


def tree_sum(df: DataFrame, tasks: int) -> DataFrame:
    """(slice, data) from (slice, node, data), sparse arrays of counts by place, added FAN at a time."""

    def added(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros(SLICE, np.int64)
        for d in t.column("data"):
            step, n = unsqueezed(d.as_py(), "u4", "u8")
            total[np.cumsum(step, dtype=np.uint32)] += n.astype(np.int64)
        at = np.flatnonzero(total)
        return at, total[at]

    def node(t: pa.Table) -> pa.Table:
        at, n = added(t)
        return pa.table({"slice": t.column("slice").slice(0, 1), "node": t.column("node").slice(0, 1), "data": pa.array([squeezed(gaps(at.astype(np.uint32)), n.astype(np.uint64))], pa.binary())})

    while tasks > 1:
        tasks = -(-tasks // FAN)
        df = df.withColumn("node", F.expr(f"node div {FAN}").cast("int")).groupBy("slice", "node").applyInArrow(node, "slice int, node int, data binary")
    return df


def counted(chunks: DataFrame, size: int, filters: list, keys: DataFrame, least: int, shards: int) -> DataFrame:
    """(key, a): the phrases among keys that occur at least so often, with their exact counts; a pass over the chunks for each block of keys."""
    sc = chunks.sparkSession.sparkContext
    tasks = chunks.rdd.getNumPartitions()

    def pass_of(block: tuple[int, int]) -> DataFrame:
        slots = sc.broadcast(Slots(block_of(keys, "keys", block).reshape(-1, size)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            n = np.zeros(len(slots.value.keys), np.int64)
            for batch in batches:
                for ids, start, h in phrases(batch, size, filters):
                    shard = h >> np.uint64(64 - shards)
                    got = slots.value.find(rows_of(ids, start[(shard >= block[0]) & (shard < block[1])], size))
                    n += np.bincount(got[got >= 0], minlength=len(n))
            for lo in range(0, len(n), SLICE):
                at = np.flatnonzero(n[lo : lo + SLICE])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([lo // SLICE], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([squeezed(gaps(at.astype(np.uint32)), n[lo + at].astype(np.uint64))], pa.binary())], ["slice", "node", "data"])

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for which, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    step, n = unsqueezed(data, "u4", "u8")
                    often = n >= least
                    at = np.cumsum(step, dtype=np.uint32)[often].astype(np.int64) + which * SLICE
                    yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in slots.value.keys[at]], pa.binary()), pa.array(n[often].astype(np.int64))], ["key", "a"])

        done = keep(tree_sum(chunks.mapInArrow(released(run), "slice int, node int, data binary"), tasks).mapInArrow(named, "key binary, a long"), "counted")
        slots.destroy()
        return done

    return _all(chunks, [pass_of(b) for b in shard_blocks(keys)], "key binary, a long")


# ---- scores ----------------------------------------------------------------------------------


def cuts(candidates: DataFrame, parts: DataFrame, size: int = 4) -> DataFrame:
    """(key, a, l1.., r1..): how often the first k words and the rest of a candidate occur, read by slot from parts (key, a), fewer than BLOCK of them at a time."""
    sc = candidates.sparkSession.sparkContext
    blocks = max(1, -(-parts.count() // (BLOCK // 2)))
    names = [f"{s}{k}" for s in "lr" for k in range(1, size)]

    def padded(keys: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.pad(keys, ((0, 0), (0, size - 1 - keys.shape[1]))))

    def pass_of(block: int) -> DataFrame:
        t = parts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).select("key", "a").toArrow()
        raw = [k.ljust(8 * (size - 1), b"\0") for k in t.column(0).to_pylist()]
        slots = Slots(np.frombuffer(b"".join(raw), np.uint64).reshape(-1, size - 1))
        n = np.zeros(len(raw), np.int64)
        n[slots.slot] = t.column(1).to_numpy()
        held = sc.broadcast((slots, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots, n = held.value
            for batch in batches:
                raw = batch.column(0).to_pylist()
                size_of = np.array([len(k) // 8 for k in raw])
                for k in np.unique(size_of):
                    own = np.flatnonzero(size_of == k)
                    keys = np.frombuffer(b"".join(raw[i] for i in own), np.uint64).reshape(-1, k)
                    for c in range(1, k):
                        for side, part in (("l", keys[:, :c]), ("r", keys[:, c:])):
                            at = slots.find(padded(part))
                            hit = at >= 0  # every part is in one block
                            rows = pa.array(own[hit])
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(hit.sum(), names.index(f"{side}{c}"), np.int32)), pa.array(n[at[hit]])], ["key", "a", "what", "n"])

        done = keep(candidates.select("key", "a").mapInArrow(run, "key binary, a long, what int, n long"), "cuts")
        held.destroy()
        return done

    read = reduce(DataFrame.unionByName, [pass_of(b) for b in range(blocks)])
    return read.groupBy("key", "a").agg(*(F.max(F.when(F.col("what") == i, F.col("n"))).alias(c) for i, c in enumerate(names)))


def first_rows(df: DataFrame, by: str, order: list, most: int, number: Callable, salt: str) -> DataFrame:
    """The rows whose number() within by is at most so many: first within parts of by, so that no task sorts a whole large one."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = df.withColumn("_s", F.pmod(F.xxhash64(salt), F.lit(parts))).withColumn("_n", number().over(Window.partitionBy(by, "_s").orderBy(*order))).where(F.col("_n") <= most)
    return some.withColumn("_n", number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most).drop("_s")


def frequent_phrases(docs: DataFrame, least: int = 30, size: int = 4) -> tuple[DataFrame, DataFrame]:
    """The words (id, lang, word, n), and all phrases (key, a) of 2 to size words that occur at least so often in their language."""
    chunks, words = numbered(docs)
    total = words.agg(F.sum("n")).first()[0] or 0
    shards = min(max(6, (total >> 21).bit_length()), 20)
    power = min(max(total.bit_length() + 2, shards + 3), FILTER)
    filters, out = [word_filter(words, least, shards, power)], []
    for k in range(2, size + 1):
        found = buckets(chunks, k, filters, least, shards, power)
        filters.append(collected_filter(found, shards, power))
        keys = candidate_keys(chunks, k, filters, found, shards)
        out.append(counted(chunks, k, filters, keys, least, shards))
    for held in filters:
        held.destroy()
    return words, _all(chunks, out, "key binary, a long")


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, size: int = 4) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases that no longer phrase stands for."""
    words, found = frequent_phrases(docs, least, size)
    single = words.where(F.col("n") >= least)
    as_key = F.unhex(F.concat(*(F.substring(F.lpad(F.hex("id"), 16, "0"), 15 - 2 * i, 2) for i in range(8))))  # little-endian
    single = single.withColumn("key", as_key)
    parts = single.select("key", F.col("n").alias("a")).unionByName(found.where(F.length("key") <= 8 * (size - 1)))
    d = cuts(found, parts, size)
    score = lambda k: F.expr(f"cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l{k} as decimal(19,0)) + r{k})")
    cell = lambda k: F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    d = d.select("key", "a", F.array_min(F.array_compact(F.array(*(cell(k) for k in range(1, size))))).alias("c")).select("key", "a", "c.score", "c.l", "c.r")
    inner = [(n, i, j) for n in range(3, size + 1) for j in range(2, n) for i in range(n - j + 1)]
    within = F.explode(F.array_compact(F.array(*(F.when(F.length("key") == 8 * n, F.substring("key", 8 * i + 1, 8 * j)) for n, i, j in inner)))).alias("key") if inner else F.col("key")
    longest = found.where(F.length("key") > 16).select(within, F.col("a").alias("f")).groupBy("key").agg(F.max("f").alias("f"))
    d = d.join(longest, "key", "left").where("f is null or cast(100 as decimal(3,0)) * f < cast(80 as decimal(3,0)) * a").drop("f")
    d = d.withColumn("first", F.substring("key", 1, 8)).join(single.select(F.col("key").alias("first"), "lang"), "first").drop("first")
    best = keep(first_rows(d, "lang", [F.desc("score"), F.desc("a")], most, F.rank, "key"), "best").drop("_n")  # what ties with the last stays
    spelt = best.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("length(key) div 8 - 1")), lambda i: F.col("key").substr(i * 8 + 1, F.lit(8)))).alias("pos", "one"))
    spelt = spelt.join(single.select(F.col("key").alias("one"), "word"), "one").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x.word), " ").alias("phrase"))
    d = first_rows(best.join(spelt, "key"), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most, F.row_number, "key")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return d.join(totals, "lang").select("lang", F.col("_n").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
