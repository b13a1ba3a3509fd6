"""Packing: concatenate all token streams and cut the result into windows of a fixed length.

Pass 1 tokenizes each text once, where it lies, and stores the ids with their place in the
partition; a sum over each partition gives its total. The prefix sums of those totals (one number
a partition, so bounded by the number of tasks, not of documents) are the global offsets. Pass 2
cuts each document's ids at the multiples of the length. No row is shuffled in either pass, no
sequence but the last is short, and each piece names its sequence and its offset there.

Null text counts as empty (the end id alone); null or repeated doc_ids and further columns change
nothing: every row is packed by itself, in scan order. The special strings that the vocabulary
itself lists become their ids wherever a text holds them. A very long text is tokenized whole, in
one row, and cut like others. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import arrow_batches, keep, released

#: Splits exactly as the vocabulary's own pattern does, without backtracking.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """text -> ids of the byte-level BPE public_tokenizers.path(vocabulary + ".json"), its added tokens included.

    The ranks beside it hold the same vocabulary in the form that the faster library reads.
    """
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary + ".json"), encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(public_tokenizers.path(vocabulary + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        coded = tiktoken.Encoding(vocabulary, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
        allowed = set(added)
        _encoders[vocabulary] = lambda text: coded.encode(text, allowed_special=allowed, disallowed_special=()) if any(a in text for a in allowed) else coded.encode_ordinary(text)
    return _encoders[vocabulary]


def tokenized(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(pid, local_start, doc_id, n_tokens, ids): ids as little-endian 16-bit numbers, local_start within partition pid."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, at, code = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                starts, sizes, ids, seen = [], [], [], {}
                for text in part.column(1).to_pylist():
                    if (got := seen.get(text)) is None:
                        got = seen[text] = np.array([*code(text or ""), end_id], dtype="<u2").tobytes()
                    starts.append(at)
                    sizes.append(len(got) // 2)
                    ids.append(got)
                    at += len(got) // 2
                yield pa.RecordBatch.from_arrays([pa.array([pid] * len(ids), pa.int32()), pa.array(starts, pa.int64()), part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["pid", "local_start", "doc_id", "n_tokens", "ids"])

    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(released(run), f"pid int, local_start long, doc_id {kind}, n_tokens long, ids binary")


def pack(docs: DataFrame, length: int = 1024, vocabulary: str = "byte_bpe_50k", end_id: int = 0) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids): ids as little-endian 32-bit numbers."""
    kind, kept = dict(docs.dtypes)["doc_id"], keep(tokenized(docs, vocabulary, end_id), "tokens")
    base, total = {}, 0
    for pid, size in sorted(map(tuple, kept.groupBy("pid").agg(F.max(F.col("local_start") + F.col("n_tokens"))).collect())):
        base[pid], total = total, total + size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out: list[list] = [[] for _ in names]
                rows, whole = [], part.column("ids")
                for i, (pid, local, size) in enumerate(zip(part.column("pid").to_pylist(), part.column("local_start").to_pylist(), part.column("n_tokens").to_pylist(), strict=True)):
                    ids, first = np.frombuffer(whole[i].as_buffer(), dtype="<u2").astype("<u4"), base[pid] + local
                    cuts = [0, *range(length - first % length, size, length), size]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        for column, value in zip(out[1:], (a, b - a, size, (first + a) // length, (first + a) % length, ids[a:b].tobytes()), strict=True):
                            column.append(value)
                        rows.append(i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in out[1:6]), pa.array(out[6], pa.binary())], names)

    return kept.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """One row a sequence: its ids (binary, 32-bit) and its boundary records in order. At most `length` pieces meet in a row."""
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    got = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return got.select("sequence_id", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p.ids)), "")).alias("ids"), F.transform("parts", lambda p: F.struct(p.offset.alias("offset"), p.doc_id.alias("doc_id"), p.start.alias("start"), p.length.alias("length"))).alias("boundaries"))
