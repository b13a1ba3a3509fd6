"""Token counts by the whole-token shortcut: pre-tokens that are one token are counted, only the rest is merged.

Which strings of the vocabulary encode alone as one token is proved before any text is read: each
string goes through the model's merges by itself, once a worker. A text is cut at the vocabulary's
added tokens (one token each) and then into pre-tokens; a pre-token among the proved strings is one
token, another one is merged by the library's own model, and its count remembered.

The library cuts by its own Unicode tables, which are older than those of the regex module. Their
cuts are equal on the code points of SAME (a test compares each of them), so a text with any other
code point is cut by the library itself; the counts do not depend on which of the two cuts.

Null text counts as empty: no bytes, no tokens. A very long text is cut where white space follows
something else, which is always the end of a pre-token, so it is never held as one list. Repeated
rows and null doc_ids are counted each by itself; further columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corvane.llm.common import arrow_batches, released

#: Ranges of code points where both Unicode tables cut alike: up to Cyrillic, CJK and Hangul.
SAME = ((0x0, 0x557), (0x3000, 0x9FFF), (0xAC00, 0xD7A3))

#: Code points of a text that are cut at a time, and merged pre-tokens that a worker remembers.
PIECE, REMEMBERED = 1 << 18, 1 << 18


def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """What cuts texts of SAME into pre-tokens, what finds other code points, and what finds places where a text may be cut."""
    inside = [c for a, b in SAME for c in range(a, b + 1)]
    kind = lambda test: "".join(re.escape(chr(c)) for c in inside if test(chr(c)))
    letter, number = kind(lambda c: unicodedata.category(c)[0] == "L"), kind(lambda c: unicodedata.category(c)[0] == "N")
    space = kind(lambda c: c in "\t\n\x0b\x0c\r \x85" or unicodedata.category(c)[0] == "Z")
    cut = rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(cut), re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in SAME) + "]"), re.compile(f"(?<=[^{space}])(?=[{space}])")


class Merged(dict):
    """Pre-token -> how many tokens its merges leave. Forgets all when full, which costs only time."""

    def __init__(self, merge) -> None:
        self.merge = merge

    def __missing__(self, word: str) -> int:
        n = len(self.merge(word.encode()))
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


class TokenCounter:
    """text -> number of tokens, for one byte-level BPE vocabulary in the tokenizers format."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        if said["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or said.get("normalizer"):
            raise ValueError("the vocabulary must be a byte-level BPE without prefix space and normalizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in said["added_tokens"]):
            raise ValueError("added tokens that take their surroundings are not supported")
        whole = Tokenizer.from_file(path)
        self.library, model = whole.pre_tokenizer, whole.model
        signs, byte = ByteLevel(add_prefix_space=False, use_regex=False), {}  # the character of the vocabulary -> its byte
        for code in (*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x110000, 0x1000)):
            raw = chr(code).encode()
            byte |= dict(zip(signs.pre_tokenize_str(chr(code))[0][0], raw, strict=True))
        ranks: dict[bytes, int] = {}
        self.one: set[str] = set()
        for token, rank in said["model"]["vocab"].items():
            raw = bytes(byte.get(c, 255) for c in token)
            if 255 in raw:  # no text in UTF-8 holds that byte
                continue
            ranks[raw] = rank
            if len(model.tokenize(token)) == 1:
                try:
                    self.one.add(raw.decode())
                except UnicodeDecodeError:  # a part of a character is no pre-token
                    pass
        spare = max(ranks.values(), default=0) + 1
        ranks |= {bytes([b]): spare + b for b in range(256) if bytes([b]) not in ranks}  # the merging library wants them all
        added = sorted((t["content"] for t in said["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.merged = Merged(tiktoken.Encoding("counted", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece)
        self.cut, self.other, self.edge = _patterns()

    def words(self, text: str) -> Iterator[list[str]]:
        if not text.isascii() and self.other.search(text):
            yield [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
            return
        at = 0
        while len(text) - at > PIECE:
            edge = self.edge.search(text, at + PIECE)
            if edge is None:
                break
            yield self.cut.findall(text[at : edge.start()])
            at = edge.start()
        yield self.cut.findall(text[at:] if at else text)

    def __call__(self, text: str) -> int:
        parts = self.added.split(text) if self.added else [text]
        total = len(parts) - 1
        for part in parts:
            for words in self.words(part):
                rest = [w for w in words if w not in self.one]
                total += len(words) - len(rest) + sum(map(self.merged.__getitem__, rest))
        return total


_counters: dict[str, TokenCounter] = {}


def counter(vocabulary: str) -> TokenCounter:
    if vocabulary not in _counters:
        import public_tokenizers

        _counters[vocabulary] = TokenCounter(public_tokenizers.path(vocabulary + ".json"))
    return _counters[vocabulary]


def counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row a document, counted where it lies."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            n = pa.array([count(t.as_py()) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(text).cast(pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
