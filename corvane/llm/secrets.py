"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for what they don't name.

A candidate is a run of 16 or more token characters that starts within `reach` code points after a
word such as "credential" or "bearer" or the user part of a url, on whatever line, or stands in the
body of a private key block. A run that the word itself begins (session=..., token_live_...) is a
candidate less the rest of the identifier; what follows the first "=" of a run is a candidate of its
own. The last line of a block, which may be short, goes with the line before it. A candidate is
compressed with a zstandard dictionary made of common identifiers, those that the corpus itself uses
most (`learned`), and the text around it, less copies of the candidate; the bytes that it then adds, over
its length, is its novelty. Words and identifiers cost a few bytes; random keys cost nearly their length
and are reported as kind "novel", with every other run of the text that is the same string. The longer a key and the smaller its alphabet,
the better its bare symbols compress; so a candidate is novel, too, if it costs nearly what a random
string of its alphabet and length costs. Words that the dictionary lacks would pass that, and so
would any candidate without digits: there the letters must also follow each other less likely than
in words. Without letters, 16 digits in a row count. Paths, addresses and names, whose parts between
separators are words, short numbers or both, and UUIDs are left alone.

Null text counts as empty. Each row is scanned by itself, so repeated rows, null or repeated doc_ids
and further columns change nothing; an empty table gives no rows. Whole texts are scanned, however
long, in time that grows with their length.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LETTERS_LOW, LETTERS_UP, arrow_batches, released

# The patterns and the least length of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

# Words that make their surroundings sensitive.
SENSITIVE = re.compile(r"credential|bearer|authorization|private|passphrase|password|passwd|pwd|secret|token|signature|api.?key|access.?key|session|cookie|sas_|auth|(?<![a-z])key(?![a-z])|://[^/\s:@]{1,64}:", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST = 16
LONG_NUMBER = re.compile("[0-9]{16}")
DIGITS, UPPER, LOWER = "0123456789", LETTERS_UP, LETTERS_LOW
# Fixed value: long words of English, German, French and Spanish stay below it, random letters above.
PAIR_BITS = 4.5
# What goes on as an identifier, and the body of a private key block, its line ends escaped or not.
PLAIN = re.compile(r"[A-Za-z/+_-]*[0-9]{0,2}")
NAME = re.compile(r"[_-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+)[_-]+)*")
BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----((?:(?:\s|\\[nr])+[A-Za-z-]+: [^\n]*)*(?:(?:\s|\\[nr])+=?[A-Za-z0-9+/]+=*)*)")
LINE = re.compile(r"(?:(?<!\\)|(?<=\\)[nr])([A-Za-z0-9+/=]+)")
# Identifiers and words that keys are not made of.
IDENTIFIERS = " ".join(
    "the and for with that this from have not are was you your all can will has been their which would there about more other some into than only also "
    "account access address admin application array authentication authorization boolean buffer bucket cache callback certificate class client cloud cluster "
    "column command common config configuration connection console constant container content context controller cookie count create credential current data "
    "database date debug default delete description development directory document domain element email enabled encoding endpoint environment error event "
    "example exception execute expires export field file filter format function generate global group handler hash header host identifier image import index "
    "info input instance integer interface internal item iterator keyword label language length level library list local location logger login manager master "
    "memory message metadata method mode model module name network node null number object offset operation option order output package page parameter parent "
    "parser password path pattern permission placeholder platform policy port position prefix primary private process production profile project property "
    "protocol provider proxy public query queue random read record reference region register release remote replace request require resource response result "
    "return role root route sample schema scope script search secret section security select sequence server service session setting signature size source "
    "standard start state static status storage stream string structure style system table target task template test text thread timeout timestamp title token "
    "transaction type undefined update upload user username utility validate value variable vector version view virtual width window worker workspace write "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx ---------------- ================ ________________".split()
)


UUID = re.compile("[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)
SPOKEN = re.compile("[A-Za-z]{0,3}[0-9]{0,5}|([A-Za-z]+)[0-9]{0,3}")
IDENTIFIER = re.compile("(?<![A-Za-z0-9_])[A-Za-z_]{4,32}(?![A-Za-z0-9_])")

#: Bytes of the dictionary that is learned from a corpus, and what must remain of a candidate beside words.
DICTIONARY, UNSPOKEN = 1 << 14, 8


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by pattern; leftmost and non-overlapping within a kind."""
    low, found = text.lower(), []
    if any(w in low for w in ("passw", "secret", "token", "api_key", "apikey")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def novelty(candidate: str, around: str, known: str = "") -> float:
    """Bytes that the candidate adds to a zstandard frame primed with identifiers and its surroundings, over its length."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(f"{known} {IDENTIFIERS} {around}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    raw = candidate.encode()
    return (len(squeeze(raw)) - len(squeeze(b""))) / len(raw)


def alphabet(candidate: str) -> str:
    """The smallest usual alphabet that holds the candidate: decimal, hexadecimal, base 32, else its kinds of letters, digits and its marks."""
    used = set(candidate)
    for usual in (DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER, UPPER + "234567"):
        if used <= set(usual):
            return usual
    return "".join(k for k in (DIGITS, UPPER, LOWER) if used & set(k)) + "".join(sorted(used - set(DIGITS + UPPER + LOWER)))


@lru_cache(4096)
def expected(symbols: str, length: int) -> float:
    """The novelty of a random string; from 4096 symbols on it hardly changes."""
    draw = random.Random(length)
    return novelty("".join(draw.choice(symbols) for _ in range(length)), "")


@lru_cache(1)
def _pairs() -> dict[tuple[str, str], float]:
    """Bits of each letter after each other one, as in IDENTIFIERS, with one pair of each kind added."""
    low = IDENTIFIERS.lower()
    seen = Counter(p for p in zip(low, low[1:], strict=False) if set(p) <= set(LOWER))
    of = Counter(a for a, _ in seen.elements())
    return {(a, b): -math.log2((seen[a, b] + 1) / (of[a] + 26)) for a in LOWER for b in LOWER}


def wordlike(candidate: str) -> bool:
    """Whether its letters follow each other as in words: under PAIR_BITS bits each; a uniform choice costs more."""
    low, bits = candidate.lower(), _pairs()
    costs = [bits[p] for p in zip(low, low[1:], strict=False) if p in bits]
    return bool(costs) and sum(costs) < PAIR_BITS * len(costs)


def spoken(candidate: str) -> bool:
    """Whether hardly anything is left beside words, short numbers and what divides them."""
    if UUID.fullmatch(candidate):
        return True
    left = 0
    for part in re.split("[/_=+-]+", candidate):
        m = SPOKEN.fullmatch(part)
        if not m or (m[1] and not wordlike(m[1])):
            left += len(part)
    return left < UNSPOKEN


def is_novel(candidate: str, around: str, least: float, known: str = "") -> bool:
    letters, digits = re.search("[A-Za-z]", candidate), re.search("[0-9]", candidate)
    if (not letters and not LONG_NUMBER.search(candidate)) or spoken(candidate):
        return False
    costs = novelty(candidate, around.replace(candidate, " "), known)
    if letters and digits and costs >= least:
        return True
    symbols = alphabet(candidate)
    return costs >= least * expected(symbols, min(len(candidate), 4096)) and (symbols[10:].lower() == "abcdef" or not wordlike(candidate))


def in_context(text: str, reach: int) -> list[tuple[int, int]]:
    """(start, end) of the runs near a sensitive word, by start; a run that such words begin starts after the first and after the last of them."""
    marks = [m.end() for m in SENSITIVE.finditer(text)]
    if not marks:
        return []
    at = set()
    for c in CANDIDATE.finditer(text):
        a, b = c.span()
        first, last = bisect_right(marks, a - 1), bisect_right(marks, b - 1) - 1
        if first and a - marks[first - 1] <= reach:
            at.add((a, b))
        if first <= last:
            at |= {(NAME.match(text, marks[k], b).end(), b) for k in (first, last)}
    return sorted(at)


def novel_spans(text: str, base: list[tuple[int, int, str]], reach: int, least: float, known: str = "") -> list[tuple[int, int, str]]:
    """Incompressible strings in a sensitive context that no base span touches; none within another."""
    found: set[tuple[int, int]] = set()
    same: dict[str, bool] = {}
    starts, ends, reached = sorted(x for x, _, _ in base), [], 0
    for _, y, _ in sorted(base):
        ends.append(reached := max(reached, y))

    def novel(a: int, b: int) -> bool:
        if b - a < LEAST or not free(a, b):
            return False
        word = text[a:b]
        if not same.get(word) and not is_novel(word, text[max(0, a - 512) : a] + " " + text[b : b + 512], least, known):
            return False
        same[word] = True  # each copy of what is novel somewhere is
        found.add((a, b))
        return True

    def free(a: int, b: int) -> bool:
        before = bisect_right(starts, b - 1)  # base spans that start before b; the farthest of them ends beyond a if any overlaps
        return not (before and ends[before - 1] > a)

    for a, b in in_context(text, reach):
        cut = text.find("=", a, b)
        value = cut
        while 0 <= value < b and text[value] == "=":
            value += 1
        novel(a, cut if cut >= 0 and novel(value, b) and PLAIN.fullmatch(text, a, cut) else b)
    for m in BLOCK.finditer(text) if "PRIVATE KEY" in text else ():
        known = False
        for c in LINE.finditer(text, *m.span(1)):
            a, b = c.span(1)
            if b - a >= LEAST:
                known = novel(a, b)
            elif known:  # the end of a block, too short to be measured
                found.add((a, b))
    if same:
        found |= {c.span() for c in CANDIDATE.finditer(text) if c[0] in same and free(*c.span())}
    out, end = [], 0
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if b > end:
            out.append((a, b, "novel"))
            end = b
    return out


def spans_of(text: str | None, reach: int = 64, least: float = 0.8, known: str = "") -> list[tuple[int, int, str]]:
    base = base_spans(text or "")
    found = base + (novel_spans(text, base, reach, least, known) if text else [])
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def learned(docs: DataFrame) -> str:
    """The identifiers that most texts of the corpus hold, DICTIONARY bytes of them, the most frequent last, where zstandard looks first.

    All texts are counted: words of letters and underscores that read like words, so no key is learned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(set(IDENTIFIER.findall(text.as_py() or "")))
            if len(seen) > 200_000:
                yield sent()
                seen.clear()
        yield sent()

    arrow_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(released(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counted = counted.repartition(64)  # each part sends its first words to the driver: as many parts whatever the corpus
    most = [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(DICTIONARY // 5).collect()]
    out, size = [], 0
    for word in filter(wordlike, most):
        size += len(word) + 1
        if size > DICTIONARY:
            break
        out.append(word)
    return " ".join(reversed(out))


def scan(docs: DataFrame, reach: int = 64, least: float = 0.8) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>), by start, then kind; positions in code points, end exclusive."""
    kind, known = dict(docs.dtypes)["doc_id"], learned(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            got = [[{"kind": k, "start": a, "end": b} for a, b, k in spans_of(t, reach, least, known)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, shape)], ["doc_id", "spans"])

    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, mark: str = "[SECRET]", reach: int = 64, least: float = 0.8) -> DataFrame:
    """The documents with each union of overlapping spans replaced by mark; n_chars follows where there is such a column."""
    known = learned(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, out = batch.schema.get_field_index("text"), []
            for text in batch.column(k).to_pylist():
                pieces, at = [], 0
                for a, b, _ in spans_of(text, reach, least, known):
                    if b > at:
                        pieces += [text[at:a], mark] if a >= at else []
                        at = b
                out.append(text if not at else "".join([*pieces, text[at:]]))
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))

    arrow_batches(docs.sparkSession)
    done = docs.mapInArrow(released(run), docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else done
