"""Text functions: strip, prompt rendering, output parsing, tokens, near-duplicate clauses.

Columns where Spark's own functions express it; Arrow-batched functions where they don't.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as str.strip() knows it, wider than trim().
SPACE = "[\\s\\x1c-\\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def render(template: str, **slots: Column) -> Column:
    """The template with each NAME replaced, one after the other, so what was filled in may be filled again."""
    out = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit(name), value)
    return out


def question(template: str, gene: Column, disease: Column) -> Column:
    return render(template, GENE=gene, DISEASE=disease)


def heads(gene: Column, variants: Column) -> Column:
    """The gene name before the variants, unless it is empty or one of them; variants keep repeats."""
    return F.when((gene != "") & ~F.array_contains(variants, gene), F.concat(F.array(gene), variants)).otherwise(variants)


# Fixed value: a line of a model's output.
_LINE = '^- "([^"]+)", "([^"]+)", "([^"]+)"$'


def parsed(output: Column) -> Column:
    """Triplets of one model output: lines - "h", "r", "t" up to the first line that is no list item; repeats go."""
    lines = F.transform(F.split(F.concat(F.lit("- "), output), "\n"), strip)

    def listed(lines: Column) -> Column:
        ends = F.array_position(F.transform(lines, lambda x: x.startswith("- ")), F.lit(False))
        return F.when(ends == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(ends - 1, F.lit(0)).cast("int")))

    good = F.filter(F.get(F.transform(F.array(lines), listed), F.lit(0)), lambda x: x.rlike(_LINE))  # named by a lambda, the lines are stripped once
    part = lambda x, i: F.regexp_extract(x, _LINE, i)
    return F.array_distinct(F.transform(good, lambda x: F.struct(part(x, 1).alias("h"), part(x, 2).alias("r"), part(x, 3).alias("t"))))


def clause(t: Column) -> Column:
    return F.concat_ws(" ", t.h, t.r, t.t)


# Token counts and budgets

_PIECES = re.compile(r"[^\W\d_]{1,6}|\d{1,3}|[^\w\s]|_", re.U)


def count_pieces(text: str) -> int:
    """A deterministic stand-in for a vocabulary: letters by six, digits by three, marks by one."""
    return sum(1 for _ in _PIECES.finditer(text))


def vocabulary_counter(name: str) -> Callable[[str], int]:
    """Counts with a public byte-level vocabulary file, where the library is there."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    code = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(code.encode_ordinary(text))


def token_count(counter: Callable[[str], int] = count_pieces) -> Callable[[Column], Column]:
    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: counter(t) if t is not None else 0)

    return count


def truncate(text: str, most: int, counter: Callable[[str], int] = count_pieces) -> str:
    """Cut in proportion to the excess until the text has at most so many tokens, or no cut is left."""
    while (n := counter(text)) > most:
        cut = len(text) * most // n - 1
        if cut < 1:
            break
        text = text[:cut]
    return text


def truncated(most: int, counter: Callable[[str], int] = count_pieces) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: truncate(t, most, counter) if t is not None else None)

    return cut


# Words and stems

# The published rewrite rules of treebank tokens (quotes that open; points; brackets and
# dashes; quotes that close; contractions), which are applied one after the other to the whole text.
_OPENING = [
    (r"([«“‘„]|[`]+)", r" \1 "),
    (r"(?i)(')(?!re|ve|ll|m|t|s|d|n)(\w)\b", r"\1 \2"),
    (r'^"', r"``"),
    (r"(``)", r" \1 "),
    (r"([ (\[{<])(\"|'{2})", r"\1 `` "),
]
_POINTS = [
    (r"([^.])(\.)([\])}>\"'»”’ ]*)\s*$", r"\1 \2 \3 "),
    (r"([:,])([^\d])", r" \1 \2"),
    (r"([:,])$", r" \1 "),
    (r"(\.{2,})", r" \1 "),
    (r"([;@#$%&])", r" \1 "),
    (r"([^.])(\.)([\])}>\"']*)\s*$", r"\1 \2\3 "),
    (r"([?!])", r" \1 "),
    (r"([^'])' ", r"\1 ' "),
    (r"([*])", r" \1 "),
    (r"([\]\[(){}<>])", r" \1 "),
    (r"(--)", r" \1 "),
]
_CLOSING = [
    (r"([»”’])", r" \1 "),
    (r"''", r" '' "),
    (r'"', r" '' "),
    (r"\s+", r" "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
]
_CONTRACTIONS = [(rf"(?i)\b({a})({b})\b", r" \1 \2 ") for a, b in (("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("more", "'n"))]
_CONTRACTIONS += [(r"(?i)\b(wan)(na)(?=\s)", r" \1 \2 "), (r"(?i) ('t)(is)\b", r" \1 \2 "), (r"(?i) ('t)(was)\b", r" \1 \2 ")]
_COMPILED = [[(re.compile(p), r) for p, r in part] for part in (_OPENING + _POINTS, _CLOSING + _CONTRACTIONS)]


def words(text: str) -> list[str]:
    """Treebank tokens of the text, white space at its ends aside."""
    text = re.sub("[\x1c-\x1f]", " ", text).strip()
    for part, pad in zip(_COMPILED, (" ", ""), strict=True):
        for pattern, by in part:
            text = pattern.sub(by, text)
        text = f"{pad}{text}{pad}"
    return text.split()


def word_list(text: Column) -> Column:
    """words() as a column: the same rules, one after the other, in the JVM."""
    out = strip(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x1c-\\x1f]", " "))
    for part, pad in ((_OPENING + _POINTS, " "), (_CLOSING + _CONTRACTIONS, "")):
        for pattern, by in part:
            out = F.regexp_replace(out, "(?U)" + pattern, re.sub(r"\\(\d)", r"$\1", by))
        out = F.concat(F.lit(pad), out, F.lit(pad))
    return F.array_remove(F.split(out, "(?U)\\s+"), "")


def stemmed(word: Column) -> Column:
    @F.pandas_udf("string")
    def of(words_: pd.Series) -> pd.Series:
        from corvane.functions.stem import stem

        return words_.map(stem)

    return of(word)


def stems(least: int = 3) -> Callable[[Column, Column], Column]:
    """Words of at least so many letters that are no entity name, stemmed; repeats kept."""

    @F.pandas_udf("array<string>")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from functools import lru_cache

        from corvane.functions.stem import stem

        known = lru_cache(1 << 17)(stem)
        for texts, names in batches:
            yield pd.Series([[known(w) for w in words(t or "") if len(w) >= least and w not in n] for t, n in zip(texts, (set(x) if x is not None else set() for x in names), strict=True)])

    return of


# Near-duplicate clauses


class Kept:
    """Clauses that stayed, by their length: a new one is compared only with those that its length and letters allow to be alike.

    Of lengths a and b the similarity is at most 2 min(a, b) / (a + b), which leaves a range of lengths;
    in it, twice the letters in common over a + b is a bound. What is left goes to the matcher.
    """

    def __init__(self, most: float) -> None:
        self.most, self.lengths, self.rows = most, [], []
        self.texts: set[str] = set()
        self.pairs = self.compared = 0

    def add(self, clause: str) -> None:
        from difflib import SequenceMatcher

        if clause not in self.texts:
            at = bisect_right(self.lengths, len(clause))
            self.lengths.insert(at, len(clause))
            self.rows.insert(at, (Counter(clause), SequenceMatcher(None, "", clause, autojunk=False)))
            self.texts.add(clause)

    def alike(self, clause: str) -> bool:
        """Whether it equals a kept clause, or its similarity to one (the kept one as the second sequence, without the popularity heuristic) is above most."""
        if clause in self.texts:
            return True
        self.pairs += len(self.rows)
        n, letters = len(clause), Counter(clause)
        share = self.most / (2 - self.most) if self.most < 2 else 1.0
        first = bisect_left(self.lengths, int(n * share) - 1)
        last = bisect_right(self.lengths, int(n / share) + 1) if share > 0 else len(self.lengths)
        for length, (of, matcher) in zip(self.lengths[first:last], self.rows[first:last], strict=True):
            both = sum(min(k, of[c]) for c, k in letters.items())
            if 2 * min(n, length) > self.most * (n + length) and 2 * both > self.most * (n + length):
                self.compared += 1
                matcher.set_seq1(clause)
                if matcher.ratio() > self.most:
                    return True
        return False


def survived(choices: list[list[str]], most: float) -> tuple[list[list[bool]], Kept]:
    kept, first, out = Kept(most), True, []
    for choice in choices:
        stay = []
        for c in choice:
            stay.append(first or not kept.alike(c))
            if stay[-1]:
                kept.add(c)
        first = first and not choice
        out.append(stay)
    return out, kept


def survivors(choices: list[list[str]], most: float) -> list[list[bool]]:
    """Which clauses of a head's choices stay: all of the first choice that has any, then those unlike whatever stayed."""
    return survived(choices, most)[0]


def near_duplicates(most: float) -> Callable[[Column], Column]:
    """(stay, clauses, pairs, compared) of each head's choices: which stay, and the work done."""

    @F.pandas_udf("stay array<array<boolean>>, clauses bigint, pairs bigint, compared bigint")
    def of(heads_: pd.Series) -> pd.DataFrame:
        out = []
        for h in heads_:
            stay, kept = survived([list(c) for c in h], most) if h is not None else (None, Kept(most))
            out.append((stay, sum(map(len, stay or [])), kept.pairs, kept.compared))
        return pd.DataFrame(out, columns=["stay", "clauses", "pairs", "compared"])

    return of


# Names in texts


def finder(names: list[str]) -> Callable[[str], list[str]]:
    """text -> the names that it holds as written, in their order: one automaton of all names, one pass over the text."""
    import ahocorasick

    machine, always = ahocorasick.Automaton(), [i for i, n in enumerate(names) if not n]
    for i, n in enumerate(names):
        if n:
            machine.add_word(n, i)
    if not len(machine):
        return lambda text: [names[i] for i in always]
    machine.make_automaton()
    return lambda text: [names[i] for i in sorted({*always, *(i for _, i in machine.iter(text))})]


def held() -> Callable[[Column, Column], Column]:
    """(names, texts) -> of each text the names that it holds."""

    @F.pandas_udf("array<array<string>>")
    def of(names: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(finder(list(n)), t)) if t is not None and len(t) else [] for n, t in zip(names, texts, strict=True)])

    return of


# Answers


def answer_score(answers: Column) -> Column:
    """1 for an answer that begins with yes, 0 with no, else a half; null without an answer."""
    low = F.lower(F.get(answers, F.lit(0)))
    return F.when(low.isNull(), F.lit(None)).when(low.startswith("yes"), 1.0).when(low.startswith("no"), 0.0).otherwise(0.5)


def percent(ratio: Column) -> Column:
    """0.125 as 12%: half to even on the product."""
    return F.concat(F.bround(ratio * 100).cast("bigint").cast("string"), F.lit("%"))


