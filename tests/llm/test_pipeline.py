"""The whole pipeline against a plain version of it, on the smallest tables and a few planted rows."""

import math
import re

import pytest

import corpus_pipeline
from corvane.llm import common, quality, secrets

SF = "/root/testdata/sf0.001"
A = re.compile(r"[^\x20\x09-\x0D]+")
B = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def measured(t):
    w, lines = A.findall(t), [x for x in t.split("\n") if A.search(x)]
    win = [tuple(w[p : p + 8]) for p in range(len(w) - 7)]
    n = {}
    for x in win:
        n[x] = n.get(x, 0) + 1
    rep = len({q for p, x in enumerate(win) if n[x] > 1 for q in range(p, p + 8)})
    dup = len(lines) - len(set(lines))
    mean = sum(map(len, w)) / len(w) if w else 0
    scores = {"symbols": sum(c in "#*$%&|<>" for c in t) / max(1, len(w)), "dup_lines": dup / max(1, len(lines)), "repeats": rep / max(1, len(w)), "word_length": abs(math.log(mean / 5.5)) if mean else 0}
    return len(w) < 20 or 100 * rep > 30 * len(w), scores


def good(rows, labels):
    got = [measured(t or "") for _, t, _ in rows]
    held = {}
    for (i, _, lang), (failed, s) in zip(rows, got):
        if labels.get(i) in (0, 1) and not failed:
            held.setdefault(lang, {0: [], 1: []})[labels[i]].append(s)
    strata, cut = sum(bool(h[1]) for h in held.values()), {}
    for lang, h in held.items():
        used = [r for r, g in quality.GRIDS.items() if h[0] and sum(s[r] > g[0] for s in h[0]) >= 0.05 * len(h[0])]
        for step in range(max(map(len, quality.GRIDS.values()))):
            at = {r: quality.GRIDS[r][max(0, len(quality.GRIDS[r]) - 1 - step)] for r in used}
            n, k = len(h[1]), sum(any(s[r] > c for r, c in at.items()) for s in h[1])
            if not n or sum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1)) > 0.05 / strata:
                break
            cut[lang] = at
    return [r for r, (failed, s) in zip(rows, got) if not failed and not any(s[rule] > c for rule, c in cut.get(r[2], {}).items())]


def shingled(t):
    w = A.findall(low(t or ""))
    return {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))}


def single(rows):
    """One of each class of texts whose 5-word shingles are alike by 0.8 or more."""
    sets, root = [shingled(t) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for n, r in enumerate(rows):
        first.setdefault(find(n), []).append(r)
    return [min(x, key=lambda r: r[0]) for x in first.values()]


def clean(rows, items):
    wins = {}
    for t in items:
        v = B.findall(low(t or ""))
        n = min(13, len(v))
        for p in range(len(v) - n + 1 if n else 0):
            wins.setdefault(n, set()).add(tuple(v[p : p + n]))
    out = []
    for r in rows:
        w = B.findall(low(r[1] or ""))
        hit = {q for n, s in wins.items() for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in s for q in range(p, p + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


def redacted(text):
    spans, out, at = [(a, b) for a, b, _ in secrets.spans_of(text)], "", 0
    covered = [False] * len(text)
    for a, b in spans:
        covered[a:b] = [True] * (b - a)
    starts = {a for a, b in spans if a == 0 or not covered[a - 1] or not any(x < a < y for x, y in spans)}
    while at < len(text):
        out += "[SECRET]" if at in starts else "" if covered[at] else text[at]
        at += 1
    return out


def test_against_a_plain_version(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = common.table(spark, SF, "documents")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    labels = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    items = [r.text for r in common.table(spark, SF, "benchmark").collect()]
    words = rows[0][1].split()[:40]
    planted = [(900_001, " ".join([*words, items[0]]), "en"), (900_002, " ".join(["one", "two", *words, "password=abcdef0123456789", "end"]), "en"), (900_003, " ".join(["three", *words, items[1][:20]]), "en")]

    def plain(these):
        out = [good(these, labels)]
        for step in (single, lambda x: clean(x, items), lambda x: [(i, redacted(t), lang) for i, t, lang in x]):
            out.append(step(out[-1]))
        return out

    stages = plain(rows + planted)
    assert len(rows) > len(stages[0]) > len(stages[1]) > len(stages[2]) and stages[2] != stages[3]
    docs = docs.unionByName(spark.createDataFrame([(*r, "src0", len(r[1])) for r in planted], docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    got = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, stages):
        got = common.keep(stage(spark, got, SF), "stage")
        assert sorted((r.doc_id, r.text) for r in got.select("doc_id", "text").collect()) == sorted(r[:2] for r in want), name
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, len(t.encode(x, add_special_tokens=False).ids) + 1) for i, x, _ in plain(rows)[-1])
    pieces = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert sorted(tuple(r) for r in pieces) == want


def test_clean_documents_stay(spark):
    """Plain prose passes all stages unchanged, whatever surrounds it."""
    docs = common.table(spark, SF, "documents")
    prose = [f"This is plain sentence number {n} of a clean page about {w}, which says what happened and why it mattered to people there. " for n, w in enumerate("rivers bridges markets gardens schools kitchens trains letters songs maps".split())]
    more = spark.createDataFrame([(900_000 + n, (p + f"It was written by person {n} in the year {1900 + n}. ") * 1, "en", "src0", 0) for n, p in enumerate(prose)], docs.schema)
    got = docs.unionByName(more)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = common.keep(stage(spark, got, SF), "stage")
    left = {r.doc_id: r.text for r in got.where("doc_id >= 900000").collect()}
    assert left == {r.doc_id: r.text for r in more.collect()}


@pytest.mark.parametrize("text", ["password=abcdef0123 and AKIA" + "Q1" * 9, "token: " + "0a" * 20])
def test_redaction(text):
    assert "[SECRET]" in redacted(text) and "abcdef" not in redacted(text)


def test_awkward_rows(spark):
    """Nulls, repeated rows, ties, columns with clashing names, a text of 60,000 words; then an empty table."""
    import random

    r = random.Random(31)
    vocab = [f"word{i}" for i in range(20000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    long, same, near = text(60000), text(80), text(200)
    edited = " ".join([*near.split()[:100], "changed", *near.split()[101:]])
    rows = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "few words only"), (5, long), (6, same), (6, same), (7, same), (None, same), (8, near), (9, edited), (None, text(50)), (10, text(40) + " token=abcdef123456 " + text(40)), (10, text(60))]
    shape = "doc_id long, text string, lang string, source string, n_chars long, _row string, key int, component long, _n int"
    docs = spark.createDataFrame([(i, t, None if n % 3 else "en", None, None if t is None else len(t), "r", n, 7, 1) for n, (i, t) in enumerate(rows)], shape)
    got = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = common.keep(stage(spark, got, SF), "stage")
        assert got.columns == docs.columns, name
    left = sorted((str(x.doc_id), len(A.findall(x.text))) for x in got.collect())
    assert left == sorted([("5", 60000), ("6", 80), ("8", 200), ("None", 50), ("10", 81), ("10", 60)])
    pieces = corpus_pipeline.STAGES[-1][1](spark, got, SF).collect()
    assert sum(p.length for p in pieces if p.doc_id == 5) > 60000 and all(p.offset + p.length <= 1024 for p in pieces)
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = common.keep(stage(spark, none, SF), "stage")
        assert none.count() == 0, name
