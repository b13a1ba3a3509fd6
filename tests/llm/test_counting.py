"""Collocations, the filter audit and token counts against brute force, with awkward rows."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvane.llm import collocations, interaction, tokencount

SHAPE = "doc_id long, text string, lang string, n_tokens string, _s int, key string, part int, a int"


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "x", 1, "k", 2, 3) for i, t, lang in rows], SHAPE).repartition(3)


def collected(df):
    return [tuple(r) for r in df.collect()]


# ---- collocations ----------------------------------------------------------------------------


def plain_collocations(rows, least, most):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, of in f.items():
        good = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in good.items():
            for j in range(2, len(p)):
                for i in range(len(p) - j + 1):
                    longest[p[i : i + j]] = max(longest[p[i : i + j]], a)
        best = []
        for p, a in good.items():
            score, cut = min((2000000 * a // (of[p[:k]] + of[p[k:]]), k) for k in range(1, len(p)))
            if p not in longest or 100 * longest[p] < 80 * a:
                best.append((-score, -a, " ".join(p).encode(), of[p[:cut]], of[p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows(seed=3):
    r = random.Random(seed)
    words = ["a", "A", "b", "bc", "ä", "\x1c", "c\x00d", "d'e", "longword" * 40, "Z-9", "x", "y"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";x ", " \x0b", "?"]) for _ in range(n))
    rows = [(i, text(r.randint(0, 60)), r.choice(["en", "de", None, "und", ""])) for i in range(60)]
    rows += [(None, None, "en"), (1, "", None), (1, "...", "en"), (2, " \t ", "xx"), (3, text(4000), "en")]
    return rows + rows[:5] + [(9, "one two three four five. " * 9, "fr"), (9, "one two three four five. " * 9, "fr"), (10, "one two two", "fr")]


@pytest.mark.parametrize("least, most", [(3, 2000), (2, 25)])
def test_collocations(spark, least, most):
    rows = phrase_rows()
    assert sorted(collected(collocations.collocations(frame(spark, rows), least, most))) == plain_collocations(rows, least, most)


def test_collocations_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 40)  # hash functions of few keys: several passes a length
    rows = phrase_rows(4)
    assert sorted(collected(collocations.collocations(frame(spark, rows), 2, 100))) == plain_collocations(rows, 2, 100)


def test_words_that_share_a_number_are_numbered_anew(spark, monkeypatch):
    tried = []
    real = collocations.encoded

    def clashing(docs, seed):
        tried.append(seed)
        df = real(docs, seed)
        return df.selectExpr("ids", "codes", "lang", "word", "if(id is null, null, 7L) AS id", "n") if seed == 0 else df

    monkeypatch.setattr(collocations, "encoded", clashing)
    rows = [(1, "a b a b a b", "en")]
    assert sorted(collected(collocations.collocations(frame(spark, rows), 2, 10))) == plain_collocations(rows, 2, 10)
    assert tried == [0, 1]


def test_slots_are_minimal_and_tell_strangers():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 1 << 60, (5000, 3)).astype(np.uint64), axis=0)
    slots = collocations.Slots(keys)
    assert sorted(slots.slot) == list(range(len(keys))) and (slots.find(keys) == slots.slot).all()
    assert (slots.find(keys + np.uint64(1)) == -1).all()
    assert (collocations.Slots(keys[:0]).find(keys) == -1).all()
    with pytest.raises(ValueError):
        collocations.Slots(np.concatenate([keys[:1], keys[:1]]))


def test_distinct_rows_with_one_hash(monkeypatch):
    keys = np.array([[1, 2], [3, 4], [1, 2], [3, 4], [5, 6]], np.uint64)
    monkeypatch.setattr(collocations, "hashes", lambda k: (np.zeros(len(k), np.uint64),) * 2)
    assert sorted(map(tuple, collocations.only(keys))) == [(1, 2), (3, 4), (5, 6)]


def test_scores_pass_64_bits(spark):
    big = 4 * 10**17
    d = collocations.cuts(spark.createDataFrame([(b"\x01" + bytes(7) + b"\x02" + bytes(7), big)], "key binary, a long"), spark.createDataFrame([(b"\x01" + bytes(7), big), (b"\x02" + bytes(7), big + 1)], "key binary, a long"))
    got = d.selectExpr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l1 as decimal(19,0)) + r1) AS s").first()[0]
    assert got == 2000000 * big // (2 * big + 1)


# ---- the filter audit ------------------------------------------------------------------------


def plain_audit(rows, labels):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    judged = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        judged[lang or ""].append((i, fails))
    out = []
    for part, own in judged.items():
        lines, total = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in own if x[1][f] and any(x[1][e] for e in order[: step - 1])]
                here = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                total[f] += len(here)
                lines.append((f, "".join(order), step, len(left), len(here), len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in own), sum(x[0] in good for x in here), sum(x[0] in toxic for x in here)))
        out += [(part, *line[1:], total[line[0]]) for line in lines]
    return sorted(out)


def audit_rows():
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)] + ["#", "BIG", "é", "\x1c"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    long = text(250)
    rows = [(i, text(r.choice([3, 150, 210, 260, 600])), r.choice(["en", "de", None, ""])) for i in range(40)]
    rows += [(100 - i, long, r.choice(["en", "de"])) for i in range(60)] + [(41, long, "en"), (41, long, "de"), (41, long, "en"), (None, long, "en"), (None, "new", "en")]
    rows += [(200, None, "en"), (201, "", "fr"), (202, "   ", "fr"), (203, "x " * 30000, "fr"), (204, "x " * 30000, "fr"), (41, "another text of one id", "en")]
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(110)] + [(5, 1, None), (5, 0, 1), (None, 1, 1), (41, None, 1)]
    return rows, labels


def test_audit(spark):
    rows, labels = audit_rows()
    got = interaction.audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(collected(got)) == plain_audit(rows, labels)
    none = interaction.audit(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(collected(none)) == plain_audit(rows, [])


def test_chains_compare_texts_and_pass_on_what_is_held(monkeypatch):
    """Texts that share a fingerprint stay apart; a text passed on several times is still one."""
    monkeypatch.setattr(interaction.xxhash, "xxh64_intdigest", lambda x: 7)
    rows, _ = audit_rows()
    for held in (1, 1 << 20):
        monkeypatch.setattr(interaction, "HELD", held)
        sent = [x for part in (rows[:30], rows[30:80], rows[80:]) for x in interaction.chained((i, lang or "", t or "") for i, t, lang in part)]
        got = Counter()
        for i, part, mask, n in interaction.judged(sorted(sent, key=lambda x: x[0])):
            got[i, part, mask] += n
        smallest = {}
        for i, t, _ in rows:
            if i is not None:
                smallest[t or ""] = min(smallest.get(t or "", i), i)
        assert got == Counter((i, lang or "", interaction.failed(t or "") | (16 if i is not None and i > smallest[t or ""] else 0)) for i, t, lang in rows)


def test_hot_text_leaves_a_task_once():
    sent = list(interaction.chained((i, "en", "same") for i in range(1000, 0, -1)))
    assert sum(text is not None for _, (_, text, _) in sent) == 1 and len({key for key, _ in sent}) == 1000


# ---- token counts ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(spark, library):
    r = random.Random(1)
    signs = ["a", "Z", "é", " ", " ", "'s", "'t", "re", "\n", "\t", "漢", "՘", "㐀", "🙂", "ſ", "\xa0", "ǅ", "<|endoftext|>", "1", "²", "\x1c", "\x85", "the", " house", "_", "\U0001e94a"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(1500)] + [None, "", " ", "<|endoftext|>", "<|endoftext", "<|endoftext|><|endoftext|>", "a" * 20000, "word " * 120000, " " * 1000, "\n " * 700]
    rows = [(i if i % 7 else None, t, "en") for i, t in enumerate(texts)] + [(1, texts[1], None)] * 3
    got = sorted(collected(tokencount.counts(frame(spark, rows), limit=20)), key=repr)
    n = [len(e.ids) for e in library.encode_batch([t or "" for _, t, _ in rows], add_special_tokens=False)]
    assert got == sorted(((i, len((t or "").encode()), k, k > 20) for (i, t, _), k in zip(rows, n, strict=True)), key=repr)


def test_whole_tokens_are_proved(library):
    count = tokencount.counter("byte_bpe_50k")
    some = random.Random(0).sample(sorted(count.one), 3000)
    assert len(count.one) > 49000
    assert all(len(e.ids) == 1 for e in library.encode_batch([w for w in some if len(count.cut.findall(w)) == 1], add_special_tokens=False))


def test_both_cuts_agree_on_same():
    count = tokencount.counter("byte_bpe_50k")
    for a, b in tokencount.SAME:
        for code in range(a, b + 1):
            text = f"a{chr(code)}1{chr(code)}! {chr(code)}x "
            assert [m.span() for m in count.cut.finditer(text)] == [span for _, span in count.library.pre_tokenize_str(text)]


def test_texts_are_cut_where_no_pre_token_crosses(monkeypatch, library):
    monkeypatch.setattr(tokencount, "PIECE", 5)
    count, r = tokencount.counter("byte_bpe_50k"), random.Random(9)
    for _ in range(500):
        text = "".join(r.choice("ab1 !é\n\t' ") for _ in range(50))
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


# ---- empty tables ----------------------------------------------------------------------------


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SHAPE), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert collected(collocations.collocations(docs)) == []
    assert collected(interaction.audit(docs, labels)) == []
    assert collected(tokencount.counts(docs)) == []
