"""The Snowball English (Porter2) stemmer, from its published description."""

from __future__ import annotations

import re

# The algorithm's letter classes, suffix tables and exceptions.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_BEFORE = "cdeghkmnrt"
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
R1_PREFIX = ("gener", "commun", "arsen")
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

_REGION = re.compile("[aeiouy][^aeiouy]")


def _region(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _short_end(w: str) -> bool:
    """Ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


def _longest(w: str, suffixes) -> str:
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


def stem(word: str) -> str:
    w = word.lower().replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(w) <= 2:
        return w
    if w in WHOLE:
        return WHOLE[w]
    w = w.removeprefix("'")
    w = re.sub("(^|[aeiouy])y", r"\1Y", w)
    r1 = next((len(p) for p in R1_PREFIX if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)

    w = w[: len(w) - len(_longest(w, ("'", "'s", "'s'")))]
    w = _step1a(w)
    if w in AFTER_1A:
        return w
    w = _step1b(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    s = _longest(w, (*STEP2, "ogi", "li"))
    if s and len(w) - len(s) >= r1:
        if s == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif s == "li":
            w = w[:-2] if w[-3:-2] and w[-3] in LI_BEFORE else w
        else:
            w = w[: -len(s)] + STEP2[s]
    s = _longest(w, (*STEP3, "ative"))
    if s and len(w) - len(s) >= r1:
        if s == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(s)] + STEP3[s]
    s = _longest(w, (*STEP4, "ion"))
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _step1a(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        return w[:-1]
    return w


def _step1b(w: str, r1: int) -> str:
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        return w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
    if not s or not re.search("[aeiouy]", w[: -len(s)]):
        return w
    w = w[: -len(s)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w[:-1]
    return w + "e" if len(w) <= r1 and _short_end(w) else w
