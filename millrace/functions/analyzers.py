"""Text analyzers: columns of tokens."""

from __future__ import annotations

from collections.abc import Callable

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names, the stop words of the English analyzer, the greatest length of a token.
ANALYZERS = ("standard", "english", "simple", "whitespace", "keyword")
STOP_WORDS = frozenset(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)
MAX_TOKEN = 255

_WORD = regex.compile(r"\b\w[\w\p{M}]*(?:(?:(?<=\p{L})['’.:·](?=\p{L})|(?<=\p{Nd})[.,;'](?=\p{Nd}))[\w\p{M}]+)*", regex.V1 | regex.WORD)


def words(text: str) -> list[str]:
    """Words of running text by the Unicode rules: letters joined by apostrophes or mid-letters, digits by separators;
    a long one is cut into tokens of ``MAX_TOKEN`` characters. Ideographs and kana beyond these rules stand alone."""
    out = []
    for m in _WORD.finditer(text):
        w = m.group()
        if not any(map(str.isalnum, w)):
            continue
        if any("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in w):
            pieces = regex.findall(r"[\p{Han}\p{Hiragana}]|[^\p{Han}\p{Hiragana}]+", w)
        else:
            pieces = [w]
        for p in pieces:
            out.extend(p[i : i + MAX_TOKEN] for i in range(0, len(p), MAX_TOKEN))
    return out


_VOWEL = set("aeiou")


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    return c not in _VOWEL and (c != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(stem: str) -> int:
    """Turns from vowels to consonants."""
    shape = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return shape.count("vc")


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _cvc(w: str) -> bool:
    n = len(w)
    return n >= 3 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


#: Suffix rules of the published stemming algorithm, steps 2 to 4.
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(word: str, rules):
    fit = [r for r in rules if word.endswith(r[0] if isinstance(r, tuple) else r)]
    return max(fit, key=lambda r: len(r[0] if isinstance(r, tuple) else r), default=None)


def stem(word: str) -> str:
    """Porter's algorithm for lower-case English words."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and _has_vowel(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        rule = _longest(w, rules)
        if rule and _measure(w[: -len(rule[0])]) > 0:
            w = w[: -len(rule[0])] + rule[1]
    suffix = _longest(w, _STEP4)
    if suffix:
        rest = w[: -len(suffix)]
        if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
            w = rest
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _english(text: str) -> list[str]:
    out = []
    for w in words(text):
        w = w.lower()
        if w.endswith(("'s", "’s")):
            w = w[:-2]
        if w not in STOP_WORDS:
            out.append(stem(w))
    return out


def _simple(text: str) -> list[str]:
    return [w.lower() for w in regex.findall(r"\p{Alphabetic}+", text)]


def analyze(analyzer: str, text: str) -> list[str]:
    """Tokens of a query text, on the driver."""
    kinds: dict[str, Callable[[str], list[str]]] = {
        "standard": lambda t: [w.lower() for w in words(t)],
        "english": _english,
        "simple": _simple,
        "whitespace": lambda t: t.split(),
        "keyword": lambda t: [t],
    }
    return kinds[analyzer](text)


def _udf(analyzer: str):
    @F.pandas_udf("array<string>")
    def run(texts):
        return texts.map(lambda t: None if t is None else analyze(analyzer, t), na_action="ignore")

    return run


def tokens(text: Column, analyzer: str) -> Column:
    """The tokens of a text column; null for null. Inside the JVM for simple, whitespace and keyword."""
    if analyzer == "simple":
        return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{IsAlphabetic}+)"), F.lit(1))
    if analyzer == "whitespace":
        return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1))
    if analyzer == "keyword":
        return F.when(text.isNotNull(), F.array(text))
    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyzer {analyzer}")
    return _udf(analyzer)(text)


def lowercases(analyzer: str) -> bool:
    return analyzer in ("standard", "english", "simple")
