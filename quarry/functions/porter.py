"""The Porter stemmer (M. F. Porter, 1980) and the tokens of the keyword index."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_TOKEN = re.compile(r"[^\W_]+")
# Suffixes and their replacements in steps 2, 3 and 4.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    return c not in "aeiou" and not (c == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n >= 3 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    """The stem of a lower-case word; words of other letters than a-z and of two letters or fewer stay."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for pair in sorted(table.split(), key=lambda p: -len(p.split(":")[0])):
            end, new = pair.split(":")
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4.split(), key=lambda e: -len(e)):
        if w.endswith(end):
            rest = w[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def tokens(text: str) -> list[str]:
    """Lower-case stems of a text's words; _ and other signs separate."""
    return [stem(t) for t in _TOKEN.findall(text.lower())]


@F.pandas_udf(ArrayType(StringType()))
def stemmed_tokens(text: pd.Series) -> pd.Series:
    return text.map(lambda t: tokens(t or ""))
