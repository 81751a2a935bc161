"""English stems of distinct tokens, by the published Snowball rules for English (Porter2)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: the published tables. ---
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": "",
}
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
)
_DOUBLES = frozenset("bb dd ff gg mm nn pp rr tt".split())
_LI_ENDINGS = frozenset("cdeghkmnrt")

_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")
_LONG_HEAD = re.compile("gener|commun|arsen")
_CONSONANT_Y = re.compile("(?<=[aeiouy])y|^y")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _longest(word: str, tails) -> str:
    return max((t for t in tails if word.endswith(t)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    """Where the parts after the first and the second vowel-consonant pair begin."""
    head = _LONG_HEAD.match(word)
    first = head.end() if head else (m.end() if (m := _REGION.search(word)) else len(word))
    second = m.end() if (m := _REGION.search(word, first)) else len(word)
    return first, second


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, first: int) -> str:
    tail = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    base = word[: len(word) - len(tail)]
    if tail.startswith("eed"):
        return base + "ee" if len(base) >= first else word
    if not tail or not _VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base[-2:] in _DOUBLES:
        return base[:-1]
    if len(base) <= first and _SHORT_END.search(base):
        return base + "e"
    return base


def stem(word: str) -> str:
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = _CONSONANT_Y.sub("Y", word.lstrip("'"))
    first, second = _regions(word)
    word = _plural(re.sub("'s?'?$", "", word))
    if word in _AFTER_PLURAL:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and not _VOWEL.match(word[-2]):
        word = word[:-1] + "i"

    tail = _longest(word, _STEP2)
    base = word[: len(word) - len(tail)]
    fits = {"li": base[-1:] in _LI_ENDINGS, "ogi": base.endswith("l")}.get(tail, True)
    if tail and len(base) >= first and fits:
        word = base + _STEP2[tail]
    tail = _longest(word, _STEP3)
    base = word[: len(word) - len(tail)]
    if tail and len(base) >= (second if tail == "ative" else first):
        word = base + _STEP3[tail]
    tail = _longest(word, _STEP4)
    base = word[: len(word) - len(tail)]
    if tail and len(base) >= second and (tail != "ion" or base.endswith(("s", "t"))):
        word = base
    if word.endswith("e"):
        base = word[:-1]
        if len(base) >= second or (len(base) >= first and not _SHORT_END.search(base)):
            word = base
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")


@F.pandas_udf(T.StringType())
def stem_token(tokens: pd.Series) -> pd.Series:
    return tokens.map(stem)
