"""Word stems by Porter's suffix rules (1980), with the later exceptions that language toolkits apply by default."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words with stems of their own, then each step's suffixes and what takes their place.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _sounds(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for k, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _sounds(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant (not w, x, y), or is just a vowel and a consonant."""
    s = _sounds(stem)
    return (s.endswith("cvc") and stem[-1] not in "wxy") or s == "vc"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    suffix = _longest(word, ("ed", "ing"))
    stem = word[: -len(suffix)] if suffix else ""
    if "v" not in _sounds(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _sounds(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short(stem) else stem


def _step_2(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]):
        return _step_2(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) else word
    return _replaced(word, STEP_2)


def _replaced(word: str, rules: dict[str, str]) -> str:
    suffix = _longest(word, rules)
    return word[: -len(suffix)] + rules[suffix] if suffix and _measure(word[: -len(suffix)]) else word


def _step_4(word: str) -> str:
    suffix = _longest(word, STEP_4)
    stem = word[: -len(suffix)] if suffix else word
    return stem if suffix and _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")) else word


def _final(word: str) -> str:
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stem_word(word: str) -> str:
    """The stem of one word, in lower case; words of up to two letters stay."""
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _sounds(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    return _final(_step_4(_replaced(_step_2(word), STEP_3)))


def stems(words: Column) -> Column:
    """Stems of an array of words, each different word of an Arrow batch once.  A null array or word stays null."""

    @F.pandas_udf("array<string>")
    def work(batch: pd.Series) -> pd.Series:
        known: dict[str | None, str | None] = {None: None}

        def one(word):
            if word not in known:
                known[word] = stem_word(word)
            return known[word]

        return batch.map(lambda x: None if x is None else [one(w) for w in x])

    return work(words)
