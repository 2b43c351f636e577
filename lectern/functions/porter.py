"""The Porter stemming algorithm (Porter 1980), as rule tables over one word."""

from __future__ import annotations

from functools import lru_cache

#: Fixed values of the published algorithm: suffix, replacement. Steps 2, 3 and 4.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and k > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How often a run of vowels is followed by a consonant."""
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Ends consonant-vowel-consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _swap(word: str, rules, least: int) -> str:
    """Applies the rule with the longest fitting suffix, if the stem before it has more than ``least`` measures."""
    fits = [r for r in rules if word.endswith(r[0])]
    if fits:
        suffix, new = max(fits, key=lambda r: len(r[0]))
        stem = word[: len(word) - len(suffix)]
        if _measure(stem) > least:
            return stem + new
    return word


def _plural(word: str) -> str:
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + new
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: len(word) - len(suffix)]
        if word.endswith(suffix) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _doubled(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
        if word.endswith(suffix):
            break
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2, 0), _STEP3, 0)
    fits = [s for s in _STEP4 if word.endswith(s)]
    if fits:
        suffix = max(fits, key=len)
        base = word[: len(word) - len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if _measure(word) > 1 and _doubled(word) and word.endswith("l") else word
