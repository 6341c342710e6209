"""Porter's stemmer (Porter 1980), as rules over measured stems."""

from __future__ import annotations

import re

# Suffixes of the published steps and what they become, where the stem's measure is positive.
STEP_2 = "ational ate|tional tion|enci ence|anci ance|izer ize|logi log|bli ble|alli al|entli ent|eli e|ousli ous|ization ize|ation ate|ator ate|alism al|iveness ive|fulness ful|ousness ous|aliti al|iviti ive|biliti ble"
STEP_3 = "icate ic|ative |alize al|iciti ic|ical ic|ful |ness "
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _shape(word: str) -> str:
    """``c`` for each consonant and ``v`` for each vowel; y is a vowel after a consonant."""
    out = ""
    for char in word:
        vowel = char in "aeiou" or char == "y" and out[-1:] == "c"
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant that is not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replace(word: str, table: str) -> str:
    for pair in sorted(table.split("|"), key=lambda p: -len(p.split(" ")[0])):
        old, new = pair.split(" ")
        if word.endswith(old):
            return word[: -len(old)] + new if measure(word[: -len(old)]) > 0 else word
    return word


def stem(word: str) -> str:
    """The stem of a folded word; words under 3 or over 64 bytes stand as they are."""
    if not 3 <= len(word.encode()) <= 64:
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for old in ("ed", "ing"):
            if word.endswith(old) and "v" in _shape(rest := word[: -len(old)]):
                if rest.endswith(("at", "bl", "iz")) or measure(rest) == 1 and _short_end(rest):
                    rest += "e"
                elif len(rest) > 1 and rest[-1] == rest[-2] and _shape(rest)[-1] == "c" and rest[-1] not in "lsz":
                    rest = rest[:-1]
                word = rest
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP_2), STEP_3)
    for old in sorted(STEP_4.split(), key=len, reverse=True):
        if word.endswith(old):
            rest = word[: -len(old)]
            if measure(rest) > 1 and (old != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word
