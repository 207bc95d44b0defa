"""The Porter stemmer (M. F. Porter, 1980, "An algorithm for suffix stripping"), written as tables of rules."""

from __future__ import annotations

import re

#: Suffix -> replacement, longest first within a step; a rule fires when the stem's measure is over the step's.
STEP2 = [
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"),
    ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("ousli", "ous"), ("entli", "ent"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("ator", "ate"), ("logi", "log"), ("eli", "e"), ("bli", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou".split()


def _shape(word: str) -> str:
    """v for vowels, c for the rest; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, rules, above: int) -> str:
    for suffix, put in rules:
        if word.endswith(suffix):
            head = word[: -len(suffix)]
            return head + put if _measure(head) > above else word
    return word


def stem(word: str | None) -> str | None:
    """The stem of a lower-case word; words of under three letters, or over 20 characters, or with other than a-z, stay."""
    if word is None or len(word) < 3 or len(word) >= 20 or not (word.isascii() and any(c.isalpha() for c in word)):
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                head = w[: -len(end)]
                if "v" in _shape(head):
                    if head.endswith(("at", "bl", "iz")):
                        head += "e"
                    elif len(head) > 1 and head[-1] == head[-2] and _shape(head)[-1] == "c" and head[-1] not in "lsz":
                        head = head[:-1]
                    elif _measure(head) == 1 and _short_end(head):
                        head += "e"
                    w = head
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2, 0), STEP3, 0)
    for suffix in sorted([*STEP4, "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            if _measure(head) > 1 and (suffix != "ion" or head.endswith(("s", "t"))):
                w = head
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
