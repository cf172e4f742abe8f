"""The English stemmer of the Snowball project (Porter 2), from its published definition."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the definition: words with stems of their own, words that stay after step 1a, suffixes by step.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"), ("tional", "tion"), ("lessli", "less"), ("biliti", "ble"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("fulli", "ful"), ("ousli", "ous"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

V = "aeiouy"
REGION = re.compile(rf"[{V}][^{V}](.*)", re.S)
SHORT = re.compile(rf"(?:^|.*[^{V}])[{V}][^{V}wxY]$|^[{V}][^{V}]$", re.S)


def _after(word: str) -> str:
    """What follows the first consonant after a vowel."""
    m = REGION.search(word)
    return m[1] if m else ""


def _first_region(word: str) -> str:
    for lead in ("gener", "commun", "arsen"):
        if word.startswith(lead):
            return word[len(lead) :]
    return _after(word)


def _short_syllable(word: str) -> bool:
    return bool(SHORT.match(word))


@lru_cache(maxsize=65536)
def stem(word: str) -> str:
    """The stem of a lower-cased word; words of other letters than a-z and ' stay."""
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.removeprefix("'")
    word = re.sub(rf"(^|[{V}])y", r"\1Y", word)
    r1 = len(word) - len(_first_region(word))
    r2 = len(word) - len(_after(word[r1:]))
    # step 0 and 1a
    word = re.sub("('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{V}]", word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word
    # step 1b
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if word.endswith(end):
            head = word[: -len(end)]
            if end.startswith("eed"):
                word = head + "ee" if len(head) >= r1 else word
            elif re.search(f"[{V}]", head):
                word = head
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word.endswith(DOUBLES):
                    word = word[:-1]
                elif len(word) <= r1 and _short_syllable(word):
                    word += "e"
            break
    # step 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in V:
        word = word[:-1] + "i"
    # step 2
    for end, put in STEP_2:
        if word.endswith(end):
            head = word[: -len(end)]
            if len(head) >= r1 and not (end == "ogi" and not head.endswith("l")) and not (end == "li" and not re.search("[cdeghkmnrt]$", head)):
                word = head + put
            break
    # step 3
    for end, put in STEP_3:
        if word.endswith(end):
            head = word[: -len(end)]
            if len(head) >= r1 and not (end == "ative" and len(head) < r2):
                word = head + put
            break
    # step 4
    for end in STEP_4:
        if word.endswith(end):
            head = word[: -len(end)]
            if len(head) >= r2 and not (end == "ion" and not head.endswith(("s", "t"))):
                word = head
            break
    # step 5
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_syllable(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
