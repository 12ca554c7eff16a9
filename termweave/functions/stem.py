"""Word stems: the English Snowball (Porter2) algorithm with a fixed exception map."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words never stemmed, and words whose stem is given.
BANNED = {"ares"}
EXCEPTIONS = {
    "lateralization": "lateralization",
    "lateralizations": "lateralization",
    "learning": "learning",
    "learnings": "learning",
    "organization": "organization",
    "organizations": "organization",
    "organizer": "organizer",
    "organizers": "organizer",
    "development": "development",
    "developments": "development",
    "developmental": "development",
    "developmentals": "development",
    "appropriate": "appropriate",
    "appropriates": "appropriate",
    "appropriation": "appropriate",
    "appropriations": "appropriate",
    "respondent": "respondent",
    "respondents": "respondent",
    "internalize": "internalize",
    "internalizes": "internalize",
    "operant": "operant",
    "operants": "operant",
    "operation": "operation",
    "operations": "operation",
    "accommodation": "accommodation",
    "accommodations": "accommodation",
    "compensation": "compensation",
    "compensations": "compensation",
    "preoperational": "preoperational",
    "preoperationals": "preoperational",
    "perception": "perception",
    "perceptions": "perception",
    "refugee": "refugee",
    "refugees": "refugee",
    "attention": "attention",
    "attentions": "attention",
    "reflective": "reflective",
    "reflectives": "reflective",
    "attachment": "attachment",
    "attachments": "attachment",
    "plasticity": "plasticity",
    "plasticities": "plasticity",
    "plasticitys": "plasticity",
    "generativity": "generativity",
    "generativities": "generativity",
    "generativitys": "generativity",
    "integrity": "integrity",
    "integrities": "integrity",
    "integritys": "integrity",
    "interference": "interference",
    "interferences": "interference",
    "image": "image",
    "images": "image",
    "exploration": "exploration",
    "explorations": "exploration",
    "consequence": "consequence",
    "consequences": "consequence",
    "arousal": "arousal",
    "arousals": "arousal",
    "discrimination": "discrimination",
    "discriminations": "discrimination",
    "prompt": "prompt",
    "prompts": "prompt",
    "production": "production",
    "productions": "production",
    "initiative": "initiative",
    "initiatives": "initiative",
    "conservation": "conservation",
    "conservations": "conservation",
    "experimentation": "experimentation",
    "experimentations": "experimentation",
    "instruction": "instruction",
    "instructions": "instruction",
    "instructional": "instruction",
    "instructionals": "instruction",
    "tracking": "tracking",
    "trackings": "tracking",
    "processing": "processing",
    "processings": "processing",
    "shaping": "shaping",
    "shapings": "shaping",
    "decay": "decay",
    "decays": "decay",
    "retrieval": "retrieval",
    "retrievals": "retrieval",
    "chunking": "chunking",
    "chunkings": "chunkings",
    "construction": "construction",
    "constructions": "construction",
    "transfer": "transfer",
    "transfers": "transfer",
    "aversive": "aversive",
    "aversives": "aversive",
    "being": "being",
    "beings": "being",
    "objective": "objective",
    "objectives": "objective",
    "contiguity": "contiguity",
    "contiguitys": "contiguity",
    "contiguities": "contiguity",
    "reversibility": "reversibility",
    "reversibilitys": "reversibility",
    "reversibilities": "reversibility",
    "withitness": "withitness",
    "priming": "priming",
    "primings": "priming",
    "commitment": "commitment",
    "commitments": "commitment",
    "pragmatic": "pragmatics",
    "pragmatics": "pragmatics",
    "overregularize": "overregularize",
    "overregularizes": "overregularize",
}

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
#: Fixed values of the published algorithm.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
    ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""

    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in VOWELS and word[i - 1] in VOWELS:
                return i + 1
        return len(word)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_syllable(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def porter2(word: str) -> str:
    """Stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.lstrip("'")
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    # 1b
    if word.endswith(("eed", "eedly")):
        end = "eedly" if word.endswith("eedly") else "eed"
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if word.endswith(e)), None)
        if end and _has_vowel(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(DOUBLES):
                word = word[:-1]
            elif r1 >= len(word) and _short_syllable(word):
                word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # 2
    for end, put in STEP2:
        if word.endswith(end):
            if len(word) - len(end) >= r1 and (end != "ogi" or word[-4:-3] == "l") and (end != "li" or word[-3:-2] in LI_ENDINGS):
                word = word[: -len(end)] + put
            break
    # 3
    for end, put in STEP3:
        if word.endswith(end):
            if len(word) - len(end) >= (r2 if end == "ative" else r1):
                word = word[: -len(end)] + put
            break
    # 4
    for end in STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
                word = word[: -len(end)]
            break
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """Canonical form of a word.

    Only words of one letter and at least two lower-case letters are stemmed; others,
    like "NASA" or "3.14", stay as they are, case included.
    """
    if not re.fullmatch("[a-zA-Z][a-z]{2,}", word) or word.lower() in BANNED:
        return word
    return EXCEPTIONS.get(word.lower()) or porter2(word.lower())


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_all(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: None if t is None else [stem(w) for w in t])


def lemmas(term: Column, how: str) -> Column:
    """Lemmas of an array of words: ``identity``, ``lower`` or ``stem``."""
    if how == "identity":
        return term
    if how == "lower":
        return F.transform(term, F.lower)
    if how == "stem":
        return _stem_all(term)
    raise ValueError(f"unknown lemmatizer {how!r}")
