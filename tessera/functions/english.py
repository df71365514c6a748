"""English text search: lexemes with positions, and two ranks of a text for a conjunction of lexemes.

A word is a run of letters and digits, lower-cased and stemmed by the Porter2 rules; stop words are dropped but take positions.
Positions end at MOST_POSITION and a lexeme keeps MOST_PLACES of them. All weights are that of plain text.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

MOST_POSITION, MOST_PLACES = 16383, 255
WEIGHT = 0.1
LEXEMES = ArrayType(StructType([StructField("lexeme", StringType()), StructField("places", ArrayType(IntegerType()))]))

#: Stop words of English full-text search. Fixed values.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
#: Words with stems of their own, and words that stay. Fixed values.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
#: Words that stay once their plural ending is gone. Fixed values.
LATE_INVARIANT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Endings and what replaces them, within the first and second region. Fixed values.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_VOWEL = "aeiouy"
_SHORT_END = re.compile(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def region(word: str, start: int) -> int:
    """Where what follows the first non-vowel behind a vowel begins, from start on."""
    m = re.compile(r"[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) < 3 or word in INVARIANT:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    prefix = re.match("gener|commun|arsen", w)
    one = prefix.end() if prefix else region(w, 0)
    two = region(w, one)
    ends = lambda *x: max((s for s in x if w.endswith(s)), key=len, default=None)
    short = lambda s: len(s) <= one and _SHORT_END.search(s)

    found = ends("sses", "ied", "ies", "us", "ss", "s")
    if found == "sses":
        w = w[:-2]
    elif found in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif found == "s" and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in LATE_INVARIANT:
        return w
    found = ends("eed", "eedly", "ed", "edly", "ing", "ingly")
    if found in ("eed", "eedly"):
        if len(w) - len(found) >= one:
            w = w[: -len(found)] + "ee"
    elif found and re.search("[aeiouy]", w[: -len(found)]):
        w = w[: -len(found)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    found = ends(*SECOND)
    if found and len(w) - len(found) >= one and not (found == "ogi" and not w.endswith("logi")) and not (found == "li" and w[-3:-2] not in set("cdeghkmnrt")):
        w = w[: -len(found)] + SECOND[found]
    found = ends(*THIRD)
    if found and len(w) - len(found) >= (two if found == "ative" else one):
        w = w[: -len(found)] + THIRD[found]
    found = ends(*FOURTH)
    if found and len(w) - len(found) >= two and not (found == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(found)]
    if w.endswith("e") and (len(w) - 1 >= two or (len(w) - 1 >= one and not _SHORT_END.search(w[:-1]))) or (w.endswith("l") and len(w) - 1 >= two and w[-2:-1] == "l"):
        w = w[:-1]
    return w.replace("Y", "y")


def lexeme_places(text: str) -> dict[str, list[int]]:
    """Lexemes of a text with their positions, in order of first occurrence."""
    out: dict[str, list[int]] = {}
    for at, m in enumerate(re.finditer(r"[^\W_]+", text.lower()), 1):
        if m[0] not in STOP:
            places = out.setdefault(stem(m[0]), [])
            if len(places) < MOST_PLACES and (not places or places[-1] < MOST_POSITION):
                places.append(min(at, MOST_POSITION))
    return out


@F.pandas_udf(LEXEMES)
def lexemes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"lexeme": k, "places": v} for k, v in lexeme_places(t or "").items()])


def cover_density(places: list[list[int]]) -> float:
    """Rank by covers: shortest stretches that hold every lexeme, each worth more the fewer other words stand in it."""
    line = sorted((p, k) for k, own in enumerate(places) for p in own)
    total, begin = 0.0, 0
    while True:
        met: set[int] = set()
        end = None
        for at in range(begin, len(line)):
            met.add(line[at][1])
            if len(met) == len(places):
                end = at
                break
        if end is None:
            return total
        met.clear()
        start = end
        for at in range(end, begin - 1, -1):
            met.add(line[at][1])
            start = at
            if len(met) == len(places):
                break
        noise = line[end][0] - line[start][0] - (end - start)
        total += WEIGHT / (1 + (noise if noise >= 0 else (end - start) // 2))
        begin = start + 1


def nearness(places: list[list[int]]) -> float:
    """Rank by pairs of lexemes, each pair of places worth more the nearer they are; for one lexeme by its number of places."""
    if len(places) == 1:
        falling = sum(WEIGHT / (k + 1) ** 2 for k in range(len(places[0])))
        return falling / 1.64493406685
    result = None
    for i in range(len(places)):
        for k in range(i):
            for a in places[i]:
                for b in places[k]:
                    distance = abs(a - b) or MOST_POSITION
                    near = 1e-30 if distance > 100 else 1.0 / (1.005 + 0.05 * math.exp(distance / 1.5 - 2))
                    worth = math.sqrt(WEIGHT * WEIGHT * near)
                    result = worth if result is None else 1.0 - (1.0 - result) * (1.0 - worth)
    return 1e-20 if result is None else result


@F.pandas_udf(DoubleType())
def rank_by_covers(places: pd.Series) -> pd.Series:
    return places.map(lambda x: round(cover_density([list(p) for p in x]), 9))


@F.pandas_udf(DoubleType())
def rank_by_nearness(places: pd.Series) -> pd.Series:
    return places.map(lambda x: round(nearness([list(p) for p in x]), 9))
