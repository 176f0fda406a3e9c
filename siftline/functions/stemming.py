"""English stems by suffix rules, and the words that carry no meaning in a search.

A step is a list of (test, pattern, replacement): the first rule whose test the word passes
decides, and its replacement is made if its pattern holds too.  Regular expressions stay
within what every engine has (no look-around, no back-reference in a pattern), so the same
table can be run by another engine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# English stop words of full-text search.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)

_R1 = "^([^aeiouy]*[aeiouy]+[^aeiouy].*)"
_R2 = "^([^aeiouy]*[aeiouy]+[^aeiouy][^aeiouy]*[aeiouy]+[^aeiouy].*)"
_VOWEL = "^(.*[aeiouy].*)"


def _in(region: str, *pairs: str) -> list[tuple[str, str, str]]:
    """Rules ``suffix>replacement`` that hold in a region of the word."""
    return [(f"{old}$", f"{region}{old}$", rf"\1{new}") for old, new in (p.split(">") for p in pairs)]


# Suffix rules of the English stemmer, in order.  Y is a y that stands for a consonant, ~ a place where an ending was taken.
STEPS: tuple[list[tuple[str, str, str]], ...] = (
    [("^y", "^y", "Y")],
    [("[aeiouy]y", "([aeiouy])y", r"\1Y")],
    [("sses$", "sses$", "ss"), ("^..+ie[ds]$", "ie[ds]$", "i"), ("ie[ds]$", "ie[ds]$", "ie"), ("[us]s$", "~", ""), ("s$", "^(.*[aeiouy].+)s$", r"\1")],
    _in(_R1, "eedly>ee", "eed>ee") + _in(_VOWEL, "ingly>~", "edly>~", "ing>~", "ed>~"),
    [("(at|bl|iz)~$", "~$", "e"), ("(bb|dd|ff|gg|mm|nn|pp|rr|tt)~$", ".~$", ""), ("^([^aeiouy]+[aeiouy][^aeiouywxY]|[aeiouy][^aeiouy])~$", "~$", "e"), ("~$", "~$", "")],
    [("[yY]$", "^(.+[^aeiouy])[yY]$", r"\1i")],
    _in(_R1, "ization>ize", "ational>ate", "fulness>ful", "ousness>ous", "iveness>ive", "tional>tion", "biliti>ble", "lessli>less", "entli>ent", "ation>ate", "alism>al", "aliti>al", "ousli>ous", "iviti>ive", "fulli>ful",
        "enci>ence", "anci>ance", "abli>able", "izer>ize", "ator>ate", "alli>al", "bli>ble") + [("ogi$", _R1 + "logi$", r"\1log"), ("li$", "^([^aeiouy]*[aeiouy]+[^aeiouy].*[cdeghkmnrt]|[^aeiouy]*[aeiouy]+[cdghkmnrt])li$", r"\1")],
    _in(_R1, "ational>ate", "tional>tion", "alize>al", "icate>ic", "iciti>ic") + _in(_R2, "ative>") + _in(_R1, "ical>ic", "ness>", "ful>"),
    _in(_R2, "ement>", "ance>", "ence>", "able>", "ible>", "ment>", "ant>", "ent>", "ism>", "ate>", "iti>", "ous>", "ive>", "ize>") + [("ion$", "^([^aeiouy]*[aeiouy]+[^aeiouy][^aeiouy]*[aeiouy]+[^aeiouy].*[st]|[^aeiouy]*[aeiouy]+[^aeiouy][^aeiouy]*[aeiouy]+[st])ion$", r"\1")] + _in(_R2, "al>", "er>", "ic>"),
    [(_R2 + "e$", "e$", ""), ("([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])e$", "~", ""), (_R1 + "e$", "e$", ""), (_R2 + "ll$", "l$", ""), ("^[^aeiouy]*[aeiouy]+[^aeiouy][^aeiouy]*[aeiouy]+ll$", "l$", "")],
    [("Y", "Y", "y")],
)

_COMPILED = [[(re.compile(t), re.compile(p), r) for t, p, r in step] for step in STEPS]
_PLAIN = re.compile("^[a-z]{3,}$")


@lru_cache(1 << 18)
def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters and words with other characters than a-z stay."""
    if not _PLAIN.match(word):
        return word
    for step in _COMPILED:
        for test, pattern, replacement in step:
            if test.search(word):
                word = pattern.sub(replacement, word)
                break
    return word


@F.pandas_udf(StringType())
def stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in words:
        yield s.map(lambda w: None if w is None else stem(w))
