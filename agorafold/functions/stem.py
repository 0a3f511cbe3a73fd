"""Text search by English word forms: stems by Porter's second algorithm, without stop words.

One word is stemmed at a time in plain Python inside tasks; nothing but the
word is looked at, so other languages' words are only cut where they end like
English ones.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Stop words, and the words and endings that the published algorithm names.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
DONE_EARLY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_VOWEL = "aeiouy"
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions of a word begin in which endings may be cut."""
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if start is None:
        m = _REGION.search(word)
        start = m.end() if m else len(word)
    m = _REGION.search(word, start)
    return start, m.end() if m else len(word)


def _ending(word: str, endings) -> str | None:
    """The longest of some endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _has_vowel(part: str) -> bool:
    return any(c in _VOWEL for c in part)


@functools.lru_cache(maxsize=65_536)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    word = word.removeprefix("'")
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    for e in ("'s'", "'s", "'"):
        if word.endswith(e):
            word = word[: -len(e)]
            break
    # Plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in DONE_EARLY:
        return word
    # Past and continuous forms.
    e = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        word = word[: -len(e)] + "ee" if len(word) - len(e) >= r1 else word
    elif e and _has_vowel(word[: -len(e)]):
        word = word[: -len(e)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT_END.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    # Longer endings.
    e = _ending(word, [*STEP_2, "ogi", "li"])
    if e and len(word) - len(e) >= r1:
        before = word[: -len(e)]
        if e == "ogi":
            word = before + "og" if before.endswith("l") else word
        elif e == "li":
            word = before if before[-1:] and before[-1] in "cdeghkmnrt" else word
        else:
            word = before + STEP_2[e]
    e = _ending(word, [*STEP_3, "ative"])
    if e == "ative":
        word = word[: -len(e)] if len(word) - len(e) >= r2 else word
    elif e and len(word) - len(e) >= r1:
        word = word[: -len(e)] + STEP_3[e]
    e = _ending(word, [*STEP_4, "ion"])
    if e and len(word) - len(e) >= r2 and (e != "ion" or word[: -len(e)].endswith(("s", "t"))):
        word = word[: -len(e)]
    if word.endswith("e"):
        at = len(word) - 1
        word = word[:-1] if at >= r2 or (at >= r1 and not _SHORT_END.search(word[:-1])) else word
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def lexemes(text: str | None) -> list[str]:
    """The stems of a text's words, each once, in order, without stop words."""
    words = (w for w in _WORD.findall((text or "").lower()) if w not in STOP)
    return sorted({s for s in map(stem, words) if s})


def with_lexemes(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """``rows`` with the lexemes of a text."""
    schema = StructType([*rows.schema.fields, StructField(name, ArrayType(StringType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([lexemes(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], name])

    return rows.select("*", text.alias("__text")).mapInArrow(read, schema)


def has_all(found: str, query: str) -> Column:
    """True where an array of lexemes has all of a query's; a query of stop words alone finds nothing."""
    wanted = lexemes(query)
    return F.forall(F.array(*map(F.lit, wanted)), lambda w: F.array_contains(found, w)) if wanted else F.lit(False)
