"""Porter's stemmer as Column expressions: what an index of stems is built with.

Rules and their order are those of the published algorithm with its author's two later changes (bli, logi). A stemmed
column is meant for distinct terms: expressions with regular expressions are interpreted once for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Suffixes of the published steps, and what takes their place
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Measures: at least one vowel-consonant sequence, exactly one, at least two; a vowel; consonant, vowel, consonant.
M1, M_IS_1, M2 = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}(?:{_V})?$", f"^(?:{_C})?{_V}{_C}{_V}{_C}"
VOWEL, SHORT = f"^(?:{_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _plural(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w)


def _ed_ing(w: Column) -> Column:
    def mended(stem: Column) -> Column:
        double = F.rlike(stem, F.lit(r"([^aeiouylsz])\1$"))
        return F.when(F.rlike(stem, F.lit("(?:at|bl|iz)$")) | F.rlike(stem, F.lit(SHORT)), F.concat(stem, F.lit("e"))).when(double, _cut(stem, 1)).otherwise(stem)

    without = lambda n: F.when(F.rlike(_cut(w, n), F.lit(VOWEL)), _let(_cut(w, n), mended)).otherwise(w)
    eed = F.when(F.rlike(_cut(w, 3), F.lit(M1)), _cut(w, 1)).otherwise(w)
    return F.when(w.endswith("eed"), eed).when(w.endswith("ed"), without(2)).when(w.endswith("ing"), without(3)).otherwise(w)


def _y(w: Column) -> Column:
    return F.when(w.endswith("y") & F.rlike(_cut(w, 1), F.lit(VOWEL)), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _suffix(w: Column, suffixes: Iterable[str], then: Callable[[Column, Column], Column]) -> Column:
    """What `then` makes of the stem and the longest suffix; the word where it has none."""
    found = F.regexp_extract(w, f"(?:{'|'.join(suffixes)})$", 0)
    return _let(found, lambda s: F.when(s == "", w).otherwise(then(F.substring(w, F.lit(1), F.length(w) - F.length(s)), s)))


def _replaced(w: Column, rules: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    return _suffix(w, rules, lambda stem, s: F.when(F.rlike(stem, F.lit(M1)), F.concat(stem, F.element_at(table, s))).otherwise(w))


def _dropped(w: Column) -> Column:
    fits = lambda stem, s: F.rlike(stem, F.lit(M2)) & ((s != "ion") | F.rlike(stem, F.lit("[st]$")))
    return _suffix(w, STEP_4, lambda stem, s: F.when(fits(stem, s), stem).otherwise(w))


def _e(w: Column) -> Column:
    stem = _cut(w, 1)
    drop = F.rlike(stem, F.lit(M2)) | (F.rlike(stem, F.lit(M_IS_1)) & ~F.rlike(stem, F.lit(SHORT)))
    return F.when(w.endswith("e") & drop, stem).otherwise(w)


def _ll(w: Column) -> Column:
    return F.when(w.endswith("ll") & F.rlike(_cut(w, 1), F.lit(M2)), _cut(w, 1)).otherwise(w)


def porter(word: Column) -> Column:
    """The stem of a lower-case word; words of two letters or fewer, and those with anything but a to z, stay as they are. Null gives null."""
    steps = [_plural, _ed_ing, _y, lambda w: _replaced(w, STEP_2), lambda w: _replaced(w, STEP_3), _dropped, _e, _ll]
    out = word
    for step in steps:
        out = _let(out, step)
    return F.when(F.rlike(word, F.lit("^[a-z]{3,}$")), out).otherwise(word)


def stems_of(spark: SparkSession, words: Iterable[str]) -> dict[str, str]:
    """Stems of a query's few words."""
    some = sorted(set(words))
    if not some:
        return {}
    return {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in some], "word string").select("word", porter(F.col("word"))).collect()}
