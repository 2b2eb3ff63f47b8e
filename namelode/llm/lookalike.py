"""Text that looks the same brought to the same characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of other scripts that show like a Latin letter.
GREEK_AS_LATIN = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
                  "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u",
                  "κ": "k", "χ": "x", "γ": "y", "τ": "t", "η": "n", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J"}
CYRILLIC_AS_LATIN = {"А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
                     "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
                     "х": "x", "у": "y", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l",
                     "к": "k", "м": "m", "н": "h", "т": "t", "в": "b", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "ѵ": "v", "Ѵ": "V"}
ARMENIAN_AS_LATIN = {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "Տ": "S", "Լ": "L"}
#: Letters of other alphabets in Arabic script that show, within a word, like an Arabic letter.
PERSIAN_AS_ARABIC = {"ک": "ك", "ڪ": "ك", "ی": "ي", "ھ": "ه", "ہ": "ه", "ە": "ه"}
#: Letters that only those alphabets have: a word with one of them is no Arabic word.
NOT_ARABIC = "پچژگٹڈڑںے"
_LATIN_LIKE = GREEK_AS_LATIN | CYRILLIC_AS_LATIN | ARMENIAN_AS_LATIN
_CYRILLIC_LIKE = {v: k for k, v in CYRILLIC_AS_LATIN.items()} | {"i": "і", "I": "І", "s": "ѕ", "S": "Ѕ", "j": "ј", "J": "Ј"}
_ARABIC_LIKE = str.maketrans(PERSIAN_AS_ARABIC)
_GREEK_LIKE = {v: k for k, v in GREEK_AS_LATIN.items()}

_SCRIPTS = {"latin": regex.compile(r"\p{Script=Latin}"), "cyrillic": regex.compile(r"\p{Script=Cyrillic}"),
            "greek": regex.compile(r"\p{Script=Greek}"), "armenian": regex.compile(r"\p{Script=Armenian}")}
_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}")
_BLANK = regex.compile(r"[\p{White_Space}⠀ㅤﾠ]")
_WORDS = regex.compile(r"[\p{L}\p{M}]+")
_PLAIN = regex.compile(r"[\x20-\x7e]*")
#: The same test for the JVM side: only plain ASCII characters.
PLAIN_ASCII = r"^[\x20-\x7E]*$"


def _counts(word: str) -> dict[str, int]:
    return {name: len(found.findall(word)) for name, found in _SCRIPTS.items()}


def _one_script(word: str) -> str:
    """``word`` with the letters of a foreign script replaced that show like letters of its own.

    Its own script is the one of most of its letters, Latin in a tie; a word of one script, or one
    with a foreign letter that shows like none of its own, keeps that letter. In a word of Arabic script the letters of other
    alphabets that show like Arabic ones are such letters too, unless the word has one that no Arabic word has.
    """
    if any(c in PERSIAN_AS_ARABIC for c in word):
        return word if any(c in NOT_ARABIC for c in word) else word.translate(_ARABIC_LIKE)
    counts = _counts(word)
    if sum(n > 0 for n in counts.values()) < 2:
        return word
    own = max(counts, key=lambda s: (counts[s], s == "latin"))
    # when everything foreign to Latin shows like Latin, the word is a Latin one
    foreign = [c for c in word if not _SCRIPTS["latin"].match(c) and any(p.match(c) for p in _SCRIPTS.values())]
    if counts["latin"] and own != "latin" and all(c in _LATIN_LIKE for c in foreign):
        latin_only = [c for c in word if _SCRIPTS["latin"].match(c) and c not in _CYRILLIC_LIKE and c not in _GREEK_LIKE]
        if latin_only:
            own = "latin"
    table = {"latin": _LATIN_LIKE, "cyrillic": _CYRILLIC_LIKE, "greek": _GREEK_LIKE}.get(own, {})
    return "".join(c if _SCRIPTS[own].match(c) else table.get(c, c) for c in word)


def _shown(value: str) -> str:
    """``value`` in the characters it shows: compatibility composed form, blanks mapped, nothing invisible."""
    text = unicodedata.normalize("NFKC", _BLANK.sub(" ", value))
    text = _IGNORABLE.sub("", _BLANK.sub(" ", text))
    text = unicodedata.normalize("NFKC", text)
    return _WORDS.sub(lambda m: _one_script(m[0]), text)


def one_form(value: str | None) -> str | None:
    """The one form of all values that show like ``value``: also case-folded, blanks single, none outside."""
    if value is None:
        return None
    text = " ".join(_shown(value).split()).casefold()
    return unicodedata.normalize("NFKC", text)


def is_disguised(value: str | None) -> bool:
    """Whether a character of ``value`` shows like another one, as a plain blank or as nothing.

    Also a letter of several characters that exists as one. Case, plain blanks, tabs and line ends, and
    accented letters in their composed form are as they should be. Null and '' are not.
    """
    return bool(value) and not _PLAIN.fullmatch(value) and _shown(value) != _BLANK_AS_TYPED(value)


def _BLANK_AS_TYPED(value: str) -> str:  # noqa: N802
    """``value`` with tabs and line ends as blanks, which are usual characters of typed text."""
    return value.translate({9: " ", 10: " ", 13: " "})


_PER_VALUE = T.StructType([T.StructField("form", T.StringType()), T.StructField("disguised", T.BooleanType())])


@F.pandas_udf(_PER_VALUE)
def _forms(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for series in values:
        codes, distinct = pd.factorize(series)
        forms = np.array([one_form(v) for v in distinct] + [None], object)
        flags = np.array([is_disguised(v) for v in distinct] + [False], object)
        yield pd.DataFrame({"form": forms[codes], "disguised": flags[codes]})


def normalised(value: Column) -> Column:
    """A struct (form, disguised) of a text column; null gives (null, false).

    Values of plain ASCII characters are done in the JVM; only the others go to Python, where each
    distinct value of a batch is normalised once.
    """
    plain = value.rlike(PLAIN_ASCII)
    other = _forms(F.when(~plain, value))
    ascii_form = F.lower(F.trim(F.regexp_replace(value, " +", " ")))
    return F.struct(
        F.when(plain, ascii_form).otherwise(other["form"]).alias("form"),
        F.coalesce(F.when(plain, False).otherwise(other["disguised"]), F.lit(False)).alias("disguised"),
    )


FIELDS = ("original_script_name", "single_string_name", "entity_name")


def name_forms(names: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(name_id, field_name, value, form, disguised) of every non-empty value of ``fields``.

    One row for each name row and field with a value other than null and ''; a value of any length is
    normalised whole, and other columns don't matter.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields)))
    rows = names.select(F.col("id").alias("name_id"), cells.alias("c")).select("name_id", "c.field_name", "c.value")
    rows = rows.filter(F.coalesce("value", F.lit("")) != "")
    done = rows.withColumn("n", normalised(F.col("value")))
    return done.select("name_id", "field_name", "value", "n.form", "n.disguised")
