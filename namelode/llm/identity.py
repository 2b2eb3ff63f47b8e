"""What a record says about who it is, and whether two records say the same."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namelode.llm.distance import banded_distance, plain
from namelode.llm.lookalike import PLAIN_ASCII, one_form

#: Small words of names that are written or left out at will.
PARTICLES = ["al", "el", "bin", "bint", "ibn", "abu", "de", "del", "van", "von", "der", "the", "of", "and", "jr", "sr", "ii", "iii"]
#: Legal forms of organisations.
LEGAL_FORMS = ["llc", "ltd", "limited", "gmbh", "company", "co", "corp", "corporation", "inc", "plc", "pjsc", "fze", "sa", "bv",
               "ag", "nv", "oy", "srl", "liability", "ооо", "ао", "пао", "зао", "группа", "компания", "شركة", "مجموعة"]
#: Usual abbreviations in organisations' names.
ABBREVIATIONS = {"log": "logistics", "trdg": "trading", "elec": "electronics", "hldgs": "holdings", "constr": "construction",
                 "inv": "investments", "chem": "chemicals", "shpg": "shipping", "mach": "machinery", "cons": "consulting",
                 "gen": "general", "contr": "contracting", "petrol": "petroleum", "imp": "import", "exp": "export",
                 "intl": "international", "bros": "brothers", "mfg": "manufacturing", "svcs": "services"}
#: Particles that are also written as one with the word behind them.
JOINED = ("bin", "al", "el", "ibn", "abu")
#: Endings that turn the beginning of a given name into a familiar form.
FAMILIAR = ("chik", "ie", "ko", "i", "o", "y")


#: Cyrillic and Arabic letters as Latin ones; letters of no sound give ''.
LATIN_LETTERS = {"а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "є": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i",
                 "і": "i", "ї": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
                 "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "", "ы": "i", "ь": "", "э": "e",
                 "ю": "iu", "я": "ia", "ا": "a", "أ": "a", "إ": "i", "آ": "a", "ى": "i", "ي": "i", "ی": "i", "ئ": "i", "ب": "b", "پ": "p",
                 "ت": "t", "ة": "a", "ث": "th", "ج": "j", "چ": "ch", "ح": "h", "خ": "kh", "د": "d", "ذ": "d", "ر": "r", "ز": "z", "ژ": "zh",
                 "س": "s", "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "a", "غ": "g", "ف": "f", "ق": "k", "ك": "k", "ک": "k",
                 "گ": "g", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "u", "ؤ": "u", "ء": "", "ـ": ""}
_TO_LATIN = str.maketrans(LATIN_LETTERS)


@F.pandas_udf(T.StringType())
def _plain_form(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def latin(text: str | None) -> str:
        words = [w for w in re.split(r"[\W_]+", plain(one_form(text))) if w not in _UNNAMED]
        return " ".join(words).translate(_TO_LATIN)

    for series in values:
        codes, distinct = pd.factorize(series)
        done = pd.Series([latin(v) for v in distinct] + [None], dtype=object)
        yield done.iloc[codes].reset_index(drop=True)


#: Letters that writers of a name take for one another, in order of replacement.
SOUNDS = (("ph", "f"), ("th", "t"), ("ck", "k"), ("c(?!h)", "k"), ("q", "k"), ("w", "v"), ("y", "i"), ("ou|oo", "u"), (r"(.)\1+", "$1"))
_UNNAMED = frozenset(PARTICLES + LEGAL_FORMS)


def as_heard(word: Column) -> Column:
    """``word`` with letters that sound alike written one way, and doubled letters once."""
    for pattern, letter in SOUNDS:
        word = F.regexp_replace(word, pattern, letter)
    return word


def plain_words(text: Column, drop: list[str]) -> Column:
    """The words of ``text`` in plain Latin letters as they sound, without those to ``drop``; [''] for none.

    Usual abbreviations are written out; single letters stay, as initials.
    """
    ascii_only = text.rlike(PLAIN_ASCII)
    low = F.when(ascii_only, F.lower(text)).otherwise(_plain_form(F.when(~ascii_only, text)))
    words = F.split(F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), " ")
    kept = F.filter(words, lambda w: ~w.isin(drop))
    whole = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    return F.split(as_heard(F.array_join(F.transform(kept, lambda w: F.coalesce(whole[w], w)), " ")), " ")


def _years(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)(1[89]\d\d|20\d\d)(?!\d)"), 0)
    return F.transform(found, lambda y: y.cast("int"))


def listed_codes(countries: DataFrame) -> DataFrame:
    """(record_id, code): country codes as stored, without blanks, punctuation and case."""
    code = F.upper(F.regexp_replace("country_code", r"[^\p{L}\p{N}]", ""))
    return countries.select("record_id", code.alias("code")).filter(F.coalesce("code", F.lit("")) != "")


def name_bags(names: DataFrame) -> DataFrame:
    """(record_id, id, primary, script, bag): the words of every name row, the original script as a row of its own.

    A row's words come from its name parts, else the single string, else the entity name; maiden names give none.
    Organisations have no initials. Rows without words, and words without letters, are left out.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    parts = F.concat_ws(" ", "first_name", "middle_name", "surname")
    text = F.coalesce(
        F.when(filled("entity_name"), F.col("entity_name")),
        F.when(filled("surname") | filled("middle_name"), parts),
        F.when(filled("single_string_name"), F.col("single_string_name")),
        F.when(filled("first_name") & ~filled("maiden_name"), F.col("first_name")),
    )
    rows = names.filter(F.col("record_id").isNotNull() & (F.coalesce("name_type", F.lit("")) != "Maiden Name"))
    written = F.array(F.struct(text.alias("text"), F.lit(False).alias("script")), F.struct(F.col("original_script_name").alias("text"), F.lit(True).alias("script")))
    each = rows.select(
        "record_id",
        "id",
        (F.coalesce("name_type", F.lit("")) == "Primary Name").alias("primary"),
        filled("entity_name").alias("of_entity"),
        F.explode(written).alias("w"),
    ).filter(F.coalesce("w.text", F.lit("")) != "")
    words = plain_words(F.col("w.text"), PARTICLES + LEGAL_FORMS)
    kept = F.filter("words", lambda w: (w != "") & (~F.col("of_entity") | (F.length(w) > 1)))
    bags = each.select("record_id", "id", "primary", "of_entity", F.col("w.script").alias("script"), words.alias("words"))
    return bags.select("record_id", "id", "primary", "script", kept.alias("bag")).filter(F.size("bag") > 0)


def profiles(records: DataFrame, names: DataFrame, dates: DataFrame, codes: DataFrame) -> DataFrame:
    """(id, official, entity, gender, main, words, bags, years, codes) of every record with a name.

    ``main`` are the words of its fullest name row (one in Latin letters, and the primary one, if several are as
    full), ``words`` those and all longer words of all its rows, ``bags`` its distinct rows, ``years`` the years of its dates of birth
    or registration. See ``name_bags``. Repeated rows add nothing; missing dates, countries or gender are empty or null.
    """
    bags = name_bags(names)
    full = F.size(F.filter("bag", lambda w: F.length(w) > 2))
    native = ~F.col("script") & (full > 1)
    main = F.max_by("bag", F.struct(native, F.least(full, F.lit(8)), ~F.col("script"), "primary", -F.col("id"))).alias("main")
    rows = F.collect_set("bag").alias("bags")
    everything = F.array_union("main", F.filter(F.flatten("bags"), lambda w: F.length(w) > 1))
    named = bags.groupBy("record_id").agg(main, rows).withColumn("words", everything)
    born = (
        dates.filter(F.col("date_type").isin("Date of Birth", "Date of Registration"))
        .select("record_id", F.explode(_years(F.col("year"))).alias("y"))
        .groupBy("record_id")
        .agg(F.array_sort(F.collect_set("y")).alias("years"))
    )
    lands = codes.groupBy("record_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    kind = F.lower(F.trim(F.coalesce("record_type", F.lit(""))))
    people = records.select(
        "id",
        F.col("custom_list_id").isNull().alias("official"),
        (kind == "entity").alias("entity"),
        F.upper(F.substring(F.trim("gender"), 1, 1)).alias("gender"),
    )
    nothing = lambda c, t: F.coalesce(F.col(c), F.array().cast(f"array<{t}>")).alias(c)
    return (
        people.join(named.withColumnRenamed("record_id", "id"), "id")
        .join(born.withColumnRenamed("record_id", "id"), "id", "left")
        .join(lands.withColumnRenamed("record_id", "id"), "id", "left")
        .select("id", "official", "entity", "gender", "main", "words", "bags", nothing("years", "int"), nothing("codes", "string"))
    )


_STEM = re.compile(f"(?<=.{{3}})({'|'.join(FAMILIAR)})$")


@lru_cache(1 << 16)
def word_likeness(a: str, b: str) -> float:
    """How alike two words are: 1 equal, 0.8 a few letters off, 0.7 a familiar form or abbreviation, 0.6 an initial,
    0.5 if half of a short word is off, else 0."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.6 if a[0] == b[0] else 0.0
    short, long = sorted((len(a), len(b)))
    most = 0 if short < 4 else 1 if short < 6 else 2
    unlike = len(set(a) ^ set(b)) > 2 * 2  # an edit changes two letters at most
    if unlike and a[:2] != b[:2] and not a.endswith(b) and not b.endswith(a):
        return 0.0
    if most and not unlike and banded_distance(a, b, most) <= most:
        return 0.8
    for particle in JOINED:
        if a == particle + b or b == particle + a:
            return 0.8
    sa, sb = _STEM.sub("", a), _STEM.sub("", b)
    if short > 2 and long - short <= 5 and (a.startswith(b) or b.startswith(a)):
        return 0.7
    if sa == sb or (sa != a or len(a) <= 4) and b.startswith(sa) or (sb != b or len(b) <= 4) and a.startswith(sb):
        return 0.7
    if 3 < short < 6 and a[0] == b[0] and not unlike and banded_distance(a, b, 2) <= 2:
        return 0.5
    return 0.0


def _swapped_year(a: int, b: int) -> bool:
    return sorted(str(a)) == sorted(str(b))


def agreement(a: dict, b: dict) -> float | None:
    """The strength (0 to 1) with which two profiles mean the same one; None if they don't.

    Every word of the fuller name of each record must be like a word of the other record, but for as many
    as the other name is shorter; two words at least must be. People of the same name are told apart by years
    and countries that both differ, organisations only by their words.
    """
    if a["entity"] != b["entity"]:
        return None

    def likeness(word: str, words: Iterable[str]) -> float:
        return 1.0 if word in words else max((word_likeness(word, w) for w in words), default=0.0)

    main_a, main_b = a["main"], b["main"]
    of_a, spare = [], max(0, len(main_a) - len(main_b))
    for w in main_a:
        of_a.append(likeness(w, b["words"]))
        if of_a.count(0.0) > spare:
            return None
    of_b = [likeness(w, a["words"]) for w in main_b]
    left_a, left_b = of_a.count(0.0), of_b.count(0.0)
    if left_b > max(0, len(main_b) - len(main_a)):
        return None
    if a["entity"] and (left_a or left_b):
        return None
    hits = min(len(main_a) - left_a, len(main_b) - left_b)
    if hits < 2:
        return None
    alike = (sum(of_a) + sum(of_b)) / (len(of_a) + len(of_b) - left_a - left_b)
    weak = 0.5 in of_a or 0.5 in of_b
    spelled = min(sum(x not in (0.0, 0.6) for x in of) for of in (of_a, of_b))
    years = bool(a["years"] and b["years"])
    lands = bool(a["codes"] and b["codes"])
    land = bool(set(a["codes"]) & set(b["codes"]))
    year = any(abs(x - y) <= 1 for x in a["years"] for y in b["years"])
    if not year and (hits > 2 or land or not lands):  # digits of a year in another order
        year = any(_swapped_year(x, y) for x in a["years"] for y in b["years"])
    if a["gender"] and b["gender"] and a["gender"] != b["gender"] and not year:
        return None
    against = (years and not year) + (lands and not land)
    if against == 2 or against and hits == 2 and not (year or land):
        return None
    if hits == 2 and not (year or land) and alike < 0.9:
        return None
    if spelled < 2 and (not spelled or against or left_a or left_b or not (year or land)):  # initials are all the rest
        return None
    if hits == 2 and len(main_a) != len(main_b) and lands and not land:
        return None
    if weak and (a["entity"] or not (year or land) or hits == 2 and not (year and land)):
        return None
    score = 0.35 * alike + 0.15 * min(1.0, hits / 3) + 0.25 * (1.0 if year else 0.0 if years else 0.5)
    score += 0.15 * (1.0 if land else 0.0 if lands else 0.5) + 0.10 * (0.0 if left_a or left_b else 1.0)
    return round(score, 4)


def no_contradiction(a: dict, b: dict) -> float | None:
    """1 unless each name has a word that is like none of the other's; for pairs matched through a third record."""
    lonely = lambda words, others: any(not any(word_likeness(w, o) for o in others) for w in words)
    strange = lonely(a["main"], b["words"]), lonely(b["main"], a["words"])
    return None if a["entity"] != b["entity"] or all(strange) or a["entity"] and any(strange) else 1.0


def each_once(ids: pa.Array, profiles: pa.Array) -> list[dict]:
    """``profiles`` as dicts; those of an id that comes again are made once."""
    _, first, at = np.unique(np.asarray(ids), return_index=True, return_inverse=True)
    made = profiles.take(pa.array(first)).to_pylist()
    return [made[i] for i in at]


def agreed(pairs: DataFrame, judge: Callable[[dict, dict], float | None] = agreement) -> DataFrame:
    """(a, b, agreement) of those ``pairs`` (a, b, pa, pb: ids and profiles) that ``judge`` doesn't reject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, len(whole), 2000)):
            strength = [judge(x, y) for x, y in zip(*(each_once(batch.column(i), batch.column(i + 2)) for i in (0, 1)))]
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(strength, pa.float64())], ["a", "b", "agreement"]
            )
            yield out.filter(pc.is_valid(out.column(2)))

    return pairs.select("a", "b", "pa", "pb").mapInArrow(run, "a bigint, b bigint, agreement double")
