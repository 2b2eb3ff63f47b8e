"""Names in one form: folding, tokens, articles, skeletons, transliteration. All columns stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from namelode.functions import lexicon as lex

SPACE = r"\p{IsWhite_Space}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is written and computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _cased(col: Column) -> Column:
    # letters whose lower case depends on their neighbours or grows, mapped one to one
    return F.lower(F.translate(col, "Σİ", "σi"))


def _folded(col: Column) -> Column:
    fold = F.translate(_cased(col), "".join(lex.ARABIC_FOLD), "".join(lex.ARABIC_FOLD.values()))
    kept = F.regexp_replace(F.regexp_replace(fold, lex.ARABIC_MARKS, ""), rf"[^\p{{L}}\p{{Nd}}{SPACE}]", "")
    return F.regexp_replace(F.regexp_replace(kept, f"{SPACE}+", " "), "^ | $", "")


def _joined_compounds(tokens: Column) -> Column:
    """Tokens with a compound's first half put before its second, over an article between them."""
    size = F.size(tokens)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"))

    def step(state: Column, i: Column) -> Column:
        here, after = F.get(tokens, i), F.get(tokens, i + 1)
        opens = here.isin(*lex.COMPOUND_PREFIXES) & (i + 1 < size)
        three = after.isin(*lex.ARTICLES) & (i + 2 < size)
        text = F.when(opens & three, F.concat(here, after, F.get(tokens, i + 2))).when(opens, F.concat(here, after)).otherwise(here)
        skip = F.when(opens & three, 2).when(opens, 1).otherwise(0)
        passed = state["skip"] > 0
        out = F.when(passed, state["out"]).otherwise(F.array_append(state["out"], text))
        return F.struct(out.alias("out"), F.when(passed, state["skip"] - 1).otherwise(skip).alias("skip"))

    joined = F.aggregate(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), start, step, lambda s: s["out"])
    return F.when(F.exists(tokens, lambda t: t.isin(*lex.COMPOUND_PREFIXES)), joined).otherwise(tokens)


def normalize(col: Column) -> Column:
    """A name in one form: lower case, Arabic letters folded, only letters, digits and single blanks.

    Other characters vanish without leaving a blank; compound given names are one word. NULL stays NULL, a
    name of nothing else is ''.
    """
    return F.array_join(let(F.split(_folded(col), " "), _joined_compounds), " ")


def tokenize(normalized: Column) -> Column:
    """The words of a normalised name; none for ''."""
    return F.filter(F.split(normalized, " "), lambda t: t != "")


@lru_cache(4096)
def normalize_text(text: str) -> str:
    """``normalize`` of one text, for word lists and request values."""
    low = "".join({"Σ": "σ", "İ": "i"}.get(c, c) for c in text).lower()
    low = "".join(lex.ARABIC_FOLD.get(c, c) for c in low)
    low = re.sub(lex.ARABIC_MARKS, "", low)
    words = "".join(c for c in low if c.isalpha() or c.isdecimal() or c.isspace()).split()
    out, i = [], 0
    while i < len(words):
        n = 1
        if words[i] in lex.COMPOUND_PREFIXES and i + 1 < len(words):
            n = 3 if words[i + 1] in lex.ARTICLES and i + 2 < len(words) else 2
        out.append("".join(words[i : i + n]))
        i += n
    return " ".join(out)


def normal_set(words: tuple[str, ...]) -> tuple[str, ...]:
    """A word list in the form that tokens have."""
    return tuple(dict.fromkeys(n for n in map(normalize_text, words) if n))


CONNECTORS = normal_set(lex.NAME_CONNECTORS)
ENTITY_NOISE = normal_set(lex.ENTITY_NOISE)


def strip_article(token: Column) -> Column:
    """A word of five letters or more without its leading article."""
    return F.when(
        (F.length(token) >= 5) & F.substring(token, 1, 2).isin(*lex.JOINED_ARTICLES), F.substring(token, 3, 1 << 30)
    ).otherwise(token)


def article_variant(token: Column) -> Column:
    """The normalised word without its article if it has one, else ''."""
    return let(normalize(token), lambda plain: let(strip_article(plain), lambda bare: F.when(bare == plain, "").otherwise(bare)))


def skeleton(token: Column) -> Column:
    """The consonants of an ASCII word, repeated ones once; '' for other scripts."""
    bones = F.regexp_replace(F.regexp_replace(token, "[aeiouy]", ""), r"(.)\1+", "$1")
    return F.when(token.rlike(r"^[\x00-\x7F]*$"), bones).otherwise("")


def short_filtered(tokens: Column) -> Column:
    """Words of two letters or more."""
    return F.filter(tokens, lambda t: F.length(t) >= 2)


def without_connectors(tokens: Column) -> Column:
    """Words that are no connectors or titles, unless fewer than two would be left."""
    return let(F.filter(tokens, lambda t: ~t.isin(*CONNECTORS)), lambda kept: F.when(F.size(kept) < 2, tokens).otherwise(kept))


def content_tokens(tokens: Column) -> Column:
    """The words that identify: no initials and connectors, but never none."""
    return let(short_filtered(tokens), lambda longer: F.when(F.size(longer) == 0, tokens).otherwise(without_connectors(longer)))


def is_arabic(col: Column) -> Column:
    """Whether the text has an Arabic character."""
    return col.rlike("[\\u0600-\\u06FF]")


def _with_vowels(latin: Column) -> Column:
    """An 'a' after each consonant that another follows, but for digraphs and behind a vowel."""
    return let(F.split(latin, ""), _vowelled)


def _vowelled(letters: Column) -> Column:
    size = F.size(letters)
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("before"))
    vowel = lambda c: c.isin("a", "e", "i", "o", "u")
    consonant = lambda c: c.rlike(r"^\p{L}$") & ~vowel(c)

    def step(state: Column, i: Column) -> Column:
        here, after = F.get(letters, i), F.coalesce(F.get(letters, i + 1), F.lit(" "))
        digraph = here.isin("k", "s", "t", "d", "g") & (after == "h")
        insert = (i + 1 < size) & consonant(here) & consonant(after) & ~digraph & ~vowel(state["before"])
        return F.struct(
            F.concat(state["out"], here, F.when(insert, "a").otherwise("")).alias("out"),
            F.when(insert, F.lit("a")).otherwise(here).alias("before"),
        )

    return F.aggregate(F.sequence(F.lit(0), size - 1), start, step, lambda s: s["out"])


def transliterate(col: Column) -> Column:
    """Arabic text in Latin letters with short vowels between consonants; other text unchanged."""
    single = {k: v for k, v in lex.ARABIC_LATIN.items() if len(v) == 1}
    text = F.regexp_replace(col, "[\\u064B-\\u065F]", "")
    for letter, latin in lex.ARABIC_LATIN.items():
        if len(latin) != 1:
            text = F.replace(text, F.lit(letter), F.lit(latin))
    text = F.translate(text, "".join(single), "".join(single.values()))
    text = F.regexp_replace(F.regexp_replace(text, SPACE, " "), r"[^\p{L}\p{Nd} ]", "")
    return F.when(is_arabic(col), let(F.trim(text), _with_vowels)).otherwise(col)
