"""Edit distance with swaps, within a bound, and folding of typed text to plain letters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that no decomposition takes apart.
PLAIN_LETTERS = {"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"}


def banded_distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours from ``a`` to ``b``; most + 1 if more.

    Only cells within ``most`` of the diagonal are computed.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or most <= 0:
        return most + 1
    far = most + 1
    before: list[int] = []
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        least = new[0]
        for j in range(low, high + 1):
            y = b[j - 1]
            d = row[j - 1] if x == y else 1 + min(row[j - 1], row[j], new[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            new[j] = d if d < far else far
            least = min(least, new[j])
        if least >= far:
            return far
        before, row = row, new
    return row[len(b)]


@F.pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    """``banded_distance`` of columns; null if either text is null."""
    return pd.Series(
        [None if x is None or y is None else banded_distance(x, y, int(m)) for x, y, m in zip(a, b, most)], dtype="Int32"
    )


@lru_cache(1 << 16)
def plain(text: str) -> str:
    """``text`` case-folded, without accents, marks and invisible characters."""
    kept = []
    for c in unicodedata.normalize("NFKD", text.casefold()):
        if not unicodedata.combining(c) and unicodedata.category(c) != "Cf":
            kept.append(PLAIN_LETTERS.get(c, c))
    return "".join(kept)


@F.pandas_udf(T.StringType())
def plain_text(text: pd.Series) -> pd.Series:
    """``plain`` of a column, once for each distinct value of a batch."""
    codes, distinct = pd.factorize(text)
    done = pd.Series([plain(x) for x in distinct] + [None], dtype=object)
    return done.iloc[codes].reset_index(drop=True)
