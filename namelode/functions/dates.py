"""Dates as feeds and people write them: partial, in several notations, not always valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month abbreviations, by number.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month_number(text: Column) -> Column:
    """1..12 for an English month name (or an abbreviation of three or more letters) or a number, else NULL."""
    low = F.lower(F.trim(text))
    by_name = F.coalesce(*(F.when(F.substring(low, 1, 3) == m, F.lit(i)) for i, m in enumerate(MONTHS, 1)))
    number = low.try_cast("int")
    named = F.when(low.rlike("^[a-z]{3,9}$"), by_name)
    return F.when(low.rlike("^[0-9]{1,2}$"), F.when(number.between(1, 12), number)).otherwise(named)


def iso_date(text: Column) -> Column:
    """A day in one notation, yyyy-MM-dd, whatever order and separators it was written in.

    2024-03-09, 2024/3/9, 20240309, 9-MAR-2024, 9 March 2024 and 09.03.2024 are the same day. Blanks
    and '' are NULL; what is no date stays as it is, in lower case, so that it compares with itself.
    """
    t = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    year_first = r"^(\d{4})[-/. ]?(\d{1,2})[-/. ]?(\d{1,2})$"
    name_mid = r"^(\d{1,2})[-/. ]+([a-z]{3,9})[-/., ]+(\d{4})$"
    day_first = r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4})$"

    def join(year: Column, month: Column, day: Column) -> Column:
        return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))

    part = lambda p, i: F.regexp_extract(t, p, i)
    by_name = month_number(part(name_mid, 2)).cast("string")
    return (
        F.when(t == "", F.lit(None).cast("string"))
        .when(t.rlike(year_first), join(part(year_first, 1), part(year_first, 2), part(year_first, 3)))
        .when(t.rlike(name_mid) & by_name.isNotNull(), join(part(name_mid, 3), by_name, part(name_mid, 1)))
        .when(t.rlike(day_first), join(part(day_first, 3), part(day_first, 2), part(day_first, 1)))
        .otherwise(t)
    )

#: Month names and their usual abbreviations.
MONTH_NAMES = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5,
    "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
# What a comparison of dates of birth adds to a score.
DOB_FULL, DOB_MONTH, DOB_YEAR, DOB_NEAR, DOB_OFF, DOB_FAR = 10, 8, 6, 3, -10, -25


def _whole(text: Column, low: int, high: int) -> Column:
    n = F.when(text.rlike(r"^[+-]?\d{1,9}$"), text.try_cast("int"))
    return F.when(n.between(low, high), n)


def _year(text: Column) -> Column:
    return F.when(F.octet_length(text) == 4, _whole(text, 1000, 9999))


def _month(text: Column) -> Column:
    named = F.create_map(*(F.lit(x) for pair in MONTH_NAMES.items() for x in pair))[F.lower(text)]
    return F.coalesce(named, _whole(text, 1, 12))


def _partial(year: Column, month: Column, day: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return F.struct(zero(year).alias("y"), zero(month).alias("m"), zero(day).alias("d"))


def partial_date(day: Column, month: Column, year: Column) -> Column:
    """A struct (y, m, d) of a feed's three columns, 0 for what is absent or no such value.

    Without a valid year the whole date is absent, NULL.
    """
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    y = _year(clean(year))
    return F.when(y.isNotNull(), _partial(y, _month(clean(month)), _whole(clean(day), 1, 31)))


def parse_partial_date(text: Column) -> Column:
    """A struct (y, m, d) of a date as it is typed; NULL if it is none or its order can't be told.

    A year, a year and a month in either order, year-month-day, and day-month-year with the month as a
    word. Parts are divided by - / . or blanks; the calendar isn't checked.
    """
    parts = F.filter(F.split(F.trim(text), r"[-/. ]"), lambda p: p != "")
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
    n, none = F.size(parts), F.lit(None).cast("int")
    first, last = _year(a), _year(c)
    word = b.rlike("^[A-Za-z]+$")
    return (
        F.when((n == 1) & first.isNotNull(), _partial(first, none, none))
        .when((n == 2) & first.isNotNull() & _month(b).isNotNull(), _partial(first, _month(b), none))
        .when((n == 2) & first.isNull() & _year(b).isNotNull() & _month(a).isNotNull(), _partial(_year(b), _month(a), none))
        .when((n == 3) & first.isNotNull() & _month(b).isNotNull() & _whole(c, 1, 31).isNotNull(), _partial(first, _month(b), _whole(c, 1, 31)))
        .when((n == 3) & first.isNull() & last.isNotNull() & word & _month(b).isNotNull() & _whole(a, 1, 31).isNotNull(),
              _partial(last, _month(b), _whole(a, 1, 31)))
    )


def format_partial_date(date: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD; '' for an absent date."""
    y, m, d = date["y"], date["m"], date["d"]
    return (
        F.when(date.isNull() | (y == 0), "")
        .when(m == 0, F.format_string("%04d", y))
        .when(d == 0, F.format_string("%04d-%02d", y, m))
        .otherwise(F.format_string("%04d-%02d-%02d", y, m, d))
    )


def dob_comparison(query: Column, date: Column) -> Column:
    """A struct (adjustment, status) of a date of birth against a recorded one, both (y, m, d)."""
    gap = F.abs(query["y"] - date["y"])
    both_m, both_d = (query["m"] > 0) & (date["m"] > 0), (query["d"] > 0) & (date["d"] > 0)
    differs = (gap == 0) & both_m & ((query["m"] != date["m"]) | (both_d & (query["d"] != date["d"])))
    cases = (
        (differs, DOB_OFF, "contradicted"),
        ((gap == 0) & both_m & both_d, DOB_FULL, "confirmed_exact"),
        ((gap == 0) & both_m, DOB_MONTH, "confirmed_month"),
        (gap == 0, DOB_YEAR, "confirmed_year"),
        (gap == 1, DOB_NEAR, "near"),
        (gap <= 3, DOB_OFF, "contradicted"),
        (gap > 3, DOB_FAR, "contradicted"),
    )
    return F.coalesce(
        *(F.when(when, F.struct(F.lit(n).alias("adjustment"), F.lit(status).alias("status"))) for when, n, status in cases)
    )


def compare_dob(query: Column, dates: Column) -> Column:
    """A struct (adjustment, status, matched) of the best of several dates of birth; the first of equals.

    Status 'unavailable' and 0 without any date.
    """
    usable = F.filter(dates, lambda d: d.isNotNull() & (d["y"] > 0))
    ranked = F.transform(
        usable, lambda d, i: F.struct(dob_comparison(query, d)["adjustment"].alias("n"), (-i).alias("i"), d.alias("d"))
    )
    best = F.array_max(ranked)
    return F.struct(
        F.coalesce(best["n"], F.lit(0)).alias("adjustment"),
        F.when(best.isNull(), "unavailable").otherwise(dob_comparison(query, best["d"])["status"]).alias("status"),
        format_partial_date(best["d"]).alias("matched"),
    )
