"""Secondary identifiers: dates of birth and citizenships of records, and what they do to a score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelode.functions.countries import compare_citizenship
from namelode.functions.dates import compare_dob, partial_date


def birth_dates(dates: DataFrame) -> DataFrame:
    """(record_id, dob_dates): the valid dates of birth of each record, by id."""
    rows = dates.filter("date_type = 'Date of Birth'").select(
        "record_id", "id", partial_date(F.col("day"), F.col("month"), F.col("year")).alias("d")
    )
    return rows.filter("d is not null").groupBy("record_id").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("id", "d"))), lambda x: x["d"]).alias("dob_dates")
    )


def citizenships(countries: DataFrame) -> DataFrame:
    """(record_id, citizenships): the distinct codes of each record's citizenships and nationalities, by id."""
    rows = countries.filter(F.col("country_type").isin("Citizenship", "Nationality") & (F.coalesce("country_code", F.lit("")) != ""))
    first = rows.groupBy("record_id", "country_code").agg(F.min("id").alias("id"))
    return first.groupBy("record_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "country_code"))), lambda x: x["country_code"]).alias("citizenships")
    )


def with_factors(scored: DataFrame, dates: DataFrame, countries: DataFrame) -> DataFrame:
    """``scored`` (record_id, query_dob, query_codes, ...) with dob, citizenship and their sum ``adjustment``.

    A factor counts where the query supplies it: query_dob is a partial date or null, query_codes a list of
    codes (empty: supplied but none known) or null. Only identifiers of the scored records are gathered.
    """
    wanted = scored.select("record_id").distinct()
    born = birth_dates(dates.join(wanted, "record_id", "left_semi"))
    lands = citizenships(countries.join(wanted, "record_id", "left_semi"))
    rows = scored.join(born, "record_id", "left").join(lands, "record_id", "left")
    dob = F.when(F.col("query_dob").isNotNull(), compare_dob(F.col("query_dob"), F.coalesce("dob_dates", F.array().cast("array<struct<y:int,m:int,d:int>>"))))
    land = F.when(F.col("query_codes").isNotNull(), compare_citizenship(F.col("query_codes"), F.col("citizenships")))
    both = rows.withColumn("dob", dob).withColumn("citizenship", land)
    total = F.coalesce(F.col("dob.adjustment"), F.lit(0)) + F.coalesce(F.col("citizenship.adjustment"), F.lit(0))
    return both.withColumn("adjustment", total).drop("dob_dates", "citizenships")
