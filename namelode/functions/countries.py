"""Countries by code, name or usual code, and what citizenship adds to a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namelode.functions.lexicon import COUNTRY_CODES

# What citizenship adds to or takes from a score.
CITIZENSHIP_MATCH, CITIZENSHIP_MISMATCH = 6, -12


def country_key(text: Column) -> Column:
    """The ASCII letters and digits of ``text`` in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def country_index(reference: DataFrame) -> DataFrame:
    """(key, code): every way a listed country may be given: its code, its name, its usual codes.

    Codes come before names and names before usual codes where two would share a key; empty keys are left
    out. Null names have only their code.
    """
    listed = reference.select(F.upper(F.trim("code")).alias("code"), "name").filter(F.coalesce("code", F.lit("")) != "")
    usual = reference.sparkSession.createDataFrame(
        [(alias, name) for name, aliases in COUNTRY_CODES.items() for alias in aliases], "alias string, country string"
    )
    by_code = listed.select(country_key(F.col("code")).alias("key"), "code", F.lit(1).alias("rank"))
    by_name = listed.select(country_key(F.col("name")).alias("key"), "code", F.lit(0).alias("rank"))
    by_alias = usual.join(listed, country_key(F.col("country")) == country_key(F.col("name"))).select(
        country_key(F.col("alias")).alias("key"), "code", F.lit(2).alias("rank")
    )
    first = Window.partitionBy("key").orderBy("rank", "code")
    return (
        by_code.unionByName(by_name)
        .unionByName(by_alias)
        .filter(F.coalesce("key", F.lit("")) != "")
        .withColumn("n", F.row_number().over(first))
        .filter("n = 1")
        .select("key", "code")
    )


def resolve_countries(values: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """``values`` with ``resolved_code``: the code of the country in ``column``, '' if it is none of the index."""
    named = index.select(F.col("key").alias("_key"), F.col("code").alias("resolved_code"))
    joined = values.join(named, country_key(F.col(column)) == F.col("_key"), "left").drop("_key")
    return joined.withColumn("resolved_code", F.coalesce("resolved_code", F.lit("")))


def compare_citizenship(query: Column, record: Column) -> Column:
    """A struct (adjustment, status, matched) of two lists of codes: any in common confirms.

    'unavailable' and 0 without codes of the record, 'unresolved' and 0 without any of the query.
    """
    wanted = F.filter(query, lambda c: c != "")
    hit = F.try_element_at(F.filter(wanted, lambda c: F.array_contains(record, c)), F.lit(1))
    without = F.coalesce(F.size(record), F.lit(0)) <= 0
    unresolved = F.size(wanted) == 0
    return F.struct(
        F.when(unresolved | without, 0).when(hit.isNotNull(), CITIZENSHIP_MATCH).otherwise(CITIZENSHIP_MISMATCH).alias("adjustment"),
        F.when(unresolved, "unresolved").when(without, "unavailable").when(hit.isNotNull(), "confirmed").otherwise("contradicted").alias("status"),
        F.when(unresolved | without, "").when(hit.isNotNull(), hit).otherwise(F.array_join(record, ",")).alias("matched"),
    )
