"""Screening: from searched names to ranked records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namelode.functions import scoring as sc
from namelode.functions.countries import country_index, country_key
from namelode.functions.dates import parse_partial_date
from namelode.operators.factors import with_factors
from namelode.operators.records import hydrated
from namelode.operators.retrieval import like_rows, retrieved_rows, searchable, variants
from namelode.session import durable, trimmed

# Margins and limits of the rules.
FACTOR_BOOST, ALIAS_MARGIN, ALIAS_RECORDS, FACTOR_RECORDS, RESULT_RECORDS = 16, 20, 100, 200, 50


@dataclass(frozen=True)
class Tables:
    """The tables that a screening reads."""

    records: DataFrame
    names: DataFrame
    dates: DataFrame
    countries: DataFrame
    ref_countries: DataFrame


@dataclass(frozen=True)
class Options:
    """How to screen; a min_score outside 1..100 is 50, an empty type 'individual'."""

    min_score: int = 50
    search_type: str = "individual"
    policy: str = "downweight"
    shadow: bool = False
    like_fallback: bool = False
    results: int = RESULT_RECORDS

    def normal(self) -> Options:
        score = self.min_score if 1 <= self.min_score <= 100 else 50
        return Options(score, self.search_type or "individual", "filter" if self.policy == "filter" else "downweight",
                       self.shadow, self.like_fallback, self.results)


def prepared_queries(queries: DataFrame, tables: Tables, entity: bool) -> DataFrame:
    """Queries (query_id, name[, date_of_birth, citizenship array]) with name form, date, codes and ``supplied``.

    Queries that ``rejected`` names are left out: they have no results.
    """
    have = set(queries.columns)
    text = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    rows = queries.select("query_id", "name", text("date_of_birth", "string").alias("date_of_birth"), text("citizenship", "array<string>").alias("citizenship"))
    rows = rows.join(rejected(rows), "query_id", "left_anti")
    asked = rows.select("query_id", F.posexplode("citizenship").alias("pos", "country")).filter(F.trim(F.coalesce("country", F.lit(""))) != "")
    index = country_index(tables.ref_countries)
    found = asked.join(index, country_key(F.col("country")) == F.col("key"), "left").groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("pos", "code")))), lambda x: x["code"]).alias("query_codes")
    )
    dob = parse_partial_date(F.col("date_of_birth"))
    out = rows.join(found, "query_id", "left").select("query_id", "name", sc.name_form(F.col("name"), entity).alias("q"), dob.alias("query_dob"), "query_codes")
    return out.withColumn("supplied", F.col("query_dob").isNotNull() | F.col("query_codes").isNotNull())


def heavy_words(weights: DataFrame) -> DataFrame:
    """One row with the map ``w`` of the words that weigh less than usual: held by one record in a thousand, so few by their bands."""
    return weights.filter("weight < 100").agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("w"))


def _scored(rows: DataFrame, names: DataFrame, queries: DataFrame, options: Options, weight=None) -> DataFrame:
    """(query_id, record_id, name_id, ord, matched, live, shadow) of all forms of name rows (query_id, name_id, record_id)."""
    entity = options.search_type == "entity"
    wanted = rows.select("name_id").distinct()
    forms = variants(names.join(wanted, names["id"] == wanted["name_id"], "left_semi")).select("name_id", "ord", F.col("name").alias("matched"))
    forms = forms.withColumn("c", sc.name_form(F.col("matched"), entity))
    pairs = rows.select("query_id", "name_id", "record_id").join(forms, "name_id").join(queries.select("query_id", "q"), "query_id")
    live = (sc.score_entity_forms if entity else sc.score_name_forms)(F.col("q"), F.col("c"))
    shadow = F.lit(0).cast("bigint") if not options.shadow else live if entity else sc.score_name_v2_forms(F.col("q"), F.col("c"), weight)
    return pairs.select("query_id", "record_id", "name_id", "ord", "matched", live.alias("live"), shadow.alias("shadow"))


def _best(scored: DataFrame, queries: DataFrame, options: Options) -> DataFrame:
    """One row for each query and record: its best kept name by each score, earlier rows first in a tie."""
    floor = F.when(F.col("supplied"), F.greatest(F.lit(options.min_score - FACTOR_BOOST), F.lit(0))).otherwise(options.min_score)
    rows = scored.join(queries.select("query_id", floor.alias("floor")), "query_id")
    kept = rows.filter((F.col("floor") <= 0) | (F.col("live") >= F.col("floor")) | (F.col("shadow") >= F.col("floor")))
    earlier = (-F.col("name_id"), -F.col("ord"))
    return kept.groupBy("query_id", "record_id").agg(
        F.max("live").alias("name_score"),
        F.max_by("matched", F.struct("live", *earlier)).alias("matched_name"),
        F.max("shadow").alias("shadow_score"),
        F.max_by("matched", F.struct("shadow", *earlier)).alias("shadow_name"),
    )


def _expanded(rows: DataFrame, tables_names: DataFrame, queries: DataFrame, options: Options, weight=None) -> DataFrame:
    """The scores of the retrieved rows and of all other name rows of the best records among them."""
    first = durable(_scored(rows, tables_names, queries, options, weight))
    record = first.groupBy("query_id", "record_id").agg(F.max("live").alias("best"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best"), "record_id"))
    near = record.filter(F.col("best") >= max(0, options.min_score - ALIAS_MARGIN)).withColumn("n", at).filter(F.col("n") <= ALIAS_RECORDS)
    more = near.select("query_id", "record_id").join(tables_names.select(F.col("id").alias("name_id"), "record_id"), "record_id")
    unseen = more.select("query_id", "name_id", "record_id").join(rows.select("query_id", "name_id"), ["query_id", "name_id"], "left_anti")
    return first.unionByName(_scored(unseen, tables_names, queries, options, weight))


def screen(queries: DataFrame, tables: Tables, options: Options = Options(), weights: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, record_id, matched_name, name_score, score, ...) of the records that each query may mean.

    Name rows are retrieved by their words, all forms of them scored, the records of the best ones looked at
    under all their names, and each record keeps its best name. Where a query gives a date of birth or
    citizenships, the best ``FACTOR_RECORDS`` records are adjusted by theirs. Records of ``min_score`` and more are
    ranked by score, adjustment, name score and id, and the best ``results`` of each query returned. All queries are
    answered by one plan; a query without results has no rows.
    """
    options = options.normal()
    entity = options.search_type == "entity"
    asked = durable(prepared_queries(queries, tables, entity))
    names = searchable(tables.names, tables.records, options.search_type)
    weight = None
    if weights is not None and options.shadow and not entity:
        asked = asked.join(F.broadcast(heavy_words(weights))).withColumn("q", F.col("q").withField("w", F.col("w"))).drop("w")
        weight = lambda bare: F.coalesce(F.col("q")["w"][bare], F.lit(100)).cast("bigint")
    rows = durable(retrieved_rows(asked.select("query_id", "name"), names))
    best = durable(_best(_expanded(rows, names, asked, options, weight), asked, options))
    if options.like_fallback:
        left = asked.join(best.select("query_id").distinct(), "query_id", "left_anti")
        best = best.unionByName(_best(_expanded(like_rows(left.select("query_id", "name"), names), names, left, options, weight), left, options))
    per_query = Window.partitionBy("query_id")
    ranked = best.withColumn("n", F.row_number().over(per_query.orderBy(F.desc("name_score"), "record_id")))
    ranked = ranked.join(asked.select("query_id", "query_dob", "query_codes", "supplied"), "query_id")
    judged = with_factors(ranked.filter(F.col("supplied") & (F.col("n") <= FACTOR_RECORDS)), tables.dates, tables.countries)
    rest = ranked.filter(~F.col("supplied") | (F.col("n") > FACTOR_RECORDS))
    rest = rest.select("*", *(F.lit(None).cast(judged.schema[c].dataType).alias(c) for c in ("dob", "citizenship")), F.lit(0).alias("adjustment"))
    final = judged.unionByName(rest)

    def adjusted(score: str) -> Column:
        return sc.adjusted_score(F.col(score), F.col("adjustment"), options.min_score, options.policy)

    final = final.withColumn("score", adjusted("name_score")).withColumn("shadow_final", adjusted("shadow_score"))
    if not options.shadow:
        final = final.filter(F.col("score") >= options.min_score)
    order = per_query.orderBy(F.desc("score"), F.desc("adjustment"), F.desc("name_score"), "record_id")
    out = final.withColumn("rank", F.row_number().over(order))
    if not options.shadow:
        out = out.filter(F.col("rank") <= options.results)
    return out.select("query_id", "rank", "record_id", "matched_name", "name_score", "score", "adjustment",
                      F.col("dob.status").alias("dob_status"), F.col("citizenship.status").alias("citizenship_status"), "shadow_score", "shadow_final",
                      F.lit(None).cast("string").alias("shadow_name") if not options.shadow else F.col("shadow_name"))


def rejected(queries: DataFrame) -> DataFrame:
    """(query_id, error) of the queries that can't be screened: a blank name, or a date of birth that can't be read.

    The others of a batch are screened; one with an unreadable date has no results, as it would be judged by less than it says.
    """
    blank = trimmed(F.coalesce("name", F.lit(""))) == ""
    unread = F.lit(False)
    if "date_of_birth" in queries.columns:
        given = trimmed(F.coalesce("date_of_birth", F.lit(""))) != ""
        unread = given & parse_partial_date(F.col("date_of_birth")).isNull()
    error = F.when(blank, "name is required").when(unread, "date_of_birth can't be read")
    return queries.select("query_id", error.alias("error")).filter("error is not null")


def screened_records(screened: DataFrame, tables: Tables, custom_lists: DataFrame) -> DataFrame:
    """``screened`` rows with their records as nested documents (``record``), and whether a custom list holds each.

    Only the records that a query kept are read with their children, each once however many queries name it; ids without a
    record vanish.
    """
    docs = hydrated(screened.select(F.col("record_id").alias("id")), tables.records, custom_lists, tables.names, tables.dates, tables.countries, tables.ref_countries)
    whole = docs.select(F.col("id").alias("record_id"), F.col("custom_list_id").isNotNull().alias("is_custom_list"), "source", F.struct(*docs.columns).alias("record"))
    return screened.join(whole, "record_id")


def shadow_comparison(screened: DataFrame, min_score: int) -> DataFrame:
    """One row of counts over all kept records of a shadow screening: where the two scores agree or differ."""
    live, shadow = F.col("score") >= min_score, F.col("shadow_final") >= min_score
    both = screened.agg(
        F.count_if(live & shadow).alias("agreed"),
        F.count_if(live & ~shadow).alias("suppressed"),
        F.count_if(~live & shadow).alias("promoted"),
        F.count_if(live).alias("live_total"),
        F.coalesce(F.sum(F.col("shadow_final") - F.col("score")), F.lit(0)).alias("score_delta"),
        F.count("*").alias("compared"),
    )
    mean = F.when(F.col("compared") > 0, sc.div(F.col("score_delta"), F.col("compared"))).otherwise(0)
    return both.withColumn("mean_delta", mean)


def precision_recall(labelled: DataFrame, thresholds: tuple[int, ...] = (70, 75, 80, 85)) -> DataFrame:
    """(threshold, precision, recall) in whole percent of rows (label 0/1, score); 0 for an empty denominator."""
    at = F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold")
    rows = labelled.select("label", "score", at)
    hit = F.col("score") >= F.col("threshold")
    counts = rows.groupBy("threshold").agg(
        F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit).alias("flagged"), F.count_if(F.col("label") == 1).alias("positive")
    )
    share = lambda n, d: F.when(d == 0, F.lit(0).cast("bigint")).otherwise(sc.div(n * 100, d))
    return counts.select("threshold", share(F.col("tp"), F.col("flagged")).alias("precision"), share(F.col("tp"), F.col("positive")).alias("recall"))
