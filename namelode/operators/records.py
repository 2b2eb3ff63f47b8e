"""Reading records: filtered pages, and records with their child rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namelode.session import all_of, nullif_empty

#: Columns that make two child rows the same, by table.
CHILD_KEYS = {
    "names": ("name_type", "title_honorific", "first_name", "middle_name", "surname", "maiden_name", "suffix",
              "single_string_name", "original_script_name", "entity_name"),
    "dates": ("date_type", "day", "month", "year", "note"),
    "countries": ("country_type", "country_code"),
    "images": ("url",),
    "descriptions": ("description1_id", "description2_id", "description3_id"),
    "associations": ("associate_id", "relationship_code"),
}


def page_bounds(page: int, per_page: int) -> tuple[int, int]:
    """(offset, limit) of a page: pages start at 1, and 25 rows are taken unless 1 to 100 are asked for."""
    per_page = per_page if 1 <= per_page <= 100 else 25
    return (max(page, 1) - 1) * per_page, per_page


def filtered_records(
    records: DataFrame,
    names: DataFrame,
    record_type: str = "",
    active_status: str = "",
    first_name: str = "",
    last_name: str = "",
) -> DataFrame:
    """Records of the type and status whose primary name begins with the given first and last name.

    Comparisons ignore case. Empty filters don't filter; the names table is only read if a name is given,
    and each record comes once however many of its rows match.
    """
    same = lambda c, v: F.lower(c) == v.lower()
    found = records.filter(all_of([same(F.col(c), v) for c, v in (("record_type", record_type), ("active_status", active_status)) if v]))
    starts = [(c, v.strip()) for c, v in (("first_name", first_name), ("surname", last_name)) if v.strip()]
    if starts:
        primary = names.filter(
            all_of([F.col("name_type") == "Primary Name"] + [F.lower(F.col(c)).startswith(v.lower()) for c, v in starts])
        )
        found = found.join(primary.select(F.col("record_id").alias("id")), "id", "left_semi")
    return found


def display_name(row: Column | None = None) -> Column:
    """The entity name, else the single string, else first, middle and last name."""
    col = (lambda c: row[c]) if row is not None else F.col
    parts = F.concat_ws(" ", *(nullif_empty(col(c)) for c in ("first_name", "middle_name", "surname")))
    return F.coalesce(nullif_empty(col("entity_name")), nullif_empty(col("single_string_name")), parts)


def folded_type(record_type: Column) -> Column:
    """'Entity' for entities in any case, 'Person' for all other types, NULL for none."""
    return F.when(F.lower(record_type) == "entity", "Entity").when(record_type.isNotNull(), "Person")


def with_source(records: DataFrame, custom_lists: DataFrame) -> DataFrame:
    """``records`` with ``source`` (the official list or the custom list by name) and the folded record_type."""
    lists = custom_lists.select(F.col("id").alias("custom_list_id"), F.coalesce("name", F.lit("")).alias("list_name"))
    named = F.coalesce(nullif_empty(F.col("list_name")))
    source = (
        F.when(F.col("custom_list_id").isNull(), "sanctions_list")
        .when(named.isNotNull(), F.concat(F.lit("custom_list:"), named))
        .otherwise("custom_list")
    )
    joined = records.join(lists, "custom_list_id", "left")
    return joined.withColumn("source", source).withColumn("record_type", folded_type(F.col("record_type"))).drop("list_name")


def record_page(found: DataFrame, custom_lists: DataFrame, names: DataFrame, page: int = 1, per_page: int = 25) -> DataFrame:
    """One page of ``found`` records by id, with source and the first primary name of each."""
    offset, limit = page_bounds(page, per_page)
    chosen = found.orderBy("id").offset(offset).limit(limit)
    first = first_primary_names(names).withColumnRenamed("record_id", "id")
    return with_source(chosen, custom_lists).join(first, "id", "left")


def first_primary_names(names: DataFrame) -> DataFrame:
    """(record_id, display_name) of the primary name row with the smallest id of each record."""
    fields = [c for c in CHILD_KEYS["names"]]
    first = names.filter("name_type = 'Primary Name'").groupBy("record_id").agg(F.min_by(F.struct(*fields), "id").alias("p"))
    return first.select("record_id", display_name(F.col("p")).alias("display_name"))


def child_rows(children: DataFrame, kind: str, limit: int = 0) -> DataFrame:
    """Child rows without those that repeat an earlier one of their record, the first ``limit`` of each record.

    Null and '' are the same; ``position`` counts from 1 by id. Equal rows are found by aggregation, which
    combines them before the shuffle.
    """
    keys = CHILD_KEYS[kind]
    first = children.groupBy("record_id", *(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys)).agg(
        F.min_by(F.struct(*[c for c in children.columns if c != "record_id"]), "id").alias("row")
    )
    rows = first.select("record_id", "row.*")
    at = F.row_number().over(Window.partitionBy("record_id").orderBy("id"))
    placed = rows.withColumn("position", at)
    return placed.filter(F.col("position") <= limit) if limit > 0 else placed


def hydrated(
    ids: DataFrame,
    records: DataFrame,
    custom_lists: DataFrame,
    names: DataFrame,
    dates: DataFrame,
    countries: DataFrame,
    ref_countries: DataFrame,
    name_limit: int = 10,
    notes: bool = False,
    images: DataFrame | None = None,
    descriptions: DataFrame | None = None,
    associations: DataFrame | None = None,
) -> DataFrame:
    """The records of ``ids`` as nested documents: names, dates and countries as arrays in id order.

    So are images, descriptions (see ``described``) and associations (see ``association_names``) where they are given. Children are reduced to the wanted records before they are grouped; unknown ids vanish, records
    without children have empty arrays. ``notes`` keeps the profile notes.
    """
    wanted = ids.select("id").distinct()

    def nested(children: DataFrame, kind: str, limit: int, fields: list[str]) -> DataFrame:
        own = children.join(wanted.withColumnRenamed("id", "record_id"), "record_id", "left_semi")
        rows = child_rows(own, kind, limit)
        listed = F.array_sort(F.collect_list(F.struct("position", *fields)))
        return rows.groupBy(F.col("record_id").alias("id")).agg(
            F.transform(listed, lambda x: x.dropFields("position")).alias(kind)
        )

    named = ref_countries.select(F.col("code").alias("country_code"), F.col("name").alias("listed_name"))
    lands = countries.join(named, "country_code", "left")
    base = with_source(records.join(wanted, "id", "left_semi"), custom_lists)
    if not notes:
        base = base.drop("profile_notes")
    parts = [
        nested(names, "names", name_limit, list(CHILD_KEYS["names"])),
        nested(dates, "dates", 0, list(CHILD_KEYS["dates"])),
        nested(lands, "countries", 0, ["country_type", "country_code", "listed_name"]),
    ]
    more = (("images", images, ["url"]), ("descriptions", descriptions, [*CHILD_KEYS["descriptions"], *(f"description{n}" for n in (1, 2, 3))]),
            ("associations", associations, [*CHILD_KEYS["associations"], "is_ex", "associate_name", "relationship"]))
    parts += [nested(rows, kind, 0, fields) for kind, rows, fields in more if rows is not None]
    for part in parts:
        base = base.join(part, "id", "left")
    kinds = {p.columns[1]: p.schema[1].dataType.simpleString() for p in parts}
    return base.withColumns({k: F.coalesce(F.col(k), F.array().cast(t)) for k, t in kinds.items()})


def described(descriptions: DataFrame, d1: DataFrame, d2: DataFrame, d3: DataFrame) -> DataFrame:
    """Descriptions with the names of their three levels, each from its small reference table."""
    for n, ref in enumerate((d1, d2, d3), 1):
        named = ref.select(f"description{n}_id", F.col("name").alias(f"description{n}"))
        descriptions = descriptions.join(named, f"description{n}_id", "left")
    return descriptions


def association_names(associations: DataFrame, names: DataFrame, relationships: DataFrame) -> DataFrame:
    """Associations with the associate's display name and the name of the relationship.

    The associate's name is that of its primary name row with the smallest id, '' if it has none.
    """
    first = first_primary_names(names).select(F.col("record_id").alias("associate_id"), F.col("display_name").alias("associate_name"))
    named = relationships.select(F.col("code").alias("relationship_code"), F.col("name").alias("relationship"))
    joined = associations.join(first, "associate_id", "left").join(named, "relationship_code", "left")
    return joined.withColumn("associate_name", F.coalesce("associate_name", F.lit("")))


def record_show(store_tables: dict[str, DataFrame], custom_lists: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of ``ids`` with all their children and notes, from the tables of a load by section name."""
    t = store_tables
    said = described(t["record_description"], t["ref_description1"], t["ref_description2"], t["ref_description3"])
    links = association_names(t["association"], t["record_name"], t["ref_relationship"])
    return hydrated(ids, t["record"], custom_lists, t["record_name"], t["record_date"], t["record_country"], t["ref_country"], 0, True, t["record_image"], said, links)
