"""Sectioned JSON feeds: metadata, a streaming split into sections, typed rows."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sections of a feed in the order of loading, with the columns of each: t text, i whole number or null, b yes or no.
SECTIONS = {
    "ref_country": "code:t name:t is_territory:b profile_url:t",
    "ref_occupation": "code:i name:t",
    "ref_relationship": "code:i name:t",
    "ref_sanctions": "id:i name:t status:t description2_id:i",
    "ref_description1": "description1_id:i record_type:t name:t",
    "ref_description2": "description2_id:i description1_id:i name:t",
    "ref_description3": "description3_id:i description2_id:i name:t",
    "record": "id:i record_type:t action:t action_date:t gender:t active_status:t deceased:t profile_notes:t",
    "record_name": "record_id:i name_type:t title_honorific:t first_name:t middle_name:t surname:t maiden_name:t suffix:t "
                   "single_string_name:t original_script_name:t entity_name:t",
    "record_description": "record_id:i description1_id:i description2_id:i description3_id:i",
    "record_role": "record_id:i role_type:t occ_cat_code:i title:t since_day:t since_month:t since_year:t to_day:t to_month:t to_year:t",
    "record_date": "record_id:i date_type:t day:t month:t year:t note:t",
    "record_birth_place": "record_id:i place:t",
    "record_sanctions_ref": "record_id:i sanctions_ref_id:i since_day:t since_month:t since_year:t to_day:t to_month:t to_year:t",
    "record_country": "record_id:i country_type:t country_code:t",
    "record_id_number": "record_id:i id_type:t id_value:t id_notes:t",
    "record_source": "record_id:i url:t",
    "record_image": "record_id:i url:t",
    "record_address": "record_id:i address_line:t address_city:t address_country:t url:t",
    "association": "record_id:i associate_id:i relationship_code:i is_ex:b",
}


def columns_of(section: str) -> list[tuple[str, str]]:
    """(name, kind) of a section's columns."""
    return [tuple(c.split(":")) for c in SECTIONS[section].split()]


def text_value(col: Column) -> Column:
    """Text as it is, '' as NULL, whole numbers without a fraction."""
    return F.nullif(F.regexp_replace(col, r"^(-?\d+)\.0+$", "$1"), F.lit(""))


def whole_value(col: Column) -> Column:
    """A whole number, NULL for anything else."""
    return F.try_to_number(F.regexp_extract(col, r"^(-?\d+)(\.\d+)?$", 1), F.lit("S999999999999999999")).cast("bigint")


def flag_value(col: Column) -> Column:
    """Yes for true, 1 and their text; no for all else and for nothing."""
    return F.coalesce(F.lower(col).isin("true", "1", "1.0", "yes"), F.lit(False))


def typed(rows: DataFrame, section: str) -> DataFrame:
    """Text columns of a section in their types; rows whose id is no number are left out."""
    make = {"t": text_value, "i": whole_value, "b": flag_value}
    columns = columns_of(section)
    out = rows.select(*(make[kind](F.col(name)).alias(name) for name, kind in columns), *(["seq"] if "seq" in rows.columns else []))
    key = "id" if section == "record" else "record_id" if columns[0][0] == "record_id" else None
    return out.filter(F.col(key).isNotNull()) if key else out


def split_feed(path: str, target: str, chunk: int = 1 << 20) -> dict:
    """Splits a feed file into one file of JSON lines per section below ``target``; returns its metadata.

    The file is read once, ``chunk`` characters at a time, and never held whole; strings and nested values are
    followed, so brackets inside them don't count. The result is kept: a target made from a file of the same size
    and time is not made again. Records whose id is no number, a number in quotes included, are left out. Sections that
    a feed lacks have no file.
    """
    source, folder = Path(path), Path(target)
    stamp = {"size": source.stat().st_size, "mtime_ns": source.stat().st_mtime_ns}
    done = folder / "split.json"
    if done.exists() and (known := json.loads(done.read_text()))["stamp"] == stamp:
        return known["meta"]
    folder.mkdir(parents=True, exist_ok=True)
    meta: dict = {}
    files: dict[str, object] = {}
    try:
        for section, number, text in feed_values(path, chunk):
            if section == "_meta":
                meta = json.loads(text)
            elif section in SECTIONS:
                row = json.loads(text)
                if section == "record" and not isinstance(row.get("id"), (int, float)):
                    continue
                if section not in files:
                    files[section] = (folder / f"{section}.jsonl").open("w", encoding="utf-8")
                files[section].write(json.dumps(row | {"seq": number}, ensure_ascii=False) + "\n")
    finally:
        for file in files.values():
            file.close()
    part = folder / "split.json.part"
    part.write_text(json.dumps({"stamp": stamp, "meta": meta}))
    part.replace(done)
    return meta


_STRUCTURE, _IN_STRING = re.compile(r'["{}\[\],:]'), re.compile(r'["\\]')


def feed_values(path: str, chunk: int = 1 << 20) -> Iterator[tuple[str, int, str]]:
    """(key, position, JSON text) of each element of the feed's top-level arrays and of its other values.

    A scanner over depth, strings and escapes that jumps from one character of structure to the next; only the element at
    hand is kept in memory.
    """
    decode = codecs.getincrementaldecoder("utf-8-sig")()
    depth, quoted, escaped, in_array = 0, False, False, False
    key: str | None = None
    expect_key = False
    number = 0
    token: list[str] = []
    with open(path, "rb") as file:
        while block := file.read(chunk):
            text = decode.decode(block)
            at, end = 0, len(text)
            while at < end:
                if escaped:
                    token.append(text[at])
                    at, escaped = at + 1, False
                    continue
                found = (_IN_STRING if quoted else _STRUCTURE).search(text, at)
                stop = found.start() if found else end
                if depth:
                    token.append(text[at:stop])
                if not found:
                    break
                c, at = text[stop], stop + 1
                if quoted:
                    token.append(c)
                    escaped, quoted = c == "\\", c != '"'
                    continue
                level = depth - (2 if in_array else 1)
                if c == '"':
                    quoted = True
                    token.append(c)
                elif depth == 0:
                    if c == "{":
                        depth, expect_key = 1, True
                elif level == 0 and not in_array and c == ":" and expect_key:
                    key, expect_key, number = json.loads("".join(token)), False, 0
                    token = []
                elif level == 0 and not in_array and c == "[" and not expect_key:
                    in_array, depth = True, 2
                    token = []
                elif level == 0 and (c == "," or c in "]}"):
                    value = "".join(token).strip()
                    if value and key is not None and not expect_key:
                        yield key, number, value
                        number += 1
                    token = []
                    if in_array and c == "]":
                        in_array, depth = False, 1
                    elif not in_array:
                        expect_key = c == ","
                        depth -= c == "}"
                else:
                    token.append(c)
                    depth += (c in "{[") - (c in "}]")


def read_section(spark: SparkSession, target: str, section: str) -> DataFrame:
    """A section of a split feed as typed rows with ``seq``; no rows if the feed lacks it."""
    schema = ", ".join(f"{name} string" for name, _ in columns_of(section)) + ", seq bigint"
    file = Path(target) / f"{section}.jsonl"
    rows = spark.read.schema(schema).json(str(file)) if file.exists() else spark.createDataFrame([], schema)
    return typed(rows, section)


def read_feed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All sections of a small feed, read as one document without splitting it; ids in quotes count as numbers here."""
    fields = ", ".join(f"{s} array<struct<{', '.join(f'{n}: string' for n, _ in columns_of(s))}>>" for s in SECTIONS)
    whole = spark.read.schema(fields).option("multiLine", True).json(path)
    return {s: typed(whole.select(F.inline(F.coalesce(F.col(s), F.expr(f"cast(array() as {dict(whole.dtypes)[s]})")))), s) for s in SECTIONS}


def read_jdbc(spark: SparkSession, url: str, name: str, key: str = "id", partitions: int = 8, bounds: tuple[int, int] = (0, 1 << 32), **options: str) -> DataFrame:
    """A table of a database, read in ranges of its key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, numPartitions=partitions)
    return reader.options(lowerBound=bounds[0], upperBound=bounds[1], **options).load()
