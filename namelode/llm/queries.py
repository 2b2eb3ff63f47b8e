"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namelode.llm import canonical_list, distinctive, entity_match, formatting, identity, leakage, lookalike, name_variants, tokenize, truncated
from namelode.session import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary files are: NAMELODE_TOKENIZERS, else /opt/tokenizers."""
    return os.path.join(os.environ.get("NAMELODE_TOKENIZERS", "/opt/tokenizers"), name)


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


_PERSON_TABLES = ("sanctions_records", "sanctions_names", "sanctions_dates", "sanctions_countries")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, names, dates, countries = _tables(spark, sf_dir, *_PERSON_TABLES)
    official = records.filter("custom_list_id is null")
    return name_variants.same_name_records(identity.profiles(official, names, dates, identity.listed_codes(countries)))


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.score_words(table(spark, sf_dir, "sanctions_names")).select("record_id", "word", "df", "score")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.shared_rare_words(distinctive.score_words(table(spark, sf_dir, "sanctions_names")))


def p3_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_list.mapped_countries(*_tables(spark, sf_dir, "sanctions_countries", "sanctions_ref_countries"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_mapped(spark, sf_dir).select("country_row_id", "code")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.formatting_copies(*_tables(spark, sf_dir, *_PERSON_TABLES))


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.collapsed_records(*_tables(spark, sf_dir, *_PERSON_TABLES))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = lookalike.name_forms(table(spark, sf_dir, "sanctions_names"))
    return forms.filter("disguised").select("name_id", "field_name")


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.name_forms(table(spark, sf_dir, "sanctions_names")).select("name_id", "field_name", "form")


def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, names, dates, countries = _tables(spark, sf_dir, *_PERSON_TABLES)
    codes = entity_match.mapped_codes(countries, table(spark, sf_dir, "sanctions_ref_countries"))
    return entity_match.matched_records(identity.profiles(records, names, dates, codes))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = p6_matches(spark, sf_dir)
    a, b = F.col("record_id_a"), F.col("record_id_b")
    return pairs.select(F.least(a, b).alias("record_id_a"), F.greatest(a, b).alias("record_id_b"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, sf_dir, "documents"), vocabulary_path())


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokenize.encode_corpus(table(spark, sf_dir, "documents"), vocabulary_path())
    return tokenize.decode_corpus(ids, vocabulary_path())


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(*_tables(spark, sf_dir, "documents", "eval_items"))


def p9_removal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.removal_spans(*_tables(spark, sf_dir, "documents", "eval_items"))


def p9_unsearchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.unsearchable_items(table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated.truncated_texts(table(spark, sf_dir, "documents")).filter("cut").select("doc_id")


def p10_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated.truncation_by_source(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            p1_found,
            p2_scores,
            p2_found,
            p3_found,
            p3_mapped,
            p4_found,
            p4_collapsed,
            p5_found,
            p5_forms,
            p6_matches,
            p6_found,
            p8_ids,
            p8_decoded,
            p9_found,
            p9_removal_spans,
            p9_unsearchable,
            p10_found,
            p10_by_source,
        )
    }


_P4_CONTENT = r"""
with prim as (select record_id, min_by(struct_pack(f := first_name, m := middle_name, s := surname), id) p
  from sanctions_names where name_type = 'Primary Name' group by 1),
y as (select record_id, list_sort(list_distinct(list(regexp_replace(lower(year), '[\s\p{Z}\p{P}]+', '', 'g')))) v
  from sanctions_dates where date_type = 'Date of Birth' and coalesce(year, '') <> '' group by 1),
k as (select record_id, list_sort(list_distinct(list(regexp_replace(lower(country_code), '[\s\p{Z}\p{P}]+', '', 'g')))) v
  from sanctions_countries where country_code is not null group by 1),
c as (select r.id, y.v yy, k.v kk,
    list_sort(list_filter(string_split(regexp_replace(lower(concat_ws(' ', p.f, p.m, p.s)), '[\s\p{Z}\p{P}]+', ' ', 'g'), ' '),
      lambda w: w <> '')) n
  from sanctions_records r join prim on r.id = prim.record_id left join y on y.record_id = r.id
    left join k on k.record_id = r.id
  where lower(trim(coalesce(record_type, ''))) <> 'entity' and coalesce(p.s, '') <> ''),
g as (select id, min(id) over (partition by n, yy, kk) keep_id, count(*) over (partition by n, yy, kk) copies from c)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": r"""
with w as (select distinct record_id, unnest(regexp_extract_all(lower(concat_ws(chr(10), first_name, surname)), '\p{L}{3,}')) w
  from sanctions_names),
v as (select w from w group by 1 having count(*) between 2 and 3)
select distinct a.record_id as record_id_a, b.record_id as record_id_b
from w a join w b using (w) where w in (select w from v) and a.record_id < b.record_id""",
        "p4_found": _P4_CONTENT + "select keep_id, id as copy_id from g where id <> keep_id",
        "p4_collapsed": _P4_CONTENT + "select keep_id, copies from g where id = keep_id and copies > 1",
        "p9_found": r"""
with w as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from eval_items),
g as (select distinct item_id, array_to_string(w[p:p + 11], ' ') g
  from (select item_id, w, unnest(range(1, len(w) - 10)) p from w)),
d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w
  from documents where text is not null),
h as (select doc_id, array_to_string(w[p:p + 11], ' ') g
  from (select doc_id, w, unnest(range(1, len(w) - 10)) p from d))
select distinct doc_id, item_id from h join g using (g)""",
        "p9_unsearchable": r"""
select item_id, cast(coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+')), 0) as int) as words from eval_items
where coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+')), 0) < 12""",
        "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
    }
