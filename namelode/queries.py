"""The queries of the core and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namelode.functions import countries as ct
from namelode.functions import dates as dt
from namelode.functions import names as nm
from namelode.functions import scoring as sc
from namelode.functions.lexicon import ARABIC_LATIN
from namelode.operators import cdc, custom_lists, factors, history, records, retrieval, snapshots, weights
from namelode.plans import screen as plan
from namelode.session import nullif_empty, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


# --- snapshots -------------------------------------------------------------------------------------------------------

_LATEST = r"""
with c as (select snapshot_no, record_id, received_at, nullif(lower(trim(active_status)), '') s,
    nullif(lower(trim(action)), '') a, lower(trim(action_date)) d from record_snapshots),
n as (select *, case when d = '' then null
    when regexp_matches(d, '^\d{2}-[a-z]{3}-\d{4}$') then strftime(strptime(d, '%d-%b-%Y'), '%Y-%m-%d')
    else replace(d, '/', '-') end dd from c),
l as (select * from n qualify row_number() over (partition by snapshot_no, record_id order by received_at desc) = 1)
"""


@query(
    _LATEST
    + """
select coalesce(x.record_id, y.record_id) as record_id, cast(coalesce(x.snapshot_no, y.snapshot_no + 1) as int) as snapshot_no,
  case when y.record_id is null then 'added' when x.record_id is null then 'removed' else 'changed' end as change
from l x full join l y on x.record_id = y.record_id and x.snapshot_no = y.snapshot_no + 1
where coalesce(x.snapshot_no, y.snapshot_no + 1) between (select min(snapshot_no) + 1 from l) and (select max(snapshot_no) from l)
  and (x.record_id is null or y.record_id is null or x.s is distinct from y.s or x.a is distinct from y.a
    or x.dd is distinct from y.dd)"""
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "record_snapshots"))


# --- reading records -------------------------------------------------------------------------------------------------

_FOUND = """
from sanctions_records r where lower(r.record_type) = 'person' and lower(r.active_status) = 'active'
  and exists (select 1 from sanctions_names n where n.record_id = r.id and n.name_type = 'Primary Name'
    and starts_with(lower(n.surname), 'k'))"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    return records.filtered_records(*_t(spark, d, "sanctions_records", "sanctions_names"), "Person", "Active", "", "K")


_DISPLAY = """coalesce(nullif(entity_name, ''), nullif(single_string_name, ''),
    concat_ws(' ', nullif(first_name, ''), nullif(middle_name, ''), nullif(surname, '')))"""
_FIRST_PRIMARY = f"""first as (select record_id, {_DISPLAY} as display_name from sanctions_names where name_type = 'Primary Name'
  qualify row_number() over (partition by record_id order by id) = 1)"""


@query(
    f"""with {_FIRST_PRIMARY},
page as (select r.* {_FOUND} order by r.id limit 25 offset 25)
select p.id, case when lower(p.record_type) = 'entity' then 'Entity' when p.record_type is not null then 'Person' end as record_type,
  p.active_status, case when p.custom_list_id is null then 'sanctions_list' when nullif(c.name, '') is not null
    then 'custom_list:' || c.name else 'custom_list' end as source, f.display_name
from page p left join custom_lists c on c.id = p.custom_list_id left join first f on f.record_id = p.id"""
)
def list_records_page(spark: SparkSession, d: str) -> DataFrame:
    lists, names = _t(spark, d, "custom_lists", "sanctions_names")
    page = records.record_page(_found(spark, d), lists, names, page=2, per_page=25)
    return page.select("id", "record_type", "active_status", "source", "display_name")


@query(f"select count(*) as total {_FOUND}")
def list_records_total(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).agg(F.count("*").alias("total"))


@query(f"with {_FIRST_PRIMARY} select record_id, display_name from first")
def first_primary_names(spark: SparkSession, d: str) -> DataFrame:
    return records.first_primary_names(table(spark, d, "sanctions_names"))


def _child_sql(tab: str, kind: str, limit: str = "") -> str:
    keys = ", ".join(f"coalesce(cast({k} as varchar), '')" for k in records.CHILD_KEYS[kind])
    return f"""with k as (select record_id, id from {tab}
  qualify row_number() over (partition by record_id, {keys} order by id) = 1),
p as (select record_id, id, cast(row_number() over (partition by record_id order by id) as int) as position from k)
select record_id, id, position from p {limit}"""


@query(_child_sql("sanctions_names", "names", "where position <= 10"))
def names_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    return records.child_rows(table(spark, d, "sanctions_names"), "names", 10).select("record_id", "id", "position")


@query(_child_sql("sanctions_dates", "dates"))
def dates_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    return records.child_rows(table(spark, d, "sanctions_dates"), "dates").select("record_id", "id", "position")


@query(_child_sql("sanctions_countries", "countries"))
def countries_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    return records.child_rows(table(spark, d, "sanctions_countries"), "countries").select("record_id", "id", "position")


@query(
    """with nk as (select record_id, id from sanctions_names qualify row_number() over (partition by record_id, """
    + ", ".join(f"coalesce({k}, '')" for k in records.CHILD_KEYS["names"])
    + """ order by id) = 1),
n as (select record_id, least(count(*), 10) as k from nk group by 1),
dk as (select distinct record_id, """
    + ", ".join(f"coalesce({k}, '') as {k}" for k in records.CHILD_KEYS["dates"])
    + """ from sanctions_dates),
dd as (select record_id, count(*) as k from dk group by 1),
ck as (select distinct record_id, coalesce(country_type, '') a, coalesce(country_code, '') b from sanctions_countries),
c as (select record_id, count(*) as k from ck group by 1)
select r.id, cast(coalesce(n.k, 0) as int) as names, cast(coalesce(dd.k, 0) as int) as dates, cast(coalesce(c.k, 0) as int) as countries
from sanctions_records r left join n on n.record_id = r.id left join dd on dd.record_id = r.id left join c on c.record_id = r.id"""
)
def hydrated_sizes(spark: SparkSession, d: str) -> DataFrame:
    tabs = _t(spark, d, "sanctions_records", "custom_lists", "sanctions_names", "sanctions_dates", "sanctions_countries", "sanctions_ref_countries")
    docs = records.hydrated(tabs[0].select("id"), *tabs)
    return docs.select("id", *(F.size(k).alias(k) for k in ("names", "dates", "countries")))


_PIPED = {
    "names": ("sanctions_names", records.CHILD_KEYS["names"], "where position <= 10"),
    "dates": ("sanctions_dates", records.CHILD_KEYS["dates"], ""),
    "countries": ("sanctions_countries", ("country_type", "country_code"), ""),
}


def _piped_sql(kind: str) -> str:
    tab, fields, limit = _PIPED[kind]
    extra = ", f.name" if kind == "countries" else ""
    keys = ", ".join(f"coalesce(cast({k} as varchar), '')" for k in records.CHILD_KEYS[kind])
    join = "left join sanctions_ref_countries f on f.code = k.country_code" if kind == "countries" else ""
    return f"""(with k as (select * from {tab} qualify row_number() over (partition by record_id, {keys} order by id) = 1),
p as (select k.record_id, row_number() over (partition by k.record_id order by k.id) as position, concat_ws('|', {", ".join(f"coalesce(k.{x}, '')" for x in fields)}{", coalesce(f.name, '')" if extra else ""}) t from k {join})
select record_id, string_agg(t, ';' order by position) {kind} from p {limit} group by 1)"""


@query(
    f"""select r.id, case when lower(r.record_type) = 'entity' then 'Entity' when r.record_type is not null then 'Person' end as record_type,
  r.active_status, r.action, r.action_date, r.gender, r.deceased, case when r.custom_list_id is null then 'sanctions_list' when nullif(c.name, '') is not null
    then 'custom_list:' || c.name else 'custom_list' end as source, coalesce(n.names, '') as names, coalesce(t.dates, '') as dates, coalesce(l.countries, '') as countries
from sanctions_records r left join custom_lists c on c.id = r.custom_list_id left join {_piped_sql("names")} n on n.record_id = r.id
left join {_piped_sql("dates")} t on t.record_id = r.id left join {_piped_sql("countries")} l on l.record_id = r.id"""
)
def hydrated_records(spark: SparkSession, d: str) -> DataFrame:
    tabs = _t(spark, d, "sanctions_records", "custom_lists", "sanctions_names", "sanctions_dates", "sanctions_countries", "sanctions_ref_countries")
    docs = records.hydrated(tabs[0].select("id"), *tabs)

    def piped(kind: str) -> Column:
        fields = [f.name for f in docs.schema[kind].dataType.elementType]
        row = lambda x: F.concat_ws("|", *(F.coalesce(x[f], F.lit("")) for f in fields))
        return F.array_join(F.transform(kind, row), ";").alias(kind)

    return docs.select("id", "record_type", "active_status", "action", "action_date", "gender", "deceased", "source", *map(piped, _PIPED))


@query("""select c.id, c.name, count(r.id) as record_count from custom_lists c left join sanctions_records r on r.custom_list_id = c.id group by all""")
def custom_list_counts(spark: SparkSession, d: str) -> DataFrame:
    return custom_lists.list_counts(*_t(spark, d, "custom_lists", "sanctions_records")).select("id", "name", "record_count")


@query(
    """with gone as (select id from sanctions_records where custom_list_id = 7)
select 'records' as kind, count(*) as kept from sanctions_records where id not in (from gone)
union all select 'names', count(*) from sanctions_names where record_id not in (from gone)
union all select 'dates', count(*) from sanctions_dates where record_id not in (from gone)
union all select 'countries', count(*) from sanctions_countries where record_id not in (from gone)"""
)
def custom_list_deleted(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "sanctions_records")
    children = {k: table(spark, d, f"sanctions_{k}") for k in ("names", "dates", "countries")}
    kept, rest = custom_lists.without_list(base, children, 7)
    out = None
    for kind, rows in {"records": kept, **rest}.items():
        one = rows.agg(F.count("*").alias("kept")).select(F.lit(kind).alias("kind"), "kept")
        out = one if out is None else out.unionByName(one)
    return out


# --- loads and their changes -----------------------------------------------------------------------------------------

#: Each snapshot against the one before: the official rows of the number ``n`` are the feed, those of n - 1 the stored records.
_SNAPSHOT = """s as (select * from record_snapshots where custom_list_id is null
  qualify row_number() over (partition by snapshot_no, record_id order by received_at desc, record_type, active_status, action) = 1),
numbers as (select max(snapshot_no) top, min(snapshot_no) low from s),
e as (select snapshot_no + 1 n, record_id, coalesce(record_type, '') record_type, coalesce(active_status, '') st, s.* exclude (record_id, record_type) from s, numbers where snapshot_no < top),
i as (select snapshot_no n, record_id, record_type, active_status, coalesce(active_status, '') st, action, action_date, gender, deceased from s, numbers where snapshot_no > low)"""
_EVENTS = f"""{_SNAPSHOT},
x as (select coalesce(e.n, i.n) n, coalesce(e.record_id, i.record_id) record_id, e.record_id is null as is_new, i.record_id is null as is_gone,
  lower(trim(coalesce(e.st, ''))) = 'active' as ea, lower(trim(coalesce(i.st, ''))) = 'active' as ia,
  case when i.record_id is null then e.record_type else i.record_type end as record_type
  from e full join i on e.record_id = i.record_id and e.n = i.n),
ev as (select n as snapshot_no, record_id, record_type, unnest(list_filter([case when is_new then 'added' end, case when is_new and not ia then 'added_inactive' end,
  case when is_gone then 'removed_from_feed' end, case when (is_gone or (not is_new and not ia)) and ea then 'inactivated' end,
  case when not is_new and not is_gone and ia and not ea then 'reactivated' end], lambda v: v is not null)) change_type from x)"""


def _feed(spark: SparkSession, d: str, number: int) -> DataFrame:
    """The official rows of one snapshot as a feed: of repeated ones the one received last."""
    rows = table(spark, d, "record_snapshots").filter((F.col("snapshot_no") == number) & F.col("custom_list_id").isNull())
    fields = ("record_type", "action", "action_date", "gender", "active_status", "deceased")
    last = rows.groupBy(F.col("record_id").alias("id")).agg(F.max_by(F.struct(*fields), "received_at").alias("r"))
    return last.select("id", "r.*").withColumn("profile_notes", F.lit(None).cast("string"))


def _stored(spark: SparkSession, d: str, number: int) -> DataFrame:
    return _feed(spark, d, number).withColumn("custom_list_id", F.lit(None).cast("bigint"))


def _each_load(spark: SparkSession, d: str, make: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` gives of the stored records and the feed of every snapshot from the second on, with its number."""
    low, top = table(spark, d, "record_snapshots").agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    out = None
    for n in range(low + 1, top + 1):
        one = make(_stored(spark, d, n - 1), _feed(spark, d, n)).withColumn("snapshot_no", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _each_load(spark, d, lambda old, new: cdc.change_events(cdc.matched(cdc.official_records(old), new), True))


@query(f"with {_EVENTS} select snapshot_no, record_id, record_type, change_type from ev")
def cdc_events(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d)


@query(
    f"""with {_EVENTS} select snapshot_no, change_type, 'sanctions_record' as entity, nullif(record_type, '') as record_type, count(*) as count
from ev group by all"""
)
def cdc_counts(spark: SparkSession, d: str) -> DataFrame:
    return _each_load(spark, d, lambda old, new: cdc.change_counts(cdc.change_events(cdc.matched(cdc.official_records(old), new), True)))


@query(f"""with {_EVENTS} select snapshot_no, record_id, change_type from ev where change_type <> 'added_inactive'
qualify row_number() over (partition by snapshot_no order by record_id, change_type) <= 300""")
def cdc_kept_events(spark: SparkSession, d: str) -> DataFrame:
    kept = lambda old, new: cdc.kept_events(cdc.change_events(cdc.matched(cdc.official_records(old), new), True), 300)
    return _each_load(spark, d, kept).select("snapshot_no", "record_id", "change_type")


_REWRITES = "(e.st <> i.st or (lower(trim(e.st)) = 'active' and coalesce(i.action, '') = 'del'))"


@query(f"with {_SNAPSHOT} select i.n as snapshot_no, i.record_id as id from e join i on e.record_id = i.record_id and e.n = i.n where {_REWRITES}")
def cdc_updates(spark: SparkSession, d: str) -> DataFrame:
    return _each_load(spark, d, lambda old, new: cdc.matched(cdc.official_records(old), new).filter(cdc.needs_update()).select("id"))


def _applied_column(name: str, removed: str) -> str:
    stored = "(select s.record_type from s where s.snapshot_no = e.n - 1 and s.record_id = e.record_id)" if name == "record_type" else f"e.{name}"
    return f"case when i.record_id is null then {removed or stored} when e.record_id is null or {_REWRITES} then i.{name} else {stored} end as {name}"


@query(
    f"""with {_SNAPSHOT} select coalesce(e.n, i.n) as snapshot_no, coalesce(e.record_id, i.record_id) as id, """
    + ", ".join(_applied_column(c, r) for c, r in (("record_type", ""), ("action", "'del'"), ("action_date", "'2025-03-10'"), ("gender", ""), ("active_status", "'Inactive'"), ("deceased", "")))
    + """ from e full join i on e.record_id = i.record_id and e.n = i.n"""
)
def cdc_applied(spark: SparkSession, d: str) -> DataFrame:
    rows = _each_load(spark, d, lambda old, new: cdc.applied(old, new, True, F.lit("2025-03-10")))
    return rows.drop("profile_notes", "custom_list_id")


@query(
    f"""with {_SNAPSHOT}, n as (select n, (select count(*) from e where e.n = m.n) existing, (select count(*) from i where i.n = m.n) incoming from (select distinct n from i) m)
select cast(n as int) as snapshot_no, existing > 0 and (existing <= 10000 or incoming >= existing * 9 // 10) as complete from n"""
)
def complete_feed_guard(spark: SparkSession, d: str) -> DataFrame:
    sizes = dict(table(spark, d, "record_snapshots").filter("custom_list_id is null").groupBy("snapshot_no").agg(F.countDistinct("record_id")).collect())
    rows = [(n, cdc.is_complete_feed("full", 0, sizes[n], sizes.get(n - 1, 0))) for n in sorted(sizes) if n - 1 in sizes]
    return spark.createDataFrame(rows, "snapshot_no int, complete boolean")


@query(
    f"""with {_EVENTS}, own as (select distinct record_id from ev),
nm as (select record_id, trim({_DISPLAY}) shown, id, case name_type when 'Primary Name' then 1 when 'Also Known As' then 2
    when 'Spelling Variation' then 3 else 0 end k from sanctions_names where record_id in (from own)),
n1 as (select record_id, shown from nm where shown <> '' qualify row_number() over (partition by record_id order by k, id) = 1),
d1 as (select record_id, concat_ws('-', nullif(year, ''), nullif(month, ''), nullif(day, '')) dob from sanctions_dates
  where lower(date_type) like '%birth%' and concat_ws('-', nullif(year, ''), nullif(month, ''), nullif(day, '')) <> ''
  qualify row_number() over (partition by record_id order by id) = 1),
c1 as (select c.record_id, string_agg(coalesce(f.name, c.country_code, ''), '|' order by c.id) lands
  from sanctions_countries c left join sanctions_ref_countries f on f.code = c.country_code group by 1)
select ev.snapshot_no, ev.record_id, ev.change_type, n1.shown as display_name, d1.dob as date_of_birth, c1.lands as countries
from ev left join n1 using (record_id) left join d1 using (record_id) left join c1 using (record_id)"""
)
def cdc_event_details(spark: SparkSession, d: str) -> DataFrame:
    tabs = _t(spark, d, "sanctions_names", "sanctions_dates", "sanctions_countries", "sanctions_ref_countries")
    rows = cdc.event_details(_events(spark, d), *tabs)
    listed = F.from_json("countries_json", "array<struct<type:string,code:string,name:string>>")
    named = F.array_join(F.transform(listed, lambda c: c["name"]), "|")
    return rows.select("snapshot_no", "record_id", "change_type", "display_name", "date_of_birth", named.alias("countries"))


@query(
    """with s as (select snapshot_no, code, name from (select 1 snapshot_no, code, name from sanctions_ref_countries
  union all select 2, code, upper(name) from sanctions_ref_countries where is_territory) )
select code, arg_max(name, snapshot_no) as name from s group by 1"""
)
def upserted_reference(spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "sanctions_ref_countries")
    new = ref.filter("is_territory").select("code", F.upper("name").alias("name"))
    return cdc.upserted(ref, new, "code", ["name"])


@query(
    """with r as (select cast(ts as date) as day, min(ts) as started_at from events group by 1),
p as (select * from r order by started_at desc limit 10 offset 10),
i as (select day, epoch_us(started_at) - epoch_us(lead(started_at) over (order by started_at desc)) us from p)
select day, case when us > 0 then round(us / 3600000000, 2) end as interval_hours, (select count(*) from r) as total,
  case when us > 0 then (case when us >= 3600000000 then (us // 3600000000) || 'h' else '' end) || (case when us >= 60000000 then (us // 60000000 % 60) || 'm' else '' end)
    || (us % 60000000 // 1000000) || (case when us % 1000000 = 0 then '' else '.' || rtrim(lpad(cast(us % 1000000 as varchar), 6, '0'), '0') end) || 's' end as interval from i"""
)
def run_history_page(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").groupBy(F.to_date("ts").alias("id")).agg(F.min("ts").alias("started_at"))
    return history.run_page(runs, 2, 10).select(F.col("id").alias("day"), "interval_hours", "interval", "total")


@query(
    """with c as (select cast(ts as date) as run_id, event_type, count(*) n from events where event_type <> 'error' group by 1, 2)
select run_id, cast(sum(n) as bigint) as total_records_affected from c group by 1"""
)
def run_records_affected(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "added_inactive").otherwise(F.col("event_type"))
    changes = table(spark, d, "events").groupBy(F.to_date("ts").alias("run_id"), kind.alias("change_type")).agg(F.count("*").alias("count"))
    rows = changes.withColumn("entity", F.lit("sanctions_record")).withColumn("record_type", F.lit(None).cast("string"))
    return history.affected(rows)


@query(
    """with e as (select cast(ts as date) as run_id, event_id from events)
select run_id, event_id from e qualify row_number() over (partition by run_id order by event_id) <= 100"""
)
def run_record_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.to_date("ts").alias("run_id"), F.col("event_id").alias("id"))
    return history.record_changes(rows, 0).select("run_id", F.col("id").alias("event_id"))


# --- functions on names ----------------------------------------------------------------------------------------------

_FOLD = "translate(lower(translate({0}, 'Σİ', 'σi')), 'آأإٱىئةؤ', 'ااااييهو')"
_NORMAL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(" + _FOLD + r", '[ً-ٰٕـء]', '', 'g'), '[^\p{{L}}\p{{Nd}}\s\p{{Z}}]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
)
def _joined(normal: str) -> str:
    """SQL for a normalised text with its compounds joined: a first half takes the next word, over an article if one more follows."""
    first, article = "(عبد|abd|abdul|abdel|abdal)", "(ال|al|el)"
    three = f"regexp_replace(' ' || ({normal}) || ' ', ' {first} {article} ([^ ]+)', ' \\1\\2\\3', 'g')"
    return f"trim(regexp_replace({three}, ' {first} ([^ ]+)', ' \\1\\2', 'g'))"


@query("select id, " + _joined(_NORMAL.format("surname")) + " as normalized from sanctions_names where surname is not null")
def normalized_surnames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sanctions_names").filter("surname is not null").select("id", nm.normalize(F.col("surname")).alias("normalized"))


def _latin(text: str) -> str:
    """SQL for Arabic text in Latin letters: each letter by the table, then an 'a' between consonants but for digraphs and behind a vowel."""
    one = {k: v for k, v in ARABIC_LATIN.items() if len(v) == 1}
    out = rf"regexp_replace({text}, '[\x{{064B}}-\x{{065F}}]', '', 'g')"
    for letter, latin in ARABIC_LATIN.items():
        if len(latin) != 1:
            out = f"replace({out}, '{letter}', '{latin}')"
    out = f"translate({out}, '{''.join(one)}', '{''.join(one.values())}')"
    out = rf"trim(regexp_replace(regexp_replace({out}, '[\s\p{{Z}}]', ' ', 'g'), '[^\p{{L}}\p{{Nd}} ]', '', 'g'))"
    consonant = r"regexp_matches({0}, '^\p{{L}}$') and {0} not in ('a', 'e', 'i', 'o', 'u')"
    spaced = f"""{consonant.format("x[1]")} and {consonant.format("x[2]")} and not (x[1] in ('k', 's', 't', 'd', 'g') and x[2] = 'h')
      and coalesce(acc[-1], '') not in ('a', 'e', 'i', 'o', 'u')"""
    letters = "list_transform(range(1, length(w) + 1), lambda i: [w[i], coalesce(nullif(w[i + 1:i + 1], ''), ' ')])"
    return f"""list_transform([{out}], lambda w: array_to_string(list_reduce({letters},
      lambda acc, x: list_concat(acc, case when {spaced} then [x[1], 'a'] else [x[1]] end), cast([] as varchar[])), ''))[1]"""


_ARABIC = r"regexp_matches(original_script_name, '[\x{0600}-\x{06FF}]')"


@query(f"select id, {_latin('original_script_name')} as latin from sanctions_names where {_ARABIC}")
def transliterated_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sanctions_names").filter(nm.is_arabic(F.col("original_script_name")))
    return rows.select("id", nm.transliterate(F.col("original_script_name")).alias("latin"))


_SURNAME_TOKENS = f"""(select distinct unnest(string_split({_joined(_NORMAL.format("surname"))}, ' ')) t from sanctions_names where surname is not null)"""
_BARE = "case when length({0}) >= 5 and {0}[1:2] in ('ال', 'al', 'el') then {0}[3:] else {0} end"
_BONES = r"""case when regexp_matches({0}, '^[\x00-\x7F]*$') then array_to_string(list_filter(list_filter(string_split({0}, ''), lambda c: c not in ('a', 'e', 'i', 'o', 'u', 'y')),
    lambda c, i: i = 1 or c <> list_filter(string_split({0}, ''), lambda c: c not in ('a', 'e', 'i', 'o', 'u', 'y'))[i - 1]), '') else '' end"""


def _distance(a: str, b: str) -> str:
    """SQL for the edit distance of characters, where the built-in one counts bytes: row by row of the usual table."""
    above = f"case when j = 1 then row[1] + 1 else least(row[j] + 1, row[j - 1] + case when ord({b}[j - 1]) = x[1] then 0 else 1 end) end - j"
    after = f"list_transform([list_transform(range(1, len(row) + 1), lambda j: {above})], lambda t: list_transform(range(1, len(row) + 1), lambda j: list_min(t[1:j]) + j))[1]"
    letters = f"list_transform(range(1, length({a}) + 1), lambda i: [cast(ord({a}[i]) as bigint)])"
    slow = f"list_reduce({letters}, lambda row, x: {after}, range(0, length({b}) + 1))[-1]"
    return rf"case when regexp_matches({a} || {b}, '^[\x00-\x7F]*$') then levenshtein({a}, {b}) else {slow} end"


def _similar(pairs: str) -> str:
    """SQL of ``sims``: (a, b, s), the similarity of the normalised words of ``pairs`` (a, b)."""
    return f"""sw as (select distinct t, {_BARE.format("t")} bare from (select a t from {pairs} union select b from {pairs})),
sb as (select t, bare, {_BONES.format("bare")} bones from sw),
sp as (select p.a, p.b, x.bare ba, y.bare bb, x.bones sa, y.bones so, greatest(length(x.bare), length(y.bare)) l from (select distinct a, b from {pairs}) p
  join sb x on x.t = p.a join sb y on y.t = p.b),
sd as (select *, {_distance("ba", "bb")} dist from sp),
sq as (select *, (l - dist) * 100 // l s0, case when l <= 2 then 0 when l <= 7 then 1 when l <= 11 then 2 else 3 end budget from sd),
sims as (select a, b, cast(case when ba = bb then 100 when dist <= budget and s0 >= 85 then s0 when length(sa) >= 3 and sa = so then greatest(s0, 85)
  when dist > budget or s0 < 65 then 0 else s0 end as bigint) s from sq)"""


def _surname_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sanctions_names").filter("surname is not null")
    return rows.select(F.explode(F.split(nm.normalize(F.col("surname")), " ")).alias("t")).distinct()


@query(f"""with t as {_SURNAME_TOKENS}, b as (select t, {_BARE.format("t")} bare from t) select t, bare, {_BONES.format("bare")} as bones from b""")
def token_forms(spark: SparkSession, d: str) -> DataFrame:
    bare = nm.strip_article(F.col("t"))
    return _surname_tokens(spark, d).select("t", bare.alias("bare"), nm.skeleton(bare).alias("bones"))


#: A name row's own text, as the screening shows it; the original script where there is nothing else.
_OWN_TEXT = f"coalesce(nullif({_DISPLAY}, ''), original_script_name)"
_ROW_PAIRS = f"""nr as (select record_id, id, {_OWN_TEXT} txt from sanctions_names where record_id is not null),
rp as (select a.id qid, b.id cid, a.txt qtxt, b.txt ctxt from nr a join nr b on a.record_id = b.record_id and a.id < b.id),
nf as (select distinct txt, {_joined(_NORMAL.format("txt"))} n from nr where txt is not null),
nt as (select txt, n, list_filter(string_split(n, ' '), lambda t: t <> '') toks from nf)"""


def _row_pairs(spark: SparkSession, d: str, entity: bool) -> DataFrame:
    """(qid, cid, q, c): every two name rows of a record, with the form of each."""
    text = F.coalesce(nullif_empty(records.display_name()), F.col("original_script_name"))
    rows = table(spark, d, "sanctions_names").filter("record_id is not null").select("record_id", "id", sc.name_form(text, entity).alias("f"))
    other = rows.select("record_id", F.col("id").alias("cid"), F.col("f").alias("c"))
    return rows.select("record_id", F.col("id").alias("qid"), F.col("f").alias("q")).join(other, "record_id").filter("qid < cid")


def _listed(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _best_of(side: str, other: str, name: str) -> str:
    """SQL of the mean (f) of the best similarity of each word of ``side`` among those of ``other``, by pair."""
    words = lambda x, alias: f"(select qid, cid, unnest({x}) {alias}, unnest(range(1, len({x}) + 1)) {alias}i from tp)"
    return f"""{name}_w as (select x.qid, x.cid, x.wi, max(coalesce(s.s, 0)) best from {words(side, "w")} x left join {words(other, "v")} y
  on x.qid = y.qid and x.cid = y.cid left join sims s on s.a = x.w and s.b = y.v group by all),
{name} as (select qid, cid, cast(sum(best) as bigint) // count(*) f from {name}_w group by all)"""


_TOKEN_PAIRS = """wp as (select distinct a, b from (select unnest(qs) a, cs from tp), unnest(cs) u(b)),
both_ways as (select a, b from wp union select b, a from wp)"""
_FULL = f"""full_l as (select qid, cid, qn, cn, case when greatest(length(qn), length(cn)) = 0 then 100
    else (greatest(length(qn), length(cn)) - {_distance("qn", "cn")}) * 100 // greatest(length(qn), length(cn)) end whole from tp)"""
_GUARD = "case when coalesce(qn, '') = '' or coalesce(cn, '') = '' then 0 when qn = cn then 100 else {0} end"


@query(
    f"""with {_ROW_PAIRS},
fs as (select txt, n, toks, list_filter(toks, lambda t: length(t) >= 2) short from nt),
fk as (select *, case when len(list_filter(short, lambda t: t not in {_listed(nm.CONNECTORS)})) < 2 then short
  else list_filter(short, lambda t: t not in {_listed(nm.CONNECTORS)}) end kept from fs),
tp as (select qid, cid, q.n qn, c.n cn, case when len(q.short) = 0 or len(c.short) = 0 then q.toks else q.kept end qs,
  case when len(q.short) = 0 or len(c.short) = 0 then c.toks else c.kept end cs from rp left join fk q on q.txt = qtxt left join fk c on c.txt = ctxt),
{_TOKEN_PAIRS}, {_similar("both_ways")}, {_best_of("qs", "cs", "fwd")}, {_best_of("cs", "qs", "rev")}, {_FULL},
gq as (select qid, cid, max(coalesce(s.s, 0)) filter (x.wi = 1) given, max(coalesce(s.s, 0)) filter (x.wi = x.k) family
  from (select qid, cid, unnest(qs) w, unnest(range(1, len(qs) + 1)) wi, len(qs) k, cs from tp) x, unnest(x.cs) y(v) left join sims s on s.a = x.w and s.b = y.v group by all),
b0 as (select tp.*, coalesce(fwd.f, 0) f, coalesce(rev.f, 0) r, whole, len(qs) nq, len(cs) nc, coalesce(given, 0) given, coalesce(family, 0) family
  from tp join full_l using (qid, cid) left join fwd using (qid, cid) left join rev using (qid, cid) left join gq using (qid, cid)),
b1 as (select *, (least(f, r) * 70 + whole * 20 + case when greatest(nq, nc) > 0 then least(nq, nc) * 100 // greatest(nq, nc) end * 10) // 100 base, case when nc > 0 then nq * 100 // nc end cov from b0),
b2 as (select *, case when nq >= 2 and nq < nc and f >= 90 and cov >= 40
  then greatest(base, least(f - (100 - cov) // 2, base + case when nq >= 4 then 18 else 12 end)) else base end up from b1),
b3 as (select *, case when nq >= 2 and length(qs[1]) >= 3 and given < 72 then up * 60 // 100 else up end g1 from b2),
b4 as (select *, case when nq >= 2 and length(qs[nq]) >= 3 and family < 80 then g1 * 55 // 100 else g1 end g2 from b3)
select qid, cid, cast({_GUARD.format("least(g2, 100)")} as bigint) as score from b4"""
)
def name_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _row_pairs(spark, d, False)
    return rows.select("qid", "cid", sc.score_name_forms(F.col("q"), F.col("c")).alias("score"))


@query(
    f"""with {_ROW_PAIRS},
fs as (select txt, n, toks, list_filter(toks, lambda t: t not in {_listed(nm.ENTITY_NOISE)}) core0 from nt),
fk as (select txt, n, case when len(core0) = 0 then toks else core0 end core, case when len(core0) = 0 then [] else list_filter(toks, lambda t: t in {_listed(nm.ENTITY_NOISE)}) end noise from fs),
p0 as (select qid, cid, q.n qn, c.n cn, q.core qcore, c.core ccore, q.noise qnoise, c.noise cnoise from rp left join fk q on q.txt = qtxt left join fk c on c.txt = ctxt),
tp as (select qid, cid, qn, cn, list_concat(qcore, qnoise) qs, list_concat(ccore, cnoise) cs, qcore, ccore, qnoise, cnoise from p0),
{_TOKEN_PAIRS}, {_similar("both_ways")}, {_best_of("qcore", "ccore", "fwd")}, {_best_of("ccore", "qcore", "rev")}, {_best_of("qnoise", "cnoise", "nse")}, {_FULL},
b0 as (select tp.*, coalesce(fwd.f, 0) f, coalesce(rev.f, 0) r, coalesce(nse.f, 0) m, whole, len(qcore) nq, len(ccore) nc, len(qnoise) > 0 and len(cnoise) > 0 noisy
  from tp join full_l using (qid, cid) left join fwd using (qid, cid) left join rev using (qid, cid) left join nse using (qid, cid)),
b1 as (select *, (least(f, r) * 65 + whole * 20 + case when greatest(nq, nc) > 0 then least(nq, nc) * 100 // greatest(nq, nc) end * 15) // 100 + case when noisy then m // 10 else 0 end total from b0)
select qid, cid, cast({_GUARD.format("least(total, 100)")} as bigint) as score from b1"""
)
def entity_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _row_pairs(spark, d, True)
    return rows.select("qid", "cid", sc.score_entity_forms(F.col("q"), F.col("c")).alias("score"))


_CONTENT = f"""fs as (select txt, n, toks, list_filter(toks, lambda t: length(t) >= 2) short from nt),
fk as (select txt, n, case when len(short) = 0 then toks when len(list_filter(short, lambda t: t not in {_listed(nm.CONNECTORS)})) < 2 then short
  else list_filter(short, lambda t: t not in {_listed(nm.CONNECTORS)}) end content from fs),
tp as (select qid, cid, q.n qn, c.n cn, q.content qs, c.content cs from rp left join fk q on q.txt = qtxt left join fk c on c.txt = ctxt)"""
#: Of each pair the matrix of similarities; each word of one name takes the free word of the other that it is most like; the longest run in order.
_CHAINED = """mr as (select x.qid, x.cid, wi, list(coalesce(s, 0) order by vi) r from (select qid, cid, unnest(qs) w, unnest(range(1, len(qs) + 1)) wi from tp) x
  join (select qid, cid, unnest(cs) v, unnest(range(1, len(cs) + 1)) vi from tp) y on x.qid = y.qid and x.cid = y.cid left join sims s on s.a = w and s.b = v group by all),
mm as (select qid, cid, list(r order by wi) m from mr group by all),
tk as (select *, list_reduce(m, lambda acc, r: list_transform([list_max(list_transform(list_filter(range(1, len(r) + 1), lambda j: not list_contains(acc, j)), lambda j: r[j] * 1000 - j))],
  lambda v: case when (v + 999) // 1000 >= 72 then list_append(acc, (v + 999) // 1000 * 1000 - v) else acc end)[1], cast([] as bigint[])) places from mm),
lr as (select *, list_reduce(list_transform(places, lambda p: [p]), lambda acc, x: list_append(acc, x[1] * 1000 + 1
  + coalesce(list_max(list_transform(list_filter(acc, lambda e: e // 1000 < x[1]), lambda e: e % 1000)), 0)), cast([] as bigint[])) runs from tk),
ch as (select qid, cid, m, len(m) nq, len(m[1]) nc, coalesce(list_max(list_transform(runs, lambda e: e % 1000)), 0) * 100 // greatest(len(m), len(m[1])) ordered from lr),
ca as (select *, case when nq >= 3 and nc >= 3 then (m[1][1] * 35 + m[2][2] * 20 + m[nq][nc] * 30 + ordered * 15) // 100 else (m[1][1] * 45 + m[nq][nc] * 35 + ordered * 20) // 100 end chain,
  nq >= 3 and nc >= 3 and m[1][1] < 72 and list_max(m[1][2:]) >= 72 and list_max(list_transform(m[2:], lambda r: r[1])) >= 72 swapped,
  list_transform(m, lambda r: list_max(r)) bq, list_transform(range(1, len(m[1]) + 1), lambda j: list_max(list_transform(m, lambda r: r[j]))) bc from ch)"""


def _chain_sql(weight: str, more: str = "") -> str:
    """SQL of the second scorer, with the weight of a word ``t``."""
    weighed = lambda c: f"list_transform({c}, lambda t: {weight})"
    share = lambda w, b: f"list_sum(list_transform({w}, lambda x, i: x * {b}[i])) // list_sum({w})"
    return f"""with {_ROW_PAIRS}, {_CONTENT}, {_TOKEN_PAIRS}, {_similar("both_ways")}, {_FULL}, {_CHAINED}{more},
wt as (select tp.*, whole, ca.* exclude (qid, cid), {weighed("qs")} wq, {weighed("cs")} wc from tp join full_l using (qid, cid) left join ca using (qid, cid){", heavy" if more else ""}),
b0 as (select *, cast({share("wq", "bq")} as bigint) f, cast({share("wc", "bc")} as bigint) r, list_sum(list_transform(wq, lambda x, i: case when bq[i] >= 72 then x else 0 end)) mass from wt),
b1 as (select *, (least(f, r) * 60 + chain * 25 + whole * 15) // 100 base, nq * 100 // nc cov from b0),
b2 as (select *, case when nq >= 2 and nq < nc and f >= 90 and cov >= 40
  then greatest(base, least(f - (100 - cov) // 2, base + case when nq >= 4 then 18 else 12 end)) else base end up from b1),
b3 as (select *, case when swapped then up * 72 // 100 else up end g1 from b2),
b4 as (select *, case when mass >= 150 or chain >= 95 then g1 else least(g1, 74) end g2 from b3)
select qid, cid, cast({_GUARD.format("greatest(0, least(g2, 100))")} as bigint) as score from b4"""


@query(_chain_sql(f"case when {_BARE.format('t')} in {_listed(sc.FALLBACK)} then 20 else 100 end"))
def chain_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _row_pairs(spark, d, False)
    return rows.select("qid", "cid", sc.score_name_v2_forms(F.col("q"), F.col("c")).alias("score"))


@query(
    f"""with {_ROW_PAIRS}, tp as (select qid, cid, q.toks qs, c.toks cs from rp left join nt q on q.txt = qtxt left join nt c on c.txt = ctxt),
{_TOKEN_PAIRS}, {_similar("both_ways")} select a, b, s as similarity from sims"""
)
def token_similarities(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.explode(F.transform(F.col(f"{c}.all"), lambda t: t["t"]))
    pairs = _row_pairs(spark, d, False).select("c", words("q").alias("a")).select("a", words("c").alias("b")).distinct()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.select("a", "b", sc.token_similarity(F.col("a"), F.col("b")).alias("similarity"))


def _active_tokens(spark: SparkSession, d: str) -> DataFrame:
    return weights.record_tokens(*_t(spark, d, "sanctions_records", "sanctions_names"))


_FORMS = rf"""fv as (select id name_id, record_id, unnest([entity_name, concat_ws(' ', nullif(first_name, ''), nullif(middle_name, ''), nullif(surname, '')),
    single_string_name, original_script_name, case when {_ARABIC} then {_latin('original_script_name')} end]) t, unnest(range(0, 5)) o from sanctions_names),
fc as (select name_id, record_id, regexp_replace(coalesce(t, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') n, o from fv),
forms as (select name_id, record_id, n, cast(row_number() over (partition by name_id order by o) - 1 as int) ord
  from (select * from fc where n <> '' qualify row_number() over (partition by name_id, lower(n) order by o) = 1))"""


@query(f"with {_FORMS} select name_id, record_id, ord, n as name from forms")
def name_forms(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.variants(table(spark, d, "sanctions_names"))


_WEIGHTS = f"""{_FORMS},
an as (select f.record_id, {_joined(_NORMAL.format("n"))} n from forms f join sanctions_records r on r.id = f.record_id where r.active_status = 'Active'),
a1 as (select record_id, list_filter(string_split(n, ' '), lambda t: t <> '') toks from an),
al as (select record_id, toks, list_filter(toks, lambda t: length(t) >= 2) short from a1),
ak as (select record_id, case when len(short) = 0 then toks when len(list_filter(short, lambda t: t not in {_listed(nm.CONNECTORS)})) < 2 then short
  else list_filter(short, lambda t: t not in {_listed(nm.CONNECTORS)}) end toks from al),
aw as (select record_id, unnest(toks) t from ak),
ad as (select distinct record_id, {_BARE.format("t")} token from aw where {_BARE.format("t")} <> ''),
word_weights as (select token, df, cast(case when df * 10000 >= n * 500 then 20 when df * 10000 >= n * 200 then 35 when df * 10000 >= n * 50 then 55
  when df * 10000 >= n * 10 then 80 else 100 end as bigint) as weight from (select token, count(*) df from ad group by 1), (select count(distinct record_id) n from ad))"""


@query(f"with {_WEIGHTS} select * from word_weights")
def token_weights(spark: SparkSession, d: str) -> DataFrame:
    return weights.weights(_active_tokens(spark, d))


@query(
    _chain_sql(f"coalesce(hm[{_BARE.format('t')}], 100)", ", heavy as (select map_from_entries(list((token, weight))) hm from word_weights where weight < 100)")
    .replace("with nr as", f"with {_WEIGHTS}, nr as", 1)
)
def chain_scores_measured(spark: SparkSession, d: str) -> DataFrame:
    heavy = plan.heavy_words(weights.weights(_active_tokens(spark, d)))
    rows = _row_pairs(spark, d, False).join(F.broadcast(heavy))
    weight = lambda bare: F.coalesce(F.col("w")[bare], F.lit(100)).cast("bigint")
    return rows.select("qid", "cid", sc.score_name_v2_forms(F.col("q"), F.col("c"), weight).alias("score"))


@query(
    r"""with w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{3,}')) token from documents),
n as (select count(distinct doc_id) n from w), f as (select token, count(*) df from w group by 1)
select token, df, cast(case when df * 10000 >= n * 500 then 20 when df * 10000 >= n * 200 then 35 when df * 10000 >= n * 50 then 55
  when df * 10000 >= n * 10 then 80 else 100 end as bigint) as weight from f, n"""
)
def document_token_weights(spark: SparkSession, d: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), 0))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), words.alias("token"))
    return weights.weights(rows.distinct())


@query(
    r"""with t as (select id, list_filter(regexp_split_to_array(regexp_replace(single_string_name, '[+\-><()~*"\\@.,;:!?'']', '', 'g'), '[\s\p{Z}]+'),
  lambda w: length(w) >= 2) tokens from sanctions_names where single_string_name is not null)
select id, array_to_string(tokens, '|') as tokens from t"""
)
def search_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sanctions_names").filter("single_string_name is not null")
    return rows.select("id", F.array_join(retrieval.search_tokens(F.col("single_string_name")), "|").alias("tokens"))


_GROUPS = rf"""tw as (select query_id, list_filter(regexp_split_to_array(regexp_replace(name, '[+\-><()~*"\\@.,;:!?'']', '', 'g'), '[\s\p{{Z}}]+'), lambda w: length(w) >= 2) tokens from asked),
tu as (select query_id, unnest(tokens) token, cast(unnest(range(0, len(tokens))) as int) pos from tw),
tn as (select *, {_joined(_NORMAL.format("token"))} plain from tu),
tv as (select *, case when {_BARE.format("plain")} = plain then '' else {_BARE.format("plain")} end variant, plain in {_listed(nm.CONNECTORS)} connector from tn),
tr as (select *, row_number() over (partition by query_id, connector order by length(token) desc, pos) k, count(*) filter (not connector) over (partition by query_id) telling from tv),
groups as (select query_id, pos, token, variant, not connector and k <= (telling + 1) // 2 required from tr)"""


@query(
    f"""with asked as (select id query_id, single_string_name name from sanctions_names where single_string_name is not null), {_GROUPS},
gt as (select query_id, pos, case when required then '+' else '' end || case when variant <> '' and variant <> token then '(' || token || '* ' || variant || '*)' else token || '*' end t from groups)
select a.query_id as id, coalesce(string_agg(t, ' ' order by pos), '') as query from asked a left join gt using (query_id) group by 1"""
)
def boolean_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sanctions_names").filter("single_string_name is not null")
    groups = retrieval.term_groups(retrieval.search_tokens(F.col("single_string_name")))
    return rows.select("id", retrieval.boolean_query(groups).alias("query"))


#: The names searched for: of every name row whose id is divisible by 50 its own text.
_ASKED = f"asked as (select id query_id, {_OWN_TEXT} name from sanctions_names where id % 50 = 0)"


def _searches(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce(nullif_empty(records.display_name()), F.col("original_script_name"))
    return table(spark, d, "sanctions_names").filter("id % 50 = 0").select(F.col("id").alias("query_id"), text.alias("name"))


@query(
    f"""with {_ASKED}, {_GROUPS},
tq as (select query_id, list(lower(token)) tokens from groups group by 1),
n as (select id name_id, record_id, [lower(first_name), lower(middle_name), lower(surname), lower(single_string_name), lower(original_script_name), lower(entity_name)] x
  from sanctions_names),
m as (select query_id, name_id, record_id from n, tq where len(list_filter(tokens, lambda t: len(list_filter(x, lambda c: c like '%' || t || '%')) > 0))
  >= case when len(tokens) <= 2 then len(tokens) else (len(tokens) + 1) // 2 end)
select query_id, name_id, record_id from m"""
)
def like_matches(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.like_rows(_searches(spark, d), table(spark, d, "sanctions_names"))


def _matches_sql(required: str) -> str:
    return rf"""with {_ASKED}, {_GROUPS},
gw as (select query_id, pos, {required} required, unnest(list_distinct([lower(token), lower(case when variant = '' then token else variant end)])) prefix from groups),
posted as (select name_id, record_id, unnest(list_distinct(terms)) term from (select n.id name_id, record_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', first_name, middle_name,
    surname, single_string_name, original_script_name, entity_name)), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: t <> '') terms
  from sanctions_names n join sanctions_records r on r.id = n.record_id where r.active_status = 'Active')),
vocabulary as (select term, count(*) df from posted group by 1),
vm as (select distinct query_id, pos, required, term, df from gw join vocabulary on starts_with(term, prefix)),
sizes as (select query_id, pos, required, sum(df) rows_of from vm group by all),
hit as (select distinct query_id, pos, required, name_id, record_id, rows_of from vm join posted using (term) join sizes using (query_id, pos, required)),
must as (select query_id, count(*) filter ({required}) needed from groups group by 1),
scored as (select query_id, name_id, record_id, count(*) filter (required) found, round(sum(1.0 / (1.0 + ln(1.0 + cast(rows_of as double)))), 9) relevance from hit group by all)
select query_id, name_id, record_id, relevance from scored join must using (query_id) where found = needed
qualify row_number() over (partition by query_id order by relevance desc, record_id, name_id) <= 300"""


def _matches(spark: SparkSession, d: str, broad: bool) -> DataFrame:
    recs, names = _t(spark, d, "sanctions_records", "sanctions_names")
    return retrieval.matching_rows(_searches(spark, d), retrieval.searchable(names, recs), broad).select("query_id", "name_id", "record_id", "relevance")


@query(_matches_sql("required"))
def precise_matches(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d, False)


@query(_matches_sql("(not connector and k = 1)").replace("pos, token, variant, not connector and k <= (telling + 1) // 2 required", "pos, token, variant, connector, k"))
def broad_matches(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d, True)


# --- secondary identifiers -------------------------------------------------------------------------------------------

_MONTHS = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
_DATES = rf"""d as (select id, record_id, cast(trim(year) as int) y,
  coalesce(nullif(list_position({_MONTHS}, lower(trim(coalesce(month, '')))), 0), try_cast(trim(month) as int), 0) m,
  coalesce(try_cast(trim(day) as int), 0) d from sanctions_dates
  where date_type = 'Date of Birth' and regexp_matches(trim(coalesce(year, '')), '^[1-9]\d\d\d$')),
p as (select id, record_id, y, case when m between 1 and 12 then m else 0 end m, case when d between 1 and 31 then d else 0 end d from d)"""


@query(
    f"""with {_DATES} select id, case when m = 0 then format('{{:04d}}', y) when d = 0 then format('{{:04d}}-{{:02d}}', y, m)
  else format('{{:04d}}-{{:02d}}-{{:02d}}', y, m, d) end as date from p"""
)
def partial_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sanctions_dates").filter("date_type = 'Date of Birth'")
    date = dt.partial_date(F.col("day"), F.col("month"), F.col("year"))
    return rows.select("id", date.alias("p")).filter("p is not null").select("id", dt.format_partial_date(F.col("p")).alias("date"))


@query(
    f"""with {_DATES}, c as (select *, case when y = 1972 and m > 0 and (m <> 6 or (d > 0 and d <> 10)) then -10 when y = 1972 and m > 0 and d > 0 then 10
  when y = 1972 and m > 0 then 8 when y = 1972 then 6 when abs(y - 1972) = 1 then 3 when abs(y - 1972) <= 3 then -10 else -25 end adj from p),
b as (select * from c qualify row_number() over (partition by record_id order by adj desc, id) = 1)
select record_id, cast(adj as int) as adjustment, case when adj = 10 then 'confirmed_exact' when adj = 8 then 'confirmed_month'
  when adj = 6 then 'confirmed_year' when adj = 3 then 'near' else 'contradicted' end as status from b"""
)
def dob_comparisons(spark: SparkSession, d: str) -> DataFrame:
    born = factors.birth_dates(table(spark, d, "sanctions_dates"))
    asked = F.struct(F.lit(1972).alias("y"), F.lit(6).alias("m"), F.lit(10).alias("d"))
    best = dt.compare_dob(asked, F.col("dob_dates"))
    return born.select("record_id", best["adjustment"].alias("adjustment"), best["status"].alias("status"))


@query(
    """with k as (select upper(trim(code)) code, regexp_replace(lower(code), '[^a-z0-9]', '', 'g') key, 1 r from sanctions_ref_countries
  union all select upper(trim(code)), regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 0 from sanctions_ref_countries)
select key, code from k where key <> '' qualify row_number() over (partition by key order by r, code) = 1"""
)
def country_keys(spark: SparkSession, d: str) -> DataFrame:
    return ct.country_index(table(spark, d, "sanctions_ref_countries"))


@query(
    """with k as (select upper(trim(code)) code, regexp_replace(lower(code), '[^a-z0-9]', '', 'g') key, 1 r from sanctions_ref_countries
  union all select upper(trim(code)), regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 0 from sanctions_ref_countries),
i as (select key, code from k where key <> '' qualify row_number() over (partition by key order by r, code) = 1)
select c.id, coalesce(i.code, '') as resolved_code from sanctions_countries c
left join i on i.key = regexp_replace(lower(c.country_code), '[^a-z0-9]', '', 'g')"""
)
def resolved_countries(spark: SparkSession, d: str) -> DataFrame:
    rows, ref = _t(spark, d, "sanctions_countries", "sanctions_ref_countries")
    return ct.resolve_countries(rows, ct.country_index(ref), "country_code").select("id", "resolved_code")


@query(
    """with f as (select record_id, country_code, min(id) id from sanctions_countries
  where country_type in ('Citizenship', 'Nationality') and coalesce(country_code, '') <> '' group by 1, 2),
c as (select record_id, list(country_code order by id) codes from f group by 1)
select record_id, cast(case when list_has_any(codes, ['NOVINE', 'SHUFUL']) then 6 else -12 end as int) as adjustment,
  case when list_has_any(codes, ['NOVINE', 'SHUFUL']) then 'confirmed' else 'contradicted' end as status,
  case when list_contains(codes, 'NOVINE') then 'NOVINE' when list_contains(codes, 'SHUFUL') then 'SHUFUL' else array_to_string(codes, ',') end as matched from c"""
)
def citizenship_comparisons(spark: SparkSession, d: str) -> DataFrame:
    held = factors.citizenships(table(spark, d, "sanctions_countries"))
    out = ct.compare_citizenship(F.array(F.lit("NOVINE"), F.lit("SHUFUL")), F.col("citizenships"))
    return held.select("record_id", *(out[c].alias(c) for c in ("adjustment", "status", "matched")))


@query(
    """with e as (select event_id, cast(floor(value) as bigint) % 101 s, cast((event_id % 29) as bigint) - 20 a from events where value is not null)
select event_id, cast(case when a < 0 and s >= 90 and greatest(0, least(100, s + a)) < 75 then 75 else greatest(0, least(100, s + a)) end as bigint) as score from e"""
)
def adjusted_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter("value is not null").selectExpr("event_id", "cast(floor(value) as bigint) % 101 s", "event_id % 29 - 20 a")
    return rows.select("event_id", sc.adjusted_score(F.col("s"), F.col("a"), 75).alias("score"))


@query(
    """with e as (select cast(case when event_type in ('purchase', 'click') then 1 else 0 end as int) y, cast(floor(value) as bigint) % 101 s
  from events where value is not null), t(th) as (values (70), (75), (80), (85)),
c as (select th, count(*) filter (s >= th and y = 1) tp, count(*) filter (s >= th) f, count(*) filter (y = 1) p from e, t group by 1)
select th as threshold, cast(case when f = 0 then 0 else tp * 100 // f end as bigint) as precision,
  cast(case when p = 0 then 0 else tp * 100 // p end as bigint) as recall from c"""
)
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter("value is not null").selectExpr(
        "cast(event_type in ('purchase', 'click') as int) label", "cast(floor(value) as bigint) % 101 score"
    )
    return plan.precision_recall(rows)


# --- screening -------------------------------------------------------------------------------------------------------


def _screen_tables(spark: SparkSession, d: str) -> plan.Tables:
    return plan.Tables(*_t(spark, d, "sanctions_records", "sanctions_names", "sanctions_dates", "sanctions_countries", "sanctions_ref_countries"))


@query()
def screen_names(spark: SparkSession, d: str) -> DataFrame:
    return plan.screen(_searches(spark, d), _screen_tables(spark, d))


@query()
def screen_entities(spark: SparkSession, d: str) -> DataFrame:
    return plan.screen(_searches(spark, d), _screen_tables(spark, d), plan.Options(min_score=60, search_type="entity", like_fallback=True))


@query()
def screened_documents(spark: SparkSession, d: str) -> DataFrame:
    tables = _screen_tables(spark, d)
    found = plan.screen(_searches(spark, d), tables, plan.Options(min_score=80))
    docs = plan.screened_records(found, tables, table(spark, d, "custom_lists"))
    names, dates, lands = (F.size(f"record.{k}").alias(k) for k in ("names", "dates", "countries"))
    return docs.select("query_id", "rank", "record_id", "score", "source", "is_custom_list", F.col("record.record_type").alias("record_type"), names, dates, lands)


def _searches_with_facts(spark: SparkSession, d: str) -> DataFrame:
    """The searches with the first date of birth of their record as it is typed, and its citizenships."""
    own = table(spark, d, "sanctions_names").filter("id % 50 = 0").select(F.col("id").alias("query_id"), "record_id")
    dates = table(spark, d, "sanctions_dates").filter("date_type = 'Date of Birth' and year is not null").groupBy("record_id").agg(F.min_by("year", "id").alias("date_of_birth"))
    lands = table(spark, d, "sanctions_countries").filter("country_code is not null").groupBy("record_id").agg(F.sort_array(F.collect_set("country_code")).alias("citizenship"))
    return _searches(spark, d).join(own, "query_id").join(dates, "record_id", "left").join(lands, "record_id", "left").drop("record_id")


@query()
def screen_with_factors(spark: SparkSession, d: str) -> DataFrame:
    return plan.screen(_searches_with_facts(spark, d), _screen_tables(spark, d), plan.Options(min_score=60))


@query()
def screen_rejections(spark: SparkSession, d: str) -> DataFrame:
    return plan.rejected(_searches_with_facts(spark, d))


@query()
def screen_shadow_counts(spark: SparkSession, d: str) -> DataFrame:
    tables = _screen_tables(spark, d)
    measured = weights.weights(_active_tokens(spark, d))
    found = plan.screen(_searches(spark, d), tables, plan.Options(min_score=60, shadow=True), measured)
    return plan.shadow_comparison(found, 60)
