import datetime as day
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from namelode.functions import countries as ct
from namelode.functions import dates as dt
from namelode.operators import cdc, custom_lists, history, records, retrieval
from namelode.operators.snapshots import snapshot_changes
from namelode.plans import screen as plan
from namelode.sources import feed, load


def test_partial_dates(spark):
    good = {"1985": "1985", "1985-03": "1985-03", "03/1985": "1985-03", "1985-03-12": "1985-03-12", "12-Mar-1985": "1985-03-12", "1985.2.31": "1985-02-31", " 1 sept 1990 ": "1990-09-01"}
    bad = ["03/04/1985", "85", "1985-13", "x", "1985-01-40"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string")
    out = {r[0]: r[1] for r in df.select("t", dt.format_partial_date(dt.parse_partial_date(F.col("t")))).collect()}
    assert out == good | dict.fromkeys(bad, "")


def test_dob_and_citizenship(spark):
    date = lambda y, m=0, d=0: F.struct(F.lit(y).alias("y"), F.lit(m).alias("m"), F.lit(d).alias("d"))
    one = spark.range(1)
    cases = [((1985, 3, 12), (1985, 3, 12), 10, "confirmed_exact"), ((1985, 3), (1985, 3, 12), 8, "confirmed_month"), ((1985,), (1985, 3), 6, "confirmed_year"),
             ((1985,), (1986,), 3, "near"), ((1985,), (1988,), -10, "contradicted"), ((1985,), (1999,), -25, "contradicted"), ((1985, 3), (1985, 4), -10, "contradicted")]
    for a, b, n, status in cases:
        got = one.select(dt.compare_dob(date(*a), F.array(date(*b), date(1900))).alias("c")).first()["c"]
        assert (got["adjustment"], got["status"]) == (n, status)
    got = one.select(ct.compare_citizenship(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("B"))).alias("c")).first()["c"]
    assert tuple(got) == (6, "confirmed", "B")
    got = one.select(ct.compare_citizenship(F.array().cast("array<string>"), F.array(F.lit("B"))).alias("c")).first()["c"]
    assert tuple(got) == (0, "unresolved", "")


def test_country_index(spark):
    ref = spark.createDataFrame([("SAUDI", "Saudi Arabia"), ("USA", "United States"), ("X", None), (None, "None")], "code string, name string")
    index = {r["key"]: r["code"] for r in ct.country_index(ref).collect()}
    assert index["sa"] == index["saudiarabia"] == index["saudi"] == "SAUDI" and index["us"] == "USA" and index["x"] == "X" and "" not in index


def test_values_that_move_between_columns_are_changes(spark):
    kinds = "snapshot_no int, record_id bigint, active_status string, action string, action_date string, received_at timestamp"
    at = day.datetime(2024, 1, 1)
    pairs = {1: (("x", None, None), (None, "x", None)), 2: ((None, None, None), (None, "", None)), 3: (("a", "b", None), ("ab", None, None)),
             4: (("a", None, None), ("a", None, "2024-01-02")), 5: (("A ", " b", None), ("a", "B", ""))}
    rows = [(n + 1, k, *v, at) for k, both in pairs.items() for n, v in enumerate(both)]
    got = {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {(k, 2, "changed") for k in (1, 3, 4)}


def test_boolean_text(spark):
    df = spark.createDataFrame([("noura alkahtani",), ("bin al",), ("a",)], "t string")
    out = [r[0] for r in df.select(retrieval.boolean_query(retrieval.term_groups(retrieval.search_tokens(F.col("t"))))).collect()]
    assert out == ["noura* +(alkahtani* kahtani*)", "bin* al*", ""]


def test_complete_feed():
    assert cdc.is_complete_feed("Full", 0, 9_000, 10_000) and cdc.is_complete_feed("full", 0, 1, 10)
    assert not cdc.is_complete_feed("delta", 0, 10, 10) and not cdc.is_complete_feed("full", 0, 8_999, 10_001)
    assert not cdc.is_complete_feed("full", 100, 3_900_000, 3_900_000)


def test_upsert_and_append(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 0), (2, "y", 1), (3, None, 0), (None, "z", 0)], "k int, v string, seq int")
    assert sorted(map(tuple, cdc.upserted(old, new, "k", ["v"]).collect())) == [(1, "a"), (2, "y"), (3, None)]
    more = spark.createDataFrame([(1, "n"), (4, "q"), (4, "q"), (None, "p"), (None, "p")], "k int, v string")
    assert sorted(map(str, (r["k"] for r in cdc.appended(old, more, ["k"]).collect()))) == ["1", "2", "4", "None", "None"]


def test_dense_ids(spark):
    rows = spark.range(1000).withColumnRenamed("id", "n").repartition(7)
    got = sorted((r["n"], r["id"]) for r in cdc.with_ids(rows, ["n"], 50).collect())
    assert got == [(i, i + 51) for i in range(1000)]


def test_custom_list_upload(spark):
    rows = [(0, "Person", "Ann Lee", ["A. Lee", ""], "12-Mar-1985", "SA", None, None, None, None), (1, "entity", "Acme", None, "bad", None, None, None, "reg", "7"), (2, None, " ", None, None, None, None, None, None, None)]
    out = custom_lists.uploaded(spark.createDataFrame(rows, f"entry_no long, {custom_lists.ENTRY}"), 9, 100)
    assert sorted((r["id"], r["record_type"]) for r in out["records"].collect()) == [(100, "Person"), (101, "Entity")]
    assert {(r["record_id"], r["name_type"], r["single_string_name"], r["entity_name"]) for r in out["names"].collect()} == {
        (100, "Primary Name", "Ann Lee", None), (100, "Also Known As", "A. Lee", None), (101, "Primary Name", None, "Acme")}
    assert [(r["day"], r["month"], r["year"]) for r in out["dates"].collect()] == [("12", "3", "1985")]
    assert out["countries"].count() == 1 and out["id_numbers"].count() == 1


def test_associations(spark):
    links = spark.createDataFrame([(1, 10, 2, 5, False), (2, 10, 3, 9, True)], "id long, record_id long, associate_id long, relationship_code long, is_ex boolean")
    blank = (None,) * 4
    names = spark.createDataFrame([(8, 2, "Primary Name", *blank, None, None, None, None, "Later"), (7, 2, "Primary Name", "T", "A", None, "B", None, None, "", None, "")],
                                  "id long, record_id long, " + ", ".join(f"{c} string" for c in records.CHILD_KEYS["names"]))
    kinds = spark.createDataFrame([(5, "Brother")], "code long, name string")
    out = {r["associate_id"]: (r["associate_name"], r["relationship"]) for r in records.association_names(links, names, kinds).collect()}
    assert out == {2: ("A B", "Brother"), 3: ("", None)}


def _snapshots(spark, rows):
    return spark.createDataFrame(rows, "snapshot_no int, record_id long, active_status string, action string, action_date string, received_at timestamp, extra string")


def test_snapshot_changes(spark):
    at = day.datetime(2025, 1, 1)
    late = at + day.timedelta(hours=1)
    rows = [(1, 1, "Active", "add", "2024-01-02", at, "x"), (2, 1, " ACTIVE ", "Add", "2-Jan-2024", at, "y"), (1, 2, "Active", None, "", at, ""), (2, 2, "Active", "", None, at, ""),
            (1, 3, "Active", "add", None, at, ""), (2, 3, "Active", "add", None, at, ""), (2, 3, "Inactive", "del", None, late, ""), (1, 4, "Active", "a", None, at, ""), (2, 5, "Active", "a", None, at, ""),
            (2, None, "Active", "a", None, at, ""), (None, 9, "Active", "a", None, at, "")]
    assert sorted(map(tuple, snapshot_changes(_snapshots(spark, rows)).collect())) == [(3, 2, "changed"), (4, 2, "removed"), (5, 2, "added")]
    assert snapshot_changes(_snapshots(spark, [])).count() == 0
    many = [(n, i, "Active", "a", None, at, "") for n in (1, 2) for i in range(500)] + [(2, 7, "Inactive", "a", None, late, "")] * 300
    assert list(map(tuple, snapshot_changes(_snapshots(spark, many), range_width=64, chunk_rows=4).collect())) == [(7, 2, "changed")]


FEED = {"_meta": {"feed_scope": "full", "record_count": 2}, "ref_country": [{"code": "AA", "name": "Aland"}],
        "record": [{"id": 1, "record_type": "Person", "active_status": "Active", "gender": "a]b\"{,}"}, {"id": 2, "active_status": "Active"}, {"id": "4", "active_status": "Active"}, {"id": None}],
        "record_name": [{"record_id": 1, "name_type": "Primary Name", "surname": "Lee"}], "other": [1, [2], {"a": []}], "flag": True, "association": []}


def test_feed_split_and_load(spark, tmp_path):
    path = tmp_path / "feed.json"
    path.write_text(json.dumps(FEED, indent=1))
    assert feed.split_feed(str(path), str(tmp_path / "w"), chunk=7) == FEED["_meta"]
    rows = feed.read_section(spark, str(tmp_path / "w"), "record")
    assert sorted((r["id"], r["gender"]) for r in rows.collect()) == [(1, 'a]b"{,}'), (2, None)]
    assert feed.read_section(spark, str(tmp_path / "w"), "record_role").count() == 0
    assert feed.read_feed(spark, str(path))["record"].count() == 3
    store = str(tmp_path / "store")
    first = load.load_feed(spark, str(path), store, str(tmp_path / "w1"))
    total = lambda run: dict(sum((Counter({c["change_type"]: c["count"]}) for c in run["changes"]), Counter()))
    assert first["status"] == "completed" and total(first) == {"added": 2}
    again = FEED | {"record": [{"id": 1, "record_type": "Person", "active_status": "Inactive", "action": "chg"}, {"id": 3, "active_status": "x"}]}
    path.write_text(json.dumps(again))
    second = load.load_feed(spark, str(path), store, str(tmp_path / "w2"))
    assert total(second) == {"added": 1, "added_inactive": 1, "inactivated": 2, "removed_from_feed": 1}
    now = {r["id"]: (r["active_status"], r["action"]) for r in load.Store(spark, store).read("record", load.schema_of("record")).collect()}
    assert now == {1: ("Inactive", "chg"), 2: ("Inactive", "del"), 3: ("x", None)}
    assert load.Store(spark, store).read("record_name", load.schema_of("record_name")).count() == 2
    with load.single_writer(spark, store), pytest.raises(RuntimeError):
        load.load_feed(spark, str(path), store, str(tmp_path / "w2"))
    kept = load.Store(spark, store)
    assert sorted((r["run_id"], r["record_id"], r["change_type"], r["display_name"]) for r in kept.record_changes().collect()) == [
        (2, 1, "inactivated", "Lee"), (2, 2, "inactivated", None), (2, 2, "removed_from_feed", None), (2, 3, "added", None)]
    assert history.affected(kept.run_changes()).filter("run_id = 2").first()["total_records_affected"] == 4
    path.write_text("{")
    with pytest.raises(Exception):  # noqa: B017
        load.load_feed(spark, str(path), "/proc/none", str(tmp_path / "w3"))
    (tmp_path / "bad.json").write_text('{"record": [{]}')
    with pytest.raises(ValueError):
        load.load_feed(spark, str(tmp_path / "bad.json"), store, str(tmp_path / "w4"))
    runs = history.run_page(kept.runs()).collect()
    assert [(r["id"], r["status"]) for r in runs] == [(3, "failed"), (2, "completed"), (1, "completed")] and kept.version == 2
    kept.folder.create("loader.lock", "2020-01-01T00:00:00+00:00")
    with load.single_writer(spark, store):
        pass
    assert not kept.folder.exists("loader.lock")


def test_screening(spark):
    data = "/root/testdata/sf0.001"
    tables = plan.Tables(*(spark.read.parquet(f"{data}/{t}.parquet") for t in ("sanctions_records", "sanctions_names", "sanctions_dates", "sanctions_countries", "sanctions_ref_countries")))
    row = tables.names.filter("name_type = 'Primary Name' and surname <> '' and middle_name <> ''").join(
        tables.records.filter("active_status = 'Active' and record_type <> 'Entity'").selectExpr("id record_id"), "record_id"
    ).orderBy("record_id").first()
    name = f"{row['first_name']} {row['middle_name']} {row['surname']}"
    asked = spark.createDataFrame([(1, name), (2, " "), (3, "zzzz qqqq")], "query_id int, name string")
    out = plan.screen(asked, tables, plan.Options(min_score=60, shadow=False)).collect()
    assert out[0]["query_id"] == 1 and out[0]["rank"] == 1 and out[0]["score"] == 100 and {r["query_id"] for r in out} == {1}


def test_record_show(spark, tmp_path):
    whole = FEED | {"ref_relationship": [{"code": 5, "name": "Brother"}], "ref_description1": [{"description1_id": 1, "name": "Top"}], "record_image": [{"record_id": 1, "url": "u"}, {"record_id": 1, "url": "u"}],
                    "record_description": [{"record_id": 1, "description1_id": 1}], "association": [{"record_id": 1, "associate_id": 2, "relationship_code": 5, "is_ex": "yes"}]}
    (tmp_path / "feed.json").write_text(json.dumps(whole))
    load.load_feed(spark, str(tmp_path / "feed.json"), str(tmp_path / "s"), str(tmp_path / "w"))
    store = load.Store(spark, str(tmp_path / "s"))
    lists = spark.createDataFrame([], "id bigint, name string")
    tables = {s: store.read(s, load.schema_of(s)) for s in feed.SECTIONS}
    got = {r["id"]: r for r in records.record_show(tables, lists, tables["record"].select("id")).collect()}
    one = got[1]
    assert [i["url"] for i in one["images"]] == ["u"] and one["descriptions"][0]["description1"] == "Top" and got[2]["images"] == []
    assert (one["associations"][0]["associate_name"], one["associations"][0]["relationship"], one["associations"][0]["is_ex"]) == ("", "Brother", True)


def test_screened_records_and_rejections(spark):
    data = "/root/testdata/sf0.001"
    tables = plan.Tables(*(spark.read.parquet(f"{data}/{t}.parquet") for t in ("sanctions_records", "sanctions_names", "sanctions_dates", "sanctions_countries", "sanctions_ref_countries")))
    lists = spark.read.parquet(f"{data}/custom_lists.parquet")
    row = tables.names.filter("name_type = 'Primary Name' and surname <> '' and first_name <> ''").join(
        tables.records.filter("active_status = 'Active' and record_type <> 'Entity'").selectExpr("id record_id"), "record_id"
    ).orderBy("record_id").first()
    name = f"{row['first_name']} {row['surname']}"
    asked = spark.createDataFrame([(1, name, None), (2, "\u00a0 ", None), (3, name, "someday"), (4, None, None)], "query_id int, name string, date_of_birth string")
    assert {r["query_id"]: r["error"] for r in plan.rejected(asked).collect()} == {2: "name is required", 3: "date_of_birth can't be read", 4: "name is required"}
    found = plan.screen(asked, tables, plan.Options(min_score=60, shadow=True))
    docs = plan.screened_records(found, tables, lists).collect()
    assert docs and {r["query_id"] for r in docs} == {1} and all(r["record"]["id"] == r["record_id"] and r["record"]["names"] for r in docs)
    assert all(r["is_custom_list"] == (r["record"]["custom_list_id"] is not None) and r["shadow_name"] for r in docs)
    assert plan.screened_records(found.limit(0), tables, lists).count() == 0
