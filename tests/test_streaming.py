from namelode.plans import screen as plan
from namelode.streaming.screening import change_stream, screen_stream


def test_changes_of_a_stream(spark, tmp_path):
    fields = "id bigint, record_type string, action string, action_date string, gender string, active_status string, deceased string, profile_notes string"
    stored = spark.createDataFrame([(1, "Person", "Active"), (2, "Person", "Inactive")], "id bigint, record_type string, active_status string")
    rows = [(1, "Person", "chg", None, None, "Inactive", None, None), (2, "Person", "chg", None, None, "Active", None, None), (3, "Entity", "add", None, None, "Active", None, None)]
    spark.createDataFrame(rows, fields).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(fields).parquet(str(tmp_path / "in"))
    query = change_stream(stream, lambda: stored, lambda df, _: seen.extend(map(tuple, df.select("record_id", "change_type").collect())), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [(1, "inactivated"), (2, "reactivated"), (3, "added")]


def test_screening_of_a_stream(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    tables = plan.Tables(*(spark.read.parquet(f"{data}/{t}.parquet") for t in ("sanctions_records", "sanctions_names", "sanctions_dates", "sanctions_countries", "sanctions_ref_countries")))
    texts = tables.names.filter("id % 50 = 0").selectExpr("id query_id", "coalesce(single_string_name, concat_ws(' ', first_name, middle_name, surname)) name")
    texts.coalesce(1).write.parquet(str(tmp_path / "in"))
    options, seen = plan.Options(min_score=60), []
    stream = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
    query = screen_stream(stream, tables, options, lambda df, _: seen.extend(map(tuple, df.select("query_id", "rank", "record_id").collect())), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == sorted(map(tuple, plan.screen(texts, tables, options).select("query_id", "rank", "record_id").collect())) != []


def test_wildcard_fallback_and_entities(spark):
    data = "/root/testdata/sf0.001"
    tables = plan.Tables(*(spark.read.parquet(f"{data}/{t}.parquet") for t in ("sanctions_records", "sanctions_names", "sanctions_dates", "sanctions_countries", "sanctions_ref_countries")))
    active = tables.records.filter("active_status = 'Active'").selectExpr("id record_id", "record_type")
    entity = tables.names.filter("entity_name <> ''").join(active.filter("record_type = 'Entity'"), "record_id").orderBy("id").first()
    person = tables.names.filter("length(surname) > 6 and first_name <> ''").join(active.filter("record_type <> 'Entity'"), "record_id").orderBy("id").first()
    asked = spark.createDataFrame([(1, entity["entity_name"]), (2, f"{person['first_name'][1:]} {person['surname'][1:]}")], "query_id int, name string")
    found = plan.screen(asked, tables, plan.Options(search_type="entity")).collect()
    assert entity["record_id"] in {r["record_id"] for r in found if r["query_id"] == 1 and r["score"] == 100}
    without, fallback = (plan.screen(asked.filter("query_id = 2"), tables, plan.Options(min_score=40, like_fallback=f)).collect() for f in (False, True))
    assert person["record_id"] not in {r["record_id"] for r in without} and person["record_id"] in {r["record_id"] for r in fallback}
