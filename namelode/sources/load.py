"""Loading a feed into a versioned set of Parquet tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namelode.operators import cdc
from namelode.operators.history import run_row
from namelode.sources.feed import SECTIONS, columns_of, read_section, split_feed

#: Keys of the reference sections.
REFERENCE_KEYS = {"ref_country": "code", "ref_occupation": "code", "ref_relationship": "code", "ref_sanctions": "id",
                  "ref_description1": "description1_id", "ref_description2": "description2_id", "ref_description3": "description3_id"}
#: A lock of a load that hasn't ended is taken over after so long.
STALE = timedelta(hours=12)
#: The runs, their counts and the records they changed.
RUNS = "id bigint, started_at timestamp, completed_at timestamp, status string, duration_ms bigint, error string, changes string"
RUN_CHANGES = "run_id bigint, change_type string, entity string, record_type string, count bigint"
RECORD_CHANGES = ("run_id bigint, id bigint, record_id bigint, change_type string, record_type string, active_status string, gender string, action string, "
                  "action_date string, deceased string, display_name string, date_of_birth string, countries_json string")  # fmt: skip


class Folder:
    """A folder of any file system that the session knows, by small text files."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str, replace: bool = False) -> bool:
        """Writes a file whole; False if it is there and isn't to be replaced."""
        try:
            stream = self.fs.create(self._at(name), replace)
        except Exception:
            if self.exists(name):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._at(name))] if self.exists(name) else []


@contextmanager
def single_writer(spark: SparkSession, store: str, stale: timedelta = STALE) -> Iterator[None]:
    """Holds the store's lock; a second loader is refused at once, but takes over the lock of a load that began ``stale`` ago."""
    folder, now = Folder(spark, store), datetime.now(timezone.utc)
    if not folder.create("loader.lock", now.isoformat()):
        held = folder.read("loader.lock")
        if not held or now - datetime.fromisoformat(held) < stale:
            raise RuntimeError(f"another load holds {store}/loader.lock")
        folder.create("loader.lock", now.isoformat(), replace=True)
    try:
        yield
    finally:
        folder.delete("loader.lock")


class Store:
    """Tables below a folder; the highest number in ``versions`` names the version that readers see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path, Folder(spark, path)

    @property
    def version(self) -> int:
        return max([0, *map(int, (n for n in self.folder.names("versions") if n.isdecimal()))])

    def read(self, name: str, schema: str) -> DataFrame:
        """A table of the current version; empty if there is none."""
        return self._table(f"v{self.version}/{name}", schema)

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self.folder.exists(name) else self.spark.createDataFrame([], schema)

    def publish(self, version: int) -> None:
        """Makes a version the current one in one step: a file appears."""
        self.folder.create(f"versions/{version}", "")

    def runs(self) -> DataFrame:
        """The history of loads, running and failed ones too; ``changes`` are their counts as JSON."""
        return self.spark.read.schema(RUNS).json(f"{self.path}/runs") if self.folder.exists("runs") else self.spark.createDataFrame([], RUNS)

    def run_changes(self) -> DataFrame:
        """The counts of changes of every load."""
        return self._table("run_changes", RUN_CHANGES)

    def record_changes(self) -> DataFrame:
        """The records that each load changed, with what they were called."""
        return self._table("record_changes", RECORD_CHANGES)


def schema_of(section: str) -> str:
    kinds = {"t": "string", "i": "bigint", "b": "boolean"}
    extra = ", custom_list_id bigint" if section == "record" else ", id bigint" if section not in REFERENCE_KEYS else ""
    return ", ".join(f"{n} {kinds[k]}" for n, k in columns_of(section)) + extra


def load_feed(spark: SparkSession, path: str, store_path: str, work: str) -> dict:
    """Loads a feed into the store and returns the run's row with its change counts.

    The feed is split once; every table is written to a new version, which becomes current when all are
    there, so readers see the old or the new state and a failed load leaves nothing but a failed run. A run is in the history
    from its start.
    """
    store, began = Store(spark, store_path), datetime.now(timezone.utc)
    with single_writer(spark, store_path):
        number = max([0, *(int(n.split(".")[0]) for n in store.folder.names("runs") if n[0].isdecimal())]) + 1
        note = lambda row: store.folder.create(f"runs/{number}.json", json.dumps(row | {"changes": json.dumps(row.get("changes"))}, default=lambda t: t.isoformat()), True)
        note(run_row(number, began))
        try:
            counts = _load(spark, path, store, work, number)
        except Exception as problem:
            note(run_row(number, began, datetime.now(timezone.utc), "failed", str(problem)[:500]))
            raise
        row = run_row(number, began, datetime.now(timezone.utc), "completed") | {"changes": counts}
        note(row)
    return row


def _load(spark: SparkSession, path: str, store: Store, work: str, run: int) -> list[dict]:
    meta = split_feed(path, work)
    version = store.version + 1
    folder = f"{store.path}/v{version}"
    for section, key in REFERENCE_KEYS.items():
        columns = [n for n, _ in columns_of(section) if n != key]
        merged = cdc.upserted(store.read(section, schema_of(section)), read_section(spark, work, section), key, columns)
        merged.write.mode("overwrite").parquet(f"{folder}/{section}")
    stored = store.read("record", schema_of("record"))
    incoming = read_section(spark, work, "record")
    existing_n, incoming_n = (df.agg(F.count("*")).first()[0] for df in (cdc.official_records(stored), incoming))
    complete = existing_n > 0 and cdc.is_complete_feed(str(meta.get("feed_scope", "")), int(meta.get("record_count") or 0), incoming_n, existing_n)
    events = cdc.change_events(cdc.matched(cdc.official_records(stored), incoming), complete)
    cdc.applied(stored, incoming, complete).write.mode("overwrite").parquet(f"{folder}/record")
    events.write.mode("overwrite").parquet(f"{folder}/events")
    for section in SECTIONS:
        if section in REFERENCE_KEYS or section == "record":
            continue
        old, new = store.read(section, schema_of(section)), read_section(spark, work, section)
        last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        numbered = cdc.with_ids(new, ["seq"], last).select(*old.columns)
        if section == "association":
            merged = cdc.appended(old, numbered, ["record_id", "associate_id", "relationship_code"])
        else:
            merged = old.unionByName(numbered)
        merged.write.mode("overwrite").parquet(f"{folder}/{section}")
    written = spark.read.parquet(f"{folder}/events")
    counted = cdc.change_counts(written)
    counted.select(F.lit(run).cast("bigint").alias("run_id"), "*").write.mode("append").parquet(f"{store.path}/run_changes")
    _details(spark, store, folder, written, existing_n > 0, run).write.mode("append").parquet(f"{store.path}/record_changes")
    store.publish(version)
    return [r.asDict() for r in counted.collect()]


def _details(spark: SparkSession, store: Store, folder: str, events: DataFrame, later: bool, run: int) -> DataFrame:
    """The record_changes of a load: of a first one those of stored records only, so no 'added'; ``cdc.kept_events`` of all others."""
    kept = cdc.kept_events(events if later else events.filter("change_type <> 'added'"))
    of = lambda section: spark.read.parquet(f"{folder}/{section}")
    named = cdc.event_details(kept, of("record_name"), of("record_date"), of("record_country"), of("ref_country"))
    rows = named.join(of("record").select(F.col("id").alias("record_id"), "active_status", "gender", "action", "action_date", "deceased"), "record_id", "left")
    numbered = cdc.with_ids(rows, ["record_id", "change_type"], 0).withColumn("run_id", F.lit(run).cast("bigint"))
    wanted = [c.split()[0] for c in RECORD_CHANGES.split(", ")]
    return numbered.select(*(F.nullif(c, F.lit("")).alias(c) if dict(numbered.dtypes)[c] == "string" else F.col(c) for c in wanted))
