"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namelode.functions.dates import iso_date


def plain_status(col: Column) -> Column:
    """A status or action without case and outer blanks; '' is NULL."""
    return F.nullif(F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")), F.lit(""))


def latest_rows(snapshots: DataFrame, values: list[Column]) -> DataFrame:
    """One row for each (snapshot_no, record_id): two hashes of ``values`` in the row received last.

    Of rows that agree in received_at the one with the greater hash holds, whatever order they are read
    in; a null received_at is the earliest. Rows with a null key are dropped, as they name no record.
    """
    # a hash skips nulls: each value is told with its length, a null as '-', so none can stand for another
    content = F.concat(*(F.coalesce(F.concat(F.length(v), F.lit(":"), v), F.lit("-")) for v in values))
    h1 = F.xxhash64("record_id", content)
    h2 = F.xxhash64(content, F.lit("second"), "record_id")
    rank = F.struct(F.col("received_at"), h1.alias("h1"), h2.alias("h2"))
    held = (
        snapshots.filter(F.col("snapshot_no").isNotNull() & F.col("record_id").isNotNull())
        .groupBy("snapshot_no", "record_id")
        .agg(F.max(rank).alias("held"))
    )
    return held.select("snapshot_no", "record_id", "held.h1", "held.h2")


def snapshot_changes(
    snapshots: DataFrame, range_width: int = 4096, chunk_rows: int = 16
) -> DataFrame:
    """(record_id, snapshot_no, change): records added, removed or changed against the snapshot before.

    active_status, action and action_date are compared in canonical form. The rows of each snapshot,
    sorted by key, fall into chunks whose borders are set by the keys themselves (one key in
    ``chunk_rows``, within ranges of ``range_width`` keys), so that a row which comes or goes moves no
    other border. Chunks with the digest that the same chunk has in the neighbouring snapshot are
    discarded; only rows of the other chunks are joined and classified. A key is one row of one range
    after the aggregation that finds the row received last, which combines repeated rows before the
    shuffle: no range can be hot. An empty table gives no rows; the first snapshot has no changes.
    """
    values = [plain_status(F.col("active_status")), plain_status(F.col("action")), iso_date(F.col("action_date"))]
    bounds = snapshots.agg(F.min("snapshot_no").alias("first"), F.max("snapshot_no").alias("last"))
    rows = (
        latest_rows(snapshots, values)
        .withColumn("range_no", F.expr(f"record_id div {range_width}L"))
        .repartition("range_no")
    )
    is_border = F.pmod(F.xxhash64("record_id"), F.lit(chunk_rows)) == 0
    along = Window.partitionBy("range_no", "snapshot_no").orderBy("record_id")
    rows = rows.withColumn("chunk", F.last(F.when(is_border, F.col("record_id")), ignorenulls=True).over(along))
    by_chunk = Window.partitionBy("range_no", "chunk").orderBy("snapshot_no")

    # two independent hashes: a chunk is discarded on 128 equal bits
    def digest(offset: int) -> Column:
        frame = by_chunk.rangeBetween(offset, offset)
        return F.struct(F.expr("bit_xor(h1)").over(frame), F.expr("bit_xor(h2)").over(frame))

    marked = rows.select(
        "snapshot_no",
        "record_id",
        F.struct("h1", "h2").alias("h"),
        (~digest(0).eqNullSafe(digest(-1))).alias("as_new"),
        (~digest(0).eqNullSafe(digest(1))).alias("as_old"),
    ).filter("as_new or as_old")
    # a row of an unmatched chunk meets the row of the snapshot before and that of the one after
    no_hash = F.lit(None).cast("struct<h1: bigint, h2: bigint>")
    meets = F.array(
        F.when(F.col("as_new"), F.struct(F.col("snapshot_no").alias("n"), F.col("h").alias("new"), no_hash.alias("old"))),
        F.when(F.col("as_old"), F.struct((F.col("snapshot_no") + 1).alias("n"), no_hash.alias("new"), F.col("h").alias("old"))),
    )
    both = (
        marked.select("record_id", F.explode(F.filter(meets, lambda m: m.isNotNull())).alias("m"))
        .groupBy("record_id", F.col("m.n").alias("snapshot_no"))
        .agg(F.max("m.new").alias("new_hash"), F.max("m.old").alias("old_hash"))
    )
    change = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
    )
    return (
        both.select("record_id", F.col("snapshot_no").cast("int").alias("snapshot_no"), change.alias("change"))
        .filter(F.col("change").isNotNull())
        .join(
            F.broadcast(bounds), (F.col("snapshot_no") > F.col("first")) & (F.col("snapshot_no") <= F.col("last")),
            "left_semi",
        )
    )
