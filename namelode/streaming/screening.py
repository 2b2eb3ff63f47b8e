"""Screening and change capture over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from namelode.operators.cdc import change_events, matched
from namelode.plans.screen import Options, Tables, screen


def screen_stream(queries: DataFrame, tables: Tables, options: Options, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Screens every micro-batch of a stream of queries (query_id, name, ...) and hands the results to ``write``.

    A batch is screened as a whole by one plan; ``checkpoint`` keeps the stream's progress, so a batch that
    was cut short is screened again.
    """
    def batch(rows: DataFrame, number: int) -> None:
        write(screen(rows, tables, options), number)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def change_stream(incoming: DataFrame, existing: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Classifies every micro-batch of a stream of delta rows against the records stored at that time."""
    def batch(rows: DataFrame, number: int) -> None:
        write(change_events(matched(existing(), rows), False), number)

    return incoming.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
