"""Admission by age in a stream: what is too old goes to the journal in the same trigger."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.status import late_drop
from ..session import scratch_folder

c = F.col


def _write(rows: DataFrame, sink: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(os.path.join(sink, f"batch={batch_id}"))


def stream_late_drop(stream: DataFrame, age_ms: Column, limit: Column | float, folder: str) -> StreamingQuery:
    """Starts a query that writes admitted rows to ``folder``/accepted and the others, as journal rows, to ``folder``/journal.

    A trigger writes both sinks under its own number and replaces what an
    interrupted run of the same trigger has left there, so that after a restart
    from the checkpoint in ``folder`` every received row stands in exactly one of
    them. An empty trigger leaves empty files. Rows without an age are admitted by no limit: they go to the journal.
    """

    def both(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        admitted, late = late_drop(batch, F.coalesce(age_ms, F.lit(float("inf"))), limit)
        _write(admitted, f"{folder}/accepted", batch_id)
        _write(late, f"{folder}/journal", batch_id)
        batch.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def admitted_and_journal(stream: DataFrame, age_ms: Column, limit: Column | float, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs the stream over everything available; (admitted rows, journal rows) of all triggers so far."""
    spark = stream.sparkSession
    folder = folder or os.path.join(scratch_folder(spark), f"admission-{uuid.uuid4().hex}")
    stream_late_drop(stream, age_ms, limit, folder).awaitTermination()
    admitted, late = (spark.read.parquet(f"{folder}/{sink}").drop("batch") for sink in ("accepted", "journal"))
    return admitted, late
