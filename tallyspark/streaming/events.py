"""Session events as streams: live statistics, phases, latest answers and gathered batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import live_stats


def event_files(spark: SparkSession, folder: str, name: str = "events.parquet", per_trigger: int = 1000) -> DataFrame:
    """Stream of the files called ``name`` in a folder; the schema is that of what is there."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def as_file_events(events: DataFrame) -> DataFrame:
    """File events of the test table: users are sessions, errors failures, refunds conversions; bytes are hundredths of the value."""
    return events.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"),
        F.lit(False).alias("converted"), F.round(F.col("value") * 100).cast("long").alias("original_bytes"), F.expr("cast(round(value * 100) as bigint) div 3").alias("output_bytes"),
    )


SUMS = ["processed", "converted", "optimized", "original_bytes", "output_bytes", "saved_bytes"]


def streamed_live_stats(stream: DataFrame, work: str) -> DataFrame:
    """Runs the stream to its present end and returns the statistics of every session so far.

    Sums are a streaming aggregation in update mode, so a batch writes only the sessions it changed, into the
    folder of its number, which a batch that is run again replaces.  The latest row of a session
    counts.  ``work`` is the caller's folder: a later run with the same one goes on from its checkpoint.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/stats/batch={number}")

    query = live_stats(stream, "session_id").writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{work}/checkpoint").foreachBatch(keep).start()
    query.awaitTermination()
    return latest(stream.sparkSession.read.parquet(f"{work}/stats"), ["session_id"], "batch", *SUMS).drop("batch")


PHASES = "session_id string, phase string, processed long, total long, saved_bytes long"


def phase_machine(events: DataFrame):
    """(session_id, phase, processed, total, saved_bytes) after each batch of started, file, failed and finished events.

    idle -> running at started; a file counts only while running; finished -> done; an error
    keeps partial results.  Events of a batch are taken in the order of ``seq``, so ties and
    late events of earlier batches can't move a session back.
    """
    state_schema = "phase string, processed long, total long, saved long, last long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, processed, total, saved, last = state.get if state.exists else ("idle", 0, 0, 0, -1)
        for rows in batches:
            for e in rows.sort_values("seq").itertuples():
                if e.seq <= last:
                    continue
                last = int(e.seq)
                if e.kind == "started":
                    phase, processed, total, saved = "running", 0, int(e.total or 0), 0
                elif e.kind == "file" and phase == "running":
                    processed += 1
                    if not e.converted:
                        saved += max(0, int(e.original_bytes) - int(e.output_bytes))
                elif e.kind == "error" and phase == "running":
                    phase = "error"
                elif e.kind == "finished" and phase == "running":
                    phase = "done"
        state.update((phase, processed, total, saved, last))
        yield pd.DataFrame([(key[0], phase, processed, total, saved)], columns=["session_id", "phase", "processed", "total", "saved_bytes"])

    return events.groupBy("session_id").applyInPandasWithState(step, PHASES, state_schema, "update", GroupStateTimeout.NoTimeout)


def latest(rows: DataFrame, keys: list[str], sequence: str, *values: str) -> DataFrame:
    """The answer with the largest sequence number of each key; earlier ones that come late don't count."""
    found = rows.groupBy(*keys).agg(F.max(sequence).alias(sequence), *[F.max_by(v, sequence).alias(v) for v in values])
    return found


def gathered(events: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    """Batches of events that follow each other within a quiet gap."""
    at = F.col(time).cast(T.TimestampType())
    return events.groupBy(*keys, F.session_window(at, gap).alias("batch")).agg(F.count("*").alias("events"))
