"""The lifecycle as a stream: state transitions checked record by record, and an upsert sink."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import ATTEMPTS, TRANSITIONS, upsert

# The stateful function travels with its code; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "record_id string, seq long, from_state string, to_state string, legal boolean, attempts int"


def checked(events: DataFrame) -> DataFrame:
    """events(record_id, seq, state) as a stream -> journal rows with their legality and failed attempts so far.

    Order within a record is by seq inside a batch and by arrival between
    batches. An illegal step is reported and leaves the state as it was.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, attempts = state.get if state.exists else (None, 0)
        rows = []
        # rows of one record in one batch: as many as its events since the last trigger
        for seq, to in pd.concat(frames).sort_values("seq", kind="stable")[["seq", "state"]].itertuples(index=False):
            legal = current is None or to in TRANSITIONS.get(current, ())
            if legal and to in ("PROCESSING_FAILED", "SYNC_FAILED") or (legal and current == to == "PENDING_AI"):
                attempts += 1
            rows.append((key[0], seq, current, to, legal, attempts))
            current = to if legal else current
        state.update((current, attempts))
        yield pd.DataFrame(rows, columns=["record_id", "seq", "from_state", "to_state", "legal", "attempts"])

    return events.groupBy("record_id").applyInPandasWithState(run, SCHEMA, "state string, attempts int", "append", GroupStateTimeout.NoTimeout)


def failed_for_good(journal: DataFrame) -> DataFrame:
    return journal.where(f"attempts >= {ATTEMPTS}")


def upsert_sink(path: str, key: list[str], order: str):
    """For foreachBatch: each batch is written as its own delta, the latest row of each key; a batch that comes again gives the same delta.

    Nothing written before is read or rewritten, so a missing delta can't be taken
    for an empty table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.limit(0), batch, key, F.col(order)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def upserted(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame:
    """The table out of all deltas: of each key the latest row of its last batch."""
    rows = spark.read.parquet(path)
    latest = F.max_by(F.struct(*(c for c in rows.columns)), F.struct("batch", order))
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(latest.alias("x")).select("x.*").drop("batch")
