"""Record lifecycles: legal transitions, journal checks, retry and back-off, idempotent delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The legal transitions, attempts before failure, longest back-off and its unit in seconds.
TRANSITIONS: dict[str, tuple[str, ...]] = {
    "CAPTURED": ("PENDING_AI", "MANUAL_REVIEW_REQUIRED"),
    "PENDING_AI": ("AI_PROCESSED", "PROCESSING_FAILED", "MANUAL_REVIEW_REQUIRED", "PENDING_AI"),
    "AI_PROCESSED": ("NEEDS_REVIEW",),
    "NEEDS_REVIEW": ("VALIDATED", "PENDING_AI", "MANUAL_REVIEW_REQUIRED"),
    "PROCESSING_FAILED": ("PENDING_AI", "MANUAL_REVIEW_REQUIRED"),
    "MANUAL_REVIEW_REQUIRED": ("VALIDATED", "PENDING_AI"),
    "VALIDATED": ("PATIENT_MATCHED", "DUPLICATE_SUSPECTED", "NEEDS_REVIEW"),
    "DUPLICATE_SUSPECTED": ("PATIENT_MATCHED", "NEEDS_REVIEW"),
    "PATIENT_MATCHED": ("REGISTERED",),
    "REGISTERED": ("SYNCED", "SYNC_FAILED"),
    "SYNC_FAILED": ("SYNCED", "SYNC_FAILED", "REGISTERED"),
    "SYNCED": ("NEEDS_REVIEW", "DUPLICATE_SUSPECTED"),
}
ATTEMPTS, LONGEST_WAIT, WAIT = 3, 300, 5


def transition_table(spark: SparkSession, edges: dict[str, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in edges.items() for b in to], "from_state string, to_state string")


def journal(events: DataFrame, record: str, order: list[str], state: str) -> DataFrame:
    """Each event with the state before it: from_state is null for a record's first."""
    w = W.partitionBy(record).orderBy(*order)
    return events.withColumn("from_state", F.lag(state).over(w)).withColumn("to_state", F.col(state))


def illegal(journal_rows: DataFrame, transitions: DataFrame) -> DataFrame:
    """Journal rows whose step is in no legal pair; first states are legal. The table of pairs has a fixed size."""
    return journal_rows.where("from_state is not null").join(F.broadcast(transitions), ["from_state", "to_state"], "left_anti")


def wait_seconds(attempts: Column) -> Column:
    return F.least(F.lit(LONGEST_WAIT), F.pow(F.lit(2), F.least(attempts, F.lit(20))) * WAIT).cast("long")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The latest row of each key, new rows after old ones; doing it again changes nothing."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("__new"), order.desc()))
    return both.withColumn("__rank", rank).where("__rank = 1").drop("__new", "__rank")


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and new ones whose key isn't there yet."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti").select(old.columns))


def guarded(current: DataFrame, requests: DataFrame, key: list[str], transitions: DataFrame) -> DataFrame:
    """Requests (key, expected, to_state) against current rows (key, state): each with the state before and after, and an outcome.

    applied: the row was in the expected state and the step is legal; refused
    otherwise, with the state as it was; missing: there is no such row. A key is
    asked for once at most.
    """
    legal = transitions.select(F.col("from_state").alias("state"), "to_state", F.lit(True).alias("legal"))
    j = requests.join(current.select(*key, "state"), key, "left").join(F.broadcast(legal), ["state", "to_state"], "left")
    good = F.col("legal") & (F.col("state") == F.col("expected"))
    outcome = F.when(F.col("state").isNull(), "missing").when(good, "applied").otherwise("refused")
    return j.select(*key, F.col("state").alias("from_state"), F.when(good, F.col("to_state")).otherwise(F.col("state")).alias("state"), outcome.alias("outcome"))


def update_payload(old: DataFrame, new: DataFrame, key: list[str], payload: str) -> DataFrame:
    """Old rows with the payload of new ones of their key; new keys are not added. new has a key once."""
    j = old.join(new.select(*key, F.col(payload).alias("__new"), F.lit(True).alias("__is")), key, "left")
    return j.select(*(F.when(F.col("__is"), F.col("__new")).otherwise(F.col(c)).alias(c) if c == payload else F.col(c) for c in old.columns))


def append_journal(old: DataFrame, new: DataFrame, record: str, order: list[str]) -> DataFrame:
    """Old rows (with seq from 1 for each record) and new ones, whose seq goes on from the record's last."""
    last = old.groupBy(record).agg(F.max("seq").alias("__last"))
    rank = F.row_number().over(W.partitionBy(record).orderBy(*order))
    own = new.withColumn("__rank", rank).join(last, record, "left").withColumn("seq", (F.coalesce("__last", F.lit(0)) + F.col("__rank")).cast("long"))
    return old.unionByName(own.select(old.columns))


def interrupted(rows: DataFrame, batch: str, order: list[str], offline: Column, failed: Column) -> DataFrame:
    """outcome of each row of a batch in order: done or failed until the first that finds no network; that one and the rest stay pending."""
    w = W.partitionBy(batch).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    stopped = F.max(offline.cast("int")).over(w) == 1
    return rows.withColumn("outcome", F.when(stopped, "pending").when(failed, "failed").otherwise("done"))


def duplicate_feedback(rows: DataFrame, key: str, code: str) -> DataFrame:
    """State after delivery: SYNCED, or DUPLICATE_SUSPECTED with the number of others and one of them where another key has the code.

    One of the others is the smallest, or for that one the largest; the code's
    smallest, largest and number of keys tell without pairs.
    """
    by = rows.where(F.col(code) != "").groupBy(code).agg(F.min(key).alias("__a"), F.max(key).alias("__b"), F.count_distinct(key).alias("__n"))
    j = rows.join(by, code, "left")
    many = F.coalesce(F.col("__n") > 1, F.lit(False))
    return j.select(key, code, F.when(many, "DUPLICATE_SUSPECTED").otherwise("SYNCED").alias("state"), F.when(many, F.col("__n") - 1).otherwise(0).alias("n_others"), F.when(many, F.when(F.col("__a") == F.col(key), F.col("__b")).otherwise(F.col("__a"))).alias("other"))
