"""Windows, rankings and lifecycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from .registry import Tables, query

STEPS = {"signup": ("view", "click"), "view": ("click", "error", "view"), "click": ("purchase", "view", "error"), "purchase": ("view", "signup"), "error": ("view", "error")}
STEPS_SQL = ", ".join(f"('{a}', '{b}')" for a, to in STEPS.items() for b in to)
def by_user() -> WindowSpec:
    return W.partitionBy("user_id").orderBy("ts", "event_id")


@query("SELECT user_id, arg_min(value, (ts, event_id)) FILTER (WHERE value > 50) AS first_large FROM events GROUP BY user_id")
def first_non_null(t: Tables) -> DataFrame:
    large = F.when(F.col("value") > 50, F.struct("ts", "event_id"))
    return t.events.groupBy("user_id").agg(F.min_by("value", large).alias("first_large"))


@query("SELECT c_nationkey, c_custkey, c_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def topk_per_group(t: Tables) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return t.customer.select("c_nationkey", "c_custkey", "c_acctbal", rank.cast("long").alias("rank")).where("rank <= 3")


@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def latest_version(t: Tables) -> DataFrame:
    """The live version of each (user, type): a maximum, so that tasks send one row for each key."""
    order = F.struct("ts", "event_id")
    return t.events.groupBy("user_id", "event_type").agg(F.max_by(F.struct("ts", "value", "event_id"), order).alias("x")).select("user_id", "event_type", "x.ts", "x.value", "x.event_id")


@query("SELECT event_id, user_id, lag(event_type) OVER w AS from_state, event_type AS to_state, lag(value) OVER w AS previous_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def prev_state_lag(t: Tables) -> DataFrame:
    j = L.journal(t.events, "user_id", ["ts", "event_id"], "event_type")
    return j.withColumn("previous_value", F.lag("value").over(by_user())).select("event_id", "user_id", "from_state", "to_state", "previous_value")


@query(f"WITH j AS (SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events) SELECT * FROM j WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN (VALUES {STEPS_SQL})")
def illegal_transitions(t: Tables) -> DataFrame:
    j = L.journal(t.events, "user_id", ["ts", "event_id"], "event_type")
    return L.illegal(j, L.transition_table(t.spark, STEPS)).select("event_id", "from_state", "to_state")


@query("""WITH e AS (SELECT event_id, user_id, ts, count(*) OVER w AS attempts, lag(ts) OVER w AS before FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, attempts, least(300, 5 * power(2, least(attempts, 20)))::BIGINT AS wait, coalesce(epoch(ts) - epoch(before) > least(300, 5 * power(2, least(attempts, 20))), true) AS due FROM e""")
def backoff_elapsed(t: Tables) -> DataFrame:
    e = t.events.where("event_type = 'error'")
    attempts = F.count("*").over(by_user().rowsBetween(W.unboundedPreceding, 0))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    e = e.select("event_id", "ts", attempts.alias("attempts"), F.lag("ts").over(by_user()).alias("before"))
    wait = L.wait_seconds(F.col("attempts"))
    return e.select("event_id", "attempts", wait.alias("wait"), F.coalesce(seconds(F.col("ts")) - seconds(F.col("before")) > wait, F.lit(True)).alias("due"))


@query("""SELECT event_id, least(n, 3) AS attempts, CASE WHEN n >= 3 THEN 'PROCESSING_FAILED' ELSE 'PENDING_AI' END AS state FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events WHERE event_type = 'error')""")
def retry_cap(t: Tables) -> DataFrame:
    n = F.count("*").over(by_user().rowsBetween(W.unboundedPreceding, 0))
    e = t.events.where("event_type = 'error'").select("event_id", n.alias("n"))
    return e.select("event_id", F.least("n", F.lit(L.ATTEMPTS)).alias("attempts"), F.when(F.col("n") >= L.ATTEMPTS, "PROCESSING_FAILED").otherwise("PENDING_AI").alias("state"))


@query("SELECT o_custkey, o_orderkey, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderkey > 100) WHERE n <= 12")
def last_n(t: Tables) -> DataFrame:
    """The last twelve of each owner, out of those after an offset."""
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return t.orders.where("o_orderkey > 100").select("o_custkey", "o_orderkey", n.cast("long").alias("n")).where("n <= 12")


@query("""WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 3600 THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM g) SELECT user_id, run, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY user_id, run""")
def run_grouping(t: Tables) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cut = t.events.withColumn("cut", F.when(micros - F.lag(micros).over(by_user()) > 3_600_000_000, 1).otherwise(0))
    run = F.sum("cut").over(by_user().rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn("run", run).groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_brand <> 'Brand#1', least(p_size // 15, 3) DESC, p_name, p_partkey) AS place FROM part")
def review_order(t: Tables) -> DataFrame:
    """Within a page: the code first, then by importance, name and key."""
    order = [F.col("p_brand") != "Brand#1", F.desc(F.least(F.floor(F.col("p_size") / 15), F.lit(3))), F.col("p_name"), F.col("p_partkey")]
    return t.part.select("p_partkey", F.row_number().over(W.partitionBy("p_type").orderBy(*order)).cast("long").alias("place"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'S', o_totalprice + 1 FROM orders WHERE o_orderkey % 3 = 0")
def upsert_last_wins(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("S").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return L.upsert(L.upsert(o, new, ["o_orderkey"], F.col("o_totalprice")), new, ["o_orderkey"], F.col("o_totalprice"))


@query("SELECT c_custkey AS k, c_mktsegment AS v FROM customer UNION ALL SELECT o_orderkey, min(o_orderstatus) FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_orderkey")
def insert_ignore(t: Tables) -> DataFrame:
    """Every order comes in under its key; a key that a customer has already is left alone."""
    new = t.orders.groupBy(F.col("o_orderkey").alias("k")).agg(F.min("o_orderstatus").alias("v"))
    return L.insert_missing(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")), new, ["k"])


@query("SELECT c_custkey, c_mktsegment AS role, c_mktsegment IN ('BUILDING', 'MACHINERY') AS granted FROM customer")
def role_filter_log(t: Tables) -> DataFrame:
    """Every access is logged, granted or not."""
    return t.customer.select("c_custkey", F.col("c_mktsegment").alias("role"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("granted"))


@query("SELECT arg_max(event_id, (ts, event_id)) AS open_event, user_id FROM events WHERE event_type = 'view' GROUP BY user_id")
def resume_open(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'view'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("open_event"))


NAMES = {"signup": "CAPTURED", "view": "PENDING_AI", "click": "AI_PROCESSED", "purchase": "NEEDS_REVIEW", "error": "PROCESSING_FAILED"}
LEGAL_SQL = ", ".join(f"('{a}', '{b}')" for a, to in L.TRANSITIONS.items() for b in to)


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items())} END AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f(user_id, n, seq, from_state, to_state, legal, attempts, now) AS (SELECT user_id, n, seq, NULL::VARCHAR, s, true, CASE WHEN s IN ('PROCESSING_FAILED', 'SYNC_FAILED') THEN 1 ELSE 0 END, s FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, e.seq, f.now, e.s, (f.now, e.s) IN ({LEGAL_SQL}), f.attempts + CASE WHEN (f.now, e.s) IN ({LEGAL_SQL}) AND (e.s IN ('PROCESSING_FAILED', 'SYNC_FAILED') OR (f.now = 'PENDING_AI' AND e.s = 'PENDING_AI')) THEN 1 ELSE 0 END, CASE WHEN (f.now, e.s) IN ({LEGAL_SQL}) THEN e.s ELSE f.now END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id::VARCHAR AS record_id, seq, from_state, to_state, legal, attempts::INT AS attempts FROM f""")
def streaming_lifecycle(t: Tables) -> DataFrame:
    """The events as a file stream, checked record by record, into a Parquet sink; all that is there, then it ends."""
    from ..sources.files import shared_folder
    from ..streaming.lifecycle import SCHEMA, checked

    state = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))[F.col("event_type")]
    at = shared_folder(t.spark)
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events*.parquet")
    journal = checked(stream.select(F.col("user_id").cast("string").alias("record_id"), F.col("event_id").alias("seq"), state.alias("state")))
    q = journal.writeStream.format("parquet").option("path", f"{at}/journal").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(SCHEMA).parquet(f"{at}/journal")
