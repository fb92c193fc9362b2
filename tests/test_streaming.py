from marlstone.operators import lifecycle
from marlstone.streaming.lifecycle import checked, failed_for_good, upsert_sink, upserted

EVENTS = [("a", 1, "CAPTURED"), ("a", 2, "PENDING_AI"), ("b", 1, "CAPTURED"), ("b", 2, "SYNCED"), ("a", 3, "PENDING_AI"), ("a", 4, "PENDING_AI"), ("a", 5, "PROCESSING_FAILED"), ("b", 3, "PENDING_AI")]


def test_stream_equals_a_fold(spark, tmp_path):
    for i in range(0, len(EVENTS), 4):
        spark.createDataFrame(EVENTS[i : i + 4], "record_id string, seq long, state string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("record_id string, seq long, state string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = checked(stream).writeStream.format("memory").queryName("journal").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.record_id, r.seq): (r.from_state, r.to_state, r.legal, r.attempts) for r in spark.table("journal").collect()}
    state, attempts, want = {}, {}, {}
    for rec, seq, to in EVENTS:
        legal = rec not in state or to in lifecycle.TRANSITIONS[state[rec]]
        if legal and (to in ("PROCESSING_FAILED", "SYNC_FAILED") or state.get(rec) == to == "PENDING_AI"):
            attempts[rec] = attempts.get(rec, 0) + 1
        want[rec, seq] = (state.get(rec), to, legal, attempts.get(rec, 0))
        if legal:
            state[rec] = to
    assert got == want
    assert failed_for_good(spark.table("journal")).count() == 1


def test_upsert_sink_replays(spark, tmp_path):
    write = upsert_sink(str(tmp_path / "t"), ["k"], "ts")
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string, ts int")
    for batch_id, rows in ((0, [(1, "a", 1), (3, "z", 1)]), (1, [(1, "b", 2), (2, "c", 1), (2, "d", 3)]), (1, [(1, "b", 2), (2, "c", 1), (2, "d", 3)])):
        write(frame(rows), batch_id)
    read = lambda: sorted((r.k, r.v) for r in upserted(spark, str(tmp_path / "t"), ["k"], "ts").collect())
    assert read() == [(1, "b"), (2, "d"), (3, "z")]
    write(frame([(3, "y", 0)]), 5)  # batches 2 to 4 were empty or are lost: what is there stays
    assert read() == [(1, "b"), (2, "d"), (3, "y")]
