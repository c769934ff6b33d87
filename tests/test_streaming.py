"""Streams against their batch twins."""

from pyspark.sql import functions as F

from lanecraft.streaming import navigation


def trips(spark, n):
    """Positions that wander along a meridian, and manoeuvres on it."""
    rows = [(t, i, i * 1000, 52.5 + (i * 37 % 40 + i) * 2e-5, 13.4) for t in (1, 2) for i in range(n)]
    ahead = [(t, k, 52.5 + k * 4e-4, 13.4) for t in (1, 2) for k in range(5 * t)]
    return spark.createDataFrame(rows, "trip long, event_id long, ts long, lat double, lng double"), spark.createDataFrame(ahead, "trip long, idx long, lat double, lng double")


def test_steps_stream_equals_batch(spark, tmp_path):
    df, ahead = trips(spark, 80)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = navigation.steps_stream(stream, ahead).writeStream.format("memory").queryName("steps").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = sorted(map(tuple, spark.sql("SELECT * FROM steps").collect()), key=str)
    want = sorted(map(tuple, navigation.steps_batch(df, ahead).collect()), key=str)
    assert got == want and max(r[2] for r in want) > 2


def test_announcements_are_made_once():
    north = lambda metres: (52.5 + (1000 - metres) / 111_194.9, 13.4)
    ahead = [(52.4, 13.4), north(0), (53.0, 13.4)]
    state, said = (0, False, False), []
    for metres in (300, 180, 150, 45, 40, 20, 190):
        state, far, near = navigation.advance(state, north(metres), ahead)
        said.append((far, near))
    assert said == [(False, False), (True, False), (False, False), (False, True), (False, False), (False, False), (False, False)] and state[0] == 1
    # Both at once where nothing was said before; and the last manoeuvre is never left.
    assert navigation.advance((0, False, False), north(10), ahead) == ((1, False, False), True, True)
    assert navigation.advance((2, False, False), (53.0, 13.4), ahead) == ((2, False, False), False, False)
    assert navigation.advance((0, False, False), None, ahead) == ((0, False, False), False, False)
    assert navigation.advance((0, False, False), north(10), []) == ((0, False, False), False, False)


def test_debounced_stream(spark, tmp_path):
    rows = [(1, 1, "2026-01-01 00:00:00"), (2, 1, "2026-01-01 00:00:01"), (3, 1, "2026-01-01 00:10:00"), (4, 2, "2026-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t string").select("event_id", "user_id", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = navigation.debounced_stream(stream, "user_id", "ts", "5 seconds").writeStream.format("memory").queryName("deb").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {r["event_id"] for r in spark.sql("SELECT * FROM deb").collect()} == {2, 3}


def test_long_trips_pass_in_batches(spark):
    df, ahead = trips(spark, 1000)
    rows = [(t, i, i * 7919 % 1000 * 20_000) for t in (1, 2, 3) for i in range(1000)]
    cooled = navigation.cooled(spark.createDataFrame(rows, "client long, event_id long, ts long").withColumn("refused", F.col("event_id") % 3 == 0))
    there = {t: [(r["lat"], r["lng"]) for r in ahead.where(F.col("trip") == t).orderBy("idx").collect()] for t in (1, 2)}
    want_steps, want_sent = [], []
    state = {1: (0, False, False), 2: (0, False, False)}
    for r in df.orderBy("trip", "ts", "event_id").collect():
        t = r["trip"]
        state[t], far, near = navigation.advance(state[t], (r["lat"], r["lng"]), there[t])
        want_steps.append((t, r["event_id"], state[t][0], far, near))
    for t in (1, 2, 3):
        until = -1
        for _, i, ts in sorted((r for r in rows if r[0] == t), key=lambda r: (r[2], r[1])):
            want_sent.append((t, i, ts >= until))
            if want_sent[-1][2] and i % 3 == 0:
                until = ts + 60_000
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for found, want in ((navigation.steps_batch(df, ahead), want_steps), (cooled, want_sent)):
            assert "InPandas" not in found._jdf.queryExecution().toString()
            assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_counts_stream(spark, tmp_path):
    rows = [(1, "view", "2026-01-01 00:00:00"), (2, "view", "2026-01-01 00:04:59"), (3, "buy", "2026-01-01 00:05:00"), (4, "view", "2026-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "event_id long, event_type string, t string").select("event_id", "event_type", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = navigation.counts_stream(stream, "ts").writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {(r["event_type"], r["n"]) for r in spark.sql("SELECT * FROM counts").collect()} == {("view", 2), ("buy", 1)}


def test_positions_find_their_own_route(spark):
    route = spark.createDataFrame([(1, 0, 52.5, 13.4), (1, 1, 52.501, 13.4), (2, 0, 52.5, 13.4005)], "trip long, idx int, lat double, lng double")
    asked = spark.createDataFrame([(1, 10, 52.5002, 13.4), (1, 11, 52.6, 13.4), (2, 12, 52.5, 13.4), (3, 13, 52.5, 13.4)], "trip long, event_id long, lat double, lng double")
    assert {r["event_id"]: r["point"] for r in navigation.on_route(asked, route).collect()} == {10: 0, 11: None, 12: 0, 13: None}


def test_the_step_machine_goes_on_after_a_restart_and_leaves_out_what_is_late(spark, tmp_path):
    df, ahead = trips(spark, 80)
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(name):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        sink = navigation.step_machine(stream, ahead).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state"))
        query = sink.outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / name))

    try:
        df.where("ts < 40000").coalesce(1).write.parquet(str(tmp_path / "in"))
        first = run("steps").count()
        # The second run reads what came since and a position of an hour before, which is too late.
        late = spark.createDataFrame([(1, 999, 39_000 - 3_600_000, 52.5, 13.4)], df.schema)
        df.where("ts >= 40000").unionByName(late).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = run("steps")
        want = sorted(map(tuple, navigation.steps_batch(df, ahead).collect()), key=str)
        assert first == 80 and sorted(map(tuple, got.collect()), key=str) == want and max(r[2] for r in want) > 2
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
