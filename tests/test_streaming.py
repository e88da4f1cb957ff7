import datetime as dt
import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from probelake.functions import rules
from probelake.functions import schema as S
from probelake.operators import state
from probelake.streaming import state_stream as stream
from tests.test_state import START, observations


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(14)
    rows = [(f"k{rnd.randint(1, 4)}", 1_534_377_600 + 600 * n, n, rnd.choice(["secure", "bogus", "other"]), rnd.random() < 0.5) for n in range(300)]
    for n, part in enumerate((rows[:180], rows[180:])):
        pd.DataFrame([(k, dt.datetime.fromtimestamp(t, dt.timezone.utc).replace(tzinfo=None), t, s, kind, ok) for k, t, s, kind, ok in part], columns=["key", "ts", "time", "seq", "kind", "ok"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / f"{n}.parquet")
    schema = "key string, ts timestamp, time long, seq long, kind string, ok boolean"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*.parquet"))
    query = stream.state_stream(events).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = sorted((r.key, r.time, r.updated, r.secure, r.bogus, r.result, r.emitted) for r in spark.table("states").collect())

    batch = spark.createDataFrame(rows, "key string, time long, seq long, kind string, ok boolean")
    said = lambda kind: F.when(F.col("kind") == kind, F.when(F.col("ok"), 1).otherwise(2))
    order = Window.partitionBy("key").orderBy("time", "seq")
    folded = rules.resolve_pairs(batch.select("*", said("secure").alias("p_s"), said("bogus").alias("p_b"), F.lit(None).cast("int").alias("p_r"), F.row_number().over(order).alias("nth")), order.rowsBetween(Window.unboundedPreceding, 0), ["p"])
    emitted = {(r.key, e.nth) for r in state.throttle(folded, ["key"]).collect() for e in r.emitted}
    want = sorted((r.key, r.time, r.time, r.p_secure, r.p_bogus, r.p_result, (r.key, r.nth) in emitted) for r in folded.collect())
    assert got == want


def test_clock_of_the_stream():
    assert stream.step_clock(0, 0, 5) == (5, 5, False)
    assert stream.step_clock(13601, 13601, 10000) == (13601, 13601, False)
    assert stream.step_clock(13601, 13601, 10001) == (13601, 13601, False)
    assert stream.step_clock(10000, 10000, 13601) == (13601, 13601, True)


def plain(rows):
    return sorted(str([bytes(v) if isinstance(v, bytearray) else [bytes(x) for x in v] if isinstance(v, list) else v for v in r]) for r in rows)


def test_whole_state_over_days_and_restarts(spark, tmp_path):
    """Three days in six files, from a batch snapshot, with a restart; an entity that is away for eleven days starts anew."""
    rnd = random.Random(29)
    days = [0, 1, 12]
    frames = []
    for n in days:
        rows = sorted(observations(rnd, 70, START + 86_400 * (n + 1)), key=lambda r: r[10])
        rows = [r for r in rows if n != 1 or r[5] != 1]  # probe 1 is away
        frames.append(rows)
    table = lambda rows: spark.createDataFrame([(*r[:3], r[3], *r[4:9]) for r in rows], S.OBSERVATION_SCHEMA)
    initial = spark.createDataFrame(state.day_state(table(observations(rnd, 60, START)))[0].collect(), state.day_state(table([]))[0].schema)
    snapshot, timeline = initial, []
    for n, rows in zip(days, frames, strict=True):
        held, emitted = state.day_state(table(rows), snapshot, F.lit(str(dt.date(2018, 8, 17) + dt.timedelta(n))))
        timeline += emitted.collect()
        snapshot = spark.createDataFrame(held.collect(), held.schema)

    source, out, check = (str(tmp_path / x) for x in ("source", "out", "check"))
    halves = [part for rows in frames for noon in [rows[len(rows) // 2][10]] for part in ([r for r in rows if r[10] < noon], [r for r in rows if r[10] >= noon])]

    def run(parts):
        for part in parts:
            table(part).coalesce(1).write.mode("append").parquet(source)
            read = spark.readStream.schema(S.OBSERVATION_SCHEMA).parquet(source)
            query = stream.whole_state_stream(read, initial).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
            query.awaitTermination(300)
            assert query.exception() is None

    run(halves)  # each part is a restart from the checkpoint
    names = ["prb_id", "addr", "updated", *state.SNAPSHOT_STATES]
    assert plain(spark.read.parquet(out).select(*names).collect()) == plain(r for r in spark.createDataFrame(timeline, snapshot.select(*names).schema).select(*names).collect()) and timeline
    left = stream.read_state(spark, check, F.lit("2018-08-29"))
    assert plain(left.select(*snapshot.columns).collect()) == plain(snapshot.collect())


def test_expiry_is_that_of_the_daily_chain():
    day = 86_400
    for updated in (START, START + 1, START + day - 1):
        at = stream.expiry(updated)
        assert at % day == 0 and updated < at - S.KEEP_DAYS * day and updated >= at - day - S.KEEP_DAYS * day
