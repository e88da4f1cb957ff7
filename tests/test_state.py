import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from probelake.functions import schema as S
from probelake.functions import wire
from probelake.operators import gates, state
from tests import fold

START = 1_534_377_600  # 2018-08-16
CONTROL = bytes([145, 97, 20, 17])


def message(rnd, msm):
    """A random response that fits the measurement, and its parts."""
    rcode = rnd.choice([0, 0, 0, 2, 3])
    kind = {S.WHOAMI_G: 16, S.QNAMEMIN: 16, S.WHOAMI_6: 28, S.TCP6: 28}.get(msm, 1)
    if kind == 16:
        pool = [b"198.51.100.7", b"2001:db8::7", b"edns0-client-subnet 198.51.100.0/24", b"edns0-client-subnet 2001:db8::/56", b"HOORAY it works", b"NO it does not", b"else"]
        datas = [b"".join(bytes([len(t)]) + t for t in rnd.sample(pool, rnd.randint(1, 2))) for _ in range(rnd.randint(0, 2))]
    elif kind == 28:
        datas = [rnd.randbytes(rnd.choice([16, 16, 16, 15, 17])) for _ in range(rnd.randint(0, 2))]
    else:
        datas = [rnd.choice([CONTROL, CONTROL, rnd.randbytes(4), rnd.randbytes(3), CONTROL + b"x"]) for _ in range(rnd.choice([0, 1, 1, 2, 5]))]
    raw = wire.encode("q.example", kind, [("q.example", kind, d) for d in datas], rcode)
    return raw, {"rcode": rcode, "ancount": len(datas), "answers": [(kind, d) for d in datas], "texts": [wire.strings(d) for d in datas] if kind == 16 else []}


def observations(rnd, n, start=START, days=1):
    out = []
    for seq in range(n):
        msm = rnd.choice(S.KNOWN + [S.DNSKEY_SECURE[5], S.DNSKEY_BOGUS[5], S.NOT_TA_20326, S.NOT_TA_19036] * 4)
        time = start + rnd.randrange(0, 86_400 * days, 600)
        addr = b"\0" * 10 + b"\xff\xff" + bytes([192, 0, 2, rnd.randint(1, 2)])
        error = rnd.random() < 0.05
        raw, m = (b'{"timeout":5000}', None) if error else message(rnd, msm)
        out.append((msm, dt.date(2018, 8, 16), seq, dt.datetime.fromtimestamp(time, dt.timezone.utc).replace(tzinfo=None), None, rnd.randint(1, 3), addr, error, raw, m, time))
    return out


def expected(rows, states=None):
    states, emitted = dict(states or {}), []
    order = sorted(S.KNOWN, key=str)
    for r in sorted(rows, key=lambda r: (r[10], order.index(r[0]), r[2])):
        s = states.setdefault((r[5], r[6]), fold.new())
        if r[9] is not None:
            fold.apply(s, r[0], r[9])
        if fold.tick(s, r[10]):
            emitted.append((r[5], r[6], s["updated"], s["nxdomain"], s["has_ta_20326"], s[f"{S.RSASHA256}_result"]))
    return states, emitted


def frame(spark, rows):
    return spark.createDataFrame([(*r[:3], r[3], *r[4:9]) for r in rows], S.OBSERVATION_SCHEMA)


def normal(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return [bytes(x) for x in v] if isinstance(v, list) else v


def check_snapshot(snapshot, states):
    got = {(r.prb_id, bytes(r.addr)): r.asDict() for r in snapshot.collect()}
    assert set(got) == set(states)
    for key, want in states.items():
        for name, value in want.items():
            assert normal(got[key][name]) == value, (key, name)


def test_day_state_equals_the_plain_fold(spark):
    rows = observations(random.Random(5), 700)
    states, emitted = expected(rows)
    snapshot, timeline = state.day_state(frame(spark, rows))
    check_snapshot(snapshot, states)
    got = sorted((r.prb_id, bytes(r.addr), r.updated, r.nxdomain, r.has_ta_20326, r[f"{S.RSASHA256}_result"]) for r in timeline.collect())
    assert got == sorted(emitted)


def test_days_one_by_one_with_carry_over_and_expiry(spark):
    rnd = random.Random(6)
    first, second = observations(rnd, 250), observations(rnd, 250, START + 86_400)
    states, _ = expected(first)
    snapshot, _ = state.day_state(frame(spark, first))
    kept = spark.createDataFrame(snapshot.collect(), snapshot.schema)
    states, _ = expected(second, states)
    check_snapshot(state.day_state(frame(spark, second), kept, F.lit("2018-08-17"))[0], states)
    late = state.day_state(frame(spark, []), kept, F.lit("2018-08-27"))[0]
    assert {(r.prb_id, bytes(r.addr)) for r in late.collect()} == {k for k, s in expected(first)[0].items() if s["updated"] >= START + 86_400}
    assert state.day_state(frame(spark, []), kept, F.lit("2018-09-27"))[0].count() == 0


@pytest.mark.parametrize(
    ("times", "emitted", "updated", "logged"),
    [
        ([10000], [], 10000, 10000),
        ([10000, 13600], [], 13600, 10000),
        ([10000, 13601], [13601], 13601, 13601),
        ([10000, 13601, 10000], [13601], 13601, 13601),
        ([10000, 13601, 10001], [13601], 13601, 13601),
        ([10000, 20000, 20001], [20000], 20001, 20000),
    ],
)
def test_throttle(spark, times, emitted, updated, logged):
    rows = spark.createDataFrame([("k", n, t) for n, t in enumerate(times, 1)], "k string, nth long, time long")
    r = state.throttle(rows, ["k"]).first()
    assert ([e.updated for e in r.emitted], r.updated, r.logged) == (emitted, updated, logged)


@pytest.mark.parametrize(("steps", "result"), [("S+ B-", 1), ("B- S+", 1), ("S+ B+", 2), ("B+ S+", 2), ("B- S-", 3), ("B+ S-", 3), ("S- B-", 0), ("S- B+", 0), ("S+ B- S-", 3), ("S+ B- S- B-", 3), ("S-", 0), ("B+", 0)])
def test_pair_sequences(spark, steps, result):
    rows = []
    for n, step in enumerate(steps.split()):
        msm = S.DNSKEY_SECURE[0] if step[0] == "S" else S.DNSKEY_BOGUS[0]
        raw = wire.encode("q.example", 1, [("q.example", 1, CONTROL)] if step[1] == "+" else [], 0 if step[1] == "+" else 2)
        rows.append((msm, dt.date(2018, 8, 16), n, dt.datetime(2018, 8, 16, 0, n), None, 1, b"\0" * 16, False, raw))
    snapshot, _ = state.day_state(spark.createDataFrame(rows, S.OBSERVATION_SCHEMA))
    assert snapshot.first()["dnskey_rsamd5_result"] == result


def test_gates(spark):
    day = dt.datetime(2018, 8, 16)
    rows = spark.createDataFrame([("a", 1, day.replace(hour=23, minute=56)), ("a", 2, day.replace(hour=1)), ("b", 1, day.replace(hour=2))], "f string, seq int, time timestamp")
    assert {r.f: r.complete for r in gates.completeness(rows, ["f"], F.to_date("time")).collect()} == {"a": True, "b": False}
    assert {r.f: r.back for r in gates.disorder(rows, ["f"], "seq", "time").collect()} == {"a": 1, "b": 0}
    assert gates.newest_missing(rows.select(F.to_date("time").alias("day")), "day", F.lit("2018-08-14"), F.lit("2018-08-16")).first().day == dt.date(2018, 8, 15)




def test_merge_order_in_ranges(spark):
    rnd = random.Random(15)
    rows = [(rnd.choice(["8", "10", "9"]), rnd.choice([5, rnd.randint(0, 400)]), n) for n in range(900)]
    df = spark.createDataFrame(rows, "stream string, time long, seq long")
    got = [(r.stream, r.time, r.seq) for r in state.merge_order(df, "stream", "time", ["seq"]).orderBy("merge_ord").collect()]
    assert got == sorted(rows, key=lambda r: (r[1], r[0], r[2]))
    assert [r.merge_ord for r in state.merge_order(df, "stream", "time", ["seq"]).orderBy("merge_ord").collect()] == list(range(1, 901))
    assert state.merge_order(df.limit(0), "stream", "time", ["seq"]).count() == 0
    assert state.merge_order(df.withColumn("before", F.lit(1)).drop("before"), "stream", "time", ["seq"]).columns == ["stream", "time", "seq", "merge_ord"]


def test_throttle_equals_the_clock_of_each_event(spark):
    """Times in any order, ties, carried clocks, entities with nothing but a carried clock."""
    rnd = random.Random(23)
    rows, want = [], {}
    for key in range(60):
        held = (rnd.choice([0, 0, 50_000]), None)
        s = {"updated": 0, "logged": 0}
        if held[0]:
            s = {"updated": held[0], "logged": held[0] - rnd.randint(0, 3600)}
            rows.append((key, -1, -(1 << 40), s["updated"], s["logged"]))
        emitted, time = [], rnd.randint(1, 100_000)
        for nth in range(1, rnd.choice([2, 40, 200])):
            time = max(1, time + rnd.choice([0, 1, rnd.randint(-9000, 9000), rnd.randint(0, 1200)]))
            rows.append((key, nth, time, None, None))
            if fold.tick(s, time):
                emitted.append((nth, s["updated"]))
        want[key] = (s["updated"], s["logged"], emitted)
    df = spark.createDataFrame(rows, "k int, nth long, time long, u long, l long").repartition(7)
    got = {r.k: (r.updated, r.logged, [(e.nth, e.updated) for e in r.emitted]) for r in state.throttle(df, ["k"], updated="u", logged="l").collect()}
    assert got == want


def test_throttle_of_a_hot_entity(spark):
    """Ten million events of one entity in 40 tasks: each sends a row for each second at most."""
    events = spark.range(0, 10_000_000, 1, 40).select(F.lit("hot").alias("k"), F.col("id").alias("nth"), (F.lit(START) + F.floor(F.col("id") * 86_400 / 10_000_000) - F.col("id") % 5000).cast("long").alias("time"))
    r = state.throttle(events, ["k"]).first()
    s, emitted, latest = {"updated": 0, "logged": 0}, [], 0
    for n in range(10_000_000):  # only an event later than all before it changes anything
        if (t := START + n * 86_400 // 10_000_000 - n % 5000) > latest:
            latest = t
            if fold.tick(s, t):
                emitted.append((n, t))
    assert ([(e.nth, e.updated) for e in r.emitted], r.updated, r.logged) == (emitted, s["updated"], s["logged"]) and len(emitted) > 15


def test_state_rows_move_once(spark):
    """The wide rows are shuffled by entity once; clocks and last rows are joined to them where they are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, timeline = state.day_state(frame(spark, observations(random.Random(7), 50)))
        plan = timeline._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "prb_id" in plan and all("nth" not in x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan))
