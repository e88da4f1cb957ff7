"""Queries over the driver's tables: each engine operator on an analogue of its input, and the same in SQL.

``events`` stands for observations (user: entity, type: measurement), customers and
suppliers for addresses and prefixes, orders and line items for counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from probelake.functions import addresses, classify, dates, rules, wire
from probelake.functions import schema as S
from probelake.operators import cube, gates, history, netjoin, ranking, series, state
from probelake.sources import readers
from probelake.sources.sinks import checkpointed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


# --- state -------------------------------------------------------------------

_PAIR_SQL = """
  e AS (SELECT *, CASE WHEN event_type = 'click' THEN CASE WHEN value < 50 THEN 1 ELSE 2 END END AS s,
                  CASE WHEN event_type = 'view' THEN CASE WHEN value < 50 THEN 1 ELSE 2 END END AS b,
                  CASE WHEN event_type = 'purchase' THEN CASE WHEN value < 50 THEN 1 ELSE 2 END END AS n19,
                  CASE WHEN event_type = 'signup' THEN CASE WHEN value < 50 THEN 1 ELSE 2 END END AS n20 FROM events),
  l1 AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER w, 0) AS secure, coalesce(last_value(b IGNORE NULLS) OVER w, 0) AS bogus
         FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  l2 AS (SELECT *, CASE WHEN s = 1 AND bogus = 2 THEN 1 WHEN s = 1 AND bogus = 1 THEN 2 WHEN s = 2 AND bogus <> 0 THEN 3
                        WHEN b = 1 AND secure = 1 THEN 2 WHEN b = 2 AND secure = 1 THEN 1 END AS said FROM l1),
  l3 AS (SELECT *, coalesce(last_value(said IGNORE NULLS) OVER w, 0) AS result FROM l2 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  l4 AS (SELECT *, coalesce(last_value(CASE WHEN n20 = 1 THEN 0 WHEN n20 = 2 THEN CASE WHEN result = 1 THEN 1 ELSE 0 END END IGNORE NULLS) OVER w, 0) AS has_20326
         FROM l3 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  l5 AS (SELECT *, coalesce(last_value(CASE WHEN n19 = 1 THEN CASE WHEN has_20326 = 1 THEN 2 ELSE 0 END WHEN n19 = 2 THEN CASE WHEN has_20326 = 1 THEN 1 ELSE 0 END END IGNORE NULLS) OVER w, 0) AS has_19036
         FROM l4 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
"""


def _pair_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Window, Callable[[str], Column]]:
    said = lambda kind: F.when(F.col("event_type") == kind, F.when(F.col("value") < 50, S.CAN).otherwise(S.CANNOT))
    window = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = _events(spark, sf_dir).select("event_id", "ts", "user_id", said("click").alias("p_s"), said("view").alias("p_b"), F.lit(None).cast("int").alias("p_r"), said("purchase").alias("n19"), said("signup").alias("n20"))
    return rules.resolve_pairs(rows, window, ["p"]), window, said


@query("WITH " + _PAIR_SQL + """
  SELECT user_id, arg_max(secure, (ts, event_id)) AS secure, arg_max(bogus, (ts, event_id)) AS bogus, arg_max(result, (ts, event_id)) AS result, count(*) AS n
  FROM l3 GROUP BY user_id""")
def capability_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secure and bogus probes of a pair folded in order of time."""
    rows, _, _ = _pair_rows(spark, sf_dir)
    last = F.max_by(F.struct("p_secure", "p_bogus", "p_result"), F.struct("ts", "event_id"))
    return rows.groupBy("user_id").agg(last.alias("s"), F.count("*").alias("n")).select("user_id", F.col("s.p_secure").alias("secure"), F.col("s.p_bogus").alias("bogus"), F.col("s.p_result").alias("result"), "n")


@query("WITH " + _PAIR_SQL + "SELECT user_id, event_id, result, has_20326, has_19036 FROM l5")
def trust_anchor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four levels of dependent states, as of every event, over one shuffle and sort."""
    rows, window, _ = _pair_rows(spark, sf_dir)
    none = F.lit(None).cast("int")
    rows = rules.resolve_anchors(rows, window, F.col("n19"), F.col("n20"), F.col("p_result"), none, none)
    return rows.select("user_id", "event_id", F.col("p_result").alias("result"), F.col("has_ta_20326").alias("has_20326"), F.col("has_ta_19036").alias("has_19036"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events WHERE value IS NOT NULL GROUP BY ALL")
def keyed_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running last assignment, as of each entity's last row."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = _events(spark, sf_dir).filter("value is not null")
    rows = rows.withColumns({"last": rules.running(F.col("value"), order.rowsBetween(Window.unboundedPreceding, 0), None), "nth": F.row_number().over(order)})
    return rows.groupBy("user_id", "event_type").agg(F.max_by("last", "nth").alias("value"), F.max("ts").alias("ts"))


@query("""
WITH RECURSIVE r AS (
  SELECT user_id % 16 AS entity, CAST(ts AS DATE) AS day, CAST(epoch(date_trunc('second', ts)) AS BIGINT) + (event_id * 7919) % 10800 - 5400 AS t, event_id,
         row_number() OVER (PARTITION BY user_id % 16, CAST(ts AS DATE) ORDER BY event_id) AS nth FROM events),
f AS (
  SELECT entity, day, nth, t AS updated, t AS logged, false AS emitted FROM r WHERE nth = 1
  UNION ALL
  SELECT r.entity, r.day, r.nth,
         CASE WHEN f.updated - r.t > 3600 THEN f.updated ELSE greatest(f.updated, r.t) END,
         CASE WHEN f.updated - r.t <= 3600 AND greatest(f.updated, r.t) - f.logged > 3600 THEN r.t ELSE f.logged END,
         f.updated - r.t <= 3600 AND greatest(f.updated, r.t) - f.logged > 3600
  FROM f JOIN r ON r.entity = f.entity AND r.day = f.day AND r.nth = f.nth + 1)
SELECT entity, day, CAST(nth AS BIGINT) AS nth, updated FROM f WHERE emitted""")
def throttled_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emissions of entities whose events come up to three hours out of order."""
    t = F.unix_timestamp("ts") + (F.col("event_id") * 7919) % 10800 - 5400
    rows = _events(spark, sf_dir).select((F.col("user_id") % 16).alias("entity"), F.to_date("ts").alias("day"), t.alias("time"), F.col("event_id").alias("nth_id"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("entity", "day").orderBy("nth_id")))
    return state.throttle(numbered, ["entity", "day"]).select("entity", "day", F.explode("emitted").alias("e")).select("entity", "day", "e.nth", "e.updated")


# Observations of every kind of measurement, made from events: what an event measures follows from its
# number, the answer is the control address (or good) where its value is below 50, errors have no answer.
_MEASURED = [
    S.WHOAMI_G, S.WHOAMI_A, S.WHOAMI_6, S.QNAMEMIN, S.TCP4, S.TCP6, S.NXDOMAIN, S.DNSKEY_SECURE[5], S.DNSKEY_BOGUS[5], S.DNSKEY_SECURE[8], S.DNSKEY_BOGUS[8],
    S.DS_SECURE[1], S.DS_BOGUS[1], S.NOT_TA_20326, S.NOT_TA_19036, S.IS_TA_20326, S.FLAGDAY[0], S.FLAGDAY[1], 999,
]


@F.arrow_udf(BinaryType())
def _answers(msms, values, ids):
    import pyarrow as pa

    out = []
    for msm, value, n in zip(msms.to_pylist(), values.to_pylist(), ids.to_pylist(), strict=True):
        good, four = value < 50, bytes([10, n >> 16 & 255, n >> 8 & 255, n & 255])
        kind, data = wire.A, [bytes(map(int, S.CONTROL_ADDRESS.split("."))) if good else four]
        if msm == S.WHOAMI_G:
            texts = [".".join(map(str, four)).encode(), b"edns0-client-subnet 10.0.0.0/24" if good else b"edns0-client-subnet 2001:db8::/56"]
            kind, data = wire.TXT, [bytes([len(t)]) + t for t in texts]
        elif msm in (S.WHOAMI_A, S.TCP4):
            data = [four if good else four[:3]]
        elif msm in (S.WHOAMI_6, S.TCP6):
            kind, data = wire.AAAA, [bytes.fromhex("20010db8") + bytes(8) + four if good else four]
        elif msm == S.QNAMEMIN:
            text = b"HOORAY it does" if good else b"NO it does not"
            kind, data = wire.TXT, [bytes([len(text)]) + text]
        elif msm == S.NXDOMAIN:
            data = [four] if good else []
        out.append(wire.encode("q.example", kind, [("q.example", kind, d) for d in data], 3 if msm == S.NXDOMAIN and not good else 0))
    return pa.array(out, pa.binary())


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of 40 probes with two resolvers each."""
    e = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    msm = F.element_at(F.array(*map(F.lit, _MEASURED)), (F.col("event_id") % len(_MEASURED) + 1).cast("int"))
    addr = addresses.mapped(addresses.number_v4(F.lit(0xC0000200) + F.col("user_id") % 2))
    error = F.col("event_type") == "error"
    return e.select(
        msm.alias("msm_id"), F.to_date("ts").alias("day"), F.col("event_id").alias("seq"), F.date_trunc("second", "ts").cast("timestamp").alias("time"), F.lit(None).cast("float").alias("rt"),
        (F.col("user_id") % 40).alias("prb_id"), addr.alias("addr"), error.alias("is_error"), F.when(~error, _answers(msm, F.col("value"), F.col("event_id"))).alias("msg"),
    )


_M = {m: k for k, m in enumerate(_MEASURED)}
_STREAMS = ", ".join(f"({m}, {k})" for k, m in enumerate(sorted(S.KNOWN, key=str)))


def _last_sql(name: str, ids: list[int], good: str, bad: str, other: str = "0") -> str:
    at = ", ".join(str(_M[i]) for i in ids)
    return f"coalesce(arg_max(CASE WHEN good THEN {good} ELSE {bad} END, o) FILTER (NOT error AND m IN ({at}) AND CASE WHEN good THEN {good} ELSE {bad} END IS NOT NULL), {other}) AS {name}"


def _pair_sql(name: str, secure: int, bogus: int, last: str) -> str:
    """Common table expressions of a pair's states and result, after the one named ``last``."""
    w = "PARTITION BY prb_id, res ORDER BY o"
    return f"""
  {name}1 AS (SELECT *, CASE WHEN NOT error AND m = {_M[secure]} THEN CASE WHEN good THEN 1 ELSE 2 END END AS {name}_s, CASE WHEN NOT error AND m = {_M[bogus]} THEN CASE WHEN good THEN 1 ELSE 2 END END AS {name}_b FROM {last}),
  {name}2 AS (SELECT *, coalesce(last_value({name}_s IGNORE NULLS) OVER w, 0) AS {name}_secure, coalesce(last_value({name}_b IGNORE NULLS) OVER w, 0) AS {name}_bogus FROM {name}1 WINDOW w AS ({w})),
  {name}3 AS (SELECT *, CASE WHEN {name}_s = 1 AND {name}_bogus = 2 THEN 1 WHEN {name}_s = 1 AND {name}_bogus = 1 THEN 2 WHEN {name}_s = 2 AND {name}_bogus <> 0 THEN 3
                             WHEN {name}_b = 1 AND {name}_secure = 1 THEN 2 WHEN {name}_b = 2 AND {name}_secure = 1 THEN 1 END AS {name}_said FROM {name}2),
  {name}4 AS (SELECT *, coalesce(last_value({name}_said IGNORE NULLS) OVER ({w}), 0) AS {name}_result FROM {name}3)"""


#: Rows of the last day and of entities that are not older than ten days before it, then the states as of each row.
_DAY_SQL = f"""
  st(id, so) AS (VALUES {_STREAMS}),
  ms(k, id) AS (VALUES {", ".join(f"({k}, {m})" for m, k in _M.items())}),
  raw AS (SELECT event_id, CAST(ts AS DATE) AS day, CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) AS t, user_id % 40 AS prb_id, user_id % 2 AS res, event_id % {len(_MEASURED)} AS m, event_type = 'error' AS error, value < 50 AS good,
                 '0A' || upper(lpad(printf('%x', event_id), 6, '0')) AS four FROM events),
  last AS (SELECT max(day) AS d FROM raw),
  known AS (SELECT raw.*, so, (t, so, event_id) AS o FROM raw JOIN ms ON k = m JOIN st USING (id)),
  seen AS (SELECT prb_id, res, max(t) AS early FROM known, last WHERE day < d GROUP BY ALL),
  obs AS (SELECT known.* FROM known LEFT JOIN seen USING (prb_id, res), last WHERE day = d OR early >= CAST(floor(epoch(CAST(d AS TIMESTAMP))) AS BIGINT) - 864000),
  {_pair_sql("rsa", S.DNSKEY_SECURE[5], S.DNSKEY_BOGUS[5], "obs")},
  {_pair_sql("ec", S.DNSKEY_SECURE[8], S.DNSKEY_BOGUS[8], "rsa4")},
  {_pair_sql("ds", S.DS_SECURE[1], S.DS_BOGUS[1], "ec4")},
  a1 AS (SELECT *, coalesce(last_value(CASE WHEN NOT error AND m = {_M[S.NOT_TA_20326]} THEN CASE WHEN NOT good AND rsa_result = 1 THEN 1 ELSE 0 END END IGNORE NULLS) OVER (PARTITION BY prb_id, res ORDER BY o), 0) AS has_ta_20326 FROM ds4),
  a2 AS (SELECT *, coalesce(last_value(CASE WHEN NOT error AND m = {_M[S.NOT_TA_19036]} THEN CASE WHEN has_ta_20326 <> 1 THEN 0 WHEN good THEN 2 ELSE 1 END END IGNORE NULLS) OVER (PARTITION BY prb_id, res ORDER BY o), 0) AS has_ta_19036 FROM a1)"""

_V6 = "'20010DB80000000000000000' || four"


@query(f"""
WITH {_DAY_SQL}
SELECT prb_id, CAST(res AS INTEGER) AS res, max(t) AS updated,
  {_last_sql("whoami_g", [S.WHOAMI_G], "four", "four", "NULL")}, {_last_sql("ecs_mask", [S.WHOAMI_G], "24", "0")}, {_last_sql("ecs_mask6", [S.WHOAMI_G], "0", "56")},
  {_last_sql("whoami_a", [S.WHOAMI_A, S.TCP4], "four", "NULL", "NULL")}, {_last_sql("whoami_6", [S.WHOAMI_6, S.TCP6], _V6, "NULL", "NULL")},
  {_last_sql("qnamemin", [S.QNAMEMIN], "1", "2")}, {_last_sql("tcp_ipv4", [S.TCP4], "1", "2")}, {_last_sql("tcp_ipv6", [S.TCP6], "1", "2")},
  {_last_sql("nxdomain", [S.NXDOMAIN], "1", "2")}, {_last_sql("hijacked", [S.NXDOMAIN], "four", "''", "''")},
  {_last_sql("not_ta_19036", [S.NOT_TA_19036], "1", "2")}, {_last_sql("not_ta_20326", [S.NOT_TA_20326], "1", "2")}, {_last_sql("does_flagday", S.FLAGDAY, "2", "1")},
  arg_max(has_ta_19036, o) AS has_ta_19036, arg_max(has_ta_20326, o) AS has_ta_20326,
  arg_max(rsa_secure, o) AS rsa_secure, arg_max(rsa_bogus, o) AS rsa_bogus, arg_max(rsa_result, o) AS rsa_result, arg_max(ec_result, o) AS ec_result, arg_max(ds_result, o) AS ds_result
FROM a2 GROUP BY prb_id, res""")
def day_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole state of the last day on a carried snapshot: messages decoded, all rules, errors, unknown measurements, expiry."""
    snapshot = _last_day(spark, sf_dir)[0]
    pair = {"rsa": "dnskey_rsasha256", "ec": "dnskey_ecdsa256", "ds": "ds_sha384"}
    res = addresses.v4_number(F.substring("addr", 13, 4)) - 0xC0000200
    return snapshot.select(
        "prb_id", res.cast("int").alias("res"), "updated", *[F.hex(c).alias(c) for c in ("whoami_g", "whoami_a", "whoami_6")], "ecs_mask", "ecs_mask6", "qnamemin", "tcp_ipv4", "tcp_ipv6", "nxdomain",
        F.array_join(F.transform("hijacked", F.hex), ",").alias("hijacked"), "not_ta_19036", "not_ta_20326", "does_flagday", "has_ta_19036", "has_ta_20326",
        F.col("dnskey_rsasha256_secure").alias("rsa_secure"), F.col("dnskey_rsasha256_bogus").alias("rsa_bogus"), *[F.col(f"{p}_result").alias(f"{n}_result") for n, p in pair.items()],
    )


def _last_day(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(snapshot, timeline) of the last day; the snapshot of the days before is carried into it."""
    rows = _observations(spark, sf_dir)
    last = F.lit(_table(spark, sf_dir, "events").agg(F.max(F.to_date("ts"))).first()[0])
    # Written once, as the daily job does: each branch of the last day would fold the days before anew.
    early = checkpointed(state.day_state(rows.filter(F.col("day") < last))[0])
    return state.day_state(rows.filter(F.col("day") == last), early, last)


@query(f"""
WITH RECURSIVE {_DAY_SQL},
  n AS (SELECT *, row_number() OVER (PARTITION BY prb_id, res ORDER BY o) AS nth FROM a2),
  f AS (SELECT prb_id, res, nth, t AS updated, t AS logged, false AS emitted FROM n WHERE nth = 1
        UNION ALL
        SELECT n.prb_id, n.res, n.nth, greatest(f.updated, n.t), CASE WHEN greatest(f.updated, n.t) - f.logged > 3600 THEN n.t ELSE f.logged END, greatest(f.updated, n.t) - f.logged > 3600
        FROM f JOIN n ON n.prb_id = f.prb_id AND n.res = f.res AND n.nth = f.nth + 1)
SELECT prb_id, CAST(res AS INTEGER) AS res, f.updated, rsa_result, ec_result, ds_result, has_ta_20326, has_ta_19036 FROM f JOIN n USING (prb_id, res, nth), last WHERE emitted AND day = d""")
def day_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The emissions of the last day, each with the state as it was, on carried clocks."""
    timeline = _last_day(spark, sf_dir)[1]
    res = addresses.v4_number(F.substring("addr", 13, 4)) - 0xC0000200
    return timeline.select("prb_id", res.cast("int").alias("res"), "updated", F.col("dnskey_rsasha256_result").alias("rsa_result"), F.col("dnskey_ecdsa256_result").alias("ec_result"), F.col("ds_sha384_result").alias("ds_result"), "has_ta_20326", "has_ta_19036")


@query("""
WITH d AS (SELECT max(CAST(ts AS DATE)) AS last FROM events), k AS (SELECT user_id, CAST(floor(epoch(max(date_trunc('second', ts)))) AS BIGINT) AS updated FROM events, d WHERE CAST(ts AS DATE) < last GROUP BY user_id)
SELECT user_id, updated FROM k, d WHERE updated >= CAST(floor(epoch(CAST(last AS TIMESTAMP))) AS BIGINT) - 864000""")
def carry_over_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a snapshot of the days before carries into the last day: entities not older than ten days."""
    events = _events(spark, sf_dir)
    last = F.lit(events.agg(F.max(F.to_date("ts"))).first()[0])
    updated = F.unix_timestamp(F.max(F.date_trunc("second", "ts")).cast("timestamp"))
    seen = events.filter(F.to_date("ts") < last).groupBy(F.col("user_id").alias("prb_id")).agg(updated.alias("updated"))
    blank = {n: F.lit(None).cast("binary") if n.startswith("whoami") else F.array().cast("array<binary>") if n == "hijacked" else F.lit(0) for n in state.SNAPSHOT_STATES}
    snapshot = seen.withColumns({"addr": F.unhex(F.lit("00" * 16)), "logged": F.col("updated"), **blank})
    return state.carried(snapshot, last).select(F.col("prb_id").alias("user_id"), F.col("carried_updated").alias("updated"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_type, event_id) AS merge_ord FROM events")
def kway_merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.merge_order(_events(spark, sf_dir), "event_type", "ts", ["event_id"]).select("event_id", "merge_ord")


# --- network joins -----------------------------------------------------------

_NET_SQL = """
  ip AS (SELECT DISTINCT (c_custkey * 2654435761) % 4294967296 AS ip FROM customer),
  raw AS (SELECT 6 + s_suppkey % 15 AS masklen, (s_suppkey * 2654435761) % 4294967296 AS n, CAST(64500 + s_suppkey % 40 AS INTEGER) AS asn FROM supplier),
  p AS (SELECT n - n % (CAST(1 AS BIGINT) << CAST(32 - masklen AS INTEGER)) AS network, masklen, max(asn) AS asn FROM raw GROUP BY ALL),
  r AS (SELECT network AS f, network + (CAST(1 AS BIGINT) << CAST(32 - masklen AS INTEGER)) AS t, masklen, asn FROM p)
"""


def _net(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spread = lambda c: (F.col(c) * 2654435761) % (1 << 32)
    ips = _table(spark, sf_dir, "customer").select(spread("c_custkey").alias("ip"))
    masklen = (F.lit(6) + F.col("s_suppkey") % 15).cast("int")
    prefixes = _table(spark, sf_dir, "supplier").select(netjoin.network(spread("s_suppkey"), masklen).alias("network"), masklen.alias("masklen"), (F.lit(64500) + F.col("s_suppkey") % 40).cast("int").alias("asn"))
    return ips, prefixes


@query("WITH " + _NET_SQL + "SELECT ip, coalesce(arg_max(asn, masklen), 0) AS asn FROM ip LEFT JOIN r ON f <= ip AND ip < t GROUP BY ip")
def prefix_lpm_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips, prefixes = _net(spark, sf_dir)
    return netjoin.lpm_v4(ips, prefixes)


@query("WITH " + _NET_SQL + "SELECT ip, coalesce(arg_max(asn, masklen), 0) AS asn FROM ip LEFT JOIN r ON f <= ip AND ip < t GROUP BY ip")
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through flattened ranges."""
    ips, prefixes = _net(spark, sf_dir)
    return netjoin.range_lookup(ips, netjoin.flatten_v4(prefixes))


@query("WITH " + _NET_SQL + """,
  cut AS (SELECT DISTINCT unnest([f, t]) AS a FROM r),
  piece AS (SELECT a, lead(a) OVER (ORDER BY a) AS b FROM cut),
  own AS (SELECT a, b, arg_max(asn, masklen) AS asn FROM piece JOIN r ON f <= a AND a < t WHERE b IS NOT NULL GROUP BY a, b),
  mark AS (SELECT *, CASE WHEN lag(b) OVER (ORDER BY a) = a AND lag(asn) OVER (ORDER BY a) = asn THEN 0 ELSE 1 END AS s FROM own),
  isle AS (SELECT *, sum(s) OVER (ORDER BY a) AS g FROM mark)
  SELECT min(a) AS "from", max(b) AS till, asn FROM isle GROUP BY g, asn""")
def prefix_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return netjoin.flatten_v4(_net(spark, sf_dir)[1])


_V6_SQL = """
  ip6 AS (SELECT c_custkey, '20010db8' || lpad(printf('%x', (c_custkey * 2654435761) % 4294967296), 8, '0') || '000000000000' || lpad(printf('%x', c_custkey % 65536), 4, '0') AS h FROM customer),
  p6raw AS (SELECT 32 + 4 * (s_suppkey % 5) AS masklen, '20010db8' || lpad(printf('%x', (s_suppkey * 2654435761) % 4294967296), 8, '0') AS h, CAST(64500 + s_suppkey % 40 AS INTEGER) AS asn FROM supplier),
  p6 AS (SELECT substr(h, 1, CAST(masklen // 4 AS INTEGER)) AS stem, max(asn) AS asn FROM p6raw GROUP BY 1)
"""


def _net6(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    head = F.unhex(F.lit("20010db8"))
    spread = lambda c: addresses.number_v4((F.col(c) * 2654435761) % (1 << 32))
    tail = F.unhex(F.lpad(F.hex(F.col("c_custkey") % 65536), 16, "0"))
    ips = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(head, spread("c_custkey"), tail).alias("ip"))
    masklen = (F.lit(32) + 4 * (F.col("s_suppkey") % 5)).cast("int")
    full = F.concat(head, spread("s_suppkey"), F.unhex(F.lit("00" * 8)))
    return ips, _table(spark, sf_dir, "supplier").select(addresses.network_v6(full, masklen).alias("network"), masklen.alias("masklen"), (F.lit(64500) + F.col("s_suppkey") % 40).cast("int").alias("asn"))


@query("WITH " + _V6_SQL + "SELECT h AS ip, coalesce(arg_max(asn, length(stem)), 0) AS asn FROM ip6 LEFT JOIN p6 ON starts_with(h, stem) GROUP BY h")
def prefix_lpm_lookup_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips, prefixes = _net6(spark, sf_dir)
    return netjoin.lpm_v6(ips, prefixes).select(F.lower(F.hex("ip")).alias("ip"), "asn")


@query("WITH " + _V6_SQL + """,
  r AS (SELECT rpad(stem, 16, '0') AS f, rpad(stem, 16, 'f') AS t, length(stem) AS n, asn FROM p6),
  x AS (SELECT f, 1 AS open, n, asn, t FROM r)
  SELECT h AS at, coalesce(arg_max(asn, n), 0) AS asn FROM (SELECT DISTINCT unnest([f, t]) AS h FROM r) LEFT JOIN r ON f <= h AND h <= t GROUP BY h""")
def prefix_overlay_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattened IPv6 ranges, read at the first and last /64 of every prefix."""
    prefixes = _net6(spark, sf_dir)[1]
    ranges = netjoin.flatten_v6(prefixes).select(F.col("from"), "till", "asn")
    last = F.concat(F.substring("network", 1, 4), F.substring(F.unhex(F.rpad(F.substring(F.hex("network"), F.lit(1), (F.col("masklen") / 4).cast("int")), 32, "F")), 5, 4), F.unhex(F.lit("00" * 8)))
    points = prefixes.select(F.explode(F.array("network", last)).alias("at")).distinct()
    # Ranges are disjoint: of the ranges that begin up to a point the last one holds it, or none does.
    order = Window.partitionBy(F.substring("at", 1, 2)).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = points.select("at", F.lit(1).alias("kind"), F.lit(None).cast("struct<till:binary,asn:int>").alias("r")).unionByName(ranges.select(F.col("from").alias("at"), F.lit(0).alias("kind"), F.struct("till", "asn").alias("r")))
    held = both.withColumn("held", F.last("r", ignorenulls=True).over(order)).filter("kind = 1")
    return held.select(F.lower(F.hex(F.substring("at", 1, 8))).alias("at"), F.when(F.col("held.till").isNull() | (F.col("held.till") > F.col("at")), F.col("held.asn")).otherwise(0).alias("asn"))


@query("WITH " + _NET_SQL + "," + _V6_SQL + """,
  q AS (SELECT network, masklen, asn FROM p),
  look AS (SELECT ip, coalesce(arg_max(asn, masklen), 0) AS asn FROM ip LEFT JOIN r ON f <= ip AND ip < t GROUP BY ip),
  look6 AS (SELECT h, coalesce(arg_max(asn, length(stem)), 0) AS asn FROM ip6 LEFT JOIN p6 ON starts_with(h, stem) GROUP BY h),
  c AS (SELECT c_custkey, (c_custkey * 2654435761) % 4294967296 AS ip FROM customer)
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE a.asn END AS auth_g, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE a.asn END AS auth_a, CASE WHEN c_custkey % 5 = 0 THEN -1 WHEN c_custkey % 5 = 1 THEN a.asn ELSE s.asn END AS auth_6,
         CASE WHEN c_custkey % 2 = 0 THEN a.asn ELSE s.asn END AS res, CASE WHEN c_custkey % 7 = 0 AND ip <> 0 THEN a.asn ELSE -1 END AS nxhj,
         CASE WHEN c_custkey % 50 = 0 THEN -1 ELSE CAST(c_custkey % 50 AS INTEGER) END AS prb_4, -1 AS prb_6
  FROM c JOIN look a USING (ip) JOIN ip6 USING (c_custkey) JOIN look6 s USING (h)""")
def network_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of the five addresses of an entity, IPv4 and IPv6, and of its probe; customer 0's address is all zeros, which is none."""
    ips, six = _net6(spark, sf_dir)
    k = F.col("c_custkey")
    four = addresses.number_v4((k * 2654435761) % (1 << 32))
    snapshot = ips.select(
        k.alias("c_custkey"), (k % 50).alias("prb_id"), F.when(k % 2 == 0, addresses.mapped(four)).otherwise(F.col("ip")).alias("addr"), F.when(k % 3 != 0, four).alias("whoami_g"), F.when(k % 4 != 0, four).alias("whoami_a"),
        F.when(k % 5 == 1, addresses.mapped(four)).when(k % 5 > 1, F.col("ip")).alias("whoami_6"), F.when(k % 7 == 0, F.array(four)).otherwise(F.array().cast("array<binary>")).alias("hijacked"),
    )
    probes = spark.range(1, 50).select(F.col("id").alias("prb_id"), F.col("id").cast("int").alias("asn_v4"), F.lit(-1).alias("asn_v6"))
    return netjoin.enrich(snapshot, probes, _net(spark, sf_dir)[1], six).select("c_custkey", "auth_g", "auth_a", "auth_6", "res", "nxhj", "prb_4", "prb_6")


_ASN_SQL = """
  x AS (SELECT c_custkey, CAST(c_custkey % 7 AS INTEGER) - 1 AS x4, CAST(c_custkey % 5 AS INTEGER) - 1 AS x6, CAST(c_custkey % 11 AS INTEGER) AS y,
               CAST(c_custkey % 13 AS INTEGER) - 1 AS g, CAST(c_custkey // 13 % 9 AS INTEGER) - 1 AS a, CAST(c_custkey // 7 % 6 AS INTEGER) - 1 AS s FROM customer)
"""


def _asns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column]]:
    k = F.col("c_custkey")
    div = lambda n: F.floor(k / n)
    rows = _table(spark, sf_dir, "customer").select(
        "c_custkey", *[e.cast("int").alias(n) for n, e in {"x4": k % 7 - 1, "x6": k % 5 - 1, "y": k % 11, "g": k % 13 - 1, "a": div(13) % 9 - 1, "s": div(7) % 6 - 1}.items()]
    )
    return rows, [F.col(c) for c in ("x4", "x6", "y", "g", "a", "s")]


@query("WITH " + _ASN_SQL + """,
  z AS (SELECT *, CASE WHEN y = 0 THEN CASE WHEN x4 > 0 THEN x4 WHEN x6 > 0 THEN x6 ELSE -1 END ELSE y END AS res,
               CASE WHEN x4 > 0 THEN x4 WHEN x6 > 0 THEN x6 ELSE -1 END AS x FROM x)
  SELECT c_custkey,
    CASE WHEN greatest(g, a, s) <= 0 THEN 0
         WHEN (g > 0 AND g IN (x4, x6)) OR (a > 0 AND a IN (x4, x6)) OR (s > 0 AND s IN (x4, x6)) THEN 1
         WHEN y > 0 AND y IN (g, a, s) THEN 3 ELSE 2 END AS origin,
    CASE WHEN greatest(g, a, s) <= 0 THEN x
         WHEN g > 0 AND g IN (x4, x6) THEN g WHEN a > 0 AND a IN (x4, x6) THEN a WHEN s > 0 AND s IN (x4, x6) THEN s
         WHEN res > 0 AND res IN (g, a, s) THEN x
         WHEN res IN (x4, x6) THEN res ELSE x END AS probe_asn,
    res AS resolver_asn,
    CASE WHEN greatest(g, a, s) > 0 AND g > 0 AND g IN (x4, x6) THEN g WHEN a > 0 AND a IN (x4, x6) THEN a WHEN s > 0 AND s IN (x4, x6) THEN s
         WHEN g > 0 AND g = res THEN g WHEN a > 0 AND a = res THEN a WHEN s > 0 AND s = res THEN s
         WHEN g > 0 THEN g WHEN a > 0 THEN a WHEN s > 0 THEN s WHEN 0 IN (g, a, s) THEN 0 ELSE -1 END AS auth_asn
  FROM z""")
def int_fwd_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cols = _asns(spark, sf_dir)
    return rows.select("c_custkey", classify.origin_class(*cols).alias("origin"), *[v.alias(f"{k}_asn") for k, v in classify.attributed(*cols).items()])


# --- cube and ranks ----------------------------------------------------------

_TYPES = ["click", "error", "purchase", "signup", "view"]
_NAMES = {t: [f"{t}_{k}" for k in (1, 2, 3)] for t in _TYPES}
_CUBE_SQL = """
  d AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, least(count(*), 3) AS v, row_number() OVER () AS x FROM events GROUP BY user_id, CAST(ts AS DATE), event_type),
  row_ AS (SELECT DISTINCT user_id, day FROM d),
  h AS (SELECT user_id, day, event_type || '_' || v AS value FROM d),
  s1 AS (SELECT user_id, day, '' AS selection FROM row_ UNION ALL SELECT user_id, day, value FROM h),
  s2 AS (SELECT * FROM s1 UNION ALL SELECT h.user_id, h.day, h.value || '/' || i.value FROM h JOIN h i ON h.user_id = i.user_id AND h.day = i.day AND split_part(h.value, '_', 1) < split_part(i.value, '_', 1))
"""


def _daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """A row for each user and day, as a resolver of the user, with capability values 0 to 3 by event type."""
    rows = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(*[F.least(F.count_if(F.col("event_type") == t), F.lit(3)).alias(t) for t in _TYPES])
    return rows, cube.held_values({t: F.col(t) for t in _TYPES}, _NAMES)


def _cube_sql(k: int) -> str:
    return f"WITH {_CUBE_SQL} SELECT selection, count(*) AS n_resolvers, count(DISTINCT user_id) AS n_probes FROM s{k} GROUP BY selection"


@query(_cube_sql(1))
def selection_cube_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.cube(*_daily(spark, sf_dir), "user_id", 1)


@query(_cube_sql(2))
def selection_cube_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.cube(*_daily(spark, sf_dir), "user_id", 2)


@query(f"WITH {_CUBE_SQL}" + """,
  c AS (SELECT s1.selection, h.value, count(*) AS n FROM s1 JOIN h USING (user_id, day) GROUP BY ALL),
  f AS (SELECT DISTINCT user_id, value FROM h),
  g AS (SELECT selection, value, count(*) AS n_prbs FROM (SELECT DISTINCT selection, user_id FROM s1) JOIN f USING (user_id) GROUP BY ALL)
  SELECT selection, value, coalesce(n, 0) AS n, coalesce(n_prbs, 0) AS n_prbs FROM c FULL JOIN g USING (selection, value)""")
def probe_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by rows of a selection, and by its probes with all their rows."""
    return cube.value_counts(*_daily(spark, sf_dir), "user_id", 1)


@query(f"WITH {_CUBE_SQL} SELECT s1.selection, CAST(user_id % 7 AS BIGINT) AS value, count(*) AS n FROM s1 WHERE user_id % 7 <> 0 GROUP BY ALL")
def dimension_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, held = _daily(spark, sf_dir)
    return cube.histogram(rows, F.col("user_id") % 7, held, 1, F.col("user_id") % 7 != 0)


@query("""
WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT n, count(*) AS items, string_agg('AS' || k, ',' ORDER BY k) AS names, row_number() OVER (ORDER BY n DESC) AS band FROM c GROUP BY n)
SELECT CAST(band AS INTEGER) AS band, n AS "count", items, CAST(n * items AS BIGINT) AS total, CASE WHEN items > 20 THEN 'in ' || items || ' ASNs (' || n || ')' ELSE names END AS label FROM b WHERE band <= 12
UNION ALL SELECT NULL, NULL, CAST(sum(items) AS BIGINT), CAST(sum(n * items) AS BIGINT), 'Remaining' FROM b WHERE band > 12 HAVING count(*) > 0""")
def asn_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with equally many orders share a band."""
    counts = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("asn")).agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    return ranking.bands(counts, ["all"], most=12).drop("all")


@query("""
WITH c AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, part) AS k FROM c)
SELECT CAST(k AS INTEGER) AS rank, CAST(part AS VARCHAR) AS part, n FROM r WHERE k <= 9 UNION ALL SELECT NULL, 'Remaining', CAST(sum(n) AS BIGINT) FROM r WHERE k > 9 HAVING count(*) > 0""")
def top_n_with_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))
    return ranking.top_n(counts, [], "part", "n", 9)


@query("""
WITH c AS (SELECT l_returnflag AS flag, CAST(l_quantity AS INTEGER) AS mask, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY n DESC, mask) AS k FROM c)
SELECT flag, CAST(k AS INTEGER) AS rank, CAST(mask AS VARCHAR) AS mask, n FROM r WHERE k <= 10 UNION ALL SELECT flag, NULL, 'Remaining', CAST(sum(n) AS BIGINT) FROM r WHERE k > 10 GROUP BY flag""")
def top_masks_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("int").alias("mask")).agg(F.count("*").alias("n"))
    return ranking.top_n(counts, ["flag"], "mask", "n", 10)


@query("""
WITH t AS (SELECT l_suppkey AS supp FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 100)
SELECT supp, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN t ON supp = l_suppkey OR supp = l_partkey WHERE supp IN (l_suppkey, l_partkey) GROUP BY supp""")
def topn_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with one of the 100 busiest suppliers as their supplier or part number; a line may match two."""
    lines = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    counts = lines.groupBy(F.col("l_suppkey").alias("supp")).agg(F.count("*").alias("n"))
    rows = ranking.top_semi_join(lines, F.array("l_suppkey", "l_partkey"), ranking.ranked_top(counts, "supp", "n", 100).drop("n"), "supp")
    return rows.groupBy("supp").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("WITH " + _ASN_SQL + """,
  t AS (SELECT g AS asn, row_number() OVER (ORDER BY count(*) DESC, g) AS rank FROM x GROUP BY g QUALIFY rank <= 6),
  c AS (SELECT DISTINCT c_custkey, unnest([g, a, s]) AS asn FROM x),
  k AS (SELECT c_custkey, count(*) FILTER (asn <> 0) AS d FROM c GROUP BY 1),
  m AS (SELECT c_custkey, asn, row_number() OVER (PARTITION BY c_custkey ORDER BY rank) AS nth FROM c JOIN t USING (asn))
  SELECT asn, count(*) AS n FROM m JOIN k USING (c_custkey) WHERE d > 0 AND nth <= d GROUP BY asn""")
def topn_semi_join_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row counts for at most as many top items, by rank, as it has different routed candidates."""
    rows, _ = _asns(spark, sf_dir)
    counts = rows.groupBy(F.col("g").alias("asn")).agg(F.count("*").alias("n"))
    matched = ranking.top_semi_join(rows, F.array("g", "a", "s"), ranking.ranked_top(counts, "asn", "n", 6).drop("n"), "asn", within=0)
    return matched.groupBy("asn").agg(F.count("*").alias("n"))


# --- series ------------------------------------------------------------------


@query("""
WITH t AS (SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (event_type IN ('click', 'view')) AS known, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (event_type = 'click') AS clickers FROM events GROUP BY 1)
SELECT day, total, known, total - known AS unknown, round(100.0 * known / total, 6) AS share, round(100.0 * clickers / users, 6) AS probe_share FROM t""")
def daily_series_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type").isin("click", "view")).alias("value"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("event_type") == "click", F.col("user_id"))).alias("clickers")
    )
    known = series.with_unknown(rows, ["day", "users", "clickers"], "total", "value")
    return known.select("day", "total", "known", "unknown", F.round(series.share(F.col("known"), F.col("total")), 6).alias("share"), F.round(series.share(F.col("clickers"), F.col("users")), 6).alias("probe_share"))


@query("""
WITH c AS (SELECT user_id AS u, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'signup' AND value > 99) AS n FROM events GROUP BY ALL),
f AS (SELECT u, min(day) AS start FROM c WHERE n <> 0 GROUP BY u), l AS (SELECT u, max(day) AS last FROM c JOIN f USING (u) GROUP BY u)
SELECT u, day, n, day = last AS latest FROM c JOIN f USING (u) JOIN l USING (u) WHERE day >= start""")
def trimmed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy(F.col("user_id").alias("u"), F.to_date("ts").alias("day")).agg(F.count_if((F.col("event_type") == "signup") & (F.col("value") > 99)).alias("n"))
    kept = series.trim(rows, ["u"], "day", "n")
    last = kept.groupBy("u").agg(F.max("day").alias("last"))
    return kept.join(last, "u").select("u", "day", "n", (F.col("day") == F.col("last")).alias("latest"))


@query("""
WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type AS t, user_id AS asn, count(*) AS n FROM events GROUP BY ALL),
b AS (SELECT day, n, count(*) AS items, sum(n) AS total, list(asn) AS asns FROM c WHERE t = 'click' GROUP BY day, n),
e AS (SELECT day, unnest(asns) AS asn, CAST(floor(total / items) AS BIGINT) AS n FROM b WHERE items <= 20),
top AS (SELECT 'AS' || asn AS asn FROM e GROUP BY 1 ORDER BY sum(n) DESC, 1 DESC LIMIT 9),
x AS (SELECT day, 'AS' || e.asn AS asn, sum(n) AS n FROM e WHERE 'AS' || e.asn IN (FROM top) GROUP BY ALL),
s AS (SELECT day, sum(total) AS al FROM b GROUP BY 1)
SELECT day, asn, CAST(n AS BIGINT) AS n FROM x UNION ALL SELECT s.day, 'Remaining', CAST(al - coalesce(sum(n), 0) AS BIGINT) FROM s LEFT JOIN x USING (day) GROUP BY s.day, al""")
def top_asns_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _events(spark, sf_dir).filter("event_type = 'click'").groupBy(F.to_date("ts").alias("day"), F.col("user_id").alias("asn")).agg(F.count("*").alias("n"))
    return series.top_of_series(ranking.bands(counts, ["day"]), "day", "label", "total")


@query("""
WITH c AS (SELECT CAST(ts AS DATE) AS day, CAST(user_id % 64 AS INTEGER) AS mask, count(*) AS n FROM events GROUP BY ALL),
t AS (SELECT mask FROM c WHERE mask > 0 GROUP BY mask ORDER BY sum(n) DESC, mask LIMIT 15)
SELECT day, CASE WHEN mask IN (FROM t) THEN '/' || mask ELSE 'Remaining' END AS label, CAST(sum(n) AS BIGINT) AS n FROM c WHERE mask > 0 GROUP BY ALL""")
def top_masks_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 64).cast("int").alias("mask")).agg(F.count("*").alias("n"))
    return series.top_masks(rows, "day", "mask", "n")


@query("SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in _TYPES) + " FROM events GROUP BY 1")
def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return series.pivot_report(long, "day", "event_type", "n", _TYPES)


@query("SELECT s_suppkey, coalesce(n_name, 'AS' || (s_nationkey + s_suppkey % 2 * 10)) AS label FROM supplier LEFT JOIN nation ON s_nationkey + s_suppkey % 2 * 10 = n_nationkey")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers beyond the known ones have no name."""
    names = _table(spark, sf_dir, "nation").select(F.concat(F.lit("AS"), "n_nationkey").alias("asn"), F.col("n_name").alias("name"))
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("AS"), F.col("s_nationkey") + F.col("s_suppkey") % 2 * 10).alias("asn"))
    return series.with_labels(rows, names).select("s_suppkey", "label")


# --- gates and history -------------------------------------------------------


@query("""
SELECT event_type, CAST(ts AS DATE) AS day, min(ts) AS first, max(ts) AS last, count(*) AS rows, CAST(floor(epoch(CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP))) - floor(epoch(max(ts))) AS BIGINT) <= 7200 AS complete
FROM events GROUP BY event_type, CAST(ts AS DATE)""")
def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.completeness(_events(spark, sf_dir), ["event_type"], F.to_date("ts"), "ts", near=7200)


@query("""
WITH s AS (SELECT event_type, event_id, ts + to_seconds((event_id * 7919) % 10800) AS t FROM events), b AS (SELECT *, lag(t) OVER (PARTITION BY event_type, event_id // 1000 ORDER BY event_id) AS p FROM s)
SELECT event_type, event_id // 1000 AS file, count(*) AS rows, count(*) FILTER (p > t) AS back FROM b GROUP BY ALL""")
def sortedness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0)
    t = F.col("ts") + F.make_dt_interval(zero, zero, zero, ((F.col("event_id") * 7919) % 10800).cast("decimal(18,6)"))
    return gates.disorder(_events(spark, sf_dir).withColumns({"t": t, "file": F.floor(F.col("event_id") / 1000)}), ["event_type", "file"], "event_id", "t")


@query("""
WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)
SELECT user_id, CAST(g AS DATE) AS day FROM (SELECT min(day) AS a, max(day) AS b FROM e), (SELECT DISTINCT user_id FROM e), generate_series(a, b, INTERVAL 1 DAY) t(g) WHERE (user_id, CAST(g AS DATE)) NOT IN (SELECT (user_id, day) FROM e)""")
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without an event of a user, between the first and last day of all."""
    events = _events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day"))
    first, last = events.agg(F.min("day"), F.max("day")).first()
    return gates.missing_days(events, "day", F.lit(first), F.lit(last), ["user_id"])


@query("""
WITH o AS (SELECT o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT priority, CAST(g AS DATE) AS day FROM (SELECT min(day) AS a, max(day) AS b FROM o), (SELECT DISTINCT priority FROM o), generate_series(a, b, INTERVAL 1 DAY) t(g) WHERE (priority, CAST(g AS DATE)) NOT IN (SELECT (priority, day) FROM o)""")
def missing_days_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without an order of a priority, over all orders."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("day"))
    first, last = orders.agg(F.min("day"), F.max("day")).first()
    return gates.missing_days(orders, "day", F.lit(first), F.lit(last), ["priority"])


@query("""
WITH d AS (SELECT max(CAST(ts AS DATE)) AS last FROM events)
SELECT user_id, event_type, max(ts) AS dt FROM events, d GROUP BY ALL HAVING max(ts) >= max(last) - INTERVAL 10 DAY""")
def rewrite_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "event_type", F.col("ts").alias("dt"))
    last = rows.agg(F.max(F.to_date("dt"))).first()[0]
    cut = F.lit(last)
    early = history.last_seen(rows.filter(F.to_date("dt") < cut), ["user_id", "event_type"])
    return history.fold(early, rows.filter(F.to_date("dt") >= cut), ["user_id", "event_type"], cut)


# --- ingest ------------------------------------------------------------------

_V4 = "(user_id % 223 + 1) || '.' || (event_id % 256) || '.' || (event_id // 256 % 256) || '.' || (user_id % 256)"


@query(f"""
SELECT event_id AS prb_id, CAST(0 AS BIGINT) AS seq, to_timestamp(CAST(floor(epoch(ts)) AS BIGINT))::TIMESTAMP AS time,
       CASE WHEN event_type = 'view' THEN NULL ELSE {_V4} END AS address, event_type <> 'click' AS is_error, CAST(json_extract(props, '$.k') AS VARCHAR) AS k
FROM events WHERE event_type IN ('click', 'purchase')""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested objects written as JSON text and read back: clicks have an answer, purchases an error, others are incomplete."""
    u, e, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    text = F.concat_ws(".", (u % 223 + 1), (e % 256), (F.floor(e / 256) % 256), (u % 256))
    k = F.get_json_object("props", "$.k")
    attempt = F.struct(
        F.unix_timestamp("ts").alias("time"),
        F.when(kind == "click", text).alias("dst_addr"),
        F.when(kind.isin("click", "purchase"), text).when(kind == "signup", "resolver.example").alias("dst_name"),
        F.when(kind.isin("purchase", "view", "signup"), F.struct(k.alias("timeout"))).alias("error"),
        F.when(kind == "click", F.struct(F.lit(1.5).alias("rt"), F.regexp_replace(F.base64(F.encode(k, "utf-8")), "=", "").alias("abuf"))).alias("result"),
    )
    lines = _events(spark, sf_dir).select(F.to_json(F.struct(F.array(attempt).alias("resultset"), e.alias("prb_id"), F.lit("ignored").alias("extra"))).alias("line"))
    rows, _ = readers.parse_lines(lines, "line", S.NXDOMAIN, "2024-01-01")
    message = F.decode("msg", "utf-8")
    return rows.select("prb_id", "seq", "time", addresses.v4_text(F.substring("addr", 13, 4)).alias("address"), "is_error", F.when(F.col("is_error"), F.get_json_object(message, "$.timeout")).otherwise(message).alias("k"))


@F.arrow_udf(BinaryType())
def _encoded(types, values, ids):
    import pyarrow as pa

    out = []
    for kind, value, n in zip(types.to_pylist(), values.to_pylist(), ids.to_pylist(), strict=True):
        name, alias = f"Host{n}.Example", f"target{n}.example"
        data = bytes([10, n >> 16 & 255, n >> 8 & 255, n & 255])
        rcode, answers = {
            "click": (0, [(name, wire.A, data)]),
            "view": (0, [(name.lower(), wire.CNAME, wire.write_name(alias.upper())), (alias, wire.A, data)]),
            "purchase": (3, []),
            "signup": (0, []),
        }.get(kind, (2, []))
        out.append(wire.encode(name, wire.A, answers, rcode, ident=int(value) & 0xFFFF))
    return pa.array(out, pa.binary())


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", _encoded("event_type", F.floor("value").cast("long"), "event_id").alias("msg"))


@query("""
SELECT event_id, CAST(CASE event_type WHEN 'purchase' THEN 3 WHEN 'error' THEN 2 ELSE 0 END AS INTEGER) AS rcode, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS INTEGER) AS ancount,
       'host' || event_id || '.example.' AS qname, CAST(floor(value) AS INTEGER) AS id,
       CASE WHEN event_type IN ('click', 'view') THEN '10.' || (event_id // 65536 % 256) || '.' || (event_id // 256 % 256) || '.' || (event_id % 256) END AS answer
FROM events""")
def wire_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages encoded from rows, decoded again; header fields natively, answers through CNAMEs by the UDF."""
    rows = _messages(spark, sf_dir).withColumn("m", wire.parse_dns("msg"))
    answer = F.try_element_at(F.col("m.answers"), F.lit(1))["rdata"]
    return rows.select("event_id", wire.rcode(F.col("msg")).alias("rcode"), wire.count_of(F.col("msg"), "answer").alias("ancount"), "m.qname", "m.id", addresses.v4_text(answer).alias("answer"))


@query("""
WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t FROM events GROUP BY user_id)
SELECT CASE WHEN t IN ('click', 'view') THEN 'does_nxdomain' WHEN t IN ('purchase', 'signup') THEN 'doesnt_nxdomain' ELSE 'broken' END AS value, count(*) AS n_resolvers, count(DISTINCT user_id % 20) AS n_probes FROM l GROUP BY 1""")
def rewriting_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end for one measurement: messages, decoding, the non-existence rule, last state, counts by value."""
    rows = _messages(spark, sf_dir).withColumn("m", wire.parse_dns("msg"))
    said = rules.assignments(F.col("m"), F.lit(S.NXDOMAIN))["nxdomain"]
    last = rows.withColumn("said", said).groupBy("user_id").agg(F.max_by("said", F.struct("ts", "event_id")).alias("nxdomain"))
    value = F.when(F.col("nxdomain") == S.CAN, "does_nxdomain").when(F.col("nxdomain") == S.CANNOT, "doesnt_nxdomain").otherwise("broken")
    return last.groupBy(value.alias("value")).agg(F.count("*").alias("n_resolvers"), F.count_distinct(F.col("user_id") % 20).alias("n_probes"))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, CAST((length(html) - length(replace(html, '<li>', ''))) // 4 AS INTEGER) AS items FROM pages")
def html_pre_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text between tags, and the number of listed parts."""
    return _table(spark, sf_dir, "pages").select("page_id", readers.tagged("html", "title")[0].alias("title"), readers.tagged("html", "li")[1].alias("items"))


@query("""
WITH n AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS ip FROM orders)
SELECT o_orderkey, (ip >> 24) || '.' || (ip >> 16 & 255) || '.' || (ip >> 8 & 255) || '.' || (ip & 255) AS text, '00000000000000000000FFFF' || upper(lpad(printf('%x', ip), 8, '0')) AS mapped, ip AS number, CAST(o_orderkey % 33 AS INTEGER) AS mask FROM n""")
def address_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers to addresses, text and mapped form and back; the number after the last slash."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 2654435761) % (1 << 32)).alias("ip"))
    text = addresses.v4_text(addresses.number_v4(F.col("ip")))
    full = addresses.address_bytes(F.col("text"))
    subnet = F.concat("text", F.lit("/"), (F.col("o_orderkey") % 33).cast("string"))
    return rows.withColumn("text", text).select("o_orderkey", "text", F.hex(full).alias("mapped"), addresses.v4_number(F.substring(full, 13, 4)).alias("number"), addresses.trailing_number(subnet).alias("mask"))


# --- dimensions --------------------------------------------------------------


@query("""
SELECT s_suppkey, (s_suppkey * 2654435761) % 4294967296 // (CAST(1 AS BIGINT) << 8) * (CAST(1 AS BIGINT) << 8) AS network, 24 AS masklen, CAST(64500 + s_suppkey AS INTEGER) AS asn
FROM supplier WHERE s_suppkey % 5 <> 0""")
def prefix_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix text with one or several origins (the first counts); rows without a number are no prefixes."""
    n = netjoin.network((F.col("s_suppkey") * 2654435761) % (1 << 32), F.lit(24))
    asn = F.when(F.col("s_suppkey") % 5 == 0, "none").otherwise(F.concat((F.lit(64500) + F.col("s_suppkey")).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "_1,2").otherwise("")))
    text = _table(spark, sf_dir, "supplier").select(addresses.v4_text(addresses.number_v4(n)).alias("prefix"), F.lit(24).alias("masklen"), asn.alias("asn"))
    four, _ = readers.prefixes(text)
    return four.select((F.col("asn") - 64500).cast("long").alias("s_suppkey"), "network", "masklen", "asn")


@query("""
WITH c AS (SELECT c_custkey AS prb_id, c_custkey % 3 = 0 OR c_custkey % 1000 = 0 AS no4, c_custkey % 4 = 0 OR c_custkey % 900 = 0 AS no6 FROM customer)
SELECT prb_id, CASE WHEN no4 THEN -1 ELSE CAST(prb_id % 1000 AS INTEGER) END AS asn_v4, CASE WHEN no6 THEN -1 ELSE CAST(prb_id % 900 AS INTEGER) END AS asn_v6
FROM c WHERE NOT (no4 AND no6)""")
def probe_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes with the networks that are known; 0 in an archive is unknown, as null is."""
    k = F.col("c_custkey")
    none = F.lit(None)
    raw = _table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 3 != 0, (k % 1000).cast("int")).alias("asn_v4"), F.when(k % 4 != 0, (k % 900).cast("int")).alias("asn_v6"),
        none.cast("double").alias("latitude"), none.cast("double").alias("longitude"), none.cast("string").alias("country_code"),
    )
    return readers.probes(raw).select("prb_id", "asn_v4", "asn_v6")


@query("SELECT 'AS' || n_nationkey AS asn, 'N' || n_regionkey AS handle, n_name AS name FROM nation")
def asn_name_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the lines of a page's preformatted block, a page for each region."""
    line = F.concat(F.lit("AS"), "n_nationkey", F.lit("  N"), "n_regionkey", F.lit(" - "), "n_name")
    pages = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(line), "<br />\n").alias("lines"))  # a nation's line each
    return readers.asn_names(pages.select(F.concat(F.lit("<html><pre>"), "lines", F.lit("</pre></html>")).alias("html")), "html")


@query("""
WITH e AS (SELECT CAST(ts AS DATE) AS day, CAST(user_id % 10 AS VARCHAR) AS selection, event_type AS value, user_id, CAST(user_id % 33 AS INTEGER) AS mask FROM events),
c AS (SELECT day, selection, value, count(*) AS n, count(DISTINCT user_id) AS n_prbs FROM e GROUP BY ALL),
b AS (SELECT day, selection, sum(n) AS resolvers, max(n) FILTER (value = 'click') AS can_tcp, max(n_prbs) FILTER (value = 'click') AS can_tcp_prbs FROM c GROUP BY ALL),
m0 AS (SELECT day, selection, mask, count(*) AS n FROM e WHERE mask <> 0 GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY day, selection ORDER BY n DESC, mask) AS k FROM m0),
m2 AS (SELECT day, selection, max(mask) FILTER (k = 1) AS m1, max(n) FILTER (k = 1) AS n1, max(mask) FILTER (k = 2) AS m2, coalesce(sum(n) FILTER (k > 2), 0) AS rest FROM m GROUP BY ALL),
u AS (SELECT day, selection, user_id, count(*) AS n FROM e GROUP BY ALL),
g0 AS (SELECT day, selection, n, count(*) AS items, string_agg('AS' || user_id, ',' ORDER BY user_id) AS names FROM u GROUP BY day, selection, n),
g AS (SELECT *, row_number() OVER (PARTITION BY day, selection ORDER BY n DESC) AS k FROM g0),
g2 AS (SELECT day, selection, sum(n * items) FILTER (k = 1) AS t1, max(CASE WHEN items > 20 THEN 'in ' || items || ' ASNs (' || n || ')' ELSE names END) FILTER (k = 1) AS l1, coalesce(sum(n * items) FILTER (k > 2), 0) AS rest FROM g GROUP BY ALL)
SELECT b.day, b.selection, CAST(coalesce(can_tcp, 0) AS VARCHAR) AS can_tcp, CAST(coalesce(can_tcp_prbs, 0) AS VARCHAR) AS can_tcp_prbs, '0' AS can_gost, CAST(resolvers AS BIGINT) AS resolvers,
       CAST(coalesce(m1, 0) AS VARCHAR) AS mask_1, CAST(coalesce(n1, 0) AS VARCHAR) AS mask_1_count, CAST(coalesce(m2.m2, 0) AS VARCHAR) AS mask_2, CAST(coalesce(m2.rest, 0) AS VARCHAR) AS masks_rest,
       CAST(CAST(t1 AS BIGINT) AS VARCHAR) AS band_1, l1 AS band_1_label, CAST(CAST(g2.rest AS BIGINT) AS VARCHAR) AS bands_rest
FROM b LEFT JOIN m2 USING (day, selection) JOIN g2 USING (day, selection)""")
def wide_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of 965 columns from long tables of values, masks and bands; some of its columns."""
    from probelake.sources import sinks

    rows = _events(spark, sf_dir).select(F.to_date("ts").alias("day"), (F.col("user_id") % 10).cast("string").alias("selection"), "event_type", "user_id")
    key = ["day", "selection"]
    counted = rows.groupBy(*key, "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_prbs"))
    values = counted.withColumn("value", F.when(F.col("event_type") == "click", "can_tcp").otherwise(F.concat(F.lit("other_"), "event_type")))
    base = counted.groupBy(*key).agg(F.sum("n").alias("n_resolvers"), F.sum("n_prbs").alias("n_probes")).withColumn("datetime", F.lit(""))
    mask = (F.col("user_id") % 33).cast("int")
    masks = ranking.top_n(rows.filter(mask != 0).groupBy(*key, mask.alias("mask")).agg(F.count("*").alias("n")), key, "mask", "n", 2).withColumn("family", F.lit("ECS mask"))
    bands = ranking.bands(rows.groupBy(*key, F.col("user_id").alias("asn")).agg(F.count("*").alias("n")), key, most=2).withColumn("dim", F.lit("resolver"))
    wide = sinks.wide_report(base, values, masks, bands)
    named = {"resolvers": "# resolvers", "mask_1": "ECS mask #1", "mask_1_count": "ECS mask #1 count", "mask_2": "ECS mask #2", "masks_rest": "Remaining ECS mask count", "band_1": "resolver #1 total", "band_1_label": "resolver #1 ASNs", "bands_rest": "Remaining resolver ASNs count"}
    return wide.select(*key, "can_tcp", "can_tcp_prbs", "can_gost", *[F.col(c).alias(n) for n, c in named.items()])


@query(f"WITH {_CUBE_SQL} SELECT selection, user_id AS probe, strftime(day, '%Y-%m-%d') AS address FROM s1")
def selection_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of all selections, a row each."""
    rows, held = _daily(spark, sf_dir)
    return cube.members(rows, held, "user_id", F.col("day").cast("string"), 1)


@query("""
WITH f AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, '2018/' || o_orderkey || '.gz' AS file FROM orders)
SELECT arg_max(file, (day, o_orderkey)) AS file FROM f""")
def newest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest file of a creation log, a line for each order."""
    order = F.struct(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey"))
    log = _table(spark, sf_dir, "orders").select(order.alias("nth"), F.concat_ws("\t", "o_orderkey", F.lit("15"), F.concat(F.lit("2018/"), "o_orderkey", F.lit(".gz"))).alias("value"))
    return readers.newest_prefix_file(log)


@query("""
SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS text, date_trunc('second', ts) AS back, CAST(ts AS DATE) = DATE '2024-01-07' AS on_day FROM events""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC times to text and back, and the same-day test."""
    rows = _events(spark, sf_dir).withColumn("text", dates.time_text(F.col("ts").cast("timestamp")))
    return rows.select("event_id", "text", dates.text_time(F.col("text")).cast("timestamp_ntz").alias("back"), dates.on_day(F.col("ts"), F.lit("2024-01-07")).alias("on_day"))


@query("""
WITH h AS (SELECT event_id, user_id, CAST(ts AS DATE) AS dt, 'h' || (event_id % 7) AS a, 'h' || (event_id % 5) AS b FROM events),
x AS (SELECT DISTINCT dt, user_id, unnest([a, b]) AS ip FROM h)
SELECT CAST(substr(ip, 2) AS INTEGER) AS asn, user_id AS prb_id, max(dt) AS dt FROM x WHERE ip <> 'h0' GROUP BY ALL""")
def rewrites_by_asn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last rewrite of each network and entity; networks that are not routed (0) do not count."""
    e = F.col("event_id")
    slots = F.array(F.concat(F.lit("h"), e % 7), F.concat(F.lit("h"), e % 5))
    timeline = _events(spark, sf_dir).select(F.to_date("ts").alias("dt"), F.col("user_id").alias("prb_id"), F.lit("r").alias("resolver"), slots.alias("hijacked"))
    asns = spark.range(7).select(F.concat(F.lit("h"), "id").alias("ip"), F.col("id").cast("int").alias("asn"))
    return history.rewrites(timeline, asns)["by_asn"].select("asn", "prb_id", "dt")


# --- mergeable counters, checks, capability values ----------------------------


@query("WITH " + _CUBE_SQL + """
SELECT date_trunc('month', day)::DATE AS month, selection, count(*) AS n_resolvers, count(DISTINCT user_id) AS n_probes FROM s1 GROUP BY ALL""")
def monthly_probes_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct probes of a month from the bitmaps of its days."""
    rows, held = _daily(spark, sf_dir)
    days = cube.probe_bitmaps(rows, held, "user_id", 1, ["day"])
    return cube.merged(days.withColumn("month", F.trunc("day", "month")), ["month"])


_CROSSING_SQL = """
  WITH r AS (SELECT s_suppkey, (s_suppkey * 2654435761) % 4294967296 // 256 * 256 AS f, 8 + s_suppkey % 12 AS masklen FROM supplier),
  x AS (SELECT *, f + (CAST(1 AS BIGINT) << CAST(32 - masklen AS INTEGER)) AS t FROM r)
"""


@query(_CROSSING_SQL + """
SELECT a.s_suppkey, a.f AS network, CAST(a.masklen AS INTEGER) AS masklen, max(b.t) AS crossed FROM x a JOIN x b ON b.f < a.f OR b.f = a.f AND b.t > a.t GROUP BY ALL HAVING max(b.t) > a.f AND a.t > max(b.t)""")
def prefix_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes with bits beyond their length, which overlap others in part."""
    k = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", (F.floor((k * 2654435761) % (1 << 32) / 256) * 256).alias("network"), (F.lit(8) + k % 12).cast("int").alias("masklen"))
    return netjoin.crossing(rows)


@query("""
WITH x AS (SELECT o_orderkey, o_orderkey % 5 AS six, o_orderkey % 7 AS m4, o_orderkey % 3 AS m6, CAST(o_orderkey % 4 AS INTEGER) AS v, CAST(o_custkey % 4 AS INTEGER) AS w FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN six > 2 THEN 'can_ipv6' END, CASE WHEN v = 1 THEN 'can_tcp' END, CASE WHEN w = 1 THEN 'can_tcp6' END, CASE WHEN m4 = 1 OR m6 = 2 THEN 'does_ecs' END, CASE WHEN v = 1 THEN 'does_flagday' END,
  CASE w WHEN 1 THEN 'does_qnamemin' WHEN 2 THEN 'doesnt_qnamemin' END, CASE v WHEN 1 THEN 'does_nxdomain' WHEN 2 THEN 'doesnt_nxdomain' END, CASE w WHEN 1 THEN 'has_ta_19036' WHEN 2 THEN 'hasnt_ta_19036' END, CASE v WHEN 1 THEN 'has_ta_20326' WHEN 2 THEN 'hasnt_ta_20326' END, """
  + ", ".join(f"CASE {'v' if k % 2 else 'w'} WHEN 1 THEN 'can_{p}' WHEN 2 THEN 'cannot_{p}' WHEN 3 THEN 'broken_{p}' END" for k, p in enumerate(x.split("_", 1)[1] for x in S.PAIRS))
  + """, CASE w WHEN 1 THEN 'is_internal' WHEN 2 THEN 'is_forwarding' WHEN 3 THEN 'is_external' END) AS held
FROM x""")
def capability_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 24 capabilities of raw states; an IPv6 address of zeros is none."""
    k, v, w = F.col("o_orderkey"), (F.col("o_orderkey") % 4).cast("int"), (F.col("o_custkey") % 4).cast("int")
    zero, some = F.unhex(F.lit("00" * 16)), F.unhex(F.lit("00" * 15 + "01"))
    rows = _table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 5 > 2, some).when(k % 5 > 0, zero).alias("whoami_6"), F.when(k % 7 == 1, 24).otherwise(0).alias("ecs_mask"), F.when(k % 3 == 2, 56).otherwise(0).alias("ecs_mask6"),
        v.alias("tcp_ipv4"), w.alias("tcp_ipv6"), v.alias("does_flagday"), w.alias("qnamemin"), v.alias("nxdomain"), w.alias("has_ta_19036"), v.alias("has_ta_20326"), w.alias("origin"),
        *[(v if n % 2 else w).alias(f"{p}_result") for n, p in enumerate(S.PAIRS)],
    )
    return rows.select("o_orderkey", F.array_join(cube.held_values(classify.capability_values(F.col("origin")), dict(S.CAPABILITIES)), ",").alias("held"))


@query("""
WITH c AS (SELECT event_type, user_id % 9 AS g, CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (value > 50) AS n FROM events GROUP BY ALL),
l AS (SELECT event_type, g, max(day) AS day FROM c GROUP BY ALL)
SELECT event_type, g, day, n, total, round(100.0 * n / total, 6) AS share FROM c JOIN l USING (event_type, g, day)""")
def latest_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 9).alias("g"), F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("n"))
    return series.latest_share(rows, ["event_type", "g"], "day", "n", "total").withColumn("share", F.round("share", 6))


@query("""
WITH v AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY ALL), t AS (SELECT CAST(ts AS DATE) AS day, count(*) AS total FROM events GROUP BY 1),
x AS (SELECT day, 'does_qnamemin' AS label, n FROM v WHERE event_type = 'click' UNION ALL SELECT day, 'doesnt_qnamemin', n FROM v WHERE event_type = 'view'),
u AS (SELECT * FROM x UNION ALL SELECT t.day, 'unknown', total - coalesce(s, 0) FROM t LEFT JOIN (SELECT day, sum(n) AS s FROM x GROUP BY day) USING (day)),
f AS (SELECT label, min(day) AS start FROM u WHERE n <> 0 GROUP BY label)
SELECT day, label, CAST(n AS BIGINT) AS n, round(100.0 * n / total, 6) AS share FROM u JOIN f USING (label) JOIN t USING (day) WHERE day >= start""")
def property_series_qnamemin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One property's daily series from the tables of a report."""
    days = _events(spark, sf_dir).select(F.to_date("ts").alias("day"), "event_type", F.lit("").alias("selection"))
    name = F.when(F.col("event_type") == "click", "does_qnamemin").when(F.col("event_type") == "view", "doesnt_qnamemin").when(F.col("event_type") == "error", "does_flagday")
    values = days.withColumn("value", name).filter("value is not null").groupBy("day", "selection", "value").agg(F.count("*").alias("n"))
    base = days.groupBy("day", "selection").agg(F.count("*").alias("n_resolvers"))
    prop = next(p for p in series.PROPERTIES if p[0] == "qnamemin")
    return series.property_series(prop, base, values, None, None)


@F.arrow_udf(BinaryType())
def _compressed(ids):
    import pyarrow as pa

    out = []
    for n in ids.to_pylist():
        # The question at 12; the CNAME's owner points to it, its target ends in the question's last label; the address' owner points to that target.
        name = wire.write_name(f"host{n}.example")
        target = bytes([5]) + b"alias" + bytes([0xC0, 12 + 1 + len(f"host{n}")])
        head = wire.encode(f"host{n}.example", wire.A, counts=(2, 0, 0))
        at = len(head) + 12
        cname = bytes([0xC0, 12, 0, wire.CNAME, 0, 1, 0, 0, 0, 60, 0, len(target)]) + target
        a = bytes([0xC0 | at >> 8, at & 255, 0, wire.A, 0, 1, 0, 0, 0, 60, 0, 4, 10, n >> 16 & 255, n >> 8 & 255, n & 255])
        assert head[12 : 12 + len(name)] == name
        out.append(head + cname + a)
    return pa.array(out, pa.binary())


@query("""
SELECT event_id, 'host' || event_id || '.example.' AS qname, 'alias.example.' AS owner, '10.' || (event_id // 65536 % 256) || '.' || (event_id // 256 % 256) || '.' || (event_id % 256) AS answer FROM events""")
def wire_compressed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with pointers: to the question, into its labels, and to a name that ends in a pointer."""
    answer = F.try_element_at(F.col("m.answers"), F.lit(1))
    rows = _events(spark, sf_dir).select("event_id", wire.parse_dns(_compressed("event_id")).alias("m"))
    return rows.select("event_id", "m.qname", answer["name"].alias("owner"), addresses.v4_text(answer["rdata"]).alias("answer"))
