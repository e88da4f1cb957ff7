import datetime as dt
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from probelake.functions import classify
from probelake.functions import schema as S
from probelake.operators import cube, history, ranking, series, state
from probelake.plans import chain
from probelake.sources import readers, sinks
from tests.test_state import START, frame, observations

@pytest.fixture
def tiny(spark):
    """The tables are tiny and the plans many and wide: one partition, nothing compiled."""
    quick = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k) for k in quick}
    for k, v in quick.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


NAMES = {"a": ["a1"], "b": ["b1", "b2"], "c": ["c1", "c2", "c3"]}


def test_registry(spark):
    assert len(S.CAPABILITIES) == 24 and len(S.VALUES) == 58
    columns = sinks.report_columns()
    assert len(columns) == 965 and len(set(columns)) == 965
    assert len(sinks.timeline_columns()) == 67


def test_cube_equals_brute_force(spark):
    rnd = random.Random(12)
    rows = [(rnd.randint(1, 9), n, rnd.randint(0, 1), rnd.randint(0, 2), rnd.randint(0, 3)) for n in range(80)]
    df = spark.createDataFrame(rows, "prb long, r long, a int, b int, c int")
    held = cube.held_values({k: F.col(k) for k in NAMES}, NAMES)
    own = {r[1]: [NAMES[k][v - 1] for k, v in zip(NAMES, r[2:], strict=True) if v] for r in rows}
    members = defaultdict(list)
    for r in rows:
        for d in range(3):
            for s in itertools.combinations(own[r[1]], d):
                members["/".join(s)].append(r)
    got = {r.selection: (r.n_resolvers, r.n_probes) for r in cube.cube(df, held, "prb", 2).collect()}
    assert got == {s: (len(m), len({r[0] for r in m})) for s, m in members.items()}
    flags = defaultdict(set)
    for r in rows:
        flags[r[0]] |= set(own[r[1]])
    want = {}
    for s, m in members.items():
        n, p = Counter(v for r in m for v in own[r[1]]), Counter(v for q in {r[0] for r in m} for v in flags[q])
        want |= {(s, v): (n[v], p[v]) for v in n.keys() | p.keys()}
    assert {(r.selection, r.value): (r.n, r.n_prbs) for r in cube.value_counts(df, held, "prb", 2).collect()} == want


def test_probe_flags_look_beyond_the_selection(spark):
    """Probe 1 has one resolver with tcp and another with ecs: in the selection of tcp it still counts for ecs."""
    df = spark.createDataFrame([(1, 1, 0), (1, 0, 1)], "prb long, tcp int, ecs int")
    held = cube.held_values({"tcp": F.col("tcp"), "ecs": F.col("ecs")}, {"tcp": ["can_tcp"], "ecs": ["does_ecs"]})
    r = cube.value_counts(df, held, "prb", 1).filter("selection = 'can_tcp' and value = 'does_ecs'").first()
    assert (r.n, r.n_prbs) == (0, 1)


def test_classifier_table(spark):
    table = [(1, -1, 0, 1, -1, -1, 1), (-1, 2, 9, -1, 2, -1, 1), (1, -1, 5, 5, -1, -1, 3), (1, -1, 1, 7, -1, -1, 2), (1, -1, 5, 7, 0, -1, 2), (1, -1, 5, -1, 0, -1, 0)]
    cols = ["x4", "x6", "y", "g", "a", "six"]
    df = spark.createDataFrame(table, "x4 int, x6 int, y int, g int, a int, six int, want int")
    assert all(r.got == r.want for r in df.select("want", classify.origin_class(*map(F.col, cols)).alias("got")).collect())


def test_bands(spark):
    counts = [(1, n, 50) for n in range(21)] + [(1, 100, 40), (1, 101, 40), (1, 102, 7)] + [(2, 1000 + n, 500 - n) for n in range(102)]
    got = ranking.bands(spark.createDataFrame(counts, "g int, asn long, n long"), ["g"]).collect()
    one = {r.band: (r.label, r.total) for r in got if r.g == 1}
    assert one == {1: ("in 21 ASNs (50)", 1050), 2: ("AS100,AS101", 80), 3: ("AS102", 7)}
    two = {r.band: (r.label, r["count"], r.total) for r in got if r.g == 2}
    assert len(two) == 101 and two[100] == ("AS1099", 401, 401) and two[None] == ("Remaining", None, 400 + 399)


def test_series(spark):
    bands = spark.createDataFrame([("d1", "AS1,AS2", 11), ("d1", "AS-1", 99), ("d2", "AS2", 4), ("d2", "in 30 ASNs (1)", 30), ("d2", "Remaining", 5)], "day string, label string, total long")
    got = {(r.day, r.asn): r.n for r in series.top_of_series(bands, "day", "label", "total", 1).collect()}
    assert got == {("d1", "AS2"): 5, ("d1", "Remaining"): 105, ("d2", "AS2"): 4, ("d2", "Remaining"): 35}
    days = spark.sql("SELECT explode(sequence(date'2018-01-01', date'2018-12-31')) AS day")
    assert series.month_starts(days, "day").count() == 12 and series.month_starts(days.limit(100), "day").count() == 100
    long = spark.createDataFrame([("d1", "p", 0, 10), ("d2", "p", 3, 10), ("d3", "p", 4, 8), ("d1", "q", 0, 1)], "day string, prop string, n long, total long")
    assert [(r.day, r.n) for r in series.trim(long, ["prop"], "day", "n").orderBy("day").collect()] == [("d2", 3), ("d3", 4)]
    assert {r.prop: r.share for r in series.latest_share(long, ["prop"], "day", "n", "total").collect()} == {"p": 50.0, "q": 0.0}


def test_rewrite_history(spark):
    day = dt.datetime(2018, 8, 16)
    rows = [(day, 1, "r", ["10.0.0.2", "10.0.0.1"]), (day.replace(day=18), 1, "r", ["10.0.0.1"]), (day, 2, "s", ["10.9.9.9"]), (day, 3, "t", [])]
    asns = spark.createDataFrame([("10.0.0.1", 5), ("10.0.0.2", 5), ("10.9.9.9", 0)], "ip string, asn int")
    out = history.rewrites(spark.createDataFrame(rows, "dt timestamp, prb_id long, resolver string, hijacked array<string>"), asns)
    assert [(r.prb_id, r.resolver, r.asn, r.dt.day) for r in out["by_probe"].collect()] == [(1, "r", 5, 18)]
    assert {(r.ip, r.dt.day) for r in out["ips_by_asn"].collect()} == {("10.0.0.1", 18), ("10.0.0.2", 16)}
    kept = history.fold(out["ips_by_asn"], out["ips_by_asn"].limit(0), ["asn", "ip"], F.lit("2018-08-27"))
    assert [r.ip for r in kept.collect()] == ["10.0.0.1"]


def test_json_cases(spark, tmp_path):
    objects = """[{"resultset":[{"time":1534377600,"dst_addr":"192.0.2.1","x":{"y":[1,{"z":2}]},"error":{"timeout":5000},"result":{"rt":1.5,"abuf":"AAEC"}},
      {"dst_name":"2001:db8::1","error":{"timeout":5000}},{"dst_name":"host.example","result":{"abuf":"AAEC"}},{"dst_addr":"192.0.2.9"},{"dst_addr":"192.0.2.3","result":{"rt":-1,"abuf":"AA"}}],"prb_id":7},
      {"resultset":[{"dst_addr":"192.0.2.1","result":{"abuf":"AAEC"}}]}]"""
    (tmp_path / "a.json").write_text(objects)
    (tmp_path / "b.json").write_text('[{"prb_id": 9, "resultset": [{"dst_addr"')
    good, bad = readers.read_measurements(spark, str(tmp_path / "*.json"), 8311777, "2018-08-16")
    rows = {bytes(r.addr)[-4:] if bytes(r.addr)[:12] == b"\0" * 10 + b"\xff\xff" else bytes(r.addr): r for r in good.filter("prb_id = 7").collect()}
    assert set(rows) == {b"\xc0\0\2\1", b"\xc0\0\2\3", bytes.fromhex("20010db8000000000000000000000001")}
    first = rows[b"\xc0\0\2\1"]
    assert (bytes(first.msg), first.is_error, first.rt, first.time) == (b"\0\1\2", False, 1.5, dt.datetime(2018, 8, 16))
    error = rows[bytes.fromhex("20010db8000000000000000000000001")]
    assert error.is_error and bytes(error.msg) == b'{"timeout":5000}' and rows[b"\xc0\0\2\3"].rt is None
    assert len(bad.collect()) == 1 and good.filter("prb_id is null").count() == 0


def test_days_end_to_end(spark, tmp_path, tiny):
    rnd = random.Random(13)
    days = [dt.date(2018, 8, 16), dt.date(2018, 8, 17)]
    stored, states, logs = (str(tmp_path / x) for x in ("observations", "snapshots", "timelines"))
    for n, day in enumerate(days):
        rows = [(r[0], day, *r[2:]) for r in observations(rnd, 150, START + 86_400 * n)]
        sinks.write_observations(frame(spark, rows), stored)
    assert chain.next_day(spark, states, days[0]) == days[0]
    for day in days:
        chain.run_day(spark, day, stored, states, logs)
        chain.run_day(spark, day, stored, states, logs)  # again: the same tables
    assert chain.next_day(spark, states) == dt.date(2018, 8, 18)
    snapshot = spark.read.parquet(states).filter(F.col("day") == F.lit(days[1])).drop("day")
    whole, _ = state.day_state(readers.read_observations(spark, stored))
    assert sorted(map(str, snapshot.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    timeline = readers.read_timeline(spark, f"{logs}/day=2018-08-17")
    assert timeline.count() > 0 and timeline.filter("dt is null or prb_id is null").count() == 0

    four = spark.createDataFrame([(0xC0000200, 24, 64500), (0x91611400, 24, 3333)], "network long, masklen int, asn int")
    six = spark.createDataFrame([(b"\0" * 16, 0, 6)], "network binary, masklen int, asn int")
    probes = spark.createDataFrame([(1, 64500, -1), (2, 3333, 64500)], "prb_id long, asn_v4 int, asn_v6 int")
    tables = chain.report(snapshot, days[1], probes, four, six)
    base = {r.selection: r for r in tables["base"].collect()}
    assert base[""].n_resolvers == 6 and base[""].n_probes == 3
    totals = {(r.dim, r.selection): 0 for r in tables["bands"].collect()}
    for r in tables["bands"].collect():
        totals[(r.dim, r.selection)] += r.total
    assert all(n == base[s].n_resolvers for (d, s), n in totals.items() if d != "nxhj")
    wide = sinks.wide_report(tables["base"], tables["values"], tables["masks"], tables["bands"]).filter("selection = ''").collect()
    assert len(wide) == 1 and len(wide[0]) == 965 + 2
    enriched = [r.asDict() for r in tables["enriched"].collect()]
    tables_values = {(r.selection, r.value): r.n_prbs for r in tables["values"].collect()}
    flags = defaultdict(set)
    for r in enriched:
        flags[r["prb_id"]] |= set(r["held_values"])
    for dim, columns in (("auth", ("auth_g", "auth_a", "auth_6")),):
        own, members = chain.dimension_reports(tables["enriched"], dim, days[1])
        own = {(r.asn, r.selection): r for r in own.collect()}
        assert own and all(len(r) == 965 + 3 for r in own.values())
        for (asn, selection), r in own.items():
            mine = [e for e in enriched if asn in [e[c] for c in columns] and (not selection or selection in e["held_values"])]
            assert (r["# resolvers"], r["# probes"]) == (len(mine), len({e["prb_id"] for e in mine}))
            assert int(r["can_tcp"]) == sum("can_tcp" in e["held_values"] for e in mine) and int(r["can_tcp_prbs"]) == sum("can_tcp" in flags[p] for p in {e["prb_id"] for e in mine})
        assert members.count() == sum(r["# resolvers"] for r in own.values())
    for r in chain.probe_reports(tables["enriched"], days[1]).collect():
        mine = [e for e in enriched if e["prb_id"] == r.item]
        assert (r["# resolvers"], r["# probes"], int(r["can_ipv6"]), int(r["can_ipv6_prbs"])) == (len(mine), 0, sum("can_ipv6" in e["held_values"] for e in mine), 0)
    assert tables_values


def test_reports_end_to_end(spark, tmp_path, tiny):
    """Days one by one with reports and histories; a repeated day changes nothing."""
    rnd = random.Random(17)
    day = dt.date(2018, 8, 16)
    stored, states, logs, out = (str(tmp_path / x) for x in ("observations", "snapshots", "timelines", "reports"))
    sinks.write_observations(frame(spark, [(r[0], day, *r[2:]) for r in observations(rnd, 200, START)]), stored)
    four = spark.createDataFrame([(0, 1, 8), (0xC0000200, 24, 64500), (0x91611400, 24, 3333), (1 << 31, 1, 9)], "network long, masklen int, asn int")
    six = spark.createDataFrame([(b"\0" * 16, 0, 6)], "network binary, masklen int, asn int")
    probes = spark.createDataFrame([(1, 64500, -1), (2, 3333, 64500)], "prb_id long, asn_v4 int, asn_v6 int")
    chain.run_day(spark, day, stored, states, logs)
    for _ in range(2):  # again: the same tables
        chain.run_report(spark, day, states, out, probes, four, six, depth=0, by=("res",))
        chain.run_history(spark, day, logs, f"{out}/histories", four)
    rows = {n: spark.read.parquet(f"{out}/{n}") for n in ("base", "values", "bands", "members", "probes", "dimensions", "dimension_members")}
    assert rows["members"].count() == rows["base"].filter("selection = ''").first().n_resolvers == rows["probes"].agg(F.sum("`# resolvers`")).first()[0]
    assert all(r.count() for r in rows.values()) and rows["base"].count() == 1
    wide = readers.read_report(spark, f"{out}/report")
    assert wide.filter("selection is null or selection = ''").count() == 1 and len(wide.columns) == 965 + 2 and dict(wide.dtypes)["can_tcp"] == "bigint"
    base = spark.read.parquet(f"{out}/base")
    masks = "day date, selection string, family string, rank int, mask string, n long"
    tables = [spark.read.schema(masks).parquet(f"{out}/{n}") if n == "masks" else spark.read.parquet(f"{out}/{n}") for n in ("base", "values", "masks", "bands")]
    root = {r.day: r.n_resolvers for r in base.filter("selection = ''").collect()}
    assert set(root) == {day}
    assert len(series.PROPERTIES) == 26 and len({p[0] for p in series.PROPERTIES}) == 26
    for prop in (series.PROPERTIES[0], series.PROPERTIES[1], series.PROPERTIES[6]):
        rows = series.property_series(prop, *tables).collect()
        sums = Counter()
        for r in rows:
            sums[r.day] += r.n
            assert r.share == round(100 * r.n / root[r.day], 6)
        if prop[1] == "bands" or prop[0] in ("int_ext", "ipv6"):
            assert sums == Counter(root), prop
