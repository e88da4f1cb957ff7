import bz2
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from probelake.functions import addresses
from probelake.operators import netjoin
from probelake.sources import readers

RND = random.Random(11)


def random_prefixes(n, bits=32):
    out = {}
    for _ in range(n):
        masklen = RND.randint(2, 20)
        base = RND.choice([0x0A000000, 0xC0000000, 0x80000000, RND.getrandbits(32)]) << (bits - 32) if bits > 32 else RND.choice([0x0A000000, 0xC0000000, RND.getrandbits(32)])
        number = (base ^ RND.getrandbits(bits - 6)) >> (bits - masklen) << (bits - masklen)
        out[(number, masklen)] = RND.randint(1, 6)
    return out


def longest(prefixes, ip, bits=32):
    best = max((m for m in range(bits + 1) if (ip >> (bits - m) << (bits - m), m) in prefixes), default=None)
    return 0 if best is None else prefixes[(ip >> (bits - best) << (bits - best), best)]


def test_lpm_overlay_and_ranges(spark):
    prefixes = random_prefixes(120)
    table = spark.createDataFrame([(n, m, a) for (n, m), a in prefixes.items()], "network long, masklen int, asn int")
    ips = sorted({RND.getrandbits(32) for _ in range(300)} | {n for n, _ in prefixes} | {n + (1 << (32 - m)) - 1 for n, m in prefixes} | {min(n + (1 << (32 - m)), 2**32 - 1) for n, m in prefixes})
    addresses = spark.createDataFrame([(i,) for i in ips], "ip long")
    want = {i: longest(prefixes, i) for i in ips}
    assert {r.ip: r.asn for r in netjoin.lpm_v4(addresses, table).collect()} == want
    ranges = netjoin.flatten_v4(table).orderBy("from").collect()
    assert all(a.till <= b["from"] for a, b in zip(ranges, ranges[1:]))
    assert not any(a.till == b["from"] and a.asn == b.asn for a, b in zip(ranges, ranges[1:]))
    assert {i: next((r.asn for r in ranges if r["from"] <= i < r.till), 0) for i in ips} == want
    flat = spark.createDataFrame(ranges)
    assert {r.ip: r.asn for r in netjoin.range_lookup(addresses, flat).collect()} == want
    assert netjoin.lpm_v4(addresses, table.limit(0)).filter("asn <> 0").count() == 0


def test_lpm_v6(spark):
    prefixes = {(int(ipaddress.ip_network(p).network_address), ipaddress.ip_network(p).prefixlen): a for p, a in [("2001:db8::/32", 1), ("2001:db8:1::/48", 2), ("2001:db8:1:2::/96", 3), ("::/0", 9)]}
    table = spark.createDataFrame([(n.to_bytes(16, "big"), m, a) for (n, m), a in prefixes.items()], "network binary, masklen int, asn int")
    ips = [int(ipaddress.ip_address(x)) for x in ("2001:db8::1", "2001:db8:1::1", "2001:db8:1:2::9", "fe80::1", "::")]
    got = {int.from_bytes(r.ip, "big"): r.asn for r in netjoin.lpm_v6(spark.createDataFrame([(i.to_bytes(16, "big"),) for i in ips], "ip binary"), table).collect()}
    assert got == {i: longest(prefixes, i, 128) for i in ips}


def test_prefix_table_and_single_lookup(spark):
    rows = [("192.0.2.0", 24, "64500_64501"), ("192.0.2.128", 25, "64502"), ("2001:db8::", 32, "64503,64504"), ("::ffff:10.0.0.0", 104, "7"), ("192.0.2.0", 24, "64505"), ("bad", 8, "1"), ("10.1.0.0", 16, "x")]
    four, six = readers.prefixes(spark.createDataFrame(rows, "prefix string, masklen int, asn string"))
    look = lambda ip: netjoin.lookup_address(spark, four, six, ip)
    assert [look(x) for x in ("192.0.2.1", "192.0.2.200", "10.9.9.9", "::ffff:10.0.0.1", "2001:db8::5", "2001:db9::")] == [64505, 64502, 7, 7, 64503, 0]


def test_last_of_equal_prefixes_in_order(spark):
    table = spark.createDataFrame([(0, 8, 5, 1), (0, 8, 3, 2)], "network long, masklen int, asn int, nth int")
    assert netjoin.lpm_v4(spark.createDataFrame([(7,)], "ip long"), table, order="nth").first().asn == 3


def test_dimension_readers(spark, tmp_path):
    archive = json.dumps({"meta": {"n": 5}, "objects": [{"id": 1, "asn_v4": 3333, "country_code": "NL", "tags": [1]}, {"id": 2}, {"id": 3, "latitude": 1.5, "longitude": 2.5}, {"id": 4, "asn_v4": 0, "asn_v6": None, "latitude": 0, "country_code": ""}, {"id": 5, "asn_v6": 7, "asn_v4": 0}]}, indent=1)
    (tmp_path / "probes.json").write_text(archive)
    (tmp_path / "probes.json.bz2").write_bytes(bz2.compress(archive.encode()))
    for name in ("probes.json", "probes.json.bz2"):
        assert [(r.prb_id, r.asn_v4, r.asn_v6) for r in readers.read_probes(spark, str(tmp_path / name)).orderBy("prb_id").collect()] == [(1, 3333, -1), (3, -1, -1), (5, -1, 7)]
    (tmp_path / "none.json").write_text('{"objects": []}')
    with pytest.raises(ValueError, match="no probes"):
        readers.read_probes(spark, str(tmp_path / "none.json"))
    page = "<html><pre>AS1 LVLT-1 - Level 3<br />\nAS64500   TEST  - A  long name <br/>AS2 ONLY<br />junk</pre></html>"
    assert [tuple(r) for r in readers.asn_names(spark.createDataFrame([(page,)], "html string"), "html").collect()] == [("AS1", "LVLT-1", "Level 3"), ("AS64500", "TEST", "A long name"), ("AS2", "ONLY", "")]


def test_last_line_of_equal_prefixes_and_newest_file(spark, tmp_path):
    (tmp_path / "pfx").write_text("192.0.2.0\t24\t9\n192.0.2.0\t24\t5\n10.0.0.0\t8\t1\n2001:db8::\t32\t8\n2001:db8::\t32\t4\n")
    four, six = readers.read_prefixes(spark, str(tmp_path / "pfx"))
    look = lambda ip: netjoin.lookup_address(spark, four, six, ip)
    assert [look(x) for x in ("192.0.2.1", "10.1.1.1", "2001:db8::5")] == [5, 1, 4]
    (tmp_path / "log").write_text("# Format: serial time path\n1\t15\t2018/08/a.gz\n2\t16\t2018/08/b.pfx2as.gz\n\n")
    assert readers.newest_prefix_file(spark.read.text(str(tmp_path / "log"))).first().file == "2018/08/b.pfx2as.gz"


def test_masks_and_ends_of_v6(spark):
    rows = [(RND.getrandbits(128) & RND.choice([2**128 - 1, 2**64 - 1, 2**128 - 2**64]), m) for m in [*range(129), 0, 64, 65, 128]] + [(2**128 - 1, m) for m in (0, 1, 64, 65, 127, 128)]
    df = spark.createDataFrame([(n.to_bytes(16, "big"), m) for n, m in rows], "a binary, m int").withColumn("n", addresses.network_v6(F.col("a"), F.col("m")))
    for r, (n, m) in zip(df.withColumn("end", addresses.after_v6(F.col("n"), F.col("m"))).collect(), rows, strict=True):
        net = n >> (128 - m) << (128 - m)
        assert int.from_bytes(r.n, "big") == net and len(r.n) == 16, (n, m)
        end = net + (1 << (128 - m))
        assert (None if r.end is None else int.from_bytes(r.end, "big")) == (end if end < 2**128 else None), (n, m)


def test_overlay_of_v6(spark):
    nets = ["2001:db8::/32", "2001:db8:1::/48", "2001:db8:1::/64", "2001:db8:8000::/33", "2001::/16", "2002::/16", "2003::/16", "fe80::/10", "ffff::/16", "::/3"]
    prefixes = {(int(ipaddress.ip_network(p).network_address), ipaddress.ip_network(p).prefixlen): 1 + i % 4 for i, p in enumerate(nets)}
    table = spark.createDataFrame([(n.to_bytes(16, "big"), m, a) for (n, m), a in prefixes.items()], "network binary, masklen int, asn int")
    number = lambda b: 2**128 if b is None else int.from_bytes(b, "big")
    ranges = sorted((number(r["from"]), number(r.till), r.asn) for r in netjoin.flatten_v6(table).collect())
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:])) and not any(a[1] == b[0] and a[2] == b[2] for a, b in zip(ranges, ranges[1:]))
    points = {p + d for n, m in prefixes for p in (n, n + (1 << (128 - m))) for d in (-1, 0, 1) if 0 <= p + d < 2**128} | {RND.getrandbits(128) for _ in range(50)}
    for p in points:
        assert next((a for f, t, a in ranges if f <= p < t), 0) == longest(prefixes, p, 128)


def test_enrich_equals_plain_lookups(spark):
    prefixes = random_prefixes(60)
    four = spark.createDataFrame([(n, m, a) for (n, m), a in prefixes.items()], "network long, masklen int, asn int")
    six = spark.createDataFrame([(bytes.fromhex("20010db8" + "00" * 12), 32, 77)], "network binary, masklen int, asn int")
    mapped = lambda n: b"\0" * 10 + b"\xff\xff" + n.to_bytes(4, "big")
    v6 = [bytes.fromhex("20010db8" + "11" * 12), bytes.fromhex("fe80" + "00" * 14)]
    ip4 = lambda: RND.choice([n for n, _ in prefixes] + [RND.getrandbits(32)])
    rows = []
    for k in range(120):
        g, a, h = (RND.choice([None, ip4()]) for _ in range(3))
        s, r = RND.choice([None, v6[0], v6[1], mapped(ip4())]), RND.choice([mapped(8), mapped(ip4()), v6[0], v6[1]])
        four_ = lambda n: None if n is None else n.to_bytes(4, "big")
        rows.append((k % 7, r, four_(g), four_(a), s, [four_(h)] if h is not None else [], k))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    snapshot = spark.createDataFrame(rows, "prb_id long, addr binary, whoami_g binary, whoami_a binary, whoami_6 binary, hijacked array<binary>, k int")
    probes = spark.createDataFrame([(1, 5, -1), (2, -1, 6)], "prb_id long, asn_v4 int, asn_v6 int")

    def asn(ip, none):
        if ip is None or none == -1 and not any(ip):  # an address of zeros stands for none; a resolver's own is looked up
            return none
        ip = ip if len(ip) == 16 else mapped(int.from_bytes(ip, "big"))
        return longest(prefixes, int.from_bytes(ip[12:], "big")) if ip[:12] == mapped(0)[:12] else 77 if ip == v6[0] else 0

    plan = netjoin.enrich(snapshot, probes, four, six)
    want = {r[6]: (asn(r[2], -1), asn(r[3], -1), asn(r[4], -1), asn(r[1], 0), asn(r[5][0] if r[5] else None, -1), {1: 5}.get(r[0], -1), {2: 6}.get(r[0], -1)) for r in rows}
    assert {r.k: (r.auth_g, r.auth_a, r.auth_6, r.res, r.nxhj, r.prb_4, r.prb_6) for r in plan.collect()} == want
    assert plan.count() == len(rows)


def test_crossing_prefixes_are_kept_apart(spark):
    """Ranges in any order over several /8 blocks: those that nest are flattened, those that cross an earlier one come back."""
    rnd = random.Random(19)
    rows = sorted({(rnd.randrange(0, 1 << 32, 1 << 20), rnd.choice([6, 8, 9, 12])) for _ in range(60)} | {(0, 6), (0, 12), (1 << 26, 6)})
    rows = [(n, m, k) for k, (n, m) in enumerate(rows) if n + (1 << 32 - m) <= 1 << 32]
    end = lambda r: r[0] + (1 << 32 - r[1])
    want, open_end = set(), 0
    for r in sorted(rows, key=lambda r: (r[0], -end(r))):
        if r[0] < open_end < end(r):
            want.add((*r, open_end))
        open_end = max(open_end, end(r))
    good, bad = netjoin.nested(spark.createDataFrame(rows, "network long, masklen int, asn int").repartition(5))
    assert {(r.network, r.masklen, r.asn, r.crossed) for r in bad.collect()} == want and want
    kept = {(r.network, r.masklen) for r in good.collect()}
    assert kept == {(r[0], r[1]) for r in rows} - {(r[0], r[1]) for r in want}


@pytest.mark.parametrize("size", [0, 1 << 30])
def test_lookups_in_a_table_of_any_size(spark, size, monkeypatch):
    """The same matches if the table may not be broadcast; then long prefixes are found without expanding addresses."""
    monkeypatch.setattr(netjoin, "BROADCAST_BYTES", size)
    rnd = random.Random(31)
    four = {}
    for _ in range(300):
        m = rnd.choice([0, 1, 8, 15, 16, 17, 24, 31, 32])
        four[(rnd.choice([0, 0x0A0A0000, 0xFFFF0000]) | rnd.getrandbits(16) | rnd.choice([0, rnd.getrandbits(32)])) >> 32 - m << 32 - m, m] = rnd.randint(1, 50)
    ips = [0, (1 << 32) - 1, *[n + rnd.choice([0, -1, (1 << 32 - m) - 1, 1 << 32 - m]) for n, m in four], *[rnd.getrandbits(32) for _ in range(50)]]
    ips = [x for x in ips if 0 <= x < 1 << 32]
    got = netjoin.lpm_v4(spark.createDataFrame([(x,) for x in ips], "ip long").repartition(3), spark.createDataFrame([(*k, a) for k, a in four.items()], "network long, masklen int, asn int"))
    assert {r.ip: r.asn for r in got.collect()} == {x: longest(four, x) for x in ips} and got.count() == len(set(ips))
    six = {}
    for _ in range(200):
        m = rnd.choice([0, 3, 16, 31, 32, 33, 48, 64, 65, 127, 128])
        x = (0x20010DB8 << 96 | rnd.choice([0, 1, 0xFFFF]) << 80 | rnd.getrandbits(80) * rnd.choice([0, 1])) if rnd.random() < 0.8 else rnd.getrandbits(128)
        six[x >> 128 - m << 128 - m, m] = rnd.randint(1, 50)
    ips = [0, (1 << 128) - 1, *[n + rnd.choice([0, -1, (1 << 128 - m) - 1, 1 << 128 - m]) for n, m in six]]
    ips = [x for x in ips if 0 <= x < 1 << 128]
    best = lambda x: max(((m, a) for (n, m), a in six.items() if x >> 128 - m << 128 - m == n), default=(0, 0))[1]
    pack = lambda x: x.to_bytes(16, "big")
    got = netjoin.lpm_v6(spark.createDataFrame([(pack(x),) for x in ips], "ip binary").repartition(3), spark.createDataFrame([(pack(n), m, a) for (n, m), a in six.items()], "network binary, masklen int, asn int"))
    assert {bytes(r.ip): r.asn for r in got.collect()} == {pack(x): best(x) for x in ips}
    one = netjoin.lpm_v4(spark.createDataFrame([(5,)], "ip long"), spark.createDataFrame([(0, 24, 7), (1 << 16, 16, 8)], "network long, masklen int, asn int"))
    assert ("Window" in one._jdf.queryExecution().executedPlan().toString()) == (size == 0) and one.first().asn == 7
