import ipaddress
import random
import struct

from pyspark.sql import functions as F

from probelake.functions import addresses, wire


def test_base64(spark):
    texts = ["aGVsbG8=", "aGVsbG8", "aG Vs\nbG8=", "", "YQ", "YWI", "YWJj", "YWJjZ", None]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(addresses.base64_bytes(F.col("t")).alias("v")).collect()]
    assert [None if g is None else bytes(g) for g in got] == [b"hello", b"hello", b"hello", b"", b"a", b"ab", b"abc", b"abc", None]


def test_addresses(spark):
    rnd = random.Random(3)
    texts = [str(ipaddress.IPv4Address(rnd.getrandbits(32))) for _ in range(20)]
    texts += [ipaddress.IPv6Address(rnd.getrandbits(128) & rnd.getrandbits(128) & -(1 << rnd.randrange(0, 120))).compressed for _ in range(40)]
    texts += ["::", "::1", "1::", "2001:db8::ff", "::ffff:192.0.2.7", "1:2:3:4:5:6:7:8", "fe80::1:0:0:1"]
    bad = ["", "x", "256.1.1.1", "1.2.3", "1:2", "1:2:3:4:5:6:7:8:9", ":::", "1::2::3", "g::", "1.2.3.4.5", "12345::", None]
    df = spark.createDataFrame([(t,) for t in texts + bad], "t string").withColumn("b", addresses.address_bytes(F.col("t"))).withColumn("back", addresses.address_text(F.col("b")))
    for r in df.collect():
        if r.t in bad or r.t is None:
            assert r.b is None, r.t
            continue
        ip = ipaddress.ip_address(r.t)
        want = ip.packed if ip.version == 6 else b"\0" * 10 + b"\xff\xff" + ip.packed
        assert bytes(r.b) == want, r.t
        mapped = ipaddress.IPv6Address(want).ipv4_mapped
        assert r.back == (str(mapped) if mapped else ipaddress.IPv6Address(want).compressed)


def test_trailing_number(spark):
    rows = spark.createDataFrame([("x 192.0.2.0/24",), ("/",), ("a/b7",), ("no",), ("9/8/56z",)], "t string")
    assert [r.v for r in rows.select(addresses.trailing_number(F.col("t")).alias("v")).collect()] == [24, 0, 0, 0, 56]


def test_compressed_names_and_cname_chain():
    # question www.Example. A at 12; the answers point back into it
    question = wire.write_name("www.Example") + struct.pack("!2H", 1, 1)
    head = struct.pack("!6H", 7, 0x8180, 1, 2, 0, 0)
    target_at = 12 + len(question) + 2 + 10
    cname = b"\xc0\x0c" + struct.pack("!2HIH", wire.CNAME, 1, 60, 6) + b"\x03cdn\xc0\x10"
    a = struct.pack("!H", 0xC000 | target_at) + struct.pack("!2HIH", wire.A, 1, 60, 4) + bytes([145, 97, 20, 17])
    m = wire.decode(head + question + cname + a)
    assert m["qname"] == "www.example." and [r["type"] for r in m["records"]] == [5, 1]
    assert m["records"][1]["name"] == "cdn.example." and [r["rdata"] for r in m["answers"]] == [bytes([145, 97, 20, 17])]


def test_damaged_messages():
    whole = wire.encode("a.example", wire.A, [("a.example", wire.A, b"\1\2\3\4")])
    for n in range(len(whole)):
        m = wire.decode(whole[:n])
        assert m is None if n < 12 else m["answers"] == []
    loop = struct.pack("!6H", 1, 0x8180, 1, 0, 0, 0) + b"\xc0\x0c" + b"\0\1\0\1"
    assert wire.decode(loop)["qname"] is None
    assert wire.decode(None) is None


def test_texts_sets_and_signatures(spark):
    data = b"\5NO ab\3abc"
    m = wire.decode(wire.encode("t.example", wire.TXT, [("T.example", wire.TXT, data), ("t.example", wire.RRSIG, struct.pack("!H", wire.TXT) + b"x")]))
    assert m["texts"] == [[b"NO ab", b"abc"]]
    assert list(wire.rrsets(m)) == [("t.example.", 1, wire.TXT)] and len(wire.signatures(m, "t.example.", 1, wire.TXT)) == 1
    assert wire.same_name("A.b", "a.B")
    row = spark.createDataFrame([(m_,) for m_ in (wire.encode("q.example", 1, [], rcode=3), b"short", None)], "msg binary").select(wire.rcode(F.col("msg")).alias("r"), wire.parse_dns("msg").alias("m")).collect()
    assert [(r.r, r.m and r.m.rcode) for r in row] == [(3, 3), (2, None), (None, None)] or row[0].r == 3 and row[1].m is None and row[2].m is None


def test_dots_within_labels():
    one, two = wire.write_name("a\\.b.example"), wire.write_name("a.b.example")
    assert one == b"\x03a.b\x07example\0" and two == b"\x01a\x01b\x07example\0"
    for raw in (one, two, b"\x02\\.\0", b"\x01\\\x01.\0", b"\0"):
        assert wire.write_name(wire.read_name(raw, 0)[0]) == raw
    # An answer whose owner is one label with a dot is not that of the question's two labels.
    answer = one + struct.pack("!2HIH", wire.A, 1, 60, 4) + bytes([145, 97, 20, 17])
    assert wire.decode(struct.pack("!6H", 1, 0x8180, 1, 1, 0, 0) + two + struct.pack("!2H", wire.A, 1) + answer)["answers"] == []


def test_a_name_with_cname_and_address():
    """The CNAME is followed first, unless it was asked for."""
    target = wire.write_name("b.example")
    records = [("a.example", 1, bytes(4)), ("a.example", 5, target), ("b.example", 1, b"\1\2\3\4")]
    assert [r["rdata"] for r in wire.decode(wire.encode("a.example", 1, records))["answers"]] == [b"\1\2\3\4"]
    assert [r["rdata"] for r in wire.decode(wire.encode("a.example", 5, records))["answers"]] == [target]


def test_an_address_of_zeros_is_none(spark):
    rows = spark.createDataFrame([(bytes(4),), (bytes(16),), (None,), (b"\0\0\0\1",), (bytes(15) + b"\1",), (bytes(10) + b"\xff\xff" + bytes(4),)], "a binary")
    got = [r.g and bytes(r.g) for r in rows.select(addresses.given(F.col("a")).alias("g")).collect()]
    assert got == [None, None, None, b"\0\0\0\1", bytes(15) + b"\1", bytes(10) + b"\xff\xff" + bytes(4)]
