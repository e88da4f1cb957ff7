"""Fetching against a local HTTP server: failures by measurement, restarts, cut answers."""

import datetime as dt
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from probelake.sources import fetch

DAY = dt.date(2018, 8, 16)
START = 1_534_377_600


@pytest.fixture
def server():
    """404 for ids in ``bad``, a cut answer for those in ``cut``; counts what was asked for."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            msm, start = map(int, self.path.strip("/").split("/")[:2])
            server.asked[msm, (start - START) // 86_400] += 1
            if msm in server.bad:
                self.send_error(404)
                return
            body = json.dumps([{"prb_id": k, "at": start, "s": "}{\\", **server.more} for k in range(3)], indent=1).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body[:-20] if msm in server.cut else body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.asked, server.bad, server.cut, server.more = Counter(), set(), set(), {}
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def url(server):
    return f"http://127.0.0.1:{server.server_port}/{{msm_id}}/{{start}}/{{stop}}"


def test_one_failure_stops_no_other_and_restarts_fetch_what_is_missing(spark, tmp_path, server):
    raw, statuses, check = (str(tmp_path / x) for x in ("raw", "statuses", "check"))
    ids, server.bad, server.cut = [1, 2, 3], {2}, {3}
    follow = lambda until: fetch.follow(spark, url(server), raw, statuses, check, ids, DAY, until).awaitTermination(120)
    follow(DAY + dt.timedelta(1))
    got = sorted((r.msm_id, str(r.day), r.status) for r in spark.read.parquet(statuses).collect())
    assert got == [(1, "2018-08-16", 200), (2, "2018-08-16", 404), (3, "2018-08-16", fetch.BROKEN)]
    rows = spark.read.parquet(raw).collect()
    assert [json.loads(r.object) for r in sorted(rows, key=lambda r: r.object)] == [{"prb_id": k, "at": START, "s": "}{\\"} for k in range(3)] and {r.msm_id for r in rows} == {1}
    follow(DAY + dt.timedelta(2))  # only the new day
    assert {k: n for k, n in server.asked.items() if k[1] == 0} == {(1, 0): 1, (2, 0): 1, (3, 0): 1} and server.asked[1, 1] == 1
    server.bad, server.cut = set(), set()
    assert fetch.fetch_missing(spark, url(server), raw, statuses, ids, DAY, DAY + dt.timedelta(2)) == 4
    assert server.asked[1, 0] == server.asked[1, 1] == 1 and server.asked[2, 0] == server.asked[3, 1] == 2
    assert fetch.fetch_missing(spark, url(server), raw, statuses, ids, DAY, DAY + dt.timedelta(2)) == 0
    assert spark.read.parquet(raw).groupBy("msm_id", "day").count().filter("count = 3").count() == 6


def test_nothing_at_all_is_an_error(spark, tmp_path, server):
    raw, statuses, check = (str(tmp_path / x) for x in ("raw", "statuses", "check"))
    server.bad = {1, 2}
    with pytest.raises(Exception, match="NothingFetched"):
        fetch.follow(spark, url(server), raw, statuses, check, [1, 2], DAY, DAY + dt.timedelta(1)).awaitTermination(120)
    server.bad = {2}  # the same load is fetched again
    fetch.follow(spark, url(server), raw, statuses, check, [1, 2], DAY, DAY + dt.timedelta(1)).awaitTermination(120)
    assert spark.read.parquet(raw).count() == 3


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_objects_of_any_chunk(size):
    want = [{"a": "}é{\\\"", "b": {"c": k}} for k in range(5)]
    data = json.dumps(want, ensure_ascii=False).encode()
    got = list(fetch.objects(iter([data[i : i + size] for i in range(0, len(data), size)])))
    assert [json.loads(t.lstrip(" ,[")) for t in got] == want
    assert list(fetch.objects(iter([b"[]"]))) == [] and list(fetch.objects(iter([]))) == []


def test_days_from_the_server_to_observations(spark, tmp_path, server):
    from probelake.plans import cli

    server.more, server.bad = {"resultset": [{"time": START + 5, "dst_addr": "192.0.2.1", "error": {"timeout": 1}}] * 2}, {2}
    args = [str(tmp_path / x) for x in ("raw", "statuses", "check", "observations", "quarantine")]
    assert cli.fetch_days(spark, [1, 2], DAY, DAY + dt.timedelta(2), url(server), *args) == 2
    rows = spark.read.parquet(args[3]).collect()
    assert sorted((r.msm_id, r.day, r.prb_id, r.seq) for r in rows) == [(1, DAY + dt.timedelta(d), k, (k << 24) + n) for d in range(2) for k in range(3) for n in range(2)]
    server.bad = set()
    assert cli.fetch_days(spark, [1, 2], DAY, DAY + dt.timedelta(2), url(server), *args) == 0
    assert spark.read.parquet(args[3]).count() == 24 and server.asked[1, 0] == 1
