"""The splittable scan against a whole parse of the file, for every way to cut a file into splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from probelake.operators import state
from probelake.sources import json_scan, readers


def scanned(spark, path, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        return [(r.number, r.text) for r in json_scan.scan_objects(spark, str(path)).orderBy("number").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def objects(rnd, n):
    words = ["}", "{", '"', "\\", "},{", '\\"}', "[", "]", ",", "é日", "\n", "a b", '"}', "{\"x\":1}"]
    text = lambda: "".join(rnd.choices(words, k=rnd.randint(0, 6)))
    return [{"prb_id": k, "s": text(), text() or "k": {"in": [text(), {"d": {"e": text()}}]}, "z": [{}, {}], "resultset": []} for k in range(n)]


@pytest.mark.parametrize("split", [29, 400, 1 << 20])
def test_objects_of_any_split(spark, tmp_path, split):
    rnd = random.Random(split)
    for n, (layout, ascii_) in enumerate([({}, True), ({"indent": 1}, False), ({"separators": (",", ":")}, False)]):
        want = objects(rnd, 9)
        path = tmp_path / f"{n}.json"
        path.write_text(json.dumps(want, ensure_ascii=ascii_, **layout) + rnd.choice(["", "\n", "  \n"]))
        got = scanned(spark, path, split)
        assert [k for k, _ in got] == list(range(9)) and [json.loads(t) for _, t in got] == want


@pytest.mark.parametrize("split", [50, 1 << 20])
def test_cut_and_damaged_files(spark, tmp_path, split):
    want = objects(random.Random(3), 12)
    texts = [json.dumps(o) for o in want]
    whole = "[" + ",".join(texts) + "]"
    place = lambda k: 1 + sum(len(t) + 1 for t in texts[:k])
    cases = {"end of an object": (place(7) - 1, 7, None), "brace only": (place(7) + 1, 7, "{"), "before its end": (place(8) - 2, 7, texts[7][:-1]), "in it": (place(7) + 5, 7, texts[7][:5])}
    for name, (end, n, rest) in cases.items():
        path = tmp_path / f"{name}.json"
        path.write_text(whole[:end])
        got = scanned(spark, path, split)
        assert [json.loads(t) for _, t in got[:n]] == want[:n], name
        assert [t for _, t in got[n:]] == ([rest] if rest else []), name
    for name, text in (("empty", ""), ("none", "[]"), ("spaces", " [ \n ] ")):
        (tmp_path / f"{name}.json").write_text(text)
        assert scanned(spark, tmp_path / f"{name}.json", split) == []
    (tmp_path / "bare.json").write_text('[{"a": 1}, nonsense, {"b": } , {"c": 2}]')
    got = scanned(spark, tmp_path / "bare.json", split)
    assert [t for _, t in got] == ['{"a": 1}', 'nonsense, {"b": }', '{"c": 2}']


def test_what_never_ends_stays_in_parts(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"open": [' + '{"x": 1}, ' * 100 + "]")
    got = [(r.number, r.text) for r in json_scan.scan_objects(spark, str(tmp_path / "a.json"), 200).orderBy("number").collect()]
    assert got[0] == (0, '{"a": 1}') and len(got) > 3 and {n for n, _ in got[1:]} == {1}


def test_measurements_of_several_files(spark, tmp_path):
    attempt = lambda t, k: {"time": t, "dst_addr": f"192.0.2.{k}", "result": {"rt": 1.0, "abuf": "AAEC"}}
    rows = [{"prb_id": 1, "resultset": [attempt(100, 1), attempt(100, 1)]}, {"prb_id": 1, "resultset": [attempt(100, 1)]}, {"prb_id": 2, "resultset": [attempt(90, 2)]}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(rows)[:-60])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        good, bad = readers.read_measurements(spark, str(tmp_path / "*.json"), 8311777, "2018-08-16")
        got = sorted((r.prb_id, r.seq) for r in good.collect())
        held = bad.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(2 * [(1, 0), (1, 1), (1, 1 << 24)] + [(2, 2 << 24)])  # positions in the file: no two of a file are equal
    assert [(r.file.rsplit("/", 1)[1], r.number) for r in held] == [("b.json", 2)] and held[0].text.startswith('{"prb_id": 2')


def test_lines_that_are_no_objects_are_kept(spark):
    lines = spark.createDataFrame([(0, '{"prb_id": 1, "resultset": [{"dst_addr": "192.0.2.1", "error": {"timeout": 5}}]}'), (1, '{"prb_id": 2, "resul'), (2, None), (3, "{}")], "n long, line string")
    good, bad = readers.parse_lines(lines, "line", 8311777, "2018-08-16", "n")
    assert [(r.prb_id, r.seq) for r in good.collect()] == [(1, 0)]
    assert [(r.n, r.line) for r in bad.collect()] == [(1, '{"prb_id": 2, "resul')]


def test_equal_times_fold_the_same_way_however_rows_are_dealt(spark):
    """Two objects of one probe, address and second: the later one in the file stands."""
    from tests.test_state import CONTROL
    from probelake.functions import wire

    import base64

    line = lambda good: json.dumps({"prb_id": 1, "resultset": [{"time": 1_534_377_600, "dst_addr": "192.0.2.1", "result": {"rt": 1, "abuf": base64.b64encode(wire.encode("q.example", 1, [("q.example", 1, CONTROL if good else bytes(4))])).decode()}}]})
    lines = spark.createDataFrame([(n, line(n % 3 == 0)) for n in range(11)], "n long, line string")
    got = set()
    for parts in (1, 3, 7):
        good, _ = readers.parse_lines(lines.repartition(parts, F.rand(parts)), "line", 15283671, "2018-08-16", "n")
        got.add(state.day_state(good)[0].first().not_ta_20326)
    assert got == {2}
