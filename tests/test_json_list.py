"""Large JSON lists by byte ranges, against reading them whole."""

import json

import pytest

from framewright.sources.frames import FRAME_SCHEMA, scan_frame_infos
from framewright.sources.json_list import compose, read_json_lists, scan_piece, write_json_lists

SCHEMA = "n long, text string, deep array<struct<a:string>>"
ODD = ['a "quoted" } brace', "back\\slash } \\\\", "[{]}", "é ü 日本 }{", "", "\\\\\" } \n line", "}" * 30, '"', "\\"]


@pytest.fixture
def small_ranges(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    for k, v in keep.items():
        spark.conf.set(k, v)


def _records(n, start=0):
    return [{"n": start + k, "text": ODD[k % len(ODD)] * (1 + k % 7 * (k % 11 == 0) * 40), "deep": [{"a": ODD[(k + j) % len(ODD)]} for j in range(k % 4)]} for k in range(n)]


def _plain(rows):
    return [(r["n"], r["text"], [d["a"] for d in r["deep"]]) for r in rows]


@pytest.mark.parametrize("n, size", [(9, 37), (60, 900), (60, 1 << 20)])
def test_every_range_size_gives_the_same(spark, tmp_path, small_ranges, n, size):
    first, second = _records(n), _records(n // 2, n)
    (tmp_path / "a.json").write_text(json.dumps(first, ensure_ascii=False, indent=2) + "\n")
    (tmp_path / "b.json").write_text(json.dumps(second))
    (tmp_path / "c.json").write_text(" [ ]\n")
    (tmp_path / "d.json").write_text(json.dumps(_records(1, n + n // 2)))
    small_ranges(size)
    schema = spark.createDataFrame([], SCHEMA).schema
    got = read_json_lists(spark, str(tmp_path), schema).collect()
    assert sorted(r["position"] for r in got) == list(range(n + n // 2 + 1))
    assert _plain(sorted(got, key=lambda r: r["position"])) == _plain(first + second + _records(1, n + n // 2))
    if size < 1000:
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 5


def test_lists_written_by_tasks_come_back_in_order(spark, tmp_path, small_ranges):
    rows = spark.createDataFrame(_records(100), SCHEMA).repartitionByRange(3, "n").sortWithinPartitions("n")
    write_json_lists(rows, str(tmp_path / "lists"))
    write_json_lists(rows.where("false").coalesce(1), str(tmp_path / "none"))
    small_ranges(2500)
    got = read_json_lists(spark, str(tmp_path / "lists"), rows.schema).collect()
    assert [r["n"] for r in sorted(got, key=lambda r: r["position"])] == list(range(100))
    assert read_json_lists(spark, str(tmp_path / "none"), rows.schema).count() == 0


@pytest.mark.parametrize("text", ['[{"n": 1}', '{"n": 1}', '[{"n": 1}] []', '[{"n": 1} {"n": 2}]', '[[{"n": 1}], {"n": 2}]', '[{"n": 1}, 7]', "7", '["}"]', '[{"n": "x}]'])
def test_what_is_no_list_of_records_fails(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="not one JSON list|no record"):
        scan_frame_infos(spark, str(tmp_path)).collect()


def test_a_record_that_does_not_fit_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"token": "a"}, {"timestamp": "x"}]')
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        scan_frame_infos(spark, str(tmp_path), schema=FRAME_SCHEMA).collect()


def test_maps_of_ranges_compose():
    text = json.dumps(_records(40))
    pieces = [p + "}" for p in text.split("}")]
    state, depth = False, 0
    for p in pieces:
        state, change = scan_piece(state, p)
        depth += change
    assert (state, depth) == (False, -1)
    maps, truth, state, depth = [], {}, False, 0
    for start in range(0, len(pieces), 7):
        truth["f", start], ends = (state, depth), []
        for inside in (False, True):
            now, sums = inside, 0
            for p in pieces[start : start + 7]:
                now, change = scan_piece(now, p)
                sums += change
            ends += [int(now), sums]
            if inside == truth["f", start][0]:
                state, depth = now, truth["f", start][1] + sums
        maps.append(("f", start, *ends))
    assert compose(maps[::-1]) == truth and any(inside for inside, _ in truth.values())
