"""Arrays that are read in many blocks, against the json module."""

import json
import random

import pytest

from brisk.sources import alerts, json_arrays


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def value(rng, deep=0):
    kind = rng.randrange(7 if deep < 3 else 4)
    if kind == 0:
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "😀", " ", "\n", "a"]) for _ in range(rng.randrange(30)))
    if kind == 1:
        return rng.choice([1, -2.5, True, None])
    if kind in (2, 3):
        return "x" * rng.randrange(40)
    if kind == 4:
        return [value(rng, deep + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}{rng.choice(['', '}', '[', chr(34)])}": value(rng, deep + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_elements_of_arrays_in_blocks(spark, tmp_path, small_blocks, layout):
    rng = random.Random(len(layout))
    want = []
    for n in (0, 1, 40):
        rows = [{"i": i, "v": value(rng)} for i in range(n)]
        (tmp_path / f"{n}.json").write_text(("﻿" if n == 40 else "") + " \n" * n + json.dumps(rows, **layout) + "\n" * (n % 3), encoding="utf-8")
        want += [(f"{n}.json", i + 1, r) for i, r in enumerate(rows)]
    read = json_arrays.array_elements(spark, sorted(str(p) for p in tmp_path.glob("*.json")))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
    assert sorted(((r["file"].rsplit("/", 1)[-1], r["position"], json.loads(r["json"])) for r in read.collect()), key=repr) == sorted(want, key=repr)
    assert alerts.read_alerts(spark, str(tmp_path)).count() == 41


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": 1},', '[{"a": 1} {"b": 2}]', '[{"a": 1}, 5]', '[{"a": 1}, [2]]', '[{"a": "x}]', '[{"a": 1}] {"b": 2}', '[{"a": 1}]]', '[{"a": 1},, {"b": 1}]', '[{"a": 1}, {"b": ]', '[,{"a": 1}]'])
def test_what_is_no_array_of_objects_stops_the_read(spark, tmp_path, small_blocks, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="not a JSON object"):
        alerts.read_alerts(spark, str(tmp_path / "x.json")).collect()


def test_lines_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "x.json").write_text('﻿{"id": "1"}\n{"id": "2"}\n', encoding="utf-8")
    assert alerts.read_alerts(spark, str(tmp_path / "x.json")).count() == 2
