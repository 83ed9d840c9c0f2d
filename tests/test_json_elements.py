"""Documents cut by byte ranges against the json module."""

import json
import random

import pytest

from turnloom.sources import files
from turnloom.sources.json_elements import json_elements, outlines

TRICKY = ['"', "\\", "}", "{", "[", "]", ",", "\\\"", "\n", "é", "漢", "😀", " ", "a", '"}', "\\\\", "]}"]


def text(draw, n=12):
    return "".join(draw.choice(TRICKY) for _ in range(draw.randrange(n)))


def value(draw, deep=0):
    kind = draw.randrange(7 if deep < 3 else 4)
    if kind < 2:
        return text(draw)
    if kind < 4:
        return draw.choice([None, True, 1, -2.5, 10**12])
    if kind == 4:
        return [value(draw, deep + 1) for _ in range(draw.randrange(4))]
    return {text(draw): value(draw, deep + 1) for _ in range(draw.randrange(4))}


@pytest.fixture(params=[150, 2000])
def small_ranges(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(x) for x in names]
    spark.conf.set(names[0], str(request.param))
    spark.conf.set(names[1], "0")
    yield request.param
    for name, before in zip(names, old):
        spark.conf.set(name, before)


def dumped(draw, whole):
    return json.dumps(whole, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 1, 4]))


def test_random_arrays_are_cut_into_their_elements(spark, small_ranges, tmp_path):
    draw = random.Random(small_ranges)
    for i in range(2):
        whole = [{text(draw): value(draw), "n": k} for k in range(draw.choice([1, 5, 12]))]
        folder = tmp_path / f"case{i}"
        folder.mkdir()
        (folder / "one.json").write_text(draw.choice(["", "\n "]) + dumped(draw, whole) + draw.choice(["", "\n"]))
        elements, gaps = json_elements(spark, str(folder), 1)
        assert [json.loads(r["value"]) for r in elements.orderBy("element").collect()] == whole
        outline = json.loads(outlines(gaps).first()["outline"])
        assert outline == ([f"0:{len(whole)}"] if whole else [])


def test_elements_of_several_runs_keep_their_places(spark, small_ranges, tmp_path):
    draw = random.Random(small_ranges + 1)
    whole = {"x": text(draw), "parts": [{"name": str(k), "a": [{"v": value(draw)} for _ in range(k)], "b": []} for k in (3, 0, 4)]}
    path = tmp_path / "runs.json"
    path.write_text(dumped(draw, whole))
    elements, gaps = json_elements(spark, str(path), 4)
    found = [json.loads(r["value"]) for r in elements.orderBy("element").collect()]
    assert found == [x for p in whole["parts"] for x in p["a"]]
    outline = json.loads(outlines(gaps).first()["outline"])
    assert [p["a"] for p in outline["parts"]] == [["0:3"], [], ["3:7"]] and outline["x"] == whole["x"]


def test_an_element_longer_than_many_ranges(spark, small_ranges, tmp_path):
    whole = [{"t": "x}" * 90, "q": [{"deep": "\\\""}] * 9}, {"t": "short"}]
    path = tmp_path / "long.json"
    path.write_text(json.dumps(whole))
    elements, _ = json_elements(spark, str(path), 1)
    assert [json.loads(r["value"]) for r in elements.orderBy("element").collect()] == whole


@pytest.mark.parametrize("bad", [
    '[{"a":1} {"a":2}]', '[{"a":1},,{"a":2}]', '[{"a":1},]', '[{"a":1}', '{"a":1}]', '[{"a":"1}]', '[{"a":1}] x', '[{"a":1}][]'])
def test_broken_documents_fail(spark, tmp_path, bad):
    path = tmp_path / "bad.json"
    path.write_text(bad)
    with pytest.raises(Exception):
        files.read_episodes(spark, str(path)).collect()


@pytest.mark.parametrize("other", ['{"title":"x","lines":[]}', "[1,2]", "[[]]", '"text"'])
def test_only_arrays_of_objects_hold_episodes(spark, tmp_path, other):
    path = tmp_path / "other.json"
    path.write_text(other)
    with pytest.raises(Exception):
        files.read_episodes(spark, str(path)).collect()


def test_episodes_of_files_go_on_from_each_other(spark, small_ranges, tmp_path):
    draw, wanted = random.Random(3), []
    for name, n in (("a", 3), ("b", 0), ("c", 5)):
        whole = [{"title": f"{name}{k}", "url": text(draw), "lines": [
            {"speaker": text(draw), "text": text(draw, 40), "scene": 0} for _ in range(draw.randrange(6))]} for k in range(n)]
        (tmp_path / f"{name}.json").write_text(dumped(draw, whole))
        wanted += whole
    found = files.read_episodes(spark, str(tmp_path)).orderBy("episode_id").collect()
    assert [r["episode_id"] for r in found] == list(range(8))
    assert [{"title": r["title"], "url": r["url"], "lines": [x.asDict() for x in r["lines"]]} for r in found] == wanted
    with pytest.raises(Exception):
        (tmp_path / "d.json").write_text('[{"title": 1 "x"}]')
        files.read_episodes(spark, str(tmp_path)).collect()


def test_many_tasks_read_one_document(spark, small_ranges, tmp_path):
    whole = [{"title": str(i), "url": "u", "lines": []} for i in range(60)]
    path = tmp_path / "many.json"
    path.write_text(json.dumps(whole))
    pieces = spark.read.text(str(path), lineSep="}")
    assert pieces.rdd.getNumPartitions() >= path.stat().st_size // max(small_ranges, 1 + path.stat().st_size // 4)
    assert files.read_episodes(spark, str(path)).count() == 60
