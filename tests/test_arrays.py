"""JSON array files read by byte ranges: every split gives what reading the file at once gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from huntframe.sources import arrays
from huntframe.sources.lines import read_json_array, read_lines, read_windows


def arrays_and_others():
    rng = random.Random(6)
    odd = ['a,b', '"', "\\", '\\"', "]", "[{", "}],[", "é日本, ", "\\\\\",", "\u2028,\n", ""]

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.3:
            return {rng.choice(odd) + str(i): value(depth - 1) for i in range(rng.randint(0, 3))}
        if depth and kind < 0.5:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([1, -2.5, True, None, rng.choice(odd) * rng.randint(0, 4), "x" * rng.randint(0, 30)])

    sound = {f"s{i}.json": json.dumps([value(3) for _ in range(rng.randint(0, 9))], indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) for i in range(6)}
    sound |= {"blank.json": " [ \n ] ", "one.json": '[{"a": "' + "long, " * 60 + '"}]', "numbers.json": "[" + ",".join(["7"] * 150) + "]\n\n", "nested.json": "[[1,2],[3,[4]]]"}
    unsound = {"more.json": "[1,2] 3", "twice.json": "[1][2]", "comma.json": "[1,2,]", "behind.json": "[1,2],", "gap.json": "[1,,2]", "open.json": "[1,2", "mixed.json": '[1,{"a":2]}', "string.json": '[1,"a]', "word.json": "[1, abc]", "lines.json": '{"a":1}\n{"a":2}\n', "inner.json": '[1]\n{"a":2}', "empty.json": ""}
    return sound, unsound


@pytest.mark.parametrize(("block", "few"), [(120, 200_000), (150, 3), (1 << 20, 200_000)])
def test_arrays_by_byte_ranges(spark, tmp_path, block, few, monkeypatch):
    sound, unsound = arrays_and_others()
    for name, text in (sound | unsound).items():
        (tmp_path / name).write_text(text)
    monkeypatch.setattr(arrays, "FEW_BLOCKS", few)  # more are dealt by block in place of a broadcast
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {}
        for r in read_json_array(spark, str(tmp_path)).orderBy("seq").collect():
            got.setdefault(r.file.rsplit("/", 1)[1], []).append(r.value)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    plain = lambda v: v if isinstance(v, str) else None if v is None else json.dumps(v)
    assert set(got) == {name for name, text in sound.items() if json.loads(text)}
    for name, values in got.items():
        want = json.loads(sound[name])
        assert len(values) == len(want), name
        for value, w in zip(values, want):
            assert value == plain(w) or isinstance(w, (dict, list, float, bool)) and json.loads(value) == w, (name, value, w)


def test_windows_exports_are_arrays_or_lines(spark, tmp_path):
    sound, unsound = arrays_and_others()
    files = {"a b.json": "[1, 2]", **{n: unsound[n] for n in ("more.json", "lines.json", "inner.json", "comma.json")}, "z.json": '[{"q": 1},\n {"q": 2}]'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = read_windows(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.value for r in rows] == ["1", "2", "[1,2,]", "[1]", '{"a":2}', '{"a":1}', '{"a":2}', "[1,2] 3", '{"q":1}', '{"q":2}']
    assert len({r.seq for r in rows}) == len(rows) and all(r.modified for r in rows)
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "x.json").write_text("[1]")
    assert [r.value for r in read_windows(spark, str(tmp_path / "only")).collect()] == ["1"]
    assert read_lines(spark, str(tmp_path / "only")).columns == read_windows(spark, str(tmp_path / "only")).columns


def test_no_row_of_a_pass_holds_a_file(spark, tmp_path):
    n = 8_000
    (tmp_path / "big.json").write_text("[" + ",\n".join(json.dumps({"EventID": i, "text": "a, b " * 20}) for i in range(n)) + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60k")
    try:
        read = spark.read.option("lineSep", ",").text(str(tmp_path))
        assert read.rdd.getNumPartitions() > 10 and read.agg(F.max(F.length("value"))).first()[0] < 200
        got = read_json_array(spark, str(tmp_path))
        assert got.count() == n == got.select("seq").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
