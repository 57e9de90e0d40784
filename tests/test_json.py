"""Arrays of records, cut into many splits, against Python's own JSON reader."""

import json

import pytest

TEXTS = ["plain", 'a "quoted" word', "brace } in { text", "back\\slash\\", '\\"}', "", "ünï {", "line\nbreak }{", "[{]}", None]
RECORDS = [{"id": i, "text": TEXTS[i % len(TEXTS)], "more": {"n": i, "deep": {"t": TEXTS[(i * 7) % len(TEXTS)]}} if i % 3 else None}
           for i in range(120)]
SCHEMA = "id long, text string, more struct<n: long, deep: struct<t: string>>"


def rows(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: r["id"])


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "0"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key in keys:
        spark.conf.unset(key)


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"ensure_ascii": False}])
def test_arrays_in_small_splits(spark, tmp_path, small_splits, layout):
    from qualitylab.sources import readers

    for name, some in (("a", RECORDS[:50]), ("b", RECORDS[50:])):
        (tmp_path / f"{name}.json").write_text(json.dumps(some, **layout), encoding="utf-8")
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 40
    assert rows(readers.read_json(spark, str(tmp_path), SCHEMA)) == RECORDS


def test_other_layouts(spark, tmp_path):
    from qualitylab.sources import readers

    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in RECORDS[:9]))
    (tmp_path / "one.json").write_text(json.dumps(RECORDS[9]))
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "odd.json").write_text('[null, 3, "x}", ' + json.dumps(RECORDS[10]) + ", {}]")
    got = readers.read_json(spark, str(tmp_path), SCHEMA)
    assert rows(got.where("id is not null")) == RECORDS[:11]
    assert got.where("id is null").count() == 1


def test_missing_numbers(spark, tmp_path):
    from qualitylab.sources import readers

    (tmp_path / "t.csv").write_text("id,score\n1,2.5\n2,NaN\n3,\n")
    got = readers.read_csv(spark, str(tmp_path), "id int, score double").orderBy("id").collect()
    assert [r["score"] for r in got] == [2.5, None, None]
