"""Shards of awkward tables: null, common and repeated ids; the map's versions."""

import zlib

from qualitylab.llm import sharding

SCHEMA = "doc_id long, text string, key string, row string"


def loads(rows, shards=8):
    out = [0] * shards
    for r in rows:
        out[r.shard] += r.size
    return out


def even(got, shards=8):
    held = loads(got, shards)
    assert max(held) - min(held) <= 0.02 * sum(held) / shards + max(r.size for r in got)
    for shard in range(shards):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_null_common_and_repeated_ids_spread(spark):
    same = "x" * 60
    rows = [(None, f"text {i} " + "y" * (i % 50), "a", "b") for i in range(4000)]
    rows += [(7, f"other {i}", "a", "b") for i in range(3000)]
    rows += [(9, same, "a", "b")] * 3000 + [(None, same, "a", "b")] * 500 + [(None, None, "a", "b")] * 3000
    got = sharding.sharded(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    even(got)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)


def test_versions_of_the_map_are_kept_and_edited(spark, tmp_path):
    docs = spark.createDataFrame([(i, "z" * (i % 97), "", "") for i in range(6000)], SCHEMA)
    path = str(tmp_path / "map")
    assert sharding.stored_map(spark, path) is None
    first = sharding.sharded(docs, 8, map_path=path).collect()
    one = sharding.stored_map(spark, path).collect()
    assert {r.version for r in one} == {1} and len(one) == sharding.SLOTS
    again = sharding.sharded(docs, 8, map_path=path).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in first}
    more = sharding.sharded(docs, 9, map_path=path).collect()
    held = loads(more, 9)  # slots leave a shard until it is within the slack, so the new one holds the rest
    assert max(held) <= (1 + sharding.SLACK) * sum(held) / 9 and min(held) >= (1 - 9 * sharding.SLACK) * sum(held) / 9
    two = sharding.stored_map(spark, path).collect()
    assert {r.version for r in two} == {2} and len(two) == sharding.SLOTS
    old = {r.vslot: r.shard for r in one}
    moved = [r for r in two if old[r.vslot] != r.shard]
    assert 0 < len(moved) < 0.25 * sharding.SLOTS
    assert spark.read.parquet(path).count() == 2 * sharding.SLOTS
