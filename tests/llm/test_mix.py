"""The mix's blocks against what is said to be taken; lines removed in bulk."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from qualitylab.llm import lines, mixing

SCHEMA = "doc_id long, text string, source string, shard string"


def test_taken_is_what_stands_in_the_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 32)
    chance = random.Random(2)
    rows = [(i, " ".join(f"w{chance.randrange(9)}" for _ in range(chance.choice([0, 5, 90, 700]))), chance.choice("abc"), "x") for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    blocks = mixing.mixed_blocks(docs).collect()
    taken = Counter()
    for b in blocks:
        taken[b.doc_id] += b.words
        assert 0 <= b.skip and b.skip + b.words <= len(rows[b.doc_id][1].split())
    assert {r.doc_id: r.taken for r in mixing.mixed_sources(docs).collect()} == {i: taken[i] for i, *_ in rows}
    full = Counter((b.shard, b.slot) for b in blocks)
    assert all(sum(b.words for b in blocks if (b.shard, b.slot) == at) <= mixing.BLOCK for at in list(full)[:20])
    shards = {b.shard for b in blocks}
    assert shards == set(range(len(shards))) and len(shards) > 3
    counts = mixing.shard_counts(mixing.drawn(mixing.written(mixing.targets(mixing.written(mixing.streams(docs, "doc_id", "source", "text"), "s")), "t")))
    sizes = counts.groupBy("shard").agg(F.sum("slots").alias("n")).collect()
    assert all(r.n == 32 for r in sizes if r.shard < max(shards))
    assert len({(r.shard, r.slots) for r in counts.where("source_ = '=a'").collect()}) == len(shards)


def test_many_removed_lines_of_one_text_are_cheap(spark):
    bad = [f"boilerplate {i}" for i in range(30_000)]
    good = [f"own {i}" for i in range(30_000)]
    rows = [(s, "\n".join(bad), f"site{s}", "x") for s in range(lines.MIN_SITES)]
    rows.append((99, "\n".join(x for pair in zip(bad, good) for x in pair), "site0", "x"))
    start = time.time()
    got = {r.doc_id: r for r in lines.without_boilerplate(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert time.time() - start < 60
    assert got[99].kept == "\n".join(good) and got[99].n_removed == 30_000 and got[0].kept == ""


def test_lines_at_the_ends_and_none(spark):
    both = [(s, "bad\nkeep %d\n\nbad" % s, f"site{s}", "x") for s in range(lines.MIN_SITES)]
    rows = [*both, both[0], both[0], (50, "", "a", "x"), (51, None, "a", "x"), (52, "bad", None, "x"), (None, "one\nbad\nbad\n two ", "b", "x")]
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in lines.without_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect())
    want = Counter((s, 4, 2, f"keep {s}\n") for s in range(lines.MIN_SITES))
    want[(0, 4, 2, "keep 0\n")] += 2
    want.update([(50, 1, 0, ""), (51, 0, 0, None), (52, 1, 1, ""), (None, 4, 2, "one\n two ")])
    assert got == want
    assert lines.without_boilerplate(spark.createDataFrame([], SCHEMA)).isEmpty()
