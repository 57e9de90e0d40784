"""Operators on vectors against brute force: odd rows, ties, copies, repeated and null ids, empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qualitylab.llm import codes, nearest, negatives, queries, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, row_ string, code string, leaf int, rank string, vector string"
INF = float("inf")


@pytest.fixture(scope="module")
def table():
    """Random vectors of 8 components, a third of them copies of one, near copies, ties, and rows that take no part."""
    chance = random.Random(3)
    point = lambda: [chance.gauss(0, 0.3) for _ in range(8)]
    same = point()
    rows = [(i, same if i % 3 == 0 else point(), i % 4) for i in range(240)]
    rows += [(240 + i, [x + chance.gauss(0, 0.01) for x in same], 9) for i in range(20)]
    rows += [rows[100], rows[100], (None, point(), 1), (None, same, 2), (300, point(), None), (301, [4.0 * x for x in same], 3), (350, [0.0] * 8, 0)]
    odd = [None, [], [None, *same[1:]], [INF, *same[1:]], [-INF, *same[1:]], [math.nan, *same[1:]], same[:5]]
    return rows, [(400 + 50 * i, v, 1) for i, v in enumerate(odd)]


@pytest.fixture(scope="module")
def frame(spark, table):
    rows = [(*r, "x", "y", 1, "z", "w") for r in [*table[0], *table[1]]]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def last(i):
    """Sort key of an id: null comes last."""
    return (i is None, i or 0)


def plain_codes(rows, parts, entries, rounds):
    cut = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows]
    step = len(cut[0][1]) // parts
    first = sorted(cut, key=lambda r: (last(r[0]), r[1]))[:entries]
    books = [[r[1][p * step:(p + 1) * step] for r in first] for p in range(parts)]

    def assign(v, p):
        part = v[p * step:(p + 1) * step]
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        where = [[assign(v, p)[1] for p in range(parts)] for _, v, _ in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                members = [v[p * step:(p + 1) * step] for (_, v, _), w in zip(cut, where) if w[p] == e]
                if members:
                    books[p][e] = [sum(column) // len(members) for column in zip(*members)]
    out = [(i, [assign(v, p) for p in range(parts)], label) for i, v, label in cut]
    total = {}
    for _, found, label in out:
        total[label] = total.get(label, 0) + sum(d for d, _ in found)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), total[label], digest) for i, found, label in out]


@pytest.mark.parametrize("parts, entries, rounds", [(8, 16, 6), (2, 5, 3), (4, 256, 1)])
def test_codes_equal_plain_lloyd(frame, table, parts, entries, rounds):
    got = [tuple(r) for r in codes.compressed(frame, parts, entries, rounds).collect()]
    assert sorted(got, key=repr) == sorted(plain_codes(table[0], parts, entries, rounds), key=repr)


def test_codes_only_movers_are_shuffled(frame):
    base = vectors.numbered(frame.filter(vectors.finite(F.col("embedding")) & (F.size("embedding") == 8)).select(
        F.col("vec_id").alias("id_"), F.col("label").alias("label_"), vectors.scaled(F.col("embedding"), 4096).alias("vector")), "v")
    resident, _ = codes.trained(base, 8, 4, 8, 2)
    members = codes.settled(resident, 4)
    plan = members._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") <= plan.count("Union")  # the moved side alone
    assert members.filter("row_ IS NULL").isEmpty() and members.count() == base.count() * 4


def test_codes_of_empty_and_odd_tables(spark, empty, frame):
    assert codes.compressed(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.compressed(empty).isEmpty()
    assert codes.compressed(frame.filter("embedding IS NULL")).isEmpty()
    with pytest.raises(ValueError, match="divide"):
        codes.compressed(frame, parts=3)
    big = spark.createDataFrame([(1, [1e9] * 8, 1, "", "", 1, "", "")], SCHEMA)
    with pytest.raises(Exception, match="must be below"):
        codes.compressed(big).collect()
    one = codes.compressed(spark.createDataFrame([(7, [0.5] * 8, None, "", "", 1, "", "")], SCHEMA)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(7, "00" * 8, 0, 0)]


def plain_nearest(rows, k, every):
    """(query, rank, id, score) by exact search, as far as ties of different rows under one id allow."""
    use = [(i, np.array(v, float)) for i, v, _ in rows if any(v)]
    out = []
    for a, (i, q) in enumerate(use):
        if i is not None and i % every == 0:
            scores = [(float(q @ v) / math.sqrt(q @ q) / math.sqrt(v @ v), j) for b, (j, v) in enumerate(use) if b != a]
            best = sorted(scores, key=lambda s: (-round(s[0], 12), last(s[1])))[:k]
            out += [(i, r + 1, j, round(s, 9)) for r, (s, j) in enumerate(best)]
    return out


def test_neighbours_equal_exact_search_where_all_leaves_are_visited(frame, table):
    got = nearest.nearest_neighbours(frame, F.col("vec_id") % 50 == 0, target=1.01, leaf=10)
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got.collect()) == sorted(plain_nearest(table[0], 5, 50))


def test_neighbours_reach_the_calibrated_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = queries.op12_nearest_neighbours(spark, folder).collect()
    every = [(r.vec_id, r.embedding, 0) for r in rows.collect()]
    want = {(q, i) for q, _, i, _ in plain_nearest(every, 5, 50)}
    assert len(got) == len(want) and len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    exact = {i: np.array(v, float) for i, v, _ in every}
    for r in got:
        a, b = exact[r.query_id], exact[r.vec_id]
        assert r.score == pytest.approx(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b), abs=1e-12)


def test_tree_visits_every_leaf_once_and_the_nearest_first():
    chance = np.random.default_rng(2)
    x = nearest.unit(chance.normal(size=(900, 12)))
    tree = nearest.grown(x, leaf=20, branches=4)
    order = list(tree.best_bins_first(x[5]))
    assert sorted(order) == list(range(tree.leaves)) and order[0] == tree.leaf_of(x[5:6])[0]
    same = nearest.grown(np.repeat(x[:1], 500, axis=0), leaf=20)
    assert same.leaves == 1 and list(same.best_bins_first(x[1])) == [0]


def test_neighbours_of_empty_and_small_tables(spark, empty, frame):
    assert nearest.nearest_neighbours(empty, F.col("vec_id") % 50 == 0).isEmpty()
    assert nearest.nearest_neighbours(frame, F.lit(False)).isEmpty()
    two = spark.createDataFrame([(i, [float(i), 1.0], 1, "", "", 1, "", "") for i in (50, 51)], SCHEMA)
    got = nearest.nearest_neighbours(two, F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(50, 1, 51)]
    huge = spark.createDataFrame([(i, [1e300, 1e300 * i], 1, "", "", 1, "", "") for i in (0, 1, 2)], SCHEMA)
    assert [r.vec_id for r in nearest.nearest_neighbours(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def plain_negatives(rows, every):
    use = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if label is not None]
    out = []
    for a, (i, q, own) in enumerate(use):
        if i is None or i % every:
            continue
        scores = [(-sum(x * y for x, y in zip(q, v)), last(j), b, j, label) for b, (j, v, label) in enumerate(use) if b != a]
        scores.sort(key=lambda s: s[:2])
        for ps, _, _, p, _ in [s for s in scores if s[4] == own][:5]:
            far = [s for s in scores if s[4] != own and -30 * ps <= -100 * s[0] <= -90 * ps][:10]
            out += [(i, p, r + 1, s[3], -ps, -s[0]) for r, s in enumerate(far)]
    return out


def test_negatives_equal_exact_search(frame, table, monkeypatch):
    want = sorted(plain_negatives(table[0], 5), key=repr)
    whole = negatives.hard_negatives(frame, F.col("vec_id") % 5 == 0, F.col("label"))
    assert sorted((tuple(r) for r in whole.collect()), key=repr) == want
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 9)
    cut = negatives.hard_negatives(frame, F.col("vec_id") % 5 == 0, F.col("label"))
    assert sorted((tuple(r) for r in cut.collect()), key=repr) == want


def test_ranges_skip_rows_but_none_that_scores_enough():
    chance = np.random.default_rng(5)
    unit, _ = negatives.unit_vectors(chance.normal(size=(3000, 6)))
    lists, skipped = unit.argsort(axis=0, kind="stable").T, 0
    for cosine in (0.3, 0.8, 0.95, 1.0):
        for q in unit[:40]:
            kept = negatives.in_ranges(unit, lists, q, cosine)
            good = set(np.flatnonzero(unit @ q >= cosine + 1e-12))
            assert kept is None or good <= set(kept)
            skipped += 0 if kept is None else len(unit) - len(kept)
    assert skipped > 200_000


def test_large_components_are_multiplied_exactly():
    a = np.array([[float((1 << 24) + 1)] * 64])
    assert negatives.products(a, a)[0][0] == 64 * ((1 << 24) + 1) ** 2


def test_negatives_of_empty_tables(empty, frame):
    assert negatives.hard_negatives(empty, F.col("vec_id") % 5 == 0, F.col("label")).isEmpty()
    assert negatives.hard_negatives(frame, F.lit(None).cast("boolean"), F.col("label")).isEmpty()
    assert negatives.hard_negatives(frame, F.col("vec_id") % 5 == 0, F.lit(1)).isEmpty()
