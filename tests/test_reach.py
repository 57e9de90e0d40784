"""Which cells a k-nearest search looks into: every one that matters, and few others."""

import numpy as np
import pytest

from qualitylab.operators import knn


def _cells(train, pivots, sample, around):
    pivot, sample = train[:pivots], train[:sample]
    cell = knn._distances(train, pivot).argmin(axis=1)
    held = np.unique(cell)
    radius = knn._distances(train, pivot)[np.arange(len(train)), cell]
    parts = [train[cell == c] for c in held]
    known = {
        "rows": np.array([len(p) for p in parts]), "pivot": pivot[held], "sample": sample,
        "inner": np.array([radius[cell == c].min() for c in held]), "outer": np.array([radius[cell == c].max() for c in held]),
        "low": np.array([p.min(axis=0) for p in parts]), "high": np.array([p.max(axis=0) for p in parts]),
        "around": np.argsort(knn._distances(pivot[held], sample), axis=1)[:, :around],
    }
    return known, np.searchsorted(held, cell)


@pytest.mark.parametrize("kind", ["plain", "far", "twice", "flat", "missing", "infinite", "few"])
def test_cells_of_all_nearest_rows_are_reached(kind):
    chance = np.random.default_rng(8)
    train, asked = chance.normal(size=(3000, 6)), chance.normal(size=(200, 6))
    if kind == "far":
        train, asked = train + 1e7, asked + 1e7
    if kind == "twice":
        train[1000:2000] = train[:1000]
        asked[:100] = train[:100]
    if kind == "flat":
        train[:, 3:] = asked[:, 3:] = 0
        train, asked = train.round(1), asked.round(1)
    if kind in ("missing", "infinite"):
        asked[7, 2] = np.nan if kind == "missing" else np.inf
    known, cell = _cells(train, 60, 600, 3 if kind == "few" else 40)
    hits = knn._reached(asked, known, 5)
    gaps = knn._distances(asked, train)
    at_most = np.sort(gaps, axis=1)[:, 4]
    for i in range(len(asked)):
        assert np.isnan(gaps[i]).any() or hits[i, cell[gaps[i] <= at_most[i]]].all()


def test_search_does_not_compare_all_with_all():
    """Numbers that hang together, as lengths and counts of a text do, with some that lie far off and make their cells wide."""
    chance = np.random.default_rng(3)
    rows = np.repeat(chance.normal(size=(20_000, 3)), 5, axis=1) + chance.normal(size=(20_000, 15)) / 50
    rows[::200] *= 6
    train, asked = rows[:18_000], rows[18_000:]
    known, _ = _cells(train, 256, 4096, knn.AROUND)
    share = {f.__name__: (f(asked, known, 5) * known["rows"]).sum() / len(train) / len(asked) for f in (knn._reached, knn._loose)}
    assert share["_reached"] < 0.1 and share["_reached"] < share["_loose"] / 4, share


def test_more_pivots_for_more_rows_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(knn, "ROWS_A_PIVOT", 4)
    chance = np.random.default_rng(5)
    train, asked = chance.normal(size=(900, 5)).round(2), chance.normal(size=(150, 5)).round(2)
    train[400:420] = train[0]
    asked[:3] = train[0]
    frame = lambda rows: spark.createDataFrame([(i, r.tolist(), float(i % 7)) for i, r in enumerate(rows)], "id long, features array<double>, y double")
    got = knn.nearest(frame(train), frame(asked).drop("y"), 5, block_rows=16).collect()
    gaps = knn._distances(asked, train)
    want = {(i, j): gaps[i, j] for i in range(len(asked)) for j in np.lexsort((np.arange(len(train)), gaps[i]))[:5]}
    assert {(r["id"], r["neighbour"]): r["distance"] for r in got} == want
