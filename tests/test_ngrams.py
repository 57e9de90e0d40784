"""Vocabularies and weights against counting every n-gram in plain Python."""

from collections import Counter
from math import log, sqrt

import numpy as np
import pytest

from qualitylab.operators import ngrams, tfidf

STOPS = ["the"]


def grams_of(text, low, high):
    words = [w for w in (text or "").split() if len(w) >= 2 and w not in STOPS]
    return [" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


@pytest.fixture(scope="module")
def texts():
    chance = np.random.default_rng(3)
    words = np.array(["the", "x", *[chr(97 + i // 26) + chr(97 + i % 26) for i in range(400)]])
    share = 1 / np.arange(1, len(words) + 1) ** 0.7
    drawn = [" ".join(chance.choice(words, 60, p=share / share.sum())) for _ in range(500)]
    return [*drawn, drawn[0], None, "", "the x", "zz"]


def best(texts, settings):
    df, total = Counter(), Counter()
    for text in texts:
        own = grams_of(text, *settings.ngram_range)
        total.update(own)
        df.update(set(own))
    usable = [t for t in total if settings.min_df <= df[t] <= settings.max_df * len(texts)]
    kept = sorted(usable, key=lambda t: (-total[t], t))[: settings.max_features]
    return {t: (i, df[t], total[t], log((1 + len(texts)) / (1 + df[t])) + 1) for i, t in enumerate(sorted(kept))}, len(total)


@pytest.mark.parametrize("taken", [20_000, 3])
@pytest.mark.parametrize("sizes, places, max_df", [((1, 3), 50, 0.5), ((2, 2), 20, 1.0), ((1, 1), 1000, 0.9)])
def test_vocabulary_equals_counting_all(spark, texts, monkeypatch, taken, sizes, places, max_df):
    monkeypatch.setattr(ngrams, "LEAST_TAKEN", taken)
    monkeypatch.setattr(ngrams, "FIRST_TAKEN", 1)
    settings = tfidf.TfIdf(ngram_range=sizes, max_features=places, min_df=2, max_df=max_df, stop_words=STOPS)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, response string").repartition(5)
    got = {r["term"]: (r["index"], r["df"], r["total_tf"], pytest.approx(r["idf"])) for r in settings.fit(rows, "response").collect()}
    assert got == best(texts, settings)[0]


def test_weights_equal_counting(spark, texts):
    settings = tfidf.TfIdf(ngram_range=(1, 3), max_features=80, min_df=2, stop_words=STOPS)
    data = [*enumerate(texts), (7, texts[9]), (None, "zz zz")]  # one key twice, one null
    rows = spark.createDataFrame(data, "id long, response string").repartition(5)
    chosen, _ = best([t for _, t in data], settings)
    want = {}
    for key in {k for k, _ in data}:
        entries = [(t, (1 + log(n)) * chosen[t][3]) for k, text in data if k == key
                   for t, n in Counter(grams_of(text, 1, 3)).items() if t in chosen]
        length = sqrt(sum(w * w for _, w in entries))
        want |= {(key, t, chosen[t][0], round(w / length, 9)): 1 for t, w in entries}
    got = settings.transform(rows, "response", settings.fit(rows, "response")).collect()
    assert {(r["id"], r["term"], r["index"], round(r["weight"], 9)): 1 for r in got} == want


def test_rare_ngrams_are_not_shuffled(spark, texts, monkeypatch):
    monkeypatch.setattr(ngrams, "LEAST_TAKEN", 1000)
    settings = tfidf.TfIdf(ngram_range=(1, 3), max_features=50, stop_words=STOPS)
    rows = spark.createDataFrame([(t,) for t in texts], "cleaned string")
    counts = ngrams.leading(rows, (1, 3), STOPS, lambda df: df, 50)
    _, distinct = best(texts, settings)
    assert distinct > 40_000 > 5_000 > counts.count()


def test_no_term_at_all(spark):
    settings = tfidf.TfIdf(max_features=10, min_df=2)
    rows = spark.createDataFrame([(1, "one"), (2, None)], "id long, response string")
    vocabulary = settings.fit(rows, "response")
    assert vocabulary.count() == 0 and settings.transform(rows, "response", vocabulary).count() == 0
