"""Splits, folds, balancing, augmentation, encoding, joins and sources."""

import json

import pytest
from pyspark.sql import functions as F

from qualitylab.functions import augment, fixed, scores
from qualitylab.operators import augmenting, encoding, joins, sampling
from qualitylab.sources import readers, writers

TEXT = "We can improve help for people in the community. They need a good method! It works"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(500).select("id", (F.col("id") % 97).cast("double").alias("composite_score"))


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


@pytest.mark.parametrize("split", [sampling.stratified_split, sampling.random_split, sampling.positional_split])
def test_splits_are_complete_disjoint_and_repeatable(rows, split):
    train, held = split(rows)
    again, _ = split(rows.repartition(9))
    assert ids(train) | ids(held) == set(range(500)) and not ids(train) & ids(held)
    assert ids(train) == ids(again)


def test_split_sizes(spark, rows):
    train, _ = sampling.stratified_split(rows)
    assert abs(train.count() - 400) <= 2
    assert ids(sampling.positional_split(rows)[0]) == set(range(400))
    constant = spark.range(50).withColumn("composite_score", F.lit(3.0))
    assert sampling.stratified_split(constant)[0].count() == 40


def test_folds(rows):
    sizes = {r["fold"]: r["count"] for r in sampling.with_folds(rows.where("id < 103"), 5).groupBy("fold").count().collect()}
    assert sizes == {0: 21, 1: 21, 2: 21, 3: 20, 4: 20}


def test_balance(spark):
    rows = spark.createDataFrame([(i, "a" if i else "b", TEXT) for i in range(20)], "id int, category string, response string")
    out = sampling.balance_categories(rows, min_samples=10)
    assert {r["category"]: r["count"] for r in out.groupBy("category").count().collect()} == {"a": 19, "b": 10}
    assert out.where("augmentation_strategy = 'category_balance'").count() == 9


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t) for i, t in enumerate([TEXT, "one two", "one", "", None, "good Problem method"])]
    return spark.createDataFrame(rows, "id int, response string")


def applied(texts, column):
    return {r["id"]: r["x"] for r in texts.select("id", column.alias("x")).collect()}


def test_synonyms(texts):
    got = applied(texts, augment.synonym_replacement(F.col("response"), F.col("id"), 2))
    changed = [(a, b) for a, b in zip(TEXT.split(), got[0].replace("young people", "youth").split()) if a != b]
    assert len(changed) == 2 and all(b in fixed.SYNONYMS[a.lower()] for a, b in changed)
    assert got[1] == "one two" and got[2] == "one" and got[3] == "" and got[4] is None
    assert len(got[5].split()) == 3 and got[5] != "good Problem method"


def test_deletion_swap_and_shuffle(texts):
    kept = applied(texts, augment.random_deletion(F.col("response"), F.col("id"), 0.5))
    assert 0 < len(kept[0].split()) < len(TEXT.split()) and kept[5] == "good Problem method"
    gone = applied(texts, augment.random_deletion(F.col("response"), F.col("id"), 1.0))
    assert gone[0] == "works"
    swapped = applied(texts, augment.random_swap(F.col("response"), F.col("id"), 1))
    assert sorted(swapped[0].split()) == sorted(TEXT.split()) and swapped[0] != TEXT
    assert swapped[1] == "two one" and swapped[2] == "one"
    mixed = applied(texts, augment.shuffle_sentences(F.col("response"), F.col("id")))
    assert sorted(mixed[0].split()) == sorted(TEXT.split()) and mixed[1] == "one two"
    assert applied(texts.repartition(5), augment.random_swap(F.col("response"), F.col("id"), 1)) == swapped


def test_paraphrase(spark):
    rows = spark.createDataFrame([("How can AI help? ",), ("Design a tool",), ("What",), ("Howling wind",)], "p string")
    got = [r[0] for r in rows.select(augment.prompt_paraphrase(F.col("p"), F.lit(1))).collect()]
    lead = "What are the best approaches to: "
    assert got == [lead + "Can AI help?", lead + "Design a tool?", lead + "What?", lead + "Howling wind?"]


def test_augmented_frame(spark, texts):
    scored = texts.withColumn("humanity_score", F.lit(4.99))
    out = augmenting.augment_dataframe(scored, copies=2, score_noise=0.5)
    assert out.count() == 18 and out.where("augmentation_strategy is null").count() == 6
    assert out.where("humanity_score > 5 or humanity_score < 1").count() == 0
    assert augmenting.augment_dataframe(scored, copies=9).count() == 24
    assert augmenting.augment_dataframe(scored, strategies=["unknown"], copies=1).count() == 6
    assert out.where("augmentation_strategy is null and humanity_score <> 4.99").count() == 0


def test_scores_and_filters(spark):
    rows = spark.createDataFrame([(1, 4.0, 2.0, 5.0, "a"), (2, None, 1.0, 1.0, None)],
                                 "id int, humanity_score double, performance_score double, helpfulness_score double, category string")
    got = [r["composite_score"] for r in scores.with_composite(rows).orderBy("id").collect()]
    assert got[0] == pytest.approx(3.9) and got[1] is None
    assert "composite_score" not in scores.with_composite(rows.drop("humanity_score")).columns
    same, other = scores.split_by_value(rows, "category", "a")
    assert same.count() == 1 and other.count() == 1
    assert rows.select(scores.clip(F.col("humanity_score") * 10)).collect()[1][0] is None
    nan = spark.createDataFrame([(float("nan"),)], "x double")
    assert scores.nan_to_null(nan).first()["x"] is None


def test_encoding(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, None)], "id int, k string")
    codes = encoding.label_codes(rows.where("id < 3"), "k")
    assert {r["id"]: r["k_encoded"] for r in encoding.with_label_code(rows, codes, "k").collect()} == {1: 1, 2: 0, 3: -1, 4: -1}
    scaled = encoding.standard_scale(spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "x double, c double"), ["x", "c"])
    assert [tuple(r) for r in scaled.orderBy("x").collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    vocabulary = {"ai": 1, "education": 2, "health": 3}
    got = spark.createDataFrame([("ai for health",)], "t string").select(encoding.encode_text(F.col("t"), vocabulary)).first()[0]
    assert got == [1, 0, 3]


def test_rules_and_labels(spark):
    rows = spark.createDataFrame([("x" * 5, "en", 2.0), (None, "xx", 0.5)], "text string, lang string, confidence double")
    rules = {"text": {"nullable": False, "max_length": 4}, "lang": {"allowed_values": ["en"]}, "confidence": {"range": [0, 1]}}
    assert {(r["column"], r["rule"]): r["violations"] for r in joins.check_rules(rows, rules).collect()} == {
        ("text", "not_null"): 1, ("text", "max_length"): 1, ("lang", "allowed_values"): 1, ("confidence", "range"): 1}
    labels = spark.createDataFrame([(1, 2.0)], "id int, safety_score double")
    merged = joins.merge_labels(spark.createDataFrame([(1,), (2,)], "id int"), labels)
    assert {r["id"]: r["safety_score"] for r in merged.collect()} == {1: 2.0, 2: None}


def test_strategies(spark):
    asked = spark.createDataFrame([("p1", "Why?")], "prompt_id string, prompt string")
    got = {r["strategy"]: r["full_prompt"] for r in joins.with_strategies(asked).collect()}
    assert len(got) == 5 and got["baseline"] == "Why?" and got["structured"].startswith("Why?\n\n")
    plan = joins.with_strategies(asked)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "p1", "input": "x"}, {"id": "p2", "input": "y\nz"}]))
    prompts = readers.read_json(spark, str(tmp_path / "a.json"), "prompts")
    assert prompts.count() == 2 and prompts.columns[-1] == "complexity"
    (tmp_path / "c.txt").write_text("ab\ncd e\n")
    assert tuple(readers.corpus_size(readers.read_corpus(spark, str(tmp_path / "c.txt"))).first()) == (2, 8)
    nasty = spark.createDataFrame([(1, 'say "hi",\nthen\\go')], "id int, t string")
    writers.write_csv(nasty, str(tmp_path / "out"))
    assert readers.read_csv(spark, str(tmp_path / "out"), "id int, t string", multiline=True).first()["t"] == 'say "hi",\nthen\\go'
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "missing.csv"), "labelled_text").count()


def test_each_swap_has_a_place_of_its_own(spark):
    """Three swaps of a long text move words at three places, not three times at one."""
    from qualitylab.functions import augment

    words = [f"w{i}" for i in range(400)]
    rows = spark.createDataFrame([(i, " ".join(words)) for i in range(20)], "id long, response string")
    moved = [sum(a != b for a, b in zip(r[0].split(), words)) for r in rows.select(augment.random_swap(F.col("response"), F.col("id"), 3)).collect()]
    assert all(m in (3, 4, 5, 6) for m in moved) and max(moved) == 6
