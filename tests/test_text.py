import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from qualitylab.functions import features, fixed, text


def one(spark, value, build):
    row = spark.createDataFrame([(value,)], "t string").select(build(F.col("t")).alias("r")).first()
    return row["r"]


@pytest.mark.parametrize("raw,clean", [
    ("<b>Don't</b>  STOP, it's 5%!", "do not stop it is 5 !"),
    ("", ""),
    (None, ""),
    ("IT'S", "it's"),
    ("we'll they've I'm you're he'd", "we will they have i am you are he would"),
    ("café ½ … ﬁn ß", "cafe 12 ... fin"),
    ("a\x00b#c d", "a b c d"),
])
def test_clean(spark, raw, clean):
    assert one(spark, raw, text.clean) == clean


def test_clean_without_numbers(spark):
    assert one(spark, "abc 12 d3", lambda c: text.clean(c, remove_numbers=True)) == "abc d"


def test_folding_agrees_with_the_unicode_database(spark):
    single, _, longer = text._ascii_folding()
    chars = sorted(set(single + "".join(json.loads(longer)) + "ßæ中한\U0001f600́A~"))
    rows = spark.createDataFrame([(f"x{c}y{c}",) for c in chars], "t string").coalesce(4)
    for row in rows.select("t", text.fold_to_ascii(F.col("t")).alias("f")).collect():
        assert row["f"] == unicodedata.normalize("NFKD", row["t"]).encode("ascii", "ignore").decode(), row


def test_clean_output_alphabet(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bad = docs.select(text.clean(F.col("text")).alias("c")).where("c rlike '[^a-z0-9_ .!?\\']' or c rlike '  '")
    assert bad.count() == 0


def test_tokenize(spark):
    clean = "the ai system can improve x water access"
    assert one(spark, clean, text.tokenize) == ["improve", "water", "access"]
    assert one(spark, clean, lambda c: text.tokenize(c, extra_stop_words=["water"])) == ["improve", "access"]
    assert one(spark, "a bb", lambda c: text.tokenize(c, stop_words=[])) == ["bb"]
    assert len(fixed.GENERAL_STOP_WORDS) == len(set(fixed.GENERAL_STOP_WORDS))


def test_words_follow_python_white_space(spark):
    for raw in ["a b", "  a b\x1cc　d\n", "", " ", "a​b", None]:
        want = None if raw is None else raw.split()
        assert one(spark, raw, text.split_words) == want


def test_sentences_and_lists(spark):
    assert one(spark, "A b. C!  D", text.sentences) == ["A b.", "C!", "D"]
    assert one(spark, "a|b||", text.split_list) == ["a", "b", "", ""]
    assert one(spark, "Watér water fishing_net ok Tree", text.keyword_candidates) == ["water", "tree"]


@pytest.mark.parametrize("build,raw,want", [
    (features.sentence_count, "A. B! C.", 4), (features.sentence_count, None, 1), (features.sentence_count, "", 1),
    (features.paragraph_count, "a\n\nb", 2), (features.paragraph_count, "a\n\n\nb", 2), (features.paragraph_count, None, 1),
    (features.has_list, "1) x", 1), (features.has_list, "- x", 1), (features.has_list, "*", 1),
    (features.has_list, "plain", 0), (features.has_list, None, 0), (features.has_list, "-x", 0),
    (features.has_number, "a٣", 1), (features.has_number, None, 0),
    (features.unique_word_count, "The the THE cat", 2), (features.unique_word_count, None, 0),
    (features.char_length, "café", 4), (features.char_length, None, 0),
    (features.avg_word_length, "ab cdef", 3.0), (features.avg_word_length, "  ", 0.0), (features.avg_word_length, None, 0.0),
    (lambda c: features.mark_count(c, "?"), "a?? b?", 3), (lambda c: features.mark_count(c, ","), None, 0),
    (lambda c: text.contains_stem(c, fixed.MEDICAL_STEMS), "Early DIAGNOSTICS", 1),
    (lambda c: text.contains_stem(c, fixed.MEDICAL_STEMS), "unhealthy", 0),
    (lambda c: text.contains_stem(c, fixed.EMPATHY_STEMS), "caring people", 0),
    (lambda c: text.contains_stem(c, fixed.EMPATHY_STEMS), "careful", 1),
    (lambda c: text.contains_stem(c, fixed.EMPATHY_STEMS), None, 0),
])
def test_single_features(spark, build, raw, want):
    assert one(spark, raw, build) == want


def test_feature_frame(spark):
    rows = spark.createDataFrame([("why now?", "One two. Three!"), (None, None)], "prompt string, response string")
    out = [r.asDict() for r in features.with_text_features(rows).collect()]
    assert set(fixed.STRUCTURAL_FEATURES) <= set(out[0])
    assert out[0]["length_ratio"] == 1.5 and out[0]["avg_sentence_length"] == 1.0
    assert out[1]["length_ratio"] == 0 and out[1]["lexical_diversity"] == 0 and out[1]["sentence_count"] == 1


def test_features_match_plain_python(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select(F.lit("a b").alias("prompt"), F.col("text").alias("response"))
    for r in features.with_text_features(rows, notebook_extras=True).collect():
        t = r["response"]
        words = t.split()
        assert r["response_word_count"] == len(words)
        assert r["sentence_count"] == max(1, len(re.split(r"[.!?]+", t)))
        assert r["unique_word_count"] == len(set(t.lower().split()))
        assert r["has_list"] == int(bool(re.search(r"(\d\)|-\s|\*)", t)))
        assert r["paragraph_count"] == t.count("\n\n") + 1
        assert abs(r["avg_word_length"] - sum(map(len, words)) / max(1, len(words))) < 1e-9


def test_squeeze_takes_all_white_space(spark):
    assert one(spark, "\ta \n\n b  c ", text.squeeze) == "a b c"
