"""Text functions and features (T, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from qualitylab.catalog.base import (
    SPACE, WORD, Catalog, clean_sql, contractions_sql, fold_sql, letters_sql, quote, sql_list, tokens_sql, words_sql,
)
from qualitylab.catalog.data import STRATEGY_SQL
from qualitylab.functions import features, fixed, text
from qualitylab.operators import eda, encoding, joins, ordering
from qualitylab.sources import views

catalog = Catalog()
add = catalog.add

# Stems that occur in the tables' invented text stand in for the default ones.
STEMS_A, STEMS_B = ["tion", "er", "qu"], ["wh", "ê", "der"]


def _docs(spark, d, column, name):
    return views.responses(spark, d).select("id", column.alias(name))



def response():
    return F.col("response")

DOC = "SELECT doc_id AS id, "


@add("t1_fold_to_ascii", f"{DOC}{fold_sql('text')} AS folded FROM documents")
def fold(spark, d):
    return _docs(spark, d, text.fold_to_ascii(response()), "folded")


@add("t2_strip_tags", "SELECT page_id AS id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS plain FROM pages")
def tags(spark, d):
    return views.table(spark, d, "pages").select(F.col("page_id").alias("id"), text.strip_tags(F.col("html")).alias("plain"))


# The text has no short forms: every one of them is put before each "the".
FORMS = " " + " ".join(short for short, _ in fixed.CONTRACTIONS) + " the "
SHORT = f"replace(text, ' the ', {quote(FORMS)})"


@add("t3_expand_contractions", f"{DOC}{contractions_sql(SHORT)} AS expanded FROM documents")
def contractions(spark, d):
    return _docs(spark, d, text.expand_contractions(F.replace(response(), F.lit(" the "), F.lit(FORMS))), "expanded")


@add("t4_lower_case", f"{DOC}lower(text) AS lowered FROM documents")
def lowered(spark, d):
    return _docs(spark, d, F.lower(response()), "lowered")


@add("t5_drop_digits", rf"{DOC}regexp_replace(text, '\p{{Nd}}+', ' ', 'g') AS no_digits FROM documents")
def digits(spark, d):
    return _docs(spark, d, text.drop_digits(response()), "no_digits")


@add("t6_drop_punctuation", f"{DOC}regexp_replace({fold_sql('text')}, '[^a-zA-Z0-9_.!?'']', ' ', 'g') AS bare FROM documents")
def punctuation(spark, d):
    return _docs(spark, d, text.drop_punctuation(text.fold_to_ascii(response())), "bare")


@add("t7_squeeze", f"{DOC}trim(regexp_replace(text, '{SPACE}+', ' ', 'g')) AS squeezed FROM documents")
def squeezed(spark, d):
    return _docs(spark, d, text.squeeze(response()), "squeezed")


@add("t8_clean", f"{DOC}{clean_sql('text')} AS response_clean FROM documents")
def cleaned(spark, d):
    return _docs(spark, d, text.clean(response()), "response_clean")


@add("t8_clean_pages", f"SELECT page_id AS id, {clean_sql('html')} AS html_clean FROM pages")
def cleaned_pages(spark, d):
    return views.table(spark, d, "pages").select(F.col("page_id").alias("id"), text.clean(F.col("html")).alias("html_clean"))


@add("t9_tokenize", f"{DOC}array_to_string({tokens_sql(clean_sql('text'))}, ' ') AS tokens FROM documents")
def tokens(spark, d):
    return _docs(spark, d, F.array_join(text.tokenize(text.clean(response())), " "), "tokens")


@add("t10_clean_columns", f"""
WITH {views.PAIRS_SQL} SELECT conv_id, turn, {clean_sql('prompt')} AS prompt_clean, {clean_sql('response')} AS response_clean,
       array_to_string({tokens_sql(clean_sql('response'))}, ' ') AS response_tokens FROM pairs""")
def clean_columns(spark, d):
    out = features.preprocess(views.pairs(spark, d), ["prompt", "response"], ["response"])
    return out.select("conv_id", "turn", "prompt_clean", "response_clean", F.array_join("response_tokens", " ").alias("response_tokens"))


@add("t11_letters_only", f"{DOC}{letters_sql('text')} AS letters FROM documents")
def letters(spark, d):
    return _docs(spark, d, text.letters_only(response()), "letters")


def _feature_sql(source: str, key: str) -> str:
    w, p = words_sql("response"), words_sql("prompt")
    return f"""
b AS (SELECT {key}, length(prompt) AS prompt_length, length(response) AS response_length,
    len({p}) AS prompt_word_count, len({w}) AS response_word_count,
    greatest(1, len(string_split_regex(response, '[.!?]+'))) AS sentence_count,
    len(list_distinct({words_sql('lower(response)')})) AS unique_word_count,
    length(response) - length(replace(response, '?', '')) AS question_marks,
    length(response) - length(replace(response, '!', '')) AS exclamation_marks,
    CAST(regexp_matches(response, '\\p{{Nd}}\\)|-{SPACE}|[*]') AS INTEGER) AS has_list,
    CAST(regexp_matches(response, '\\p{{Nd}}') AS INTEGER) AS has_number,
    len(string_split(response, chr(10) || chr(10))) AS paragraph_count,
    CAST(regexp_matches(lower(response), '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(STEMS_A)})') AS INTEGER) AS has_medical_terms,
    CAST(regexp_matches(lower(response), '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(STEMS_B)})') AS INTEGER) AS has_empathy_words,
    length(response) - length(replace(response, ',', '')) AS comma_count,
    coalesce(round(list_sum(list_transform({w}, lambda x: length(x))) / len({w}), 6), 0.0) AS avg_word_length
  FROM {source})
"""


FEATURE_OUT = """prompt_length, response_length, prompt_word_count, response_word_count,
round(response_word_count / CASE WHEN prompt_word_count = 0 THEN 1 ELSE prompt_word_count END, 6) AS length_ratio,
sentence_count, round(response_word_count / sentence_count, 6) AS avg_sentence_length, unique_word_count,
round(unique_word_count / CASE WHEN response_word_count = 0 THEN 1 ELSE response_word_count END, 6) AS lexical_diversity,
question_marks, exclamation_marks, has_list, has_number, paragraph_count, has_medical_terms, has_empathy_words"""


def _features(df, key, extras=()):
    out = features.with_text_features(df, medical_stems=STEMS_A, empathy_stems=STEMS_B, notebook_extras=bool(extras))
    rounded = {"length_ratio", "avg_sentence_length", "lexical_diversity", "avg_word_length"}
    flags = {"has_list", "has_number", "has_medical_terms", "has_empathy_words"}
    pick = lambda c: F.round(c, 6).alias(c) if c in rounded else (F.col(c) if c in flags else F.col(c).cast("long").alias(c))
    return out.select(*key, *[pick(c) for c in [*fixed.STRUCTURAL_FEATURES, *extras]])


@add("f1_to_f13_text_features", f"WITH {views.RESPONSES_SQL}, {_feature_sql('resp', 'id')} SELECT id, {FEATURE_OUT} FROM b")
def text_features(spark, d):
    return _features(views.responses(spark, d), ["id"])


@add("f1_to_f15_pair_features", f"WITH {views.PAIRS_SQL}, {_feature_sql('pairs', 'conv_id, turn')} SELECT conv_id, turn, {FEATURE_OUT}, comma_count, avg_word_length FROM b")
def pair_features(spark, d):
    return _features(views.pairs(spark, d), ["conv_id", "turn"], ["comma_count", "avg_word_length"])


@add("f14_f15_page_features", f"""
WITH x AS (SELECT page_id AS id, url AS prompt, html AS response FROM pages), {_feature_sql('x', 'id')}
SELECT id, {FEATURE_OUT}, comma_count, avg_word_length FROM b""")
def page_features(spark, d):
    rows = views.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("prompt"), F.col("html").alias("response"))
    return _features(rows, ["id"], ["comma_count", "avg_word_length"])


@add("t12_preprocess_all", f"""
WITH {views.PAIRS_SQL} SELECT conv_id, turn, {clean_sql('prompt')} AS prompt_clean,
  len({tokens_sql(clean_sql('response'))}) AS n_tokens, length(response) AS response_length, len({words_sql('response')}) AS response_word_count FROM pairs""")
def preprocess_all(spark, d):
    out = features.preprocess_and_describe(views.pairs(spark, d))
    return out.select("conv_id", "turn", "prompt_clean", F.size("response_tokens").cast("long").alias("n_tokens"),
                      F.col("response_length").cast("long").alias("response_length"), F.col("response_word_count").cast("long").alias("response_word_count"))


@add("t13_keywords", f"""
WITH w AS (SELECT unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM documents)
SELECT word, count(*) AS count FROM w
WHERE regexp_full_match(word, '[a-zA-Z]{{4,}}') AND NOT list_contains({sql_list(fixed.STOP_WORDS)}, word)
GROUP BY word ORDER BY count DESC, word LIMIT 30""")
def keywords(spark, d):
    return eda.top_keywords(views.responses(spark, d), text.keyword_candidates(response()), fixed.STOP_WORDS)


# RE2 has no lookbehind: a mark is put after each sentence end first.
@add("t14_sentences", f"""
{DOC}len(string_split(regexp_replace(text, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1))) AS sentences FROM documents""")
def sentence_split(spark, d):
    return _docs(spark, d, F.size(text.sentences(response())).cast("long"), "sentences")


@add("t15_split_list", f"{DOC}len(string_split(text, '|')) AS parts, string_split(text, '|')[1] AS head FROM documents")
def lists(spark, d):
    parts = text.split_list(response())
    return views.responses(spark, d).select("id", F.size(parts).cast("long").alias("parts"), parts[0].alias("head"))


VOCABULARY_SQL = f"""
tok AS (SELECT doc_id AS id, unnest({tokens_sql(clean_sql('text'))}) AS term FROM documents),
voc AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS id, count(*) AS freq FROM tok GROUP BY term)
"""


def _vocabulary(spark, d):
    return encoding.build_vocabulary(views.responses(spark, d), text.tokenize(text.clean(response())))


@add("t17_vocabulary", f"WITH {VOCABULARY_SQL} SELECT term, id, freq FROM voc")
def vocabulary(spark, d):
    return _vocabulary(spark, d)


@add("t16_encode_tokens", f"""
WITH {VOCABULARY_SQL}, c AS (SELECT page_id AS id, unnest(string_split({clean_sql('html')}, ' ')) AS term,
       generate_subscripts(string_split({clean_sql('html')}, ' '), 1) - 1 AS pos FROM pages)
SELECT c.id, CAST(pos AS INTEGER) AS pos, c.term, coalesce(voc.id, 0) AS token_id FROM c LEFT JOIN voc ON voc.term = c.term""")
def encode(spark, d):
    pages = views.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.split(text.clean(F.col("html")), " ").alias("words"))
    return encoding.encode_tokens(pages, F.col("words"), _vocabulary(spark, d))


@add("t18_strategy_templates", f"""
WITH {STRATEGY_SQL} SELECT conv_id, turn, strategy, replace(template, '{{prompt}}', text) AS full_prompt FROM conversations, st WHERE role = 'user'""")
def templates(spark, d):
    asked = views.table(spark, d, "conversations").where("role = 'user'").withColumnRenamed("text", "prompt")
    return joins.with_strategies(asked).select("conv_id", "turn", "strategy", "full_prompt")


@add("t19_submission", f"""
WITH {views.RESPONSES_SQL} SELECT id, prompt, category, {quote(fixed.SUBMISSION_SYSTEM_PROMPT)} AS system_prompt,
 prompt || {quote(fixed.ENHANCED_PROMPT_SUFFIX)} AS enhanced_prompt, '' AS response, CAST(NULL AS DOUBLE) AS predicted_composite_score FROM resp""")
def submission(spark, d):
    return joins.submission(views.responses(spark, d))


@add("t20_token_count", f"{DOC}len({words_sql('text')}) AS token_count FROM documents")
def token_count(spark, d):
    return _docs(spark, d, text.token_count(response()).cast("long"), "token_count")


@add("w_language_report", f"""
WITH {views.RESPONSES_SQL}, l AS (SELECT resp.*, CAST(1 + 4 * quality AS DOUBLE) AS clarity_score FROM resp LEFT JOIN labels ON doc_id = id),
m AS (SELECT language, clarity_score, length({clean_sql('response')}) AS cl, length(response) AS rl, len({words_sql('response')}) AS rw,
  greatest(1, len(string_split_regex(response, '[.!?]+'))) AS sc, len(list_distinct({words_sql('lower(response)')})) AS uw,
  CAST(regexp_matches(response, '\\p{{Nd}}\\)|-{SPACE}|[*]') AS INTEGER) AS hl, CAST(regexp_matches(response, '\\p{{Nd}}') AS INTEGER) AS hn FROM l)
SELECT language, count(*) AS n, count(clarity_score) AS labelled, round(avg(cl), 4) AS avg_clean_length, round(avg(rl), 4) AS avg_response_length,
 round(avg(rw), 4) AS avg_response_word_count, round(avg(sc), 4) AS avg_sentence_count,
 round(avg(uw / CASE WHEN rw = 0 THEN 1 ELSE rw END), 4) AS avg_lexical_diversity, round(avg(hl), 4) AS avg_has_list, round(avg(hn), 4) AS avg_has_number,
 round(avg(clarity_score), 4) AS avg_clarity_score FROM m GROUP BY language""")
def language_report(spark, d):
    from qualitylab.plans.language_report import quality_by_language

    return quality_by_language(views.responses(spark, d), views.annotations(spark, d))
