"""Feature engineering, splits, augmentation and models (V, P, G, M)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from qualitylab.catalog.base import (
    SPACE, Catalog, deletion_sql, drawn_sql, letters_sql, root_sql, sql_list, swaps_sql, synonyms_sql, tokens_sql, uniform_sql, words_sql,
)
from qualitylab.functions import augment, features, fixed, scores, text
from qualitylab.operators import augmenting, encoding, ensembles, joins, knn, models, ordering, sampling, tfidf
from qualitylab.plans import scoring, training
from qualitylab.session import pin
from qualitylab.sources import views, writers

catalog = Catalog()
add = catalog.add
COMP = "WITH " + views.SCORES_SQL
SCORED = "WITH " + views.SCORED_SQL

def response():
    return F.col("response")



# --- encoding -------------------------------------------------------------------------------
@add("v1_label_codes", """
WITH c AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1))
SELECT doc_id AS id, documents.source AS category, CAST(coalesce(code, -1) AS INTEGER) AS category_encoded FROM documents LEFT JOIN c ON c.source = documents.source""")
def label_codes(spark, d):
    rows = views.responses(spark, d).select("id", "category")
    seen = rows.join(views.annotations(spark, d).where("safety_score = 1"), "id", "left_semi")
    return encoding.with_label_code(rows, encoding.label_codes(seen, "category"), "category")


LANGUAGES = ["de", "en", "es", "fr"]


@add("v2_one_hot", "SELECT doc_id AS id, " + ", ".join(f"CAST(lang = '{c}' AS INTEGER) AS language_{c}" for c in LANGUAGES) + " FROM documents")
def one_hot(spark, d):
    out = encoding.one_hot(views.responses(spark, d), "language", LANGUAGES)
    return out.select("id", *[f"language_{c}" for c in LANGUAGES])


@add("v3_standard_scale", f"""
WITH t AS (SELECT doc_id AS id, n_chars AS chars, len({words_sql('text')}) AS words FROM documents)
SELECT id, round((chars - avg(chars) OVER ()) / stddev_pop(chars) OVER (), 6) AS chars, round((words - avg(words) OVER ()) / stddev_pop(words) OVER (), 6) AS words FROM t""")
def standard_scale(spark, d):
    rows = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("chars"), text.token_count(F.col("text")).alias("words"))
    return encoding.standard_scale(rows, ["chars", "words"]).select("id", F.round("chars", 6).alias("chars"), F.round("words", 6).alias("words"))


# --- TF-IDF ---------------------------------------------------------------------------------
def ngram_sql(tokens: str, low: int, high: int) -> str:
    parts = [f"list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"
             for n in range(low, high + 1)]
    out = parts[0]
    for part in parts[1:]:
        out = f"list_concat({out}, {part})"
    return out


def tfidf_sql(source: str, keys: str, column: str, settings: tfidf.TfIdf) -> str:
    limit = f"ORDER BY total DESC, term LIMIT {settings.max_features}" if settings.max_features else ""
    low, high = settings.ngram_range
    n = f"(SELECT count(*) FROM {source})"
    return f"""
tk AS (SELECT {keys}, {tokens_sql(letters_sql(column))} AS ws FROM {source}),
ng AS (SELECT {keys}, unnest({ngram_sql('ws', low, high)}) AS term FROM tk),
tf AS (SELECT {keys}, term, count(*) AS tf FROM ng GROUP BY ALL),
dq AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term),
voc AS (SELECT term, df, CAST(total AS BIGINT) AS total_tf, ln((1 + {n}) / (1 + df)) + 1 AS idf FROM dq
        WHERE df >= {settings.min_df} AND df <= {settings.max_df} * {n} {limit}),
wt AS (SELECT {keys}, term, (1 + ln(tf)) * idf AS w FROM tf JOIN voc USING (term)),
tw AS (SELECT {keys}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {keys})) AS weight FROM wt)
"""


def _prompts(spark, d):
    pairs = views.pairs(spark, d)
    return pairs.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "prompt", "response")


PAIRS = "WITH " + views.PAIRS_SQL + ", pr AS (SELECT conv_id || '-' || turn AS id, prompt, response FROM pairs), "
DOCS = "WITH dc AS (SELECT doc_id AS id, text FROM documents), "
PROMPT, RESPONSE = tfidf.TfIdf(**tfidf.PROMPT_TFIDF), tfidf.TfIdf(**tfidf.RESPONSE_TFIDF)
BIGRAM, TRIGRAM, PLAIN = tfidf.TfIdf(**tfidf.BIGRAM_TFIDF), tfidf.TfIdf(**tfidf.TRIGRAM_TFIDF), tfidf.TfIdf()
ROUNDED = "SELECT id, term, round(weight, 6) AS weight FROM tw"


@add("v4_ngrams", DOCS + f"""tk AS (SELECT id, {tokens_sql(letters_sql('text'))} AS ws FROM dc)
SELECT ngram, count(*) AS n FROM (SELECT unnest({ngram_sql('ws', 1, 2)}) AS ngram FROM tk) GROUP BY ngram""")
def ngrams(spark, d):
    grams = views.responses(spark, d).select(F.explode(tfidf.ngrams(tfidf.words(response()), 1, 2)).alias("ngram"))
    return grams.groupBy("ngram").agg(F.count("*").alias("n"))


def _weights(rows, column, settings):
    out = settings.transform(rows, column, settings.fit(rows, column))
    return out.select("id", "term", F.round("weight", 6).alias("weight"))


@add("v5_prompt_tfidf", PAIRS + tfidf_sql("pr", "id", "prompt", PROMPT) + ROUNDED)
def prompt_tfidf(spark, d):
    return _weights(_prompts(spark, d), "prompt", PROMPT)


def _document_weights(name, settings):
    @add(name, DOCS + tfidf_sql("dc", "id", "text", settings) + ROUNDED)
    def query(spark, d):
        return _weights(views.responses(spark, d), "response", settings)


_document_weights("v6_response_tfidf", RESPONSE)
_document_weights("v6_bigram_tfidf", BIGRAM)
_document_weights("v6_trigram_tfidf", TRIGRAM)


@add("v7_tfidf_all_terms", PAIRS + tfidf_sql("pr", "id", "response", PLAIN) + ROUNDED)
def all_terms(spark, d):
    return _weights(_prompts(spark, d), "response", PLAIN)


@add("v7_vocabulary", DOCS + tfidf_sql("dc", "id", "text", RESPONSE) + """
SELECT term, row_number() OVER (ORDER BY term) - 1 AS index, df, total_tf, round(idf, 6) AS idf FROM voc""")
def vocabulary(spark, d):
    return RESPONSE.fit(views.responses(spark, d), "response").select("term", "index", "df", "total_tf", F.round("idf", 6).alias("idf"))


def _top(name, settings, n):
    @add(name, DOCS + tfidf_sql("dc", "id", "text", settings) + f"""
SELECT term, round(sum(weight), 6) AS total FROM tw GROUP BY term ORDER BY total DESC, term LIMIT {n}""")
    def query(spark, d):
        rows = views.responses(spark, d)
        weights = settings.transform(rows, "response", settings.fit(rows, "response"))
        return tfidf.top_terms(weights, n).select("term", F.round("total", 6).alias("total"))


_top("v8_top_terms", RESPONSE, 15)
_top("v8_top_bigrams", BIGRAM, 10)


@add("v9_truncated_svd")
def truncated_svd(spark, d):
    _, projected, _ = tfidf.fit_and_project(views.responses(spark, d), "response", RESPONSE, 100)
    return projected.select("id", F.posexplode("svd").alias("component", "value")).withColumn("value", F.round("value", 6))


def _gram_input(spark, d):
    rows = views.responses(spark, d)
    vocabulary_table = pin(RESPONSE.fit(rows, "response"))
    width = vocabulary_table.count()
    return pin(tfidf.to_rows(RESPONSE.transform(rows, "response", vocabulary_table), width, "id", rows)), width


GRAM = DOCS + tfidf_sql("dc", "id", "text", RESPONSE) + """
, places AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS place FROM voc),
gram AS (SELECT a.term AS term, sum(a.weight * b.weight) AS g FROM tw AS a JOIN tw AS b ON a.id = b.id GROUP BY a.term, b.term)
"""


@add("v9_gram_rows", GRAM.replace("SELECT a.term AS term,", "SELECT a.term AS term, a.term = b.term AS own,") + """
SELECT CAST(place AS INTEGER) AS index, round(sum(g) FILTER (own), 6) AS diagonal, round(sum(g), 6) AS total, round(sqrt(sum(g * g)), 6) AS norm
FROM gram JOIN places USING (term) GROUP BY place""")
def gram_of_terms(spark, d):
    p = F.col("products")
    add_up = lambda of: F.aggregate(F.transform(p, of), F.lit(0.0), lambda a, b: a + b)
    return tfidf.gram_rows(*_gram_input(spark, d)).select(
        "index", F.round(F.get(p, F.col("index")), 6).alias("diagonal"), F.round(add_up(lambda x: x), 6).alias("total"),
        F.round(F.sqrt(add_up(lambda x: x * x)), 6).alias("norm"))


@add("v9_singular_powers", GRAM + """
SELECT 2 AS power, CAST(round((SELECT sum(weight * weight) FROM tw), 4) AS DOUBLE) AS total
UNION ALL SELECT 4, round(sum(g * g), 4) FROM gram""")
def singular_powers(spark, d):
    """Sums of the second and fourth powers of all singular values, which are the Gram matrix's trace and squared norm."""
    rows, width = _gram_input(spark, d)
    found = tfidf.fit_svd(rows, width, width).singular_values
    return spark.createDataFrame([(n, round(float((found**n).sum()), 4)) for n in (2, 4)], "power int, total double")


@add("v10_explained_variance")
def explained_variance(spark, d):
    rows = views.responses(spark, d)
    vocabulary_table, projected, _ = tfidf.fit_and_project(rows, "response", RESPONSE, 100)
    weights = RESPONSE.transform(rows, "response", vocabulary_table)
    return tfidf.explained_variance(projected, weights, 100).select("component", F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative"))


def _block_sql(column: str, settings: tfidf.TfIdf) -> str:
    return f"(SELECT *, dense_rank() OVER (ORDER BY term) - 1 AS place FROM ({PAIRS}{tfidf_sql('pr', 'id', column, settings)} SELECT id, term, weight FROM tw))"


@add("j8_stacked_blocks", f"WITH a AS {_block_sql('prompt', PROMPT)}, b AS {_block_sql('response', RESPONSE)}" + """
SELECT id, 'prompt' AS block, count(*) AS terms, round(sum(weight), 4) AS weight, CAST(sum(place) AS BIGINT) AS places FROM a GROUP BY id
UNION ALL SELECT id, 'response', count(*), round(sum(weight), 4), CAST(sum(place + (SELECT max(place) + 1 FROM a)) AS BIGINT) FROM b GROUP BY id""")
def stacked_blocks(spark, d):
    rows = _prompts(spark, d)
    first, second = PROMPT.fit(rows, "prompt"), RESPONSE.fit(rows, "response")
    width = first.count()
    both = tfidf.hstack([(PROMPT.transform(rows, "prompt", first), width), (RESPONSE.transform(rows, "response", second), second.count())])
    block = F.when(F.col("index") < width, "prompt").otherwise("response").alias("block")
    return both.groupBy("id", block).agg(
        F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("weight"), F.sum("index").alias("places")
    )


def described(spark, d):
    """All documents with structural features, and the quality score of those that have one. Texts stay
    below the join: only numbers meet the labels."""
    numbers = features.with_text_features(views.responses(spark, d)).select("id", *fixed.STRUCTURAL_FEATURES)
    return joins.merge_labels(numbers, views.annotations(spark, d), ["clarity_score"])


def text_rows(spark, d):
    """Written once: a fit and its predictions read the numbers, and the text is measured a single time."""
    return pin(models.assemble(described(spark, d), fixed.STRUCTURAL_FEATURES, "clarity_score"))


def labelled(rows):
    """Rows to fit on; predictions cover the others too."""
    return rows.dropna(subset=["y"])


@add("v11_feature_vectors")
def feature_vectors(spark, d):
    from pyspark.ml.functions import vector_to_array

    return text_rows(spark, d).select("id", "y", F.array_join(F.transform(vector_to_array("features"), lambda x: F.round(x, 6).cast("string")), ",").alias("features"))


# --- splits ---------------------------------------------------------------------------------
def _parts(pair):
    tag = lambda df, name: df.select("id", F.lit(name).alias("part"))
    return tag(pair[0], "train").union(tag(pair[1], "validation"))


def comp(spark, d):
    return scores.with_composite(views.three_scores(spark, d))


BINS_SQL = """
, q AS (SELECT quantile_cont(composite_score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM comp),
bn AS (SELECT id, CASE WHEN composite_score > e[5] THEN 4 WHEN composite_score > e[4] THEN 3 WHEN composite_score > e[3] THEN 2
              WHEN composite_score > e[2] THEN 1 ELSE 0 END AS bin FROM comp, q)
"""


@add("p1_stratified_split", COMP + BINS_SQL + """
, r AS (SELECT id, row_number() OVER (PARTITION BY bin ORDER BY md5(id || '|42')) AS k, count(*) OVER (PARTITION BY bin) AS n FROM bn)
SELECT id, CASE WHEN k <= round_even((1 - 0.2) * n, 0) THEN 'train' ELSE 'validation' END AS part FROM r""")
def stratified_split(spark, d):
    return _parts(sampling.stratified_split(comp(spark, d)))


@add("p2_random_split", f"SELECT event_id AS id, CASE WHEN substr(md5(event_id || '|42'), 1, 8) < '{round(0.8 * 16**8):08x}' THEN 'train' ELSE 'validation' END AS part FROM events")
def random_split(spark, d):
    return _parts(sampling.random_split(views.table(spark, d, "events").select(F.col("event_id").alias("id"))))


@add("p3_positional_split", COMP + "SELECT id, CASE WHEN row_number() OVER (ORDER BY id) <= floor(count(*) OVER () * (1 - 0.2)) THEN 'train' ELSE 'validation' END AS part FROM comp")
def positional_split(spark, d):
    return _parts(sampling.positional_split(comp(spark, d)))


@add("p4_quantile_bins", COMP + BINS_SQL + "SELECT id, bin FROM bn")
def quantile_bins(spark, d):
    return sampling.quantile_bins(comp(spark, d), "composite_score", 5).select("id", "bin")


@add("p5_folds", """
WITH r AS (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n FROM events)
SELECT id, CAST(CASE WHEN k < (n % 5) * (n // 5 + 1) THEN k // (n // 5 + 1) ELSE n % 5 + (k - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM r""")
def folds(spark, d):
    return sampling.with_folds(views.table(spark, d, "events").select(F.col("event_id").alias("id")))


@add("p5_hash_folds", "SELECT event_id AS id, CAST(CAST('0x' || substr(md5(event_id || '|7'), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM events")
def hash_folds(spark, d):
    return sampling.with_folds(views.table(spark, d, "events").select(F.col("event_id").alias("id")), seed=7)


def _fine(spark, d):
    return views.responses(spark, d).withColumn("category", F.concat_ws("-", "category", "language"))


BALANCED = f"""
WITH fine AS (SELECT doc_id AS id, source || '-' || lang AS category, text FROM documents),
c AS (SELECT category, count(*) AS n FROM fine GROUP BY ALL),
m AS (SELECT id, category, text, row_number() OVER (PARTITION BY category ORDER BY md5(id || '|42'), id) - 1 AS k FROM fine),
e AS (SELECT category, n, unnest(range(1, 11 - n)) AS d FROM c WHERE n < 10),
x AS (SELECT id, id || '|' || d AS key, m.category, text FROM (SELECT *, {drawn_sql(root_sql('category', 42, 'row'), 'd')} % n AS k FROM e) AS e JOIN m USING (category, k)),
{synonyms_sql('x', 2, fixed.SYNONYMS)}"""


@add("p6_balanced_rows", BALANCED + """
SELECT x.id, category, syn.text AS response, 'category_balance' AS augmentation_strategy FROM x JOIN syn USING (key)
UNION ALL SELECT id, category, text, NULL FROM fine""")
def balanced_rows(spark, d):
    return sampling.balance_categories(_fine(spark, d), min_samples=10).select("id", "category", "response", "augmentation_strategy")


@add("p6_balanced_counts", """
WITH c AS (SELECT source || '-' || lang AS category, count(*) AS n FROM documents GROUP BY ALL)
SELECT category, greatest(n, 10) AS rows, greatest(10 - n, 0) AS added FROM c""")
def balanced_counts(spark, d):
    out = sampling.balance_categories(_fine(spark, d), min_samples=10)
    return out.groupBy("category").agg(F.count("*").alias("rows"), F.count("augmentation_strategy").alias("added"))


# --- augmentation: synonyms for words that the tables' invented text does hold ----------------
LOCAL_SYNONYMS = {"that": ["which"], "with": ["along", "beside"], "from": ["since"], "this": ["such"], "dans": ["dedans", "parmi"], "para": ["hacia"]}


KEYED = "WITH k AS (SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS key, text FROM documents), "


def _reworded(spark, d, column):
    return views.responses(spark, d).select("id", column.alias("response"))


@add("g1_synonym_replacement", KEYED + synonyms_sql("k", 2, LOCAL_SYNONYMS) + " SELECT id, text AS response FROM syn")
def synonym_replacement(spark, d):
    return _reworded(spark, d, augment.synonym_replacement(response(), F.col("id"), 2, synonyms=LOCAL_SYNONYMS))


@add("g2_random_deletion", KEYED + deletion_sql("k", 0.1) + " SELECT id, text AS response FROM del")
def random_deletion(spark, d):
    return _reworded(spark, d, augment.random_deletion(response(), F.col("id")))


@add("g3_random_swap", KEYED + swaps_sql("k", 3) + " SELECT id, text AS response FROM swp")
def random_swap(spark, d):
    return _reworded(spark, d, augment.random_swap(response(), F.col("id"), 3))


@add("g4_shuffle_sentences", KEYED + f"""
s AS (SELECT id, key, text, string_split(regexp_replace(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g'), '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)) AS s,
             {root_sql('key', 42, 'sentence')} AS r FROM k),
t AS (SELECT id, r, unnest(s) AS part, unnest(range(len(s))) AS i FROM s),
j AS (SELECT id, string_agg(part, ' ' ORDER BY {drawn_sql('r', 'i')}, i) AS text FROM t GROUP BY id)
SELECT id, CASE WHEN len(s) <= 1 THEN s.text ELSE j.text END AS response FROM s LEFT JOIN j USING (id)""")
def shuffle_sentences(spark, d):
    return _reworded(spark, d, augment.shuffle_sentences(response(), F.col("id")))


@add("g5_back_translation", KEYED + synonyms_sql("k", 3, LOCAL_SYNONYMS) + "," + swaps_sql("syn", 1) + " SELECT id, text AS response FROM swp")
def back_translation(spark, d):
    return _reworded(spark, d, augment.random_swap(augment.synonym_replacement(response(), F.col("id"), 3, synonyms=LOCAL_SYNONYMS), F.col("id")))


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE}+|{SPACE}+$', '', 'g')"


@add("g6_prompt_paraphrase", f"""
WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'How ' || text || '?' ELSE text END AS prompt FROM conversations WHERE role = 'user'),
b AS (SELECT *, {_strip("regexp_replace(" + _strip('prompt') + ", '[?]$', '')")} AS bare FROM p),
s AS (SELECT *, regexp_replace(bare, '^({'|'.join(fixed.PARAPHRASE_VERBS)}){SPACE}+', '') AS stem FROM b),
f AS (SELECT *, CASE WHEN regexp_matches(bare, '^({'|'.join(fixed.PARAPHRASE_OPENERS)})')
        THEN CASE WHEN stem <> '' THEN upper(stem[1]) || stem[2:] ELSE prompt END ELSE bare END AS base FROM s)
SELECT conv_id, turn, replace({sql_list(fixed.PARAPHRASE_TEMPLATES)}[1 + conv_id % 5], '{{base}}', base) AS prompt FROM f""")
def prompt_paraphrase(spark, d):
    asked = views.table(spark, d, "conversations").where("role = 'user'")
    prompt = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("How "), "text", F.lit("?"))).otherwise(F.col("text"))
    return asked.select("conv_id", "turn", augment.prompt_paraphrase(prompt, F.col("conv_id")).alias("prompt"))


@add("g7_noisy_scores", COMP + f"""
, n AS (SELECT id, composite_score, {root_sql('CAST(id AS VARCHAR)', 42, 'noise', '')} AS r FROM comp)
SELECT id, round(least(greatest(composite_score + sqrt(-2 * ln({uniform_sql('r', '0')})) * cos(2 * pi() * {uniform_sql('r', '1')}) * 0.05, 1.0), 5.0), 6) AS composite_score FROM n""")
def noisy_scores(spark, d):
    noisy = augment.noisy_score(F.col("composite_score"), F.col("id"), 0.05)
    return comp(spark, d).select("id", F.round(noisy, 6).alias("composite_score"))


@add("g8_augmented_frame", f"""
WITH a AS (SELECT doc_id AS id, doc_id || '|synonym_replacement' AS key, text FROM documents),
b AS (SELECT doc_id AS id, doc_id || '|random_deletion' AS key, text FROM documents),
{synonyms_sql('a', 2, fixed.SYNONYMS)}, {deletion_sql('b', 0.1)},
every AS (SELECT doc_id AS id, text, CAST(NULL AS VARCHAR) AS augmentation_strategy FROM documents
  UNION ALL SELECT id, text, 'synonym_replacement' FROM syn UNION ALL SELECT id, text, 'random_deletion' FROM del)
SELECT id, source AS category, every.text AS response, augmentation_strategy FROM every JOIN documents ON doc_id = id""")
def augmented_frame(spark, d):
    return augmenting.augment_dataframe(views.responses(spark, d), copies=2).select("id", "category", "response", "augmentation_strategy")


# --- models ---------------------------------------------------------------------------------
def _fit_predict(query, model):
    @add(query)
    def run(spark, d):
        rows = text_rows(spark, d)
        return models.fit_models(labelled(rows), [model]).predict(rows).select("id", F.round("y", 6).alias("y"), F.round(model, 6).alias("y_pred"))


for _query, _model in (("m1_ols", "linear"), ("m2_ridge", "ridge"), ("m3_lasso", "lasso"), ("m4_elastic_net", "elastic_net"),
                       ("m5_decision_tree", "decision_tree"), ("m6_random_forest", "random_forest"), ("m7_gradient_boosting", "gradient_boosting"),
                       ("m9_ada_boost", "ada_boost"), ("m9_linear_svr", "svr_linear")):
    _fit_predict(_query, _model)


def _vectors(spark, d):
    return views.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features"), F.col("label").cast("double").alias("y"))


NEAR_SQL = """
WITH t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 5 <> 0),
q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 5 = 0),
p AS (SELECT q.vec_id AS id, t.vec_id AS neighbour, list_distance(q.v, t.v) AS distance, label AS y FROM q, t),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 12), neighbour) AS r FROM p QUALIFY r <= 5)
"""


@add("j9_nearest_neighbours", NEAR_SQL + "SELECT id, neighbour, round(distance, 6) AS distance FROM n")
def nearest_neighbours(spark, d):
    rows = _vectors(spark, d)
    return knn.nearest(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")).select("id", "neighbour", F.round("distance", 6).alias("distance"))


@add("m8_knn_regression", NEAR_SQL + """
SELECT id, round(coalesce(avg(y) FILTER (distance = 0), sum(y / distance) / sum(1 / distance)), 6) AS y_pred FROM n GROUP BY id""")
def knn_regression(spark, d):
    rows = _vectors(spark, d)
    return knn.knn_regression(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")).select("id", F.round("y_pred", 6).alias("y_pred"))


def _split_rows(spark, d):
    return sampling.random_split(labelled(text_rows(spark, d)))


@add("m9_baseline_models")
def baseline_models(spark, d):
    """The whole registry at its defaults."""
    rows = text_rows(spark, d)
    train, _ = sampling.random_split(labelled(rows))
    fitted = models.fit_models(train, [*models.MODEL_REGISTRY, "not a model"])
    names = list(fitted.models)
    return fitted.predict(rows, names).select("id", "y", *[F.round(n, 6).alias(n) for n in names])


@add("m10_predict_best")
def predict_best(spark, d):
    """The best of the whole registry on the held rows, for all documents."""
    rows = text_rows(spark, d)
    train, held = sampling.random_split(labelled(rows))
    fitted = models.fit_models(train)
    best = models.best_model(models.leaderboard(fitted, held))
    return fitted.predict(rows, [best]).select("id", F.lit(best).alias("model"), F.round(best, 6).alias("y_pred"))


@add("m11_leaderboard")
def leaderboard(spark, d):
    """The whole registry at its defaults, five folds."""
    train, held = sampling.random_split(labelled(text_rows(spark, d)))
    return models.fitted_board(train, held, folds=5)[1]


LINEAR_MODELS = ["linear", "ridge", "lasso", "elastic_net"]


@add("m12_cross_validation")
def cross_validation(spark, d):
    """All linear models at their defaults, five folds, from one scan; the trees' folds are in ``m11_leaderboard``."""
    rows = labelled(text_rows(spark, d))
    return models.cross_validate(rows, LINEAR_MODELS, 5).select("model", "fold", F.round("rmse", 6).alias("rmse"), F.round("r2", 6).alias("r2"))


ONE_FEATURE = f"""
WITH r AS (SELECT doc_id AS id, CAST(len({words_sql('text')}) AS DOUBLE) AS x, 1.0 + 4 * quality AS y, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n
           FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
f AS (SELECT *, CAST(CASE WHEN k < (n % 5) * (n // 5 + 1) THEN k // (n // 5 + 1) ELSE n % 5 + (k - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM r)"""


@add("m12_one_feature_folds", ONE_FEATURE + """
, m AS (SELECT t.fold, regr_slope(f.y, f.x) AS s, regr_intercept(f.y, f.x) AS i FROM (SELECT DISTINCT fold FROM f) AS t JOIN f ON f.fold <> t.fold GROUP BY t.fold)
SELECT 'linear' AS model, fold, round(sqrt(avg((y - i - s * x) ^ 2)), 6) AS rmse, round(1 - sum((y - i - s * x) ^ 2) / (var_pop(y) * count(*)), 6) AS r2
FROM f JOIN m USING (fold) GROUP BY fold""")
def one_feature_folds(spark, d):
    words = views.responses(spark, d).select("id", text.token_count(response()).cast("double").alias("x"))
    rows = joins.merge_labels(words, views.annotations(spark, d), ["clarity_score"])
    rows = labelled(models.assemble(rows, ["x"], "clarity_score"))
    return models.cross_validate(rows, ["linear"], 5).select("model", "fold", F.round("rmse", 6).alias("rmse"), F.round("r2", 6).alias("r2"))


@add("m18_one_feature_grid", ONE_FEATURE.replace("row_number() OVER (ORDER BY doc_id) - 1 AS k", "md5(doc_id || '|42') AS h").replace(", count(*) OVER () AS n", "").partition(",\nf AS")[0] + f"""
, t AS (SELECT *, substr(h, 1, 8) < '{round(0.8 * 16**8):08x}' AS train FROM r),
s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) / stddev_pop(x) AS b FROM t WHERE train),
g(alpha) AS (VALUES (0.01), (0.1), (1.0), (10.0)),
w AS (SELECT alpha, mx, my, b / (1 + alpha / n) / sx AS w FROM s, g)
SELECT printf('{{''alpha'': %s}}', CAST(CAST(alpha AS DOUBLE) AS VARCHAR)) AS params, round(sqrt(avg((y - my - w * (x - mx)) ^ 2)), 6) AS rmse FROM t, w WHERE NOT train GROUP BY alpha""")
def one_feature_grid(spark, d):
    words = views.responses(spark, d).select("id", text.token_count(response()).cast("double").alias("x"))
    rows = joins.merge_labels(words, views.annotations(spark, d), ["clarity_score"])
    train, held = sampling.random_split(labelled(models.assemble(rows, ["x"], "clarity_score")))
    return models.grid_search(train, held, "ridge", fixed.SEARCH_GRIDS["ridge"])[2].select("params", F.round("rmse", 6).alias("rmse"))


@add("m13_best_model", SCORED + """
, l AS (SELECT 'fine' AS model, round(1 - sum((y_true - y_pred) ^ 2) / (var_pop(y_true) * count(*)), 6) AS r2 FROM scored
  UNION ALL SELECT 'coarse', round(1 - sum((y_true - y_pred_b) ^ 2) / (var_pop(y_true) * count(*)), 6) FROM scored)
SELECT model, r2 FROM l ORDER BY r2 DESC, model LIMIT 1""")
def best_of(spark, d):
    rows = views.scored(spark, d).select("id", F.col("y_true").alias("y"), F.col("y_pred").alias("fine"), F.col("y_pred_b").alias("coarse"))
    board = models.scores_of(rows, ["fine", "coarse"]).select("model", F.round("r2", 6).alias("r2"))
    return ordering.arg_max(board, "model", "r2")


@add("m14_stacking")
def stacking(spark, d):
    """All bases at their defaults, five folds; predictions for all documents."""
    rows = text_rows(spark, d)
    train, _ = sampling.random_split(labelled(rows))
    return ensembles.fit_stacking(train).predict(rows).select("id", F.round("y_pred", 6).alias("y_pred"))


@add("m15_blending", SCORED + "SELECT id, round(least(greatest((0.15 * y_pred + 0.20 * y_pred_b) / 0.35, 1.0), 5.0), 6) AS y_blend FROM scored")
def blending(spark, d):
    rows = views.scored(spark, d).withColumnsRenamed({"y_pred": "ridge", "y_pred_b": "random_forest"})
    return rows.select("id", F.round(ensembles.blend(fixed.BLEND_WEIGHTS, ["ridge", "random_forest"]), 6).alias("y_blend"))


@add("m16_voting", SCORED + "SELECT id, round(least(greatest((y_pred + y_pred_b) / 2, 1.0), 5.0), 6) AS y_vote FROM scored")
def voting(spark, d):
    return views.scored(spark, d).select("id", F.round(ensembles.vote(["y_pred", "y_pred_b"]), 6).alias("y_vote"))


@add("m17_feature_importance")
def feature_importance(spark, d):
    fitted = models.fit_models(labelled(text_rows(spark, d)), ["random_forest"])
    return models.feature_importance(fitted.models["random_forest"], fixed.STRUCTURAL_FEATURES).select("feature", F.round("weight", 6).alias("weight"))


@add("m17_top_coefficients")
def top_coefficients(spark, d):
    fitted = models.fit_models(labelled(text_rows(spark, d)), ["ridge"])
    weights = models.feature_importance(fitted.models["ridge"], fixed.STRUCTURAL_FEATURES)
    return models.top_coefficients(weights, 10).select("side", "feature", F.round("weight", 6).alias("weight"))


@add("m18_grid_search")
def grid_search(spark, d):
    train, held = _split_rows(spark, d)
    return models.grid_search(train, held, "ridge", fixed.SEARCH_GRIDS["ridge"])[2]


def _annotated(spark, d):
    return joins.merge_labels(views.responses(spark, d), views.annotations(spark, d), ["clarity_score"])


@add("m19_predict_scores")
def predict_scores(spark, d):
    """The whole scorer at its defaults, fitted to the annotated score; predictions for all documents."""
    rows = _annotated(spark, d)
    train, _ = sampling.random_split(rows.dropna(subset=["clarity_score"]))
    model, _ = scoring.fit_quality_model(train, target="clarity_score")
    return model.predict(rows.drop("clarity_score")).select("id", F.round("y_pred", 6).alias("y_pred"))


@add("m20_training_job")
def training_job(spark, d):
    """The job at its defaults (the stack of all bases, five folds), with augmentation. The registry's board is ``m11_leaderboard``;
    both at once take 369 s here at sf0.01."""
    rows = _annotated(spark, d).dropna(subset=["clarity_score"]).withColumnRenamed("clarity_score", "composite_score")
    return training.run_training(rows, None, training.TrainingConfig(augment=True)).report


@add("m21_model_card")
def model_card(spark, d):
    rows = labelled(text_rows(spark, d))
    summary = models.cv_summary(models.cross_validate(rows, ["ridge"], 5)).first()
    card = writers.model_card(spark, "structural ridge", len(fixed.STRUCTURAL_FEATURES), 0, ["ridge"],
                              {"cv_rmse": summary["cv_rmse_mean"], "cv_std": summary["cv_rmse_std"], "n_samples": rows.count()})
    return card.select("model_name", "version", "structural", "tfidf_svd", "total", F.explode("training").alias("metric", "value"))
