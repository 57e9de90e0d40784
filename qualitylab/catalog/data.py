"""Sources, sinks, projections and joins (S, N, J)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from qualitylab.catalog.base import Catalog, quote
from qualitylab.catalog.stats import REPORT_SQL
from qualitylab.functions import fixed, scores
from qualitylab.operators import eda, joins, metrics, models
from qualitylab.session import scratch_path
from qualitylab.sources import readers, views, writers

catalog = Catalog()
add = catalog.add
W = "WITH "


@add("s1_csv_scan", """
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last_key,
       CAST(sum(CAST(o_orderdate AS DATE) - DATE '1970-01-01') AS BIGINT) AS days
FROM orders GROUP BY ALL""")
def csv_scan(spark, d):
    path = scratch_path(spark, "csv")
    writers.write_csv(views.table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")), path)
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    return readers.read_csv(spark, path, schema).groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.max("o_orderkey").alias("last_key"), F.sum(F.unix_date(F.col("o_orderdate").cast("date"))).cast("long").alias("days"),
    )


@add("s2_json_scan", """
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users
FROM events GROUP BY ALL""")
def json_scan(spark, d):
    path = scratch_path(spark, "json")
    writers.write_json(views.table(spark, d, "events").drop("ts"), path)
    schema = "event_id long, user_id long, event_type string, value double, props string"
    return readers.read_json(spark, path, schema, records=False).groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"),
        F.count_distinct("user_id").alias("users"),
    )


@add("s2_json_array_scan", """
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users,
       CAST(sum(epoch_us(CAST(ts AS TIMESTAMP)) // 1000 % 1000000007) AS BIGINT) AS moments
FROM events GROUP BY ALL""")
def json_array_scan(spark, d):
    """Arrays of records, the records' moments included."""
    path = scratch_path(spark, "array")
    writers.write_json_array(views.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), path)
    schema = "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string"
    millis = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return readers.read_json(spark, path, schema).groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count_distinct("user_id").alias("users"),
        F.sum(millis % 1000000007).alias("moments"))


@add("s3_corpus_scan", """
SELECT count(*) AS lines, CAST(sum(length(text) + 1) AS BIGINT) AS characters FROM documents""")
def corpus_scan(spark, d):
    path = scratch_path(spark, "corpus")
    lines = views.table(spark, d, "documents").select(F.regexp_replace("text", "[\\n\\r]", " "))
    writers.write_text(lines, path)
    return readers.corpus_size(readers.read_corpus(spark, path))


@add("s4_load_all", W + views.SCORES_SQL + """
SELECT 'train' AS part, count(*) AS n, round(avg(composite_score), 6) AS composite FROM comp WHERE id % 5 <> 0
UNION ALL SELECT 'test', count(*), round(avg(composite_score), 6) FROM comp WHERE id % 5 = 0
UNION ALL SELECT 'labels', count(*), CAST(NULL AS DOUBLE) FROM labels""")
def load_all(spark, d):
    path = scratch_path(spark, "load")
    rows = views.three_scores(spark, d).drop("timestamp")
    writers.write_csv(rows.where("id % 5 <> 0"), f"{path}/train")
    writers.write_csv(rows.where("id % 5 = 0"), f"{path}/test")
    writers.write_csv(views.annotations(spark, d), f"{path}/labels")
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    loaded = readers.load_all(
        spark, f"{path}/train", f"{path}/test", f"{path}/labels", schema,
        "id long, clarity_score double, safety_score double",
    )
    parts = []
    for name, df in zip(("train", "test", "labels"), loaded):
        value = F.round(F.avg("composite_score"), 6) if "composite_score" in df.columns else F.lit(None).cast("double")
        parts.append(df.agg(F.count("*").alias("n"), value.alias("composite")).select(F.lit(name).alias("part"), "n", "composite"))
    return parts[0].union(parts[1]).union(parts[2])


@add("s5_prompt_readers", """
SELECT p.conv_id AS conv_id, p.turn AS turn, length(p.text) AS prompt_chars, length(r.text) AS response_chars
FROM conversations p JOIN conversations r ON r.conv_id = p.conv_id AND r.turn = p.turn + 1
WHERE p.role = 'user' AND r.role = 'assistant'""")
def prompt_readers(spark, d):
    path = scratch_path(spark, "prompts")
    turns = views.table(spark, d, "conversations")
    ident = lambda shift: F.concat_ws("-", "conv_id", F.col("turn") - shift)
    writers.write_json(turns.where("role = 'user'").select(ident(0).alias("id"), F.col("text").alias("input")), f"{path}/p")
    writers.write_json(
        turns.where("role = 'assistant'").select(
            F.concat_ws("-", "conv_id", "turn").alias("id"), ident(1).alias("prompt_id"), F.col("text").alias("output")
        ), f"{path}/r")
    both = joins.answers_to_prompts(
        readers.read_json(spark, f"{path}/p", "prompts", records=False),
        readers.read_json(spark, f"{path}/r", "answers", records=False),
    )
    part = F.split("prompt_id", "-")
    return both.select(
        part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"),
        F.char_length("input").cast("long").alias("prompt_chars"),
        F.char_length("output").cast("long").alias("response_chars"),
    )


@add("s6_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, count(*) AS rows FROM {t}" for t in ("documents", "labels", "conversations", "pages")))
def row_counts(spark, d):
    return readers.summary({t: views.table(spark, d, t) for t in ("documents", "labels", "conversations", "pages")})


@add("s7_csv_sink", """
SELECT doc_id AS id, source AS category, text AS response FROM documents""")
def csv_sink(spark, d):
    path = scratch_path(spark, "sink")
    rows = views.responses(spark, d).select("id", "category", "response")
    writers.write_csv(rows, path)
    return readers.read_csv(spark, path, "id long, category string, response string", multiline=True)


RULES = {
    "doc_id": {"nullable": False},
    "text": {"nullable": False, "max_length": 2000},
    "lang": {"nullable": False, "allowed_values": ["en", "fr"]},
    "n_chars": {"range": [100, 5000]},
}


@add("s8_dictionary_check", """
SELECT 'doc_id' AS "column", 'not_null' AS rule, count(*) FILTER (doc_id IS NULL) AS violations FROM documents
UNION ALL SELECT 'text', 'not_null', count(*) FILTER (text IS NULL) FROM documents
UNION ALL SELECT 'text', 'max_length', count(*) FILTER (length(text) > 2000) FROM documents
UNION ALL SELECT 'lang', 'not_null', count(*) FILTER (lang IS NULL) FROM documents
UNION ALL SELECT 'lang', 'allowed_values', count(*) FILTER (lang NOT IN ('en', 'fr')) FROM documents
UNION ALL SELECT 'n_chars', 'range', count(*) FILTER (n_chars NOT BETWEEN 100 AND 5000) FROM documents""")
def dictionary_check(spark, d):
    return joins.check_rules(views.table(spark, d, "documents"), RULES)


@add("s9_report_sink", REPORT_SQL)
def report_sink(spark, d):
    path = scratch_path(spark, "report")
    writers.write_report(metrics.evaluation_report(views.scored(spark, d), "user mean"), path)
    return readers.read_report(spark, path)


def _embedded(spark, d):
    return views.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("double").alias("y"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )


@add("s10_model_card")
def model_card(spark, d):
    rows = _embedded(spark, d)
    fitted = models.fit_models(rows, ["ridge"])
    row = models.scores_of(fitted.predict(rows), ["ridge"]).first()
    path = scratch_path(spark, "card")
    card = writers.model_card(spark, "ridge on vectors", 64, 0, ["ridge"], {
        "train_rmse": row["rmse"], "train_r2": row["r2"], "n_samples": rows.count()})
    writers.write_json(card, path)
    return readers.read_json(spark, path, ", ".join(f"{n} {t}" for n, t in card.dtypes), records=False)


@add("s11_saved_model", "SELECT vec_id AS id, CAST(0 AS DOUBLE) AS difference FROM embeddings")
def saved_model(spark, d):
    rows = _embedded(spark, d).withColumn("numbers", vector_to_array("features"))
    flat = rows.select("id", "y", *[F.col("numbers")[i].alias(f"f{i}") for i in range(64)])
    plan = models.pipeline([f"f{i}" for i in range(64)], "ridge", models.LabelStats.of(flat))
    path = scratch_path(spark, "model")
    fitted = plan.fit(flat)
    writers.save_model(fitted, path)
    before = fitted.transform(flat).select("id", F.col("prediction").alias("fitted"))
    after = writers.load_model(path).transform(flat).select("id", "prediction")
    return after.join(before, "id").select("id", F.round(F.abs(F.col("prediction") - F.col("fitted")), 9).alias("difference"))


@add("s12_external_tables", """
WITH c AS (SELECT n_name AS country, r_name AS region, round(sum(c_acctbal), 2) AS balance, count(*) AS customers
           FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL),
     h AS (SELECT n_name AS country, count(*) AS suppliers FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)
SELECT c.country, region, balance, customers, suppliers FROM c JOIN h USING (country)""")
def external_tables(spark, d):
    path = scratch_path(spark, "external")
    nation, region = views.table(spark, d, "nation"), views.table(spark, d, "region")
    customers = views.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey"))
    writers.write_csv(customers.select(F.col("n_name").alias("country"), F.col("r_name").alias("region"), "c_acctbal"), f"{path}/a")
    suppliers = views.table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    writers.write_json(suppliers.select(F.col("n_name").alias("country"), "s_suppkey"), f"{path}/b")
    first = readers.read_csv(spark, f"{path}/a", "country string, region string, c_acctbal double").groupBy("country", "region").agg(
        F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count("*").alias("customers"))
    second = readers.read_json(spark, f"{path}/b", "country string, s_suppkey long", records=False).groupBy("country").agg(
        F.count("*").alias("suppliers"))
    return readers.join_indicators(first, second, "country")


# --- projections and filters --------------------------------------------------------------
@add("n1_composite_score", W + views.SCORES_SQL + "SELECT id, round(composite_score, 9) AS composite_score FROM comp")
def composite_score(spark, d):
    return scores.with_composite(views.three_scores(spark, d)).select("id", F.round("composite_score", 9).alias("composite_score"))


@add("n2_category_filter", "SELECT doc_id AS id, source AS category FROM documents WHERE source IN ('src1', 'src3')")
def category_filter(spark, d):
    return scores.in_categories(views.responses(spark, d), ["src1", "src3"]).select("id", "category")


@add("n3_value_split", """
SELECT CASE WHEN quality = 1 THEN 'same' ELSE 'other' END AS part, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def value_split(spark, d):
    merged = joins.merge_labels(views.responses(spark, d), views.annotations(spark, d), ["clarity_score"])
    same, other = scores.split_by_value(merged, "clarity_score", 5.0)
    tag = lambda df, name: df.groupBy(F.lit(name).alias("part")).agg(F.count("*").alias("n"))
    return tag(same, "same").union(tag(other, "other"))


@add("n4_drop_null_rows", "SELECT doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL")
def drop_null_rows(spark, d):
    merged = joins.merge_labels(views.responses(spark, d), views.annotations(spark, d), ["clarity_score"])
    return merged.dropna(subset=["response", "clarity_score"]).select("id")


@add("n5_median_fill", """
WITH l AS (SELECT d.doc_id AS id, 1.0 + 4 * quality AS clarity_score, CASE WHEN labels.doc_id IS NULL THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS size
           FROM documents d LEFT JOIN labels ON labels.doc_id = d.doc_id)
SELECT id, CAST(coalesce(clarity_score, (SELECT median(clarity_score) FROM l)) AS DOUBLE) AS clarity_score,
       coalesce(size, (SELECT median(size) FROM l)) AS size FROM l""")
def median_fill(spark, d):
    sizes = views.table(spark, d, "documents").join(views.table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("size"))
    merged = joins.merge_labels(views.responses(spark, d), views.annotations(spark, d), ["clarity_score"]).join(sizes, "id", "left")
    return eda.fill_with_median(merged, ["clarity_score", "size"]).select("id", "clarity_score", "size")


@add("n6_null_counts", """
SELECT 'id' AS "column", 0 AS nulls UNION ALL
SELECT 'clarity_score', count(*) FILTER (quality IS NULL) FROM documents LEFT JOIN labels USING (doc_id)""")
def null_counts(spark, d):
    merged = joins.merge_labels(views.responses(spark, d), views.annotations(spark, d))
    return eda.null_counts(merged, ["id", "clarity_score"])


@add("n7_time_parts", """
SELECT event_id AS id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM events""")
def time_parts(spark, d):
    rows = views.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"))
    return scores.with_time_parts(rows).select("id", "hour", "day_of_week")


@add("n8_clip", "SELECT event_id AS id, least(greatest(value / 20, 1.0), 5.0) AS clipped FROM events")
def clip(spark, d):
    return views.table(spark, d, "events").select(F.col("event_id").alias("id"), scores.clip(F.col("value") / 20).alias("clipped"))


@add("n9_available_columns", "SELECT doc_id AS id, source AS category, lang AS language FROM documents")
def available_columns(spark, d):
    rows = views.responses(spark, d)
    return rows.select(*scores.available(rows, ["id", "category", "difficulty", "language", "clarity_score"]))


@add("n10_half_even_rounding", "SELECT event_id AS id, round_even(event_id / 8, 2) AS rounded FROM events")
def half_even_rounding(spark, d):
    return views.table(spark, d, "events").select(F.col("event_id").alias("id"), F.bround(F.col("event_id") / 8, 2).alias("rounded"))


@add("n11_excerpt", "SELECT doc_id AS id, substring(text, 1, 100) AS excerpt FROM documents")
def excerpt(spark, d):
    return views.responses(spark, d).select("id", scores.excerpt(F.col("response")).alias("excerpt"))


# --- joins ----------------------------------------------------------------------------------
@add("j1_label_join", """
SELECT d.doc_id AS id, source AS category, CAST(1 + 4 * quality AS DOUBLE) AS clarity_score, CAST(5 - 4 * toxic AS DOUBLE) AS safety_score
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def label_join(spark, d):
    return joins.merge_labels(views.responses(spark, d).select("id", "category"), views.annotations(spark, d))


@add("j2_merged_dataset", W + views.SCORES_SQL + """
SELECT id, round(composite_score, 9) AS composite_score, CAST(1 + 4 * quality AS DOUBLE) AS clarity_score
FROM comp LEFT JOIN labels ON doc_id = id""")
def merged_dataset(spark, d):
    return joins.merged_dataset(views.three_scores(spark, d), views.annotations(spark, d)).select(
        "id", F.round("composite_score", 9).alias("composite_score"), "clarity_score")


@add("j3_prompt_response_pairs", W + views.PAIRS_SQL + "SELECT conv_id, turn, prompt, response FROM pairs")
def prompt_response_pairs(spark, d):
    return views.pairs(spark, d).select("conv_id", "turn", "prompt", "response")


STRATEGY_VALUES = ", ".join(
    f"({quote(n)}, {quote(s)}, {quote(t)}, {quote(x)})" for n, s, t, x in fixed.PROMPT_STRATEGIES)
STRATEGY_SQL = f"st(strategy, system_prompt, template, description) AS (VALUES {STRATEGY_VALUES})"


@add("j4_prompts_by_strategy", W + STRATEGY_SQL + """
SELECT conv_id, turn, text AS prompt, strategy, length(system_prompt) AS system_chars
FROM conversations, st WHERE role = 'user'""")
def prompts_by_strategy(spark, d):
    asked = views.table(spark, d, "conversations").where("role = 'user'").withColumnRenamed("text", "prompt")
    return joins.with_strategies(asked).select(
        "conv_id", "turn", "prompt", "strategy", F.char_length("system_prompt").cast("long").alias("system_chars"))


@add("j5_strategy_pairs", W + views.SCORES_SQL + """
, m AS (SELECT strategy, avg(composite_score) AS m FROM comp GROUP BY ALL)
SELECT a.strategy AS strategy_a, b.strategy AS strategy_b, round(a.m - b.m, 6) AS diff
FROM m a JOIN m b ON a.strategy < b.strategy""")
def strategy_pairs(spark, d):
    means = scores.with_composite(views.three_scores(spark, d)).groupBy("strategy").agg(F.avg("composite_score").alias("m"))
    return means.alias("a").join(means.alias("b"), F.col("a.strategy") < F.col("b.strategy")).select(
        F.col("a.strategy").alias("strategy_a"), F.col("b.strategy").alias("strategy_b"),
        F.round(F.col("a.m") - F.col("b.m"), 6).alias("diff"))


@add("j6_rows_not_taken", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def rows_not_taken(spark, d):
    return joins.without(views.responses(spark, d).select("id"), views.annotations(spark, d))


@add("u1_union_missing_columns", """
SELECT doc_id AS id, lang AS language, CAST(NULL AS INTEGER) AS quality FROM documents
UNION ALL SELECT doc_id, NULL, quality FROM labels""")
def union_missing_columns(spark, d):
    first = views.responses(spark, d).select("id", "language")
    second = views.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return joins.stack(first, second)


@add("u2_row_stacking", """
SELECT doc_id AS id, n_chars AS x FROM documents UNION ALL SELECT event_id, user_id FROM events""")
def row_stacking(spark, d):
    return views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("x")).unionAll(
        views.table(spark, d, "events").select("event_id", "user_id"))
