"""Aggregations, evaluation metrics, sorts and windows (A, E, O, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from qualitylab.catalog.base import Catalog, quote, words_sql
from qualitylab.functions import scores, text
from qualitylab.operators import eda, metrics, ordering, significance
from qualitylab.sources import views

catalog = Catalog()
add = catalog.add
COMP = "WITH " + views.SCORES_SQL
SCORED = "WITH " + views.SCORED_SQL
THREE = {"avg_humanity": "humanity_score", "avg_performance": "performance_score", "avg_helpfulness": "helpfulness_score"}
NUMERIC = [*THREE.values(), "composite_score"]


def comp(spark, d):
    return scores.with_composite(views.three_scores(spark, d))


@add("a1_category_summary", COMP + """
SELECT category, count(*) AS count, round(avg(humanity_score), 3) AS avg_humanity, round(avg(performance_score), 3) AS avg_performance,
 round(avg(helpfulness_score), 3) AS avg_helpfulness, round(avg(composite_score), 3) AS avg_composite FROM comp GROUP BY category""")
def category_summary(spark, d):
    return eda.group_summary(comp(spark, d), "category", {**THREE, "avg_composite": "composite_score"}, sort_by="avg_composite")


@add("a2_strategy_stats", COMP + """
SELECT strategy, round(avg(humanity_score), 3) AS avg_humanity, round(avg(performance_score), 3) AS avg_performance,
 round(avg(helpfulness_score), 3) AS avg_helpfulness, round(avg(composite_score), 3) AS avg_composite,
 round(stddev_samp(composite_score), 3) AS std_composite FROM comp GROUP BY strategy""")
def strategy_stats(spark, d):
    return eda.group_summary(comp(spark, d), "strategy", {**THREE, "avg_composite": "composite_score"},
                             {"std_composite": "composite_score"}, "avg_composite", count=None)


NAMES = [f"c{i}" for i in range(5)]


@add("a3_prompt_strategy_pivot", COMP + "SELECT prompt_id, " + ", ".join(
    f"round(avg(composite_score) FILTER (strategy = '{n}'), 2) AS {n}" for n in NAMES) + " FROM comp GROUP BY prompt_id")
def prompt_strategy_pivot(spark, d):
    return eda.pivot_means(comp(spark, d), "prompt_id", "strategy", "composite_score", NAMES)


@add("a4_value_counts", "SELECT source, count(*) AS count FROM documents GROUP BY source")
def value_counts(spark, d):
    return eda.value_counts(views.table(spark, d, "documents"), "source")


def _describe_sql(c: str) -> str:
    return (f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
 round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
 round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM comp""")


@add("a5_describe", COMP + " UNION ALL ".join(_describe_sql(c) for c in NUMERIC))
def describe(spark, d):
    return eda.describe(comp(spark, d), NUMERIC)


@add("a6_group_versus_all", COMP + """
SELECT category, round(avg(humanity_score), 6) AS avg_humanity_score, round(avg(composite_score), 6) AS avg_composite_score,
 round((SELECT avg(humanity_score) FROM comp), 6) AS overall_humanity_score, round((SELECT avg(composite_score) FROM comp), 6) AS overall_composite_score
FROM comp GROUP BY category""")
def group_versus_all(spark, d):
    out = eda.group_versus_all(comp(spark, d), "category", ["humanity_score", "composite_score"])
    return out.select("category", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@add("a7_error_by_category", SCORED + """
SELECT category, round(avg(abs(y_true - y_pred)), 3) AS mean, round(stddev_samp(abs(y_true - y_pred)), 3) AS std, count(*) AS count
FROM scored GROUP BY category""")
def error_by_category(spark, d):
    errors = metrics.residuals(views.scored(spark, d), ["category"])
    return eda.group_summary(errors, "category", {"mean": "abs_error"}, {"std": "abs_error"}, "mean")


@add("a8_correlation_matrix", COMP + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM comp" for a in NUMERIC for b in NUMERIC))
def correlation_matrix(spark, d):
    return eda.correlation_matrix(comp(spark, d), NUMERIC).select("a", "b", F.round("r", 6).alias("r"))


@add("a9_trend_line", f"""
WITH t AS (SELECT len({words_sql('text')}) AS x, n_chars AS y FROM documents)
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM t""")
def trend_line(spark, d):
    rows = views.table(spark, d, "documents").select(text.token_count(F.col("text")).alias("x"), F.col("n_chars").alias("y"))
    return eda.trend_line(rows, "x", "y").select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


def _histogram_sql(source: str, column: str, bins: int) -> str:
    return f"""
, m AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}),
e AS (SELECT CAST(i AS INTEGER) AS bin, lo + (hi - lo) * i / {bins} AS low, CASE WHEN i = {bins - 1} THEN hi ELSE lo + (hi - lo) * (i + 1) / {bins} END AS high
      FROM m, range({bins}) r(i))
SELECT bin, round(low, 6) AS low, round(high, 6) AS high,
  (SELECT count(*) FROM {source} WHERE {column} >= low AND ({column} < high OR bin = {bins - 1})) AS count FROM e"""


@add("a10_histogram", COMP + _histogram_sql("comp", "composite_score", 10))
def histogram(spark, d):
    return eda.histogram(comp(spark, d), "composite_score", 10).select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


@add("a10_residual_histogram", SCORED + ", res AS (SELECT y_true - y_pred AS error FROM scored)" + _histogram_sql("res", "error", 15))
def residual_histogram(spark, d):
    rows = metrics.residuals(views.scored(spark, d))
    return eda.histogram(rows, "error", 15).select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


@add("a11_box_plot", """
WITH q AS (SELECT event_type AS category, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY ALL),
i AS (SELECT q.*, value, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events JOIN q ON category = event_type)
SELECT category, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, min(value) FILTER (inside) AS whisker_low, max(value) FILTER (inside) AS whisker_high,
  count(*) FILTER (NOT inside) AS outliers FROM i GROUP BY ALL""")
def box_plot(spark, d):
    rows = views.table(spark, d, "events").select(F.col("event_type").alias("category"), "value")
    return eda.box_plot(rows, "category", "value").select("category", *[F.round(c, 6).alias(c) for c in ("q1", "med", "q3")], "whisker_low", "whisker_high", "outliers")


@add("a12_target_stats", COMP + """
SELECT round(avg(composite_score), 6) AS mean, round(stddev_samp(composite_score), 6) AS std, round(min(composite_score), 6) AS min, round(max(composite_score), 6) AS max FROM comp""")
def target_stats(spark, d):
    out = eda.target_stats(comp(spark, d), "composite_score")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@add("a13_distinct", "SELECT lang AS language, count(DISTINCT source) AS categories, count(DISTINCT text) AS texts FROM documents GROUP BY lang")
def distinct(spark, d):
    return views.responses(spark, d).groupBy("language").agg(
        F.count_distinct("category").alias("categories"), F.count_distinct(F.xxhash64("response"), F.md5("response")).alias("texts"))


@add("a14_label_balance", """
SELECT label, count(*) AS rows, round(count(*) / (SELECT count(*) FROM embeddings), 6) AS share,
  round(abs(count(*) / (SELECT count(*) FROM embeddings) - 1 / (SELECT count(DISTINCT label) FROM embeddings)), 6) AS deviation FROM embeddings GROUP BY label""")
def label_balance(spark, d):
    return eda.label_balance(views.table(spark, d, "embeddings"), "label").select(
        "label", "rows", F.round("share", 6).alias("share"), F.round("deviation", 6).alias("deviation"))


# --- evaluation ---------------------------------------------------------------------------
RES = "(y_true - y_pred)"
SIMPLE = {
    "e1_rmse": ("rmse", metrics.rmse, f"sqrt(avg({RES} * {RES}))"),
    "e2_mae": ("mae", metrics.mae, f"avg(abs({RES}))"),
    "e3_r2": ("r2", metrics.r2, f"1 - sum({RES} * {RES}) / (var_pop(y_true) * count(*))"),
    "e4_mape": ("mape", metrics.mape, f"avg(abs({RES} / y_true)) FILTER (y_true <> 0) * 100"),
    "e6_max_error": ("max_error", metrics.max_error, f"max(abs({RES}))"),
    "e7_pearson": ("pearson_r", metrics.pearson_r, "corr(y_true, y_pred)"),
    "e9_explained_variance": ("explained_variance", metrics.explained_variance, f"1 - var_pop({RES}) / var_pop(y_true)"),
}


def _simple(name, column, build, expression):
    @add(name, SCORED + f"SELECT round({expression}, 6) AS {column} FROM scored")
    def query(spark, d):
        return views.scored(spark, d).agg(F.round(build(), 6).alias(column))


for _name, _parts in SIMPLE.items():
    _simple(_name, *_parts)


@add("e5_medae", SCORED + f"SELECT round(median(abs({RES})), 6) AS medae FROM scored")
def medae(spark, d):
    rows = metrics.residuals(views.scored(spark, d))
    return ordering.exact_median(rows, [], "abs_error", "medae").select(F.round("medae", 6).alias("medae"))


def ranked_sql(partition: str = "") -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    both = f"{partition}, " if partition else ""
    return f"""
, rk AS (SELECT *, rank() OVER ({part}ORDER BY y_true) + (count(*) OVER (PARTITION BY {both}y_true) - 1) / 2 AS rt,
                   rank() OVER ({part}ORDER BY y_pred) + (count(*) OVER (PARTITION BY {both}y_pred) - 1) / 2 AS rp FROM scored)
"""


@add("e8_spearman", SCORED + ranked_sql() + "SELECT round(corr(rt, rp), 6) AS spearman_r FROM rk")
def spearman(spark, d):
    return ordering.spearman(views.scored(spark, d), [], "y_true", "y_pred").select(F.round("spearman_r", 6).alias("spearman_r"))


NINE = {
    "rmse": SIMPLE["e1_rmse"][2], "mae": SIMPLE["e2_mae"][2], "r2": SIMPLE["e3_r2"][2], "mape": SIMPLE["e4_mape"][2],
    "medae": f"median(abs({RES}))", "max_error": SIMPLE["e6_max_error"][2], "pearson_r": SIMPLE["e7_pearson"][2],
    "spearman_r": "corr(rt, rp)", "explained_variance": SIMPLE["e9_explained_variance"][2],
}


def nine_sql(digits: int) -> str:
    return "count(*) AS n, " + ", ".join(f"round({e}, {digits}) AS {n}" for n, e in NINE.items())


def _rounded(df, keys, digits):
    return df.select(*keys, "n", *[F.round(m, digits).alias(m) for m in metrics.METRICS])


@add("e10_all_metrics", SCORED + ranked_sql() + f"SELECT {nine_sql(6)} FROM rk")
def all_metrics(spark, d):
    return _rounded(metrics.regression_metrics(views.scored(spark, d)), [], 6)


@add("e11_ranking_alignment", SCORED + """
, p AS (SELECT y_true, row_number() OVER (ORDER BY y_pred DESC, id) AS r FROM scored QUALIFY r <= 10),
i AS (SELECT y_true, row_number() OVER (ORDER BY y_true DESC, id) AS r FROM scored QUALIFY r <= 10)
SELECT round((SELECT sum(y_true / log2(r + 1)) FROM p) / (SELECT sum(y_true / log2(r + 1)) FROM i), 6) AS ndcg""")
def ranking_alignment(spark, d):
    return metrics.ranking_alignment(views.scored(spark, d)).select(F.round("ndcg", 6).alias("ndcg"))


@add("e12_fairness", SCORED + f"""
, g AS (SELECT difficulty AS name, sqrt(avg({RES} * {RES})) AS value FROM scored GROUP BY ALL HAVING count(*) >= 2)
SELECT name, round(value, 6) AS value FROM g UNION ALL SELECT 'worst_group_rmse', round(max(value), 6) FROM g
UNION ALL SELECT 'rmse_gap', round(max(value) - min(value), 6) FROM g""")
def fairness(spark, d):
    return metrics.fairness(views.scored(spark, d), "difficulty").select("name", F.round("value", 6).alias("value"))


@add("e13_calibration_error", SCORED + """
, m AS (SELECT min(y_true) AS lo, max(y_true) AS hi FROM scored),
e AS (SELECT i AS bin, lo + i * ((hi - lo) / 10) AS low, CASE WHEN i = 9 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 10) END AS high FROM m, range(10) r(i)),
b AS (SELECT bin, count(*) AS n, avg(y_true) AS t, avg(y_pred) AS p FROM scored JOIN e ON y_true >= low AND y_true < high GROUP BY bin)
SELECT round(sum(n * abs(t - p) / (SELECT count(*) FROM scored)), 6) AS ece FROM b""")
def calibration_error(spark, d):
    return metrics.calibration_error(views.scored(spark, d)).select(F.round("ece", 6).alias("ece"))


@add("e14_score_bands", SCORED + f"""
, b AS (SELECT CASE WHEN y_true >= 1 AND y_true < 2 THEN '1-2' WHEN y_true >= 2 AND y_true < 3 THEN '2-3' WHEN y_true >= 3 AND y_true < 4 THEN '3-4'
         WHEN y_true >= 4 AND y_true < 5 THEN '4-5' END AS band, abs({RES}) AS e FROM scored)
SELECT band, round(avg(e), 4) AS mean_error, round(stddev_pop(e), 4) AS std_error, count(*) AS count,
  round(avg(CAST(e <= 0.5 AS DOUBLE)) * 100, 2) AS pct_within_0_5 FROM b WHERE band IS NOT NULL GROUP BY band""")
def score_bands(spark, d):
    return metrics.score_bands(views.scored(spark, d))


def student_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's t: Simpson's rule over the density from 0 to |t| (at most 40, beyond which nothing is left)."""
    density = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * ln(pi() * {df}) - ({df} + 1) / 2 * ln(1 + u * u / {df}))"
    nodes = f"SELECT i, i * least(abs({t}), 40) / 4000 AS u FROM range(4001) AS x(i)"
    weight = "CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"greatest(0.0, 1 - 2 * (SELECT sum({weight} * {density}) FROM ({nodes})) * least(abs({t}), 40) / 12000)"


def normal_sql(z: str) -> str:
    """The same of the normal distribution."""
    nodes = f"SELECT i, i * least(abs({z}), 40) / 4000 AS u FROM range(4001) AS x(i)"
    weight = "CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"greatest(0.0, 1 - 2 * (SELECT sum({weight} * exp(-u * u / 2)) FROM ({nodes})) / sqrt(2 * pi()) * least(abs({z}), 40) / 12000)"


DIFF = SCORED + ", df AS (SELECT abs(y_true - y_pred) - abs(y_true - y_pred_b) AS d FROM scored) "


@add("e15_paired_ttest", DIFF + "SELECT count(d) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 4) AS t_statistic FROM df")
def paired_ttest(spark, d):
    return significance.paired_ttest(views.scored(spark, d)).select("n", "t_statistic")


@add("e15_paired_ttest_p", DIFF + f"""
, s AS (SELECT count(d) AS n, CAST(count(d) - 1 AS DOUBLE) AS f, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t FROM df)
SELECT n, round(t, 4) AS t_statistic, round({student_sql('t', 'f')}, 6) AS p_value FROM s""")
def paired_ttest_p(spark, d):
    return significance.paired_ttest(views.scored(spark, d))


@add("e16_wilcoxon", DIFF + """
, r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS k FROM df WHERE d <> 0)
SELECT count(*) AS n, round(least(sum(k) FILTER (d > 0), sum(k) FILTER (d < 0)), 4) AS statistic FROM r""")
def wilcoxon(spark, d):
    return significance.wilcoxon(views.scored(spark, d)).select("n", "statistic")


@add("e16_wilcoxon_p", DIFF + f"""
, r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS k, count(*) OVER (PARTITION BY abs(d)) AS c FROM df WHERE d <> 0),
s AS (SELECT count(*) AS n, CAST(count(*) AS DOUBLE) AS m, least(sum(k) FILTER (d > 0), sum(k) FILTER (d < 0)) AS w, sum(c * c - 1.0) AS ties FROM r),
z AS (SELECT *, (w - m * (m + 1) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24) AS z FROM s)
SELECT n, round(w, 4) AS statistic, round({normal_sql('z')}, 6) AS p_value FROM z""")
def wilcoxon_p(spark, d):
    return significance.wilcoxon(views.scored(spark, d))


@add("e17_strategy_ttests", COMP + """
, s AS (SELECT strategy, count(*) AS n, avg(composite_score) AS m, var_samp(composite_score) AS v FROM comp GROUP BY ALL)
SELECT a.strategy AS strategy_a, b.strategy AS strategy_b, round(a.m - b.m, 3) AS mean_diff,
 round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)), 3) AS t_statistic
FROM s a JOIN s b ON a.strategy < b.strategy""")
def strategy_ttests(spark, d):
    return significance.pairwise_ttests(comp(spark, d)).drop("p_value", "significant")


@add("e17_strategy_ttests_p", COMP + f"""
, s AS (SELECT strategy, count(*) AS n, avg(composite_score) AS m, var_samp(composite_score) AS v FROM comp GROUP BY ALL),
t AS (SELECT a.strategy AS strategy_a, b.strategy AS strategy_b, a.m - b.m AS diff, CAST(a.n + b.n - 2 AS DOUBLE) AS f,
      (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t FROM s a JOIN s b ON a.strategy < b.strategy),
p AS (SELECT *, {student_sql('t', 'f')} AS p FROM t)
SELECT strategy_a, strategy_b, round(diff, 3) AS mean_diff, round(t, 3) AS t_statistic, round(p, 4) AS p_value, CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS significant FROM p""")
def strategy_ttests_p(spark, d):
    return significance.pairwise_ttests(comp(spark, d))


@add("e18_group_breakdown", SCORED + ranked_sql("category") + f"SELECT category, {nine_sql(4)} FROM rk GROUP BY category HAVING count(*) >= 2")
def group_breakdown(spark, d):
    return _rounded(metrics.group_breakdown(views.scored(spark, d), "category"), ["category"], 4)


ERRORS = {
    "mean_residual": f"round(avg({RES}), 4)", "std_residual": f"round(stddev_pop({RES}), 4)",
    "max_positive_error": f"round(max({RES}), 4)", "max_negative_error": f"round(min({RES}), 4)",
    "pct_within_0_5": f"round(avg(CAST(abs({RES}) <= 0.5 AS DOUBLE)) * 100, 2)",
    "pct_within_1_0": f"round(avg(CAST(abs({RES}) <= 1.0 AS DOUBLE)) * 100, 2)",
}


@add("e19_error_analysis", SCORED + "SELECT " + ", ".join(f"{e} AS {n}" for n, e in ERRORS.items()) + " FROM scored")
def error_analysis(spark, d):
    return metrics.error_analysis(views.scored(spark, d))


def _ends_sql(kind: str, order: str) -> str:
    return f"""(SELECT '{kind}' AS kind, id, substring(prompt, 1, 100) AS prompt, round(y_true, 2) AS actual, round(y_pred, 2) AS predicted,
 round(abs({RES}), 4) AS error FROM scored ORDER BY abs({RES}) {order}, id LIMIT 5)"""


@add("e20_extreme_predictions", SCORED + _ends_sql("worst", "DESC") + " UNION ALL " + _ends_sql("best", "ASC"))
def extreme_predictions(spark, d):
    return metrics.extreme_predictions(views.scored(spark, d))


def _scope_sql(scope: str, column: str | None) -> str:
    group = column or "'all'"
    return (f"SELECT '{scope}' AS scope, {group} AS grp, CAST(count(*) AS DOUBLE) AS n, "
            + ", ".join(f"round({e.replace('rt, rp', f'rt_{scope}, rp_{scope}')}, 4) AS {n}" for n, e in NINE.items())
            + f" FROM rk GROUP BY ALL HAVING count(*) >= 2")


def _rank_columns() -> str:
    out = []
    for scope, part in (("global", ""), ("category", "category"), ("difficulty", "difficulty")):
        for side, y in (("rt", "y_true"), ("rp", "y_pred")):
            by = f"PARTITION BY {part} " if part else ""
            tie = f"{part}, {y}" if part else y
            out.append(f"rank() OVER ({by}ORDER BY {y}) + (count(*) OVER (PARTITION BY {tie}) - 1) / 2 AS {side}_{scope}")
    return ", ".join(out)


REPORT_SQL = (
     SCORED + f", rk AS (SELECT *, {_rank_columns()} FROM scored), "
     + "wide AS (" + " UNION ALL ".join(_scope_sql(s, c) for s, c in (("global", None), ("category", "category"), ("difficulty", "difficulty"))) + "), "
     + "er AS (SELECT 'errors' AS scope, 'all' AS grp, " + ", ".join(f"{e} AS {n}" for n, e in ERRORS.items()) + " FROM scored) "
     + "SELECT 'user mean' AS model, scope, grp, metric, value FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE (scope, grp)) INTO NAME metric VALUE value) "
     + "UNION ALL SELECT 'user mean', scope, grp, metric, value FROM (UNPIVOT er ON COLUMNS(* EXCLUDE (scope, grp)) INTO NAME metric VALUE value)")


@add("e21_evaluation_report", REPORT_SQL)
def evaluation_report(spark, d):
    return metrics.evaluation_report(views.scored(spark, d), "user mean")


SHOWN = ["n", "rmse", "mae", "r2", "mape", "mean_residual", "std_residual", "pct_within_0_5", "pct_within_1_0"]


@add("e22_report_summary", f"SELECT * FROM ({REPORT_SQL}) WHERE metric IN ({', '.join(map(quote, SHOWN))})")
def report_summary(spark, d):
    report = metrics.evaluation_report(views.scored(spark, d), "user mean")
    return report.where(F.col("metric").isin(SHOWN)).orderBy("scope", "grp", "metric")


@add("e23_residuals", SCORED + f"""
SELECT id, category, difficulty, round(y_true, 9) AS actual, round(y_pred, 9) AS predicted, round({RES}, 9) AS error, round(abs({RES}), 9) AS abs_error FROM scored""")
def residuals(spark, d):
    out = metrics.residuals(views.scored(spark, d), ["id", "category", "difficulty"])
    return out.select(*out.columns[:3], *[F.round(c, 9).alias(c) for c in out.columns[3:]])


# --- sorts, top-k and windows ---------------------------------------------------------------
@add("o1_sort_by_metric", COMP + "SELECT prompt_id, round(avg(composite_score), 6) AS score FROM comp GROUP BY ALL")
def sort_by_metric(spark, d):
    return comp(spark, d).groupBy("prompt_id").agg(F.round(F.avg("composite_score"), 6).alias("score")).orderBy(F.desc("score"), "prompt_id")


@add("o2_head", "SELECT doc_id AS id, source AS category FROM documents ORDER BY doc_id LIMIT 5")
def head(spark, d):
    return ordering.top(views.responses(spark, d).select("id", "category"), 5, "id")


@add("o3_top_and_bottom", COMP + """
(SELECT 'top' AS side, id, round(composite_score, 6) AS score FROM comp ORDER BY composite_score DESC, id LIMIT 10)
UNION ALL (SELECT 'bottom', id, round(composite_score, 6) FROM comp ORDER BY composite_score, id LIMIT 10)""")
def top_and_bottom(spark, d):
    rows = comp(spark, d)
    ends = [ordering.top(rows, 10, order, "id").select(F.lit(side).alias("side"), "id", F.round("composite_score", 6).alias("score"))
            for side, order in (("top", F.desc("composite_score")), ("bottom", F.asc("composite_score")))]
    return ends[0].union(ends[1])


@add("o4_most_common", "SELECT event_type, count(*) AS count FROM events GROUP BY ALL ORDER BY count DESC, event_type LIMIT 3")
def most_common(spark, d):
    return eda.value_counts(views.table(spark, d, "events"), "event_type").limit(3)


@add("o5_arg_max", COMP + "SELECT strategy, round(avg(composite_score), 6) AS score FROM comp GROUP BY ALL ORDER BY score DESC, strategy LIMIT 1")
def arg_max(spark, d):
    means = comp(spark, d).groupBy("strategy").agg(F.round(F.avg("composite_score"), 6).alias("score"))
    return ordering.arg_max(means, "strategy", "score")


@add("w1_average_ranks", """
SELECT event_id AS id, event_type AS grp, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS avg_rank FROM events""")
def average_ranks(spark, d):
    rows = views.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("grp"), "value")
    return ordering.placed(rows.dropna(), "value", {"": ["grp"]}, "_v").select("id", "grp", ordering.place_rank("_v").alias("avg_rank"))


@add("w2_row_position", COMP + "SELECT id, row_number() OVER (ORDER BY composite_score DESC, id) AS position FROM comp")
def row_position(spark, d):
    rows = comp(spark, d).select("id", "composite_score")
    return ordering.with_running_sum(rows, [F.desc("composite_score"), F.col("id")], None, "row").select("id", (F.col("row") + 1).alias("position"))


@add("w3_running_total", "SELECT doc_id AS id, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS upto FROM documents")
def running_total(spark, d):
    rows = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return ordering.with_running_sum(rows, ["id"], "n_chars", "before").select("id", (F.col("before") + F.col("n_chars")).alias("upto"))
