"""The package's queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualitylab.llm import classifier, codes, decontaminate, jaccard, lines, mixing, nearest, negatives, rules, secrets, sharding, tokens, urls


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"), limit=1024)


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secrets(table(spark, folder, "documents"))
    base = ("assign", "access", "hex")
    counts = [F.size(secrets.of_kinds(F.col("found"), kind)).cast("long").alias(f"n_{kind}") for kind in base]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("found"), base), 256).alias("base_sha256"),
                        secrets.joined(F.col("found")).alias("spans"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.without_boilerplate(table(spark, folder, "documents"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_sources(table(spark, folder, "documents"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents"), shards=8)


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A page was made of the document whose number ends its path; that document's labels are the page's."""
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    number = F.regexp_extract(urls.url_parts(F.col("url"))[1], "/([0-9]+)[^/]*/?$", 1).try_cast("long")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    labelled = pages.select("page_id", number.alias("doc_id")).join(labels.select("doc_id", good.alias("good")), "doc_id")
    return urls.judged_urls(pages, labelled)


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_sets(table(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    book = rules.ledger(table(spark, folder, "documents"))
    return book.select("doc_id", *rules.MEASURES, "failed", (~rules.passes(rules.BASE)).alias("base_failed"),
                       rules.passes(rules.POLICY).alias("kept"))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.classified(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.7)


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compressed(table(spark, folder, "embeddings"))


def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_secret_scan, op3_line_dedup, op4_decontamination, op5_source_mix, op6_sharding, op7_url_filter,
    op8_jaccard_join, op9_quality_rules, op10_quality_classifier, op11_vector_codes, op12_nearest_neighbours, op13_hard_negatives)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = r"[^\x20\x09-\x0D]+"


def _windows(relation: str, row: str, width: str) -> str:
    """Every run of ``width`` words of ``relation`` (columns ``row`` and ``w``): where it starts and its words as one string."""
    return (f"SELECT {row}, i, array_to_string(w[i:i + {width} - 1], ' ') AS g FROM {relation}, "
            f"unnest(range(1, len(w) - {width} + 2)) AS u(i)")


_LINES = rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
           FROM documents),
t AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS core FROM l),
b AS (SELECT core FROM t WHERE core <> '' GROUP BY core HAVING count(DISTINCT source) >= {lines.MIN_SITES})
SELECT doc_id, count(*) AS n_lines, count(b.core) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.core IS NULL), '') AS kept
FROM t LEFT JOIN b USING (core) GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL"""

_CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, w, least({decontaminate.WIDTH}, len(w)) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, g FROM (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM k, unnest(range(1, len(w) - n + 2)) AS u(i))),
o AS (SELECT doc_id, i, o.n, array_to_string(w[i:i + o.n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM k) AS o, unnest(range(1, len(w) - o.n + 2)) AS u(i)),
h AS (SELECT doc_id, i, o.n, item_id FROM o JOIN g ON o.g = g.g AND o.n = g.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""

_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_BLANKS}'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM ({_windows('(SELECT * FROM d WHERE len(w) > 0)', 'doc_id', f'least({jaccard.SHINGLE}, len(w))')})),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {jaccard.PERCENT} * (nx.n + ny.n - c)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id"""

_FAILED = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(rules.RULES.values()))
_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_BLANKS}') AS w FROM documents),
g AS ({_windows('d', 'doc_id', str(rules.REPEAT_WIDTH))}),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM t, unnest(range(i, i + {rules.REPEAT_WIDTH})) AS u(p) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_BLANKS}') GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST({_FAILED} AS BIGINT) AS failed FROM m)
SELECT *, failed & {rules.BASE.mask} <> 0 AS base_failed, failed & {rules.POLICY.mask} = 0 AS kept FROM f"""

_WHOLE_VECTORS = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _scaled(factor: int) -> str:
    return f"list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT))"


def _codes() -> str:
    """Lloyd's rounds as one chain of tables: parts ``p``, codebooks ``c0``, ``c1``, ..., members ``a0``, ``a1``, ..."""
    n, step = codes.PARTS, f"(len(v) // {codes.PARTS})"
    chain = [f"v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, * FROM (SELECT vec_id, label, {_scaled(codes.SCALE)} AS v FROM embeddings WHERE {_WHOLE_VECTORS}))",
             f"p AS MATERIALIZED (SELECT r, pos, v[pos * {step} + 1 : (pos + 1) * {step}] AS p FROM v, range({n}) AS u(pos))",
             f"c0 AS MATERIALIZED (SELECT pos, r - 1 AS e, p AS c FROM p WHERE r <= {codes.ENTRIES})"]
    for i in range(codes.ROUNDS + 1):
        chain.append(f"a{i} AS MATERIALIZED (SELECT r, pos, min(list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 256 + e) AS m FROM p JOIN c{i} USING (pos) GROUP BY r, pos)")
        chain.append(f"s{i} AS (SELECT pos, m % 256 AS e, k, CAST(floor(sum(p[k]) / count(*)) AS BIGINT) AS x FROM a{i} JOIN p USING (r, pos), unnest(range(1, len(p) + 1)) AS u(k) GROUP BY ALL)")
        chain.append(f"c{i + 1} AS MATERIALIZED (SELECT c.pos, c.e, coalesce(any_value(s.c), c.c) AS c FROM c{i} AS c LEFT JOIN (SELECT pos, e, list(x ORDER BY k) AS c FROM s{i} GROUP BY pos, e) AS s USING (pos, e) GROUP BY c.pos, c.e, c.c)")
    last = codes.ROUNDS
    chain.append(f"o AS (SELECT r, string_agg(lower(printf('%02x', m % 256)), '' ORDER BY pos) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{last} GROUP BY r)")
    chain.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM c{last})")
    return ("WITH " + ",\n".join(chain) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 "
            "FROM o JOIN v USING (r), h")


_NEGATIVES = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_scaled(negatives.SCALE)} AS v
           FROM embeddings WHERE label IS NOT NULL AND {_WHOLE_VECTORS}),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, b.r AS row,
             CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, row) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.r, place ORDER BY s.score DESC, s.vec_id, s.row) AS rank
      FROM p JOIN s ON s.r = p.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
      WHERE place <= {negatives.POSITIVES})
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives.NEGATIVES}"""

SQL = {"op3_line_dedup": _LINES, "op4_decontamination": _CONTAMINATION, "op8_jaccard_join": _JACCARD, "op9_quality_rules": _RULES,
       "op11_vector_codes": _codes(), "op13_hard_negatives": _NEGATIVES}
