"""Readers with declared schemas. A missing input is an error, as Spark raises it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qualitylab.functions import scores

SCHEMAS = {
    "responses": "id string, prompt string, response string, category string, difficulty string, "
                 "language string, timestamp timestamp_ntz, humanity_score double, "
                 "performance_score double, helpfulness_score double",
    "annotations": "id string, safety_score double, fairness_score double, clarity_score double, "
                   "annotator_id string",
    "labelled_text": "text string, label string, split string, confidence double, lang string, "
                     "augmented boolean",
    "test_text": "text string, label string, confidence_source string",
    "label_info": "label string, description string, example_keywords string, "
                  "parent_domain string, num_examples_train int",
    "sample_text": "text string, label string, domain_source string, annotation_round int",
    "prompts": "id string, input string, domain string, intent string, complexity string",
    "answers": "id string, prompt_id string, output string, quality string, verified boolean",
    "air_quality": "region string, air_quality_index int, status string",
    "co2": "country string, co2_emissions double, year int, co2_per_capita double, "
           "population_millions double, region string, emission_level string, data_quality string",
    "education": "country string, literacy_rate double, school_enrollment double",
    "health": "country string, life_expectancy int, health_index double",
}


def read_csv(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """Typed CSV with a header. Files split over tasks unless values hold line breaks. Empty cells are null, and so are
    numbers written as ``NaN``."""
    schema = SCHEMAS.get(schema, schema)
    return scores.nan_to_null(spark.read.csv(
        path, header=True, schema=schema, multiLine=multiline, quote='"', escape='"', enforceSchema=False,
    ))


#: The rest of a JSON string that began earlier, and what stands before the first brace outside strings.
_STRING_END = r'(?s)^(?:[^"\\]++|\\.)*+"'
_BEFORE_RECORD = r'(?s)^(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """The top-level objects of JSON files as ``record`` texts, however the files are laid out: arrays of records on one line or many,
    one record per line, or a single one. Large files split over tasks.

    Files are cut at every ``}``. Whether a cut lies inside a string, and how deep, follows from the quotes and braces before it:
    sums inside each split, for both states that a split may begin in, then sums over the splits, one row each. A record in
    one piece is complete where it stands; the pieces of others meet by record. Elements other than objects are left out.
    """
    split = ["file", "start"]
    here = Window.partitionBy(*split).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)

    pieces = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    opened = lambda odd: F.aggregate(  # noqa: E731  braces in the pieces between quotes, every other one
        F.filter("pieces", lambda _, i: i % 2 == odd), F.lit(0), lambda n, s: n + F.char_length(s) - F.char_length(F.replace(s, F.lit("{"))))
    cut = spark.read.text(path, lineSep="}").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), pieces.alias("pieces"))
    cut = cut.select("value", *split, "at", (F.size("pieces") - 1).alias("quotes"), opened(0).alias("even"), opened(1).alias("odd"))
    cut = cut.withColumn("after", F.sum("quotes").over(here) % 2).withColumn("before", (F.col("after") + F.col("quotes")) % 2)
    for state in (0, 1):
        inside = (F.col("before") + state) % 2
        closed = F.when((F.col("after") + state) % 2 == 0, 1).otherwise(0)
        cut = cut.withColumn(f"change{state}", F.when(inside == 0, F.col("even")).otherwise(F.col("odd")) - closed)
    cut = cut.withColumns({f"depth{state}": F.sum(f"change{state}").over(here) for state in (0, 1)})

    splits = cut.groupBy(*split).agg(*[F.sum(c).alias(c) for c in ("quotes", "change0", "change1")])
    splits = splits.withColumn("state", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    own = F.when(F.col("state") == 0, F.col("change0")).otherwise(F.col("change1"))
    splits = splits.withColumn("own", own).select(*split, "state", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("depth"))

    known = cut.join(splits, split).withColumn("change", own).withColumn(
        "depth", F.col("depth") + F.when(F.col("state") == 0, F.col("depth0")).otherwise(F.col("depth1")))
    closes = F.when((F.col("after") + F.col("state")) % 2 == 0, 1).otherwise(0)
    at_top, opens = F.col("depth") == F.col("change"), F.col("change") + closes > 0
    rest = F.when((F.col("before") + F.col("state")) % 2 == 1, F.regexp_replace("value", _STRING_END, "")).otherwise(F.col("value"))
    known = known.select(
        "value", *split, "at", (at_top & opens).alias("begins"), ((F.col("depth") == 0) & (closes == 1)).alias("ends"),
        (~at_top | opens).alias("inside"), F.when(at_top & opens, F.regexp_replace(rest, _BEFORE_RECORD, "")).alias("from_brace"))

    whole = known.where("begins and ends").select(F.concat("from_brace", F.lit("}")).alias("record"))
    parts = known.where("inside and not (begins and ends)").withColumn("begun", F.count_if("begins").over(here))
    last = parts.groupBy(*split).agg(F.max("begun").alias("last")).withColumn(
        "open", F.last(F.when(F.col("last") > 0, F.struct("start", "last")), ignorenulls=True).over(earlier))
    record = F.when(F.col("begun") > 0, F.struct("start", F.col("begun").alias("last"))).otherwise(F.col("open"))
    text = F.coalesce("from_brace", "value")
    long = parts.join(last.select(*split, "open"), split).groupBy("file", record.alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("start", "at", text.alias("text")))).alias("parts"))
    return whole.union(long.select(F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), "}"), F.lit("}"))))


def read_json(spark: SparkSession, path: str, schema: str, records: bool = True) -> DataFrame:
    """An array of records per file, or one record per line with ``records=False``; both split over tasks."""
    schema = SCHEMAS.get(schema, schema)
    if records:
        return json_records(spark, path).select(F.from_json("record", schema).alias("r")).select("r.*")
    return spark.read.json(path, schema=schema)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """What ``writers.write_report`` wrote, as one tidy report: model, scope, group, metric, value."""
    groups = spark.read.schema("grp string, metrics map<string, double>, model string, scope string").json(path)
    return groups.select("model", "scope", "grp", F.explode("metrics").alias("metric", "value"))


def read_corpus(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """One row per line, or per file with ``whole``, as ``value``."""
    return spark.read.text(path, wholetext=whole)


def corpus_size(corpus: DataFrame) -> DataFrame:
    """Lines and characters; a line break counts one character."""
    return corpus.agg(
        F.count(F.lit(1)).alias("lines"),
        F.coalesce(F.sum(F.char_length("value") + 1), F.lit(0)).alias("characters"),
    )


def load_all(
    spark: SparkSession, train: str, test: str, labels: str,
    schema: str = "responses", label_schema: str = "annotations",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train and test with the composite target, and labels."""
    return (
        scores.with_composite(read_csv(spark, train, schema)),
        scores.with_composite(read_csv(spark, test, schema)),
        read_csv(spark, labels, label_schema),
    )


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("dataset"), "rows")
             for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def join_indicators(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Equi-join of two indicator tables on a country or region."""
    return first.join(second, key)
