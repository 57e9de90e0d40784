"""Removal of boilerplate lines: those that stand on many sites.

A line is keyed by 128 bits of hash of its trimmed text. Each key's sites go into a HyperLogLog sketch; the
sketches of partitions merge by aggregation, so a line on all sites is one small row per task, not a group.
Estimates well below the threshold settle a line as rare, those well above as boilerplate; lines in
between, within ``MARGIN`` of the threshold, get their distinct sites counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualitylab.llm.shared import fresh, written

MIN_SITES = 8
#: log2 of a sketch's registers; share of the threshold within which an estimate is not trusted
#: (over 4 times the standard error of 1.04 / sqrt(2^LG_K)).
LG_K, MARGIN = 10, 0.15


def trimmed(line: Column) -> Column:
    """A line without white space at its ends."""
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def keyed_lines(docs: DataFrame, row: list[str], site_col: str, text_col: str) -> DataFrame:
    """Every line with text: ``row`` columns, ``site_``, ``at_`` (its number from 0) and its key ``a_``, ``b_``."""
    lines = docs.select(*row, F.col(site_col).cast("string").alias("site_"),
                        F.posexplode(F.split(text_col, "\n", -1)).alias("at_", "line_"))
    lines = lines.withColumn("line_", trimmed(F.col("line_"))).filter(F.col("line_") != "")
    return lines.select(*row, "site_", "at_", F.xxhash64("line_").alias("a_"),
                        F.xxhash64(F.lit(1), "line_").alias("b_"))


def boilerplate_keys(lines: DataFrame, min_sites: int) -> DataFrame:
    """Keys of the lines on at least ``min_sites`` sites; rows without a site count for none."""
    sited = lines.filter(F.col("site_").isNotNull()).select("a_", "b_", "site_")
    spread = sited.groupBy("a_", "b_").agg(
        F.min("site_").alias("low"), F.max("site_").alias("high"), F.hll_sketch_agg("site_", LG_K).alias("sketch"))
    if min_sites > 1:
        spread = spread.filter(F.col("low") != F.col("high"))
    judged = written(
        spread.select("a_", "b_", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= min_sites * (1 - MARGIN)), "line-sites")
    clear = judged.filter(F.col("sites") > min_sites * (1 + MARGIN)).select("a_", "b_")
    near = judged.filter(F.col("sites") <= min_sites * (1 + MARGIN)).select("a_", "b_")
    counted = (sited.join(near, ["a_", "b_"], "left_semi").groupBy("a_", "b_", "site_").count()
               .groupBy("a_", "b_").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites))
    return clear.union(counted.select("a_", "b_"))


def without_places(lines: Column, gone: Column) -> Column:
    """The text of an array of lines without those at the places ``gone`` (sorted, from 0): the runs between them, each copied once, so the
    cost follows the lines and not the lines times the places."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g + 1))

    def runs(own: Column) -> Column:
        ends = F.concat(gone, F.array(F.size(own)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(own, s + 1, e - s))), "\n")

    return F.element_at(F.transform(F.array(lines), runs), 1)  # the lines are split once, as the lambda's variable


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", site_col: str = "source",
                        text_col: str = "text") -> DataFrame:
    """One row for each id and text: id, ``n_lines`` (all lines), ``n_removed`` and ``kept``, the text without
    the lines that stand, trimmed, on at least ``min_sites`` distinct sites.

    Lines without text never count as boilerplate and stay. Null texts have no lines and stay null; empty ones
    have one, empty, line. A line on one site alone never goes, however often it stands there. Rows with a null
    site take part but add no site. Repeated rows count once for a site and come out as often as they came in.
    Columns other than id, site and text are not read.
    """
    rows = docs.select(F.col(id_col), F.col(site_col).alias(fresh("site", id_col)), F.col(text_col).alias(fresh("text", id_col)))
    site, text = rows.columns[1:]
    rows = rows.withColumn("key_", F.xxhash64(F.col(id_col), F.col(text)))
    lines = keyed_lines(rows, ["key_"], site, text)
    gone = (lines.join(boilerplate_keys(lines, min_sites), ["a_", "b_"], "left_semi")
            .groupBy("key_").agg(F.collect_set("at_").alias("gone_")))
    split = F.split(F.col(text), "\n", -1)
    none = F.array().cast("array<int>")
    joined = rows.join(gone, "key_", "left").withColumn("gone_", F.array_sort(F.coalesce("gone_", none)))
    return joined.select(
        F.col(id_col),
        F.coalesce(F.when(F.col(text).isNotNull(), F.size(split)), F.lit(0)).cast("long").alias("n_lines"),
        F.size("gone_").cast("long").alias("n_removed"),
        F.when(F.size("gone_") == 0, F.col(text)).otherwise(without_places(split, F.col("gone_"))).alias("kept"),
    )
