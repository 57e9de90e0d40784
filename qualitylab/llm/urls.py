"""Verdicts on URLs by rules, and where none fits by the labelled purity of path templates.

Every host has a tree of path segments. Segments that vary become wildcards: digits first, then segments seen too
rarely under their parent. From the deepest level up, branches whose labelled rate does not differ
significantly from that of their siblings together are merged into one. What is left are the host's templates;
each is judged by its share of good labels, smoothed by the host's share, which is smoothed by that of all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualitylab.llm.shared import written

#: Pages that a literal segment needs; z beyond which branches differ; pages' worth of prior; purity under
#: which a template is blocked.
MIN_PAGES, Z, PRIOR, PURITY = 5, 2.0, 5.0, 0.5
WILD = "*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host (and its subdomains) with the start of a path, and what to do."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and for what has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """All segments of a path, digits as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(s, "[0-9]+", r"\*"))


def deepest(rows: DataFrame, column: str) -> int:
    """Segments of the longest array in ``column``; 0 without rows."""
    return rows.agg(F.coalesce(F.max(F.size(column)), F.lit(0))).first()[0]


def common_start(a: Column, b: Column) -> Column:
    """Number of segments that two paths share from their start on."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def last_level(levels: Column) -> Column:
    """The last of ``levels``, 0 if there is none."""
    return F.coalesce(F.get(levels, F.size(levels) - 1), F.lit(0))


def generalised(shapes: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``shapes`` (rows of ``host``, ``shape``, ``n`` and more) with ``template``, in which every segment that has under
    ``min_pages`` pages below its parent is a wildcard, and ``levels``, the numbers of segments at which it parted from other templates
    of its host. No template parts from it beyond the last of them.

    A round settles what it can at once: below a node of too few pages all is wild, a node with one template is done, and
    segments that all paths of a node share are passed in one step. So there are as many rounds as branchings on one path, not
    as segments, and each reads open rows only. A round is a written table.
    """
    todo = shapes.withColumn("template", F.col("shape")).withColumn("levels", F.array().cast("array<int>"))
    keep, settled = shapes.columns, []
    while not settled or not todo.isEmpty():
        rows = todo.withColumn("at", last_level(F.col("levels"))).withColumn("node", F.slice("template", F.lit(1), F.col("at")))
        nodes = rows.groupBy("host", "node").agg(F.sum("n").alias("total"), F.min("template").alias("lo"), F.max("template").alias("hi"))
        nodes = nodes.select("host", "node", (F.col("total") < min_pages).alias("few"), (F.col("lo") == F.col("hi")).alias("one"),
                             common_start(F.col("lo"), F.col("hi")).alias("shared"))
        rows = rows.join(nodes, ["host", "node"]).withColumn("start", F.slice("template", F.lit(1), F.col("shared"))).withColumn(
            "own", F.get("template", F.col("shared")))
        ended = F.size("template") == F.col("shared")
        children = rows.filter(~F.col("few") & ~F.col("one") & ~ended).groupBy("host", "start", "own").agg(F.sum("n").alias("pages"))
        rare = children.filter((F.col("own") != WILD) & (F.col("pages") < min_pages)).select("host", "start", "own", F.lit(True).alias("rare"))
        rows = rows.join(rare, ["host", "start", "own"], "left")
        rest = F.size("template") - F.col("at")
        step = rows.select(
            *keep,
            F.when(F.col("few"), F.concat("node", F.array_repeat(F.lit(WILD), rest)))
            .when(F.col("rare"), F.concat("start", F.array(F.lit(WILD)), F.slice("template", F.col("shared") + 2, F.size("template"))))
            .otherwise(F.col("template")).alias("template"),
            (F.col("few") | F.col("one") | ended).alias("done"), "levels", "shared").select(
            *keep, "template", "done", F.when(F.col("done"), F.col("levels")).otherwise(F.concat("levels", F.array(F.col("shared") + 1))).alias("levels"))
        step = written(step, "generalised")
        settled.append(step.filter("done").drop("done"))
        todo = step.filter("NOT done").drop("done")
    out = settled[0]
    for part in settled[1:]:
        out = out.union(part)
    return out


def merged_branches(templates: DataFrame, z: float = Z) -> DataFrame:
    """``templates`` (``host``, ``template``, ``levels``, ``labelled``, ``good``) with ``branch``, the node that each ends in, and the
    node's own sums. A node moves up to its parent if its share of good labels is within ``z`` standard errors of its
    siblings' common share, or if it has no labels. A node without siblings always does, so only ``levels`` are looked at: siblings
    parted at the same of them."""
    branch = F.slice("template", F.lit(1), last_level(F.col("levels")))
    rows = templates.withColumn("branch", branch)
    for place in range(deepest(templates, "levels"), 0, -1):
        above = F.slice("branch", F.lit(1), F.coalesce(F.get("levels", F.lit(place - 2)), F.lit(0)) if place > 1 else F.lit(0))
        nodes = rows.filter(F.size("levels") == place).groupBy("host", "branch", above.alias("parent")).agg(
            F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
        siblings = nodes.groupBy("host", "parent").agg((F.sum("good") / F.nullif(F.sum("labelled"), F.lit(0))).alias("share"))
        judged = nodes.join(siblings, ["host", "parent"])
        error = F.sqrt(F.col("share") * (1 - F.col("share")) / F.nullif("labelled", F.lit(0)))
        same = (F.col("labelled") == 0) | (F.abs(F.col("good") / F.nullif("labelled", F.lit(0)) - F.col("share")) <= z * error)
        ups = judged.filter(same).select("host", "branch", F.lit(place).alias("up"))
        rows = rows.join(ups, ["host", "branch"], "left").withColumn(
            "levels", F.when(F.col("up") == F.size("levels"), F.slice("levels", 1, place - 1)).otherwise(F.col("levels")))
        rows = written(rows.drop("up").withColumn("branch", branch), "merged")
    return rows


def judged_branches(rows: DataFrame, prior: float = PRIOR) -> DataFrame:
    """Rows of ``merged_branches`` with ``purity``: the branch's share of good labels, smoothed by its host's,
    which is smoothed by the share of all (1 without any label)."""
    branches = rows.groupBy("host", "branch").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    hosts = branches.groupBy("host").agg(F.sum("labelled").alias("of_host"), F.sum("good").alias("good_of_host"))
    every = hosts.agg(F.coalesce(F.sum("good_of_host") / F.nullif(F.sum("of_host"), F.lit(0)), F.lit(1.0)).alias("base"))
    base = F.lit(every.first()[0])
    host = (F.col("good_of_host") + prior * base) / (F.col("of_host") + prior)
    purity = (F.col("good") + prior * host) / (F.col("labelled") + prior)
    joined = branches.join(hosts, "host").select("host", "branch", purity.alias("purity"))
    return rows.drop("labelled", "good", "levels").join(joined, ["host", "branch"])


def judged_urls(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", good_col: str = "good",
                rules: tuple[Rule, ...] = RULES, purity: float = PURITY, min_pages: int = MIN_PAGES, z: float = Z,
                prior: float = PRIOR) -> DataFrame:
    """One row for each row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict`` and ``template`` (the branch that the
    method ends in).

    ``labelled`` gives ids and whether they are good (boolean; null is no label); an id with several
    labels is good if all are. Null urls and urls without ``://`` have an empty host and path and are judged as the
    host ``''``. ``min_pages`` is what a literal segment needs, ``z`` the errors beyond which branches differ, ``prior`` the pages' worth
    of smoothing, ``purity`` the share of good labels under which a template is blocked. Repeated rows are judged one by one and count as often. Without labels nothing is blocked but by rules.
    Columns other than id and url are not read.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id_"), host.alias("host"), path.alias("path"))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = written(rows.withColumns({"rule": name, "ruled": verdict, "shape": shape(F.col("path"))}), "url-shapes")
    marks = labelled.filter(F.col(good_col).isNotNull()).groupBy(F.col(id_col).alias("id_")).agg(F.min(good_col).alias("good_"))
    marked = rows.select("id_", "host", "shape").join(marks, "id_", "left")
    known = F.col("good_").isNotNull()
    shapes = marked.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.sum(known.cast("long")).alias("labelled"), F.sum(F.coalesce(F.col("good_"), F.lit(False)).cast("long")).alias("good"))
    templates = generalised(written(shapes, "shapes"), min_pages)
    judged = written(judged_branches(merged_branches(templates, z), prior).select("host", "shape", "branch", "purity"), "purity")
    own = F.when(F.col("purity") < purity, "block").otherwise("allow")
    return rows.join(judged, ["host", "shape"]).select(
        F.col("id_").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("branch", "/")).alias("template"))
