"""URL filters by a path-template tree.

Every host has a tree of path segments. Segments without support become wildcards, sibling
branches whose labelled pages look alike are merged, and each template's share of blocked pages is
smoothed towards that of the same template on all hosts and from there towards the whole.
Templates whose smoothed purity is too low are rejected. Pages that a rule decides are the labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import discard, materialise, table

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SUPPORT, WIDE_SHARE = 5, 0.01
STRENGTH, MIN_PURITY, SIMILAR_Z = 8.0, 0.5, 1.96
WILD = "*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest fitting rule's (rule, verdict), else null. Rules are a short, bounded list."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _generalise(paths: DataFrame) -> DataFrame:
    """Rows (host, segments, pages, ...) with their template: level by level, a segment stays if it has support
    below its parent's template on its host, or at its level over all hosts. Levels go on until fewer pages than
    support takes have a further segment; what is deeper is all wildcards."""
    grown = paths.withColumn("template", F.lit(""))
    total = paths.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    level, left, done = 0, total, []
    while left >= SUPPORT:
        done.append(grown.where(F.size("segments") <= level))
        here = grown.where(F.size("segments") > level).withColumn("segment", F.get("segments", F.lit(level)))
        counts = materialise(here.groupBy("host", "template", "segment").agg(F.sum("pages").alias("n")), "segments")
        own = counts.where(F.col("n") >= SUPPORT).select("host", "template", "segment", F.lit(True).alias("supported"))
        wide = counts.groupBy("segment").agg(F.sum("n").alias("n")).where(F.col("n") >= max(SUPPORT, WIDE_SHARE * total)).select("segment", F.lit(True).alias("wide"))
        # at most 1 / WIDE_SHARE segments can be wide
        joined = here.join(own, ["host", "template", "segment"], "left").join(F.broadcast(wide), "segment", "left")
        kept = F.coalesce("supported", "wide", F.lit(False))
        step = F.when(kept, F.concat(F.lit("/"), F.col("segment"))).otherwise("/" + WILD)
        grown = materialise(joined.withColumn("template", F.concat("template", step)).drop("segment", "supported", "wide"), "grown")
        discard(counts)
        level += 1
        left = grown.where(F.size("segments") > level).agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    out = grown.withColumn("template", F.concat("template", F.repeat(F.lit("/" + WILD), F.size("segments") - level)))
    for part in done:
        out = out.unionByName(part)
    return out


def _merge_similar(stats: DataFrame) -> DataFrame:
    """Rows (host, template, labelled, blocked) with ``branch``: sibling templates that differ in one
    segment and whose rates differ by no more than chance explains share a branch with a wildcard there, and so
    do templates without a label with labelled siblings."""
    merged = stats.withColumn("branch", F.col("template"))
    named = F.size(F.split(F.regexp_replace("template", r"(/\*)+$", ""), "/")) - 1
    levels = stats.agg(F.max(named)).first()[0] or 0
    for level in reversed(range(levels)):
        parts = F.split("branch", "/")
        wild = F.when(F.size(parts) > level + 1, F.array_join(F.concat(F.slice(parts, 1, level + 1), F.array(F.lit(WILD)), F.slice(parts, F.lit(level + 3), F.size(parts))), "/")).otherwise(F.col("branch"))
        own = merged.withColumn("wild", wild).groupBy("host", "wild", "branch").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
        own = materialise(own, "siblings")
        pooled = own.groupBy("host", "wild").agg(F.sum("n").alias("n_all"), F.sum("b").alias("b_all"))
        rate = (F.col("b_all") + 1) / (F.col("n_all") + 2)
        others = F.col("n_all") - F.col("n")
        differ = F.abs(F.try_divide(F.col("b"), F.col("n")) - F.try_divide(F.col("b_all") - F.col("b"), others))
        chance = SIMILAR_Z * F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1), F.col("n")) + F.try_divide(F.lit(1), others)))
        alike = F.coalesce(differ <= chance, (F.col("n") == 0) & (F.col("n_all") > 0))
        moved = own.join(pooled, ["host", "wild"]).where(alike & (F.col("wild") != F.col("branch"))).select("host", "branch", "wild")
        merged = merged.join(moved, ["host", "branch"], "left").withColumn("branch", F.coalesce("wild", "branch")).select(*stats.columns, "branch")
        merged = materialise(merged, "merged")
        discard(own)
    return merged


def filter_urls(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    min_purity: float = MIN_PURITY,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template, purity.

    The longest fitting rule decides; else the page's template does: ``block`` if the smoothed share of
    pages that are not blocked is under ``min_purity``. Pages decided by a rule are the labelled ones.
    Paths are told apart to any depth, and a segment is kept by its own support, whatever share of its host it
    has; trailing slashes don't count. The tree is grown from distinct paths with counts; pages meet its verdicts once.

    Nulls: a null url has an empty host and path and is judged by the share over all pages; a null identifier is
    carried through. Repeated rows are judged alike, each counted. Without any label the purity is 0.5 and
    the verdict allow. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    named = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = named.withColumn("match", matching_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "match.rule", F.col("match.verdict").alias("ruled"))
    plain = F.regexp_replace(F.regexp_replace("path", "^/|/+$", ""), r"\*", "%2A")
    segments = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, "/"))
    base = materialise(ruled.withColumn("segments", segments), "urls")

    label = F.col("ruled")
    paths = base.groupBy("host", "segments").agg(F.count("*").alias("pages"), F.count(label).alias("labelled"), F.count(F.when(label == "block", 1)).alias("blocked"))
    templated = materialise(_generalise(materialise(paths, "paths")), "templated")
    stats = materialise(templated.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), "templates")
    merged = _merge_similar(stats)
    every = stats.agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("every_rate")).withColumn("every_rate", F.coalesce("every_rate", F.lit(0.5)))
    shapes = stats.groupBy("template").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b")).crossJoin(F.broadcast(every))
    shapes = shapes.select("template", ((F.col("b") + STRENGTH * F.col("every_rate")) / (F.col("n") + STRENGTH)).alias("shape_rate"))
    # a branch is smoothed towards the shapes of the templates that it holds
    branches = merged.join(shapes, "template").groupBy("host", "branch").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"), F.avg("shape_rate").alias("shape_rate"))
    rated = branches.select("host", "branch", (1 - (F.col("b") + STRENGTH * F.col("shape_rate")) / (F.col("n") + STRENGTH)).alias("purity"))
    verdicts = merged.join(rated, ["host", "branch"]).select("host", "template", F.col("branch"), "purity")
    of_path = materialise(templated.select("host", "segments", "template").join(verdicts, ["host", "template"]).drop("template"), "verdicts")
    judged = base.join(of_path, ["host", "segments"], "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("purity") < min_purity, "block").otherwise("allow")).alias("verdict"),
        F.col("branch").alias("template"),
        "purity",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
