"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source is to give words in proportion to its weight, but never more than ``max_epochs``
times what it has. A source at its cap is clamped and its excess goes to the others by weight
until none is above its cap: in the order of cap over weight the clamped sources come first,
so one running sum over the sources finds the level. A target is then taken as whole
repetitions of every document and one fractional repetition that takes documents in a seeded
random order until the target's words are reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, table

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 4096
SEED = 20


def water_fill(sources: DataFrame, *, max_epochs: int = 3) -> DataFrame:
    """Add ``target`` to rows (source, source_size, weight); targets add up to all sizes.

    The level is the largest L with sum(min(cap, L * weight)) equal to the total. Only sums over
    sources pass through the one task of the running sum, never documents.
    """
    cap = F.col("source_size") * max_epochs
    ranked = sources.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "position").rowsBetween(Window.unboundedPreceding, -1)
    rest = ranked.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    ).withColumn("feasible", F.col("left_words").cast("double") / F.col("left_weight") <= F.col("ratio"))
    first = F.when(F.col("feasible"), F.struct("ratio", "position", "left_words", "left_weight"))
    levelled = rest.withColumn("level", F.min(first).over(every))
    clamped = F.struct("ratio", "position") < F.struct("level.ratio", "level.position")
    share = F.col("level.left_words").cast("double") * F.col("weight") / F.col("level.left_weight")
    return levelled.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("level").isNull() | clamped, F.col("cap").cast("double"))
        .otherwise(F.least(share, F.col("cap").cast("double")))
        .alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = SEED,
    whole: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    ``size`` counts the words of the text and ``taken`` the words that the mix takes of the
    document, repeats counted: all whole repetitions, and of the fractional one everything,
    nothing, or for the one document at the boundary the part that is still wanted. The taken
    words of a source add up to its target's whole number. Weights repeat over the sources in
    code-point order, null last.

    Nulls: a null text has size 0 and takes 0; null is a source of its own; a null identifier
    takes part like any other. Rows that repeat (identifier and size) are ordered arbitrarily but
    are alike. Sources of size 0 have target 0. An empty table gives an empty result. With ``whole``
    each row has its document's columns as the struct ``document``; documents are not shuffled for it, but for
    those of the one slice of a source in which it ends.
    """
    keep = ["document"] * whole
    measured = (
        docs.select(
            *[F.struct(*docs.columns).alias("document")] * whole,
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ).withColumn("draw", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long"))
        # the order of the fractional repetition, cut into slices so that no source is sorted whole
        .withColumn("slice", F.shiftright("draw", 60 - SLICES.bit_length() + 1).cast("int"))
    )
    sized = measured if whole else materialise(measured, "sized")
    slices = materialise(sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    totals = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("position") % len(weights) + 1)
    weighed = totals.withColumn("position", position).withColumn("weight", weight.cast("long"))
    filled = (
        water_fill(weighed, max_epochs=max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("part_words", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    )
    filled = materialise(filled, "targets")

    # The slice in which the fractional repetition ends, and the words before it.
    run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = slices.withColumn("ahead", F.coalesce(F.sum("slice_size").over(run), F.lit(0)))
    ends = (
        ahead.alias("s")
        .join(filled.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")))
        .where((F.col("ahead") <= F.col("part_words")) & (F.col("part_words") < F.col("ahead") + F.col("slice_size")))
        .select(F.col("f.source").alias("source"), F.col("slice").alias("end_slice"), (F.col("part_words") - F.col("ahead")).alias("end_words"))
    )
    plan = materialise(
        filled.alias("f")
        .join(ends.alias("e"), F.col("f.source").eqNullSafe(F.col("e.source")), "left")
        .select("f.*", "end_slice", "end_words"),
        "mix_plan",
    )
    placed = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "p.source_size", "p.target", "p.whole", "p.end_slice", "p.end_words")
    at_end = F.col("slice") == F.col("end_slice")
    # Only the documents of one slice of each source are put in order.
    within = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    boundary = placed.where(at_end).withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn(
        "extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("end_words") - F.col("before")))
    )
    rest = placed.where(~F.coalesce(at_end, F.lit(False))).withColumn("extra", F.when(F.col("slice") < F.col("end_slice"), F.col("size")).otherwise(0))
    out = ["doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"), *keep]
    return rest.select(*out).unionByName(boundary.select(*out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS position FROM d GROUP BY source),
w AS (SELECT *, (position % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap,
             (3 * source_size)::DOUBLE / (position % 3 + 1) AS ratio FROM s),
r AS (SELECT *,
        (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS left_words,
        (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS left_weight
      FROM w),
l AS (SELECT left_words, left_weight, ratio AS level_ratio, position AS level_position FROM r
      WHERE left_words / left_weight <= ratio ORDER BY ratio, position LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN ratio < level_ratio OR (ratio = level_ratio AND position < level_position) THEN cap::DOUBLE
                  ELSE least(left_l * weight / weight_l, cap::DOUBLE) END AS target
      FROM w, (SELECT left_words AS left_l, left_weight AS weight_l, level_ratio, level_position FROM l)),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
o AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
             floor(p.target - p.whole * p.source_size)::BIGINT AS part_words,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, part_words - before)))::BIGINT AS taken
FROM o
"""
