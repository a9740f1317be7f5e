"""Timelines: what is shown at a time, transitions, edits as new versions, and rules on parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip_alpha(t: Column, start: Column, duration: Column, fade_in: Column, fade_out: Column) -> Column:
    """0 outside the clip; the fade-in's progress wins over the fade-out's; else 1."""
    since, left = t - start, start + duration - t
    return (
        F.when((since < 0) | (left <= 0), 0.0)
        .when((fade_in > 0) & (since < fade_in), since / fade_in)
        .when((fade_out > 0) & (left < fade_out), left / fade_out)
        .otherwise(1.0)
    )


def output_size(base: Column, rule: Column, fixed: Column) -> Column:
    """Full, half, quarter or fixed, in whole pixels and at least 1."""
    part = lambda n: F.floor(base / n)
    return F.greatest(F.lit(1), F.when(rule == "half", part(2)).when(rule == "quarter", part(4)).when(rule == "fixed", fixed).otherwise(base)).cast("long")


def layers_at(clips: DataFrame, t: int, fade: int = 30000) -> DataFrame:
    """The video clips shown at tick ``t`` of every timeline from the bottom up, with the weight that is left of each."""
    shown = clips.where("kind = 'video'").withColumn("alpha", clip_alpha(F.lit(t), F.col("start"), F.col("dur"), F.lit(fade), F.lit(fade))).where("alpha > 0")
    order = Window.partitionBy("timeline").orderBy("track", "start", "clip")
    above = Window.partitionBy("timeline").orderBy(F.desc("track"), F.desc("start"), F.desc("clip")).rowsBetween(Window.unboundedPreceding, -1)
    # over: what lies above lets through the product of its transparencies, nothing if one is opaque
    opaque = F.coalesce(F.max(F.col("alpha") >= 1).over(above), F.lit(False))
    left = F.exp(F.coalesce(F.sum(F.when(F.col("alpha") < 1, F.log1p(-F.col("alpha")))).over(above), F.lit(0.0)))
    weight = F.col("alpha") * F.when(opaque, 0.0).otherwise(left)
    return shown.select("timeline", F.row_number().over(order).alias("layer"), "clip", "alpha", weight.alias("weight"))


def transition_progress(t: Column, start: Column, length: Column) -> Column:
    """How far a transition has come, null outside it; both ends are included."""
    return F.when((length > 0) & (t >= start) & (t <= start + length), (t - start) / length)


def move_clips(clips: DataFrame, target: Column, ticks: Column) -> DataFrame:
    """Clips that fit ``target`` moved, never before 0; others stay."""
    return clips.withColumn("start", F.when(target, F.greatest(F.lit(0).cast("long"), F.col("start") + ticks)).otherwise(F.col("start")))


def ripple_others(clips: DataFrame, point: int, ticks: int) -> DataFrame:
    """Clips that start at or behind a point shifted together."""
    return move_clips(clips, F.col("start") >= point, F.lit(ticks).cast("long"))


def versions(edits: DataFrame) -> DataFrame:
    """Edits (doc, seq, kind) with undo to the number of edits in force after each step, found without
    replaying: an undo cancels the nearest edit before it that is still in force, if any.
    """
    w = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "undo", -1).when(F.col("kind") == "edit", 1).otherwise(0)
    run = edits.withColumn("sum", F.sum(step).over(w))
    floor = F.least(F.lit(0), F.min("sum").over(w))
    return run.withColumn("depth", F.col("sum") - floor).select("doc", "seq", "kind", "depth")


def bounded_change(current: Column, proposed: Column, low: float, high: float, most: float) -> tuple[Column, Column]:
    """A whitelisted parameter's new value and the code of what was cut, if anything."""
    inside = F.least(F.lit(high), F.greatest(F.lit(low), proposed))
    value = F.least(current + most, F.greatest(current - most, inside))
    code = F.when(value != inside, "maxDelta").when(inside != proposed, "clamped")
    return value, code


def network_allowed(mode: Column, privacy: Column) -> Column:
    """Whether a policy lets anything leave the machine."""
    return (mode != "off") & (privacy != "localOnly")


def media_upload_allowed(source: Column, raw: Column, deliverables: Column) -> Column:
    """Whether a privacy policy lets media out: deliverables by their own flag, raw media by either."""
    return F.when(source == "rawAllowed", raw | deliverables).otherwise(deliverables)


def usage_allowed(mode: Column, source: Column, raw: Column, deliverables: Column) -> tuple[Column, Column, Column]:
    """What a policy of use allows: network, images and video. Text alone needs no upload of media, ``off`` allows nothing."""
    media = media_upload_allowed(source, raw, deliverables)
    images, video = mode.isin("textAndImages", "textImagesAndVideo"), mode.isin("textAndVideo", "textImagesAndVideo")
    return (mode == "textOnly") | ((images | video) & media), images & media, video & media
