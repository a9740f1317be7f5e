"""Edit commands on timelines: one command for each timeline, all timelines at once.

A command's target gives the numbers that every clip of its timeline needs: where the target was, where it is now, and what ripples. A window brings them to
the clips, whose new versions are expressions. A command without a target, or out of range, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMMANDS = ("grade", "trim_end", "retime", "move", "trim_in", "blade", "ripple_trim_out", "ripple_trim_in", "ripple_delete")
GRADE, RETIME = "mv.colorGrade", "mv.retime"
_EFFECT = "struct<id:string,value:double>"


def _with_targets(placed: DataFrame) -> DataFrame:
    """Clips beside their timeline's command with the clip it means, and what it makes of it; a command that changes nothing is null, and its clip too."""
    meant = (F.col("kind") == "video") & F.col("command").isNotNull() & (F.col("target").isNull() | (F.col("target") == F.col("clip")))
    first = F.min(F.when(meant, F.struct("track", "pos", "start", "dur", "off"))).over(Window.partitionBy("timeline"))
    t = placed.withColumn("t", first)
    at, t_start, t_dur, t_off = F.col("ticks"), F.col("t.start"), F.col("t.dur"), F.col("t.off")
    off = F.greatest(F.lit(0).cast("long"), at)
    is_ = lambda *names: F.col("command").isin(*names)
    valid = (
        F.when(is_("trim_end", "ripple_trim_out"), at > t_start)
        .when(is_("blade"), (at > t_start) & (at < t_start + t_dur))
        .when(is_("ripple_trim_in"), t_dur - (off - t_off) > 0)
        .otherwise(is_(*COMMANDS))
    )
    t = t.withColumn("valid", F.col("t").isNotNull() & F.coalesce(valid, F.lit(False))).withColumns({"command": F.when(F.col("valid"), F.col("command")), "t": F.when(F.col("valid"), F.col("t"))})
    dur = F.when(is_("trim_end", "ripple_trim_out"), at - t_start).when(is_("ripple_trim_in"), t_dur - (off - t_off)).otherwise(t_dur)
    t = t.withColumns({"n_start": F.when(is_("move"), off).otherwise(t_start), "n_dur": dur, "n_off": F.when(is_("trim_in", "ripple_trim_in"), off).otherwise(t_off)})
    ripple = F.when(is_("ripple_delete"), -t_dur).when(is_("ripple_trim_out", "ripple_trim_in"), F.col("n_dur") - t_dur).otherwise(F.lit(0).cast("long"))
    return t.withColumns({"ripple": ripple, "t_track": F.col("t.track"), "t_pos": F.col("t.pos"), "t_start": t_start, "t_dur": t_dur, "t_end": t_start + t_dur}).drop("t", "valid", "target")


def _with_effect(effects: Column, name: str, value: Column) -> Column:
    """The effects with one of that name last, and only once."""
    return F.concat(F.filter(effects, lambda fx: fx["id"] != name), F.array(F.struct(F.lit(name).alias("id"), value.cast("double").alias("value")).cast(_EFFECT)))


def _settled(clips: DataFrame, touched: str) -> DataFrame:
    """Where both sides of a boundary on a touched track have transitions, these are no longer than the overlap, and none without one."""
    w = Window.partitionBy("timeline", "track").orderBy("start", "pos")
    end = F.col("start") + F.col("dur")
    after, before = F.lead("fade_in").over(w), F.lag("fade_out").over(w)
    overlap, overlap_before = end - F.lead("start").over(w), F.lag(end).over(w) - F.col("start")
    capped = lambda own, other, over: F.when(~F.col(touched) | own.isNull() | other.isNull(), own).when(over > 0, F.least(own, over))
    return clips.select("*", capped(F.col("fade_out"), after, overlap).alias("out"), capped(F.col("fade_in"), before, overlap_before).alias("in")).drop("fade_in", "fade_out").withColumnsRenamed({"in": "fade_in", "out": "fade_out"})


def apply_commands(clips: DataFrame, commands: DataFrame) -> DataFrame:
    """Clips (timeline, track, kind, clip, start, dur, off, fade_in, fade_out, effects) after their timeline's command, with ``part`` 2 for the half behind a cut.

    Commands are (timeline, command, target, ticks, value), one for each timeline; a target is a video clip's name, null the first video clip. Sound clips
    of a target's start and length go with it: they are trimmed, moved and removed alike. Ripples shift what follows on the target's track by order, and on others what starts at or
    behind the target's old end; nothing starts before 0. Both halves of a cut keep the name. A kind belongs to a track.
    """
    order = Window.partitionBy("timeline", "track").orderBy("start", "clip")
    # dealt by timeline once: the join and all windows keep clips where they are
    q = _with_targets(clips.repartition("timeline").join(commands, "timeline", "left").withColumn("pos", F.row_number().over(order)))
    is_ = lambda *names: F.coalesce(F.col("command").isin(*names), F.lit(False))
    own_track = F.coalesce(F.col("track") == F.col("t_track"), F.lit(False))
    q = q.withColumn("own", own_track & (F.col("pos") == F.col("t_pos")))
    q = q.withColumn("linked", is_("trim_end", "move", "ripple_trim_out", "ripple_trim_in", "ripple_delete") & (F.col("kind") == "audio") & F.coalesce((F.col("start") == F.col("t_start")) & (F.col("dur") == F.col("t_dur")), F.lit(False)))
    shifted = F.coalesce(F.col("ripple") != 0, F.lit(False)) & F.when(own_track, F.col("pos") > F.col("t_pos")).otherwise(F.col("start") >= F.col("t_end"))
    # the neighbours of a clip that goes lose what led to it
    gone = is_("ripple_delete") & (F.col("own") | F.col("linked"))
    q = q.withColumn("gone", gone)
    near = lambda f: F.coalesce(f("gone").over(order), F.lit(False))
    q = q.withColumns({"lost_out": near(F.lead), "lost_in": near(F.lag), "touched_by": F.max(F.col("linked")).over(Window.partitionBy("timeline", "track"))})
    touched = (is_("trim_end", "move", "ripple_trim_out", "ripple_trim_in", "ripple_delete") & own_track) | F.col("touched_by") | F.coalesce(F.col("ripple") != 0, F.lit(False))
    zero = F.lit(0).cast("long")
    start = F.when(F.col("own"), F.col("n_start")).when(F.col("linked") & is_("move"), F.greatest(zero, F.col("start") + F.col("n_start") - F.col("t_start")))
    effects = F.when(F.col("own") & is_("grade"), _with_effect(F.col("effects"), GRADE, F.col("value"))).when(F.col("own") & is_("retime"), _with_effect(F.col("effects"), RETIME, F.col("value"))).otherwise(F.col("effects"))
    trimmed = F.col("own") | (F.col("linked") & ~is_("move"))
    off = F.when(F.col("own") | (F.col("linked") & is_("ripple_trim_in")), F.col("n_off")).otherwise(F.col("off"))
    q = q.where("NOT gone").select(
        "timeline", "track", "kind", "clip", "pos",
        F.coalesce(start, "start").alias("start"), F.when(trimmed, F.col("n_dur")).otherwise(F.col("dur")).alias("dur"), off.alias("off"),
        F.when(~F.col("lost_in"), F.col("fade_in")).alias("fade_in"), F.when(~F.col("lost_out"), F.col("fade_out")).alias("fade_out"), effects.alias("effects"),
        F.when(shifted, F.col("ripple")).alias("shift"), F.col("touched_by"), touched.alias("touched"), F.when(F.col("own") & is_("blade"), F.col("ticks") - F.col("start")).alias("cut"),
    )
    # sound that goes with the target settles before anything ripples
    q = _settled(q, "touched_by").withColumn("start", F.when(F.col("shift").isNotNull(), F.greatest(zero, F.col("start") + F.col("shift"))).otherwise(F.col("start")))
    q = _settled(q, "touched")
    none = F.lit(None).cast(clips.schema["fade_in"].dataType)
    half = lambda part, *columns: F.struct(F.lit(part).alias("part"), *[c.alias(n) for n, c in zip(("start", "dur", "off", "fade_in", "fade_out"), columns)])
    cut = F.col("cut")
    whole = half(1, F.col("start"), F.coalesce("cut", "dur"), F.col("off"), F.col("fade_in"), F.when(cut.isNull(), F.col("fade_out")))
    rest = half(2, F.col("start") + cut, F.col("dur") - cut, F.col("off") + cut, none, F.col("fade_out"))
    halves = q.select("timeline", "track", "kind", "clip", "effects", F.inline(F.when(cut.isNull(), F.array(whole)).otherwise(F.array(whole, rest))))
    return halves.select("timeline", "track", "kind", "clip", "part", "start", "dur", "off", "fade_in", "fade_out", "effects")
