"""Queries on timelines, edits, policies and quality rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import edits
from tessera.operators import timeline as L
from tessera.plans.registry import Registry
from tessera.sources import views as V

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

ALPHA = """CASE WHEN 150000 < "start" OR 150000 >= "start" + dur THEN 0 WHEN 150000 - "start" < 30000 THEN (150000 - "start") / 30000::DOUBLE
   WHEN "start" + dur - 150000 < 30000 THEN ("start" + dur - 150000) / 30000::DOUBLE ELSE 1 END"""


@query(
    "compile_layers",
    V.ctes("clips") + f""", a AS (SELECT *, {ALPHA} AS alpha FROM clips WHERE kind = 'video'), n AS (SELECT *, row_number() OVER (PARTITION BY timeline ORDER BY track, "start", clip) AS layer FROM a WHERE alpha > 0)
      SELECT n.timeline, n.layer, n.clip, round(n.alpha, 9) AS alpha, round(n.alpha * coalesce((SELECT CASE WHEN bool_or(m.alpha = 1) THEN 0 ELSE exp(sum(CASE WHEN m.alpha < 1 THEN ln(1 - m.alpha) ELSE 0 END)) END FROM n m WHERE m.timeline = n.timeline AND m.layer > n.layer), 1), 9) AS weight FROM n""",
)
def compile_layers(spark, d):
    return L.layers_at(V.clips(spark, d), 150000).withColumn("alpha", F.round("alpha", 9)).withColumn("weight", F.round("weight", 9))


@query("clip_alphas", V.ctes("clips") + f" SELECT timeline, clip, round({ALPHA}, 9) AS alpha FROM clips")
def clip_alphas(spark, d):
    return V.clips(spark, d).select("timeline", "clip", F.round(L.clip_alpha(F.lit(150000), F.col("start"), F.col("dur"), F.lit(30000), F.lit(30000)), 9).alias("alpha"))


@query("transition_progress", V.ctes("clips") + """ SELECT timeline, clip, CASE WHEN 150000 >= "start" AND 150000 <= "start" + 60000 THEN round((150000 - "start") / 60000::DOUBLE, 9) END AS p FROM clips WHERE kind = 'video'""")
def transition_progress(spark, d):
    p = L.transition_progress(F.lit(150000), F.col("start"), F.lit(60000))
    return V.clips(spark, d).where("kind = 'video'").select("timeline", "clip", F.round(p, 9).alias("p"))


@query("output_sizes", "SELECT p_partkey, greatest(1, CASE p_size % 4 WHEN 0 THEN p_size // 2 WHEN 1 THEN p_size // 4 WHEN 2 THEN 7 ELSE p_size END)::BIGINT AS size FROM part")
def output_sizes(spark, d):
    rule = F.element_at(F.array(*[F.lit(x) for x in ("half", "quarter", "fixed", "full")]), F.col("p_size") % 4 + 1)
    return V.table(spark, d, "part").select("p_partkey", L.output_size(F.col("p_size"), rule, F.lit(7)).alias("size"))


@query("ripple_others", V.ctes("clips") + """ SELECT timeline, clip, CASE WHEN "start" >= 180000 THEN greatest(0, "start" - 90000) ELSE "start" END AS start_tick FROM clips""")
def ripple_others(spark, d):
    return L.ripple_others(V.clips(spark, d), 180000, -90000).select("timeline", "clip", F.col("start").alias("start_tick"))


@query("trim_and_move", V.ctes("clips") + """ SELECT timeline, clip, CASE WHEN n = 1 THEN greatest(0, "start" - 30000) ELSE "start" END AS start_tick FROM (SELECT *, row_number() OVER (PARTITION BY timeline ORDER BY "start", clip) AS n FROM clips WHERE kind = 'video') q""")
def trim_and_move(spark, d):
    """The first video clip of each timeline, as the target of an edit without an id, moved half a second ahead."""
    c = V.clips(spark, d).where("kind = 'video'").withColumn("n", F.row_number().over(Window.partitionBy("timeline").orderBy("start", "clip")))
    return L.move_clips(c, F.col("n") == 1, F.lit(-30000).cast("long")).select("timeline", "clip", F.col("start").alias("start_tick"))


@query(
    "edit_versions",
    """WITH e AS (SELECT user_id AS doc, event_id AS seq, CASE WHEN event_type IN ('error', 'purchase') THEN 'undo' ELSE 'edit' END AS kind, CASE WHEN event_type IN ('error', 'purchase') THEN -1 ELSE 1 END AS step FROM events),
      s AS (SELECT *, sum(step) OVER (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM e)
      SELECT doc, seq, kind, (run - least(0, min(run) OVER (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING)))::BIGINT AS depth FROM s""",
)
def edit_versions(spark, d):
    kind = F.when(F.col("event_type").isin("error", "purchase"), "undo").otherwise("edit")
    return L.versions(V.table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), kind.alias("kind")))


@query(
    "whitelist_edits",
    V.ctes("ev") + """, v AS (SELECT event_id, luma AS cur, luma * 3 - 0.2 AS prop FROM ev), c AS (SELECT *, least(0.9, greatest(0, prop)) AS ins FROM v), n AS (SELECT *, least(cur + 0.1, greatest(cur - 0.1, ins)) AS val FROM c)
      SELECT event_id, round(val, 9) AS value, CASE WHEN val <> ins THEN 'maxDelta' WHEN ins <> prop THEN 'clamped' END AS code FROM n""",
)
def whitelist_edits(spark, d):
    value, code = L.bounded_change(F.col("luma"), F.col("luma") * 3 - 0.2, 0.0, 0.9, 0.1)
    return V.timed_events(spark, d).select("event_id", F.round(value, 9).alias("value"), code.alias("code"))


@query("policy_predicates", "SELECT DISTINCT event_type, user_id % 3 AS privacy, event_type <> 'error' AND user_id % 3 <> 0 AS network FROM events")
def policy_predicates(spark, d):
    mode = F.when(F.col("event_type") == "error", "off").otherwise("on")
    privacy = F.when(F.col("user_id") % 3 == 0, "localOnly").otherwise("shared")
    return V.table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("privacy"), L.network_allowed(mode, privacy).alias("network")).distinct()


@query(
    "usage_policies",
    """WITH p AS (SELECT DISTINCT event_type, user_id % 2 AS raw, event_id % 2 AS deliverables, event_id % 3 = 0 AS sole FROM events),
      m AS (SELECT *, CASE WHEN sole THEN deliverables = 1 ELSE raw = 1 OR deliverables = 1 END AS media FROM p)
      SELECT event_type, raw, deliverables, sole, event_type = 'click' OR (event_type IN ('view', 'signup', 'purchase') AND media) AS network, event_type IN ('view', 'purchase') AND media AS images, event_type IN ('signup', 'purchase') AND media AS video FROM m""",
)
def usage_policies(spark, d):
    """The truth table of modes and privacy rules over network, images and video."""
    modes = {"error": "off", "click": "textOnly", "view": "textAndImages", "signup": "textAndVideo", "purchase": "textImagesAndVideo"}
    mode = F.create_map(*[F.lit(x) for item in modes.items() for x in item])[F.col("event_type")]
    p = V.table(spark, d, "events").select("event_type", (F.col("user_id") % 2).alias("raw"), (F.col("event_id") % 2).alias("deliverables"), (F.col("event_id") % 3 == 0).alias("sole")).distinct()
    source = F.when(F.col("sole"), "deliverablesOnly").otherwise("rawAllowed")
    network, images, video = L.usage_allowed(mode, source, F.col("raw") == 1, F.col("deliverables") == 1)
    return p.select("event_type", "raw", "deliverables", "sole", network.alias("network"), images.alias("images"), video.alias("video"))


def editable_clips(spark, d):
    """The clips of ``views`` with fades and effects, and for some a sound clip that goes with them."""
    number = lambda n: F.col("parts")[n].cast("long")
    effects = F.when(number(3) % 3 == 0, F.array(F.struct(F.lit(edits.RETIME).alias("id"), F.lit(2.0).alias("value")))).otherwise(F.array().cast("array<struct<id:string,value:double>>"))
    fade = lambda n, k: F.when(number(n) % 2 == k, F.lit(90000).cast("long"))
    c = V.clips(spark, d).withColumn("parts", F.split("clip", "-"))
    c = c.select("timeline", "track", "kind", "clip", "start", "dur", (F.col("off") * 600).alias("off"), fade(1, 0).alias("fade_in"), fade(3, 1).alias("fade_out"), effects.alias("effects"), ((F.col("kind") == "video") & (number(2) % 2 == 0)).alias("heard"))
    own = F.struct("track", "kind", "clip")
    sound = F.struct(F.lit("S").alias("track"), F.lit("audio").alias("kind"), F.concat("clip", F.lit("-s")).alias("clip"))
    each = c.withColumn("own", F.explode(F.when(F.col("heard"), F.array(own, sound)).otherwise(F.array(own))))
    return each.select("timeline", "own.track", "own.kind", "own.clip", "start", "dur", "off", "fade_in", "fade_out", "effects")


def edit_commands(spark, d):
    """A command for each timeline, in turn: on its first clip, on one by name, or on none."""
    named = V.clips(spark, d).groupBy("timeline").agg(F.max(F.when(F.col("kind") == "video", F.col("clip"))).alias("last"))
    t = F.col("timeline")
    command = F.element_at(F.array(*[F.lit(c) for c in edits.COMMANDS]), (t % len(edits.COMMANDS) + 1).cast("int"))
    target = F.when(t % 11 == 0, "none").when(t % 2 == 0, F.col("last"))
    return named.select("timeline", command.alias("command"), target.alias("target"), (t % 7 * 40000 + 20000).alias("ticks"), (t % 5 * 0.25).cast("double").alias("value"))


def _settle(source: str, touched: str) -> str:
    w = 'WINDOW w AS (PARTITION BY timeline, track ORDER BY s, pos)'
    return f"""SELECT * EXCLUDE (fi, fo, nfi, pfo, ov, pov), CASE WHEN NOT {touched} OR fi IS NULL OR pfo IS NULL THEN fi WHEN pov > 0 THEN least(fi, pov) END AS fi, CASE WHEN NOT {touched} OR fo IS NULL OR nfi IS NULL THEN fo WHEN ov > 0 THEN least(fo, ov) END AS fo
        FROM (SELECT *, lead(fi) OVER w AS nfi, lag(fo) OVER w AS pfo, s + dur - lead(s) OVER w AS ov, lag(s + dur) OVER w - s AS pov FROM {source} {w})"""


_RIPPLES = "('trim_end', 'move', 'ripple_trim_out', 'ripple_trim_in', 'ripple_delete')"


@query(
    "edited_timelines",
    V.ctes("clips") + f""", c0 AS (SELECT timeline, track, kind, clip, "start" AS s, dur, off * 600 AS off, CASE WHEN split_part(clip, '-', 2)::BIGINT % 2 = 0 THEN 90000 END AS fi, CASE WHEN split_part(clip, '-', 4)::BIGINT % 2 = 1 THEN 90000 END AS fo,
        CASE WHEN split_part(clip, '-', 4)::BIGINT % 3 = 0 THEN 'mv.retime=2.0' ELSE '' END AS fx FROM clips),
      c1 AS (SELECT * FROM c0 UNION ALL SELECT timeline, 'S', 'audio', clip || '-s', s, dur, off, fi, fo, fx FROM c0 WHERE kind = 'video' AND split_part(clip, '-', 3)::BIGINT % 2 = 0),
      c AS (SELECT *, row_number() OVER (PARTITION BY timeline, track ORDER BY s, clip) AS pos FROM c1),
      cmd AS (SELECT timeline, ['grade', 'trim_end', 'retime', 'move', 'trim_in', 'blade', 'ripple_trim_out', 'ripple_trim_in', 'ripple_delete'][timeline % 9 + 1] AS command,
        CASE WHEN timeline % 11 = 0 THEN 'none' WHEN timeline % 2 = 0 THEN max(clip) FILTER (kind = 'video') END AS target, timeline % 7 * 40000 + 20000 AS ticks, timeline % 5 * 0.25::DOUBLE AS value FROM clips GROUP BY timeline),
      m AS (SELECT cmd.*, v.track AS tt, v.pos AS tp, v.s AS ts, v.dur AS td, v.off AS toff FROM cmd JOIN c v ON v.timeline = cmd.timeline AND v.kind = 'video' AND (target IS NULL OR target = v.clip) QUALIFY row_number() OVER (PARTITION BY cmd.timeline ORDER BY v.track, v.pos) = 1),
      n AS (SELECT *, CASE WHEN command = 'move' THEN ticks ELSE ts END AS ns, CASE WHEN command IN ('trim_end', 'ripple_trim_out') THEN ticks - ts WHEN command = 'ripple_trim_in' THEN td - (ticks - toff) ELSE td END AS nd, CASE WHEN command IN ('trim_in', 'ripple_trim_in') THEN ticks ELSE toff END AS noff FROM m
        WHERE CASE WHEN command IN ('trim_end', 'ripple_trim_out') THEN ticks > ts WHEN command = 'blade' THEN ticks > ts AND ticks < ts + td WHEN command = 'ripple_trim_in' THEN td - (ticks - toff) > 0 ELSE TRUE END),
      k AS (SELECT *, CASE WHEN command = 'ripple_delete' THEN -td WHEN command LIKE 'ripple%' THEN nd - td ELSE 0 END AS ripple FROM n),
      q AS (SELECT c.*, k.* EXCLUDE (timeline), coalesce(track = tt AND pos = tp, FALSE) AS own, coalesce(track = tt, FALSE) AS mine, coalesce(command IN {_RIPPLES} AND kind = 'audio' AND s = ts AND dur = td, FALSE) AS linked,
        coalesce(ripple <> 0 AND CASE WHEN track = tt THEN pos > tp ELSE s >= ts + td END, FALSE) AS shifted FROM c LEFT JOIN k USING (timeline)),
      g AS (SELECT *, coalesce(command = 'ripple_delete' AND (own OR linked), FALSE) AS gone FROM q),
      h AS (SELECT *, coalesce(lead(gone) OVER w, FALSE) AS lost_out, coalesce(lag(gone) OVER w, FALSE) AS lost_in, bool_or(linked) OVER (PARTITION BY timeline, track) AS by_sound FROM g WINDOW w AS (PARTITION BY timeline, track ORDER BY s, clip)),
      e AS (SELECT timeline, track, kind, clip, pos, CASE WHEN own THEN ns WHEN linked AND command = 'move' THEN greatest(0, s + ns - ts) ELSE s END AS s, CASE WHEN own OR (linked AND command <> 'move') THEN nd ELSE dur END AS dur,
        CASE WHEN own OR (linked AND command = 'ripple_trim_in') THEN noff ELSE off END AS off, CASE WHEN NOT lost_in THEN fi END AS fi, CASE WHEN NOT lost_out THEN fo END AS fo,
        CASE WHEN own AND command = 'retime' THEN 'mv.retime=' || value::VARCHAR WHEN own AND command = 'grade' THEN CASE WHEN fx = '' THEN '' ELSE fx || ' ' END || 'mv.colorGrade=' || value::VARCHAR ELSE fx END AS fx,
        CASE WHEN shifted THEN ripple END AS shift, by_sound, coalesce(command IN {_RIPPLES} AND mine, FALSE) OR by_sound OR coalesce(ripple <> 0, FALSE) AS touched, CASE WHEN own AND command = 'blade' THEN ticks - s END AS cut FROM h WHERE NOT gone),
      first AS ({_settle('e', 'by_sound')}),
      moved AS (SELECT * REPLACE (CASE WHEN shift IS NOT NULL THEN greatest(0, s + shift) ELSE s END AS s) FROM first),
      done AS ({_settle('moved', 'touched')})
      SELECT timeline, track, clip, part::INTEGER AS part, CASE part WHEN 1 THEN s ELSE s + cut END AS start_tick, CASE WHEN cut IS NULL THEN dur WHEN part = 1 THEN cut ELSE dur - cut END AS dur, CASE part WHEN 1 THEN off ELSE off + cut END AS off,
        CASE part WHEN 1 THEN fi END::BIGINT AS fade_in, CASE WHEN cut IS NULL OR part = 2 THEN fo END::BIGINT AS fade_out, fx AS effects FROM done, (VALUES (1), (2)) parts(part) WHERE part = 1 OR cut IS NOT NULL""",
)
def edited_timelines(spark, d):
    """All clips after their timeline's command."""
    effects = F.concat_ws(" ", F.transform("effects", lambda fx: F.concat(fx["id"], F.lit("="), fx["value"].cast("string"))))
    out = edits.apply_commands(editable_clips(spark, d), edit_commands(spark, d))
    return out.select("timeline", "track", "clip", "part", F.col("start").alias("start_tick"), "dur", "off", "fade_in", "fade_out", effects.alias("effects"))


@query(
    "container_rules",
    V.ctes("samples") + """, f AS (SELECT src, max(t) - min(t) AS dur, count(*) AS n, max(luma) AS peak FROM samples GROUP BY src)
      SELECT src, CASE WHEN dur < 700 THEN 'duration' WHEN n < 400 THEN 'samples' WHEN abs(n / dur - 0.7) > 0.5 THEN 'rate' WHEN peak < 0.0005 THEN 'silent' END AS violation FROM f""",
)
def container_rules(spark, d):
    """The first rule that a source breaks."""
    f = V.samples(spark, d).groupBy("src").agg((F.max("t") - F.min("t")).alias("dur"), F.count("*").alias("n"), F.max("luma").alias("peak"))
    v = F.when(F.col("dur") < 700, "duration").when(F.col("n") < 400, "samples").when(F.abs(F.col("n") / F.col("dur") - 0.7) > 0.5, "rate").when(F.col("peak") < 0.0005, "silent")
    return f.select("src", v.alias("violation"))


@query(
    "near_black",
    V.ctes("pixels") + " SELECT frame, avg(0.2126 * r + 0.7152 * g + 0.0722 * b) < 0.45 AND avg((g < 0.4)::INT) > 0.4 AS dark FROM pixels GROUP BY frame",
)
def near_black(spark, d):
    y = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    return V.pixels(spark, d).groupBy("frame").agg(((F.avg(y) < 0.45) & (F.avg((F.col("g") < 0.4).cast("int")) > 0.4)).alias("dark"))


@query(
    "label_argmax",
    V.ctes("pixels") + " SELECT frame, x, y, CASE WHEN r >= g AND r >= b THEN 0 WHEN g >= b THEN 1 ELSE 2 END AS label FROM pixels",
)
def label_argmax(spark, d):
    """The first class with the largest value."""
    logits = F.array("r", "g", "b")
    return V.pixels(spark, d).select("frame", "x", "y", (F.array_position(logits, F.array_max(logits)) - 1).cast("int").alias("label"))


@query("region_clamp", V.ctes("pixels") + " SELECT frame, count(*) FILTER (r > 0.5 AND (x < 2 OR x > 5 OR y < 2 OR y > 5)) AS cleared, count(*) FILTER (r > 0.5 AND x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5) AS kept FROM pixels GROUP BY frame")
def region_clamp(spark, d):
    """Mask pixels outside a rectangle are zeroed: how many went and how many stay."""
    inside, on = F.col("x").between(2, 5) & F.col("y").between(2, 5), F.col("r") > 0.5
    return V.pixels(spark, d).groupBy("frame").agg(F.count_if(on & ~inside).alias("cleared"), F.count_if(on & inside).alias("kept"))


@query(
    "flow_warp",
    V.ctes("pixels") + """, m AS (SELECT frame, x + round((r - 0.5) * 4)::INTEGER AS tx, y + round((b - 0.4) * 4)::INTEGER AS ty, g FROM pixels)
      SELECT frame, tx::INTEGER AS x, ty::INTEGER AS y, max(g) AS mask FROM m WHERE tx BETWEEN 0 AND 7 AND ty BETWEEN 0 AND 7 GROUP BY frame, tx, ty""",
)
def flow_warp(spark, d):
    """A mask scattered along its flow, the largest value where several meet, nothing outside."""
    tx = (F.col("x") + F.round((F.col("r") - 0.5) * 4)).cast("int")
    ty = (F.col("y") + F.round((F.col("b") - 0.4) * 4)).cast("int")
    m = V.pixels(spark, d).select("frame", tx.alias("tx"), ty.alias("ty"), "g").where("tx between 0 and 7 and ty between 0 and 7")
    return m.groupBy("frame", F.col("tx").alias("x"), F.col("ty").alias("y")).agg(F.max("g").alias("mask"))
