"""Timelines of the line items compiled and rendered at a time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import pixels as P
from tessera.operators import render
from tessera.plans.grading_queries import Steps, _curve, _encode, _sweet, _zero
from tessera.plans.pixel_queries import LAP1, RGB, _clamp, _decode, _film, _mat
from tessera.plans.registry import Registry
from tessera.sources import views as V

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

AT, TICKS = 150_000, 6_000


def clips(spark, d):
    """The clips of ``views`` with fades, transitions, assets and retiming, which follow from suppliers and parts."""
    li = V.table(spark, d, "lineitem")
    names = F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    pick = lambda i, *of: F.element_at(F.array(*[F.lit(o) for o in of]), (i + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("timeline"),
        F.col("l_returnflag").alias("track"),
        pick(F.col("l_linenumber") % 5, "audio", "video", "video", "video", "data").alias("kind"),
        names.alias("clip"),
        (F.col("l_linenumber").cast("long") * 45000).alias("start"),
        (F.col("l_quantity").cast("long") * 6000).alias("dur"),
        (F.round(F.col("l_discount") * 100).cast("long") * 600).alias("off"),
        pick(F.col("l_suppkey") % 3, 0, 30000, 120000).alias("fade_in"),
        F.lit(30000).alias("fade_out"),
        pick(F.col("l_suppkey") % 4, "wipe", "dip", "crossfade", None).alias("transition"),
        pick(F.col("l_partkey") % 4, *render.WIPES).alias("direction"),
        F.array(F.lit(0.1), F.lit(0.0), F.lit(0.2)).alias("dip"),
        (F.col("l_partkey") % 11).cast("long").alias("asset"),
        (F.col("l_suppkey") % 2 * 0.5 + 1.0).cast("double").alias("retime"),
        (F.col("l_partkey") % 5 == 0).alias("linear"),
    )


def effects(spark, d):
    """The effects on every clip, sound among them."""
    number = lambda c, n: F.split("clip", "-")[n].cast("long").alias(c)
    c = clips(spark, d).select("timeline", "clip", number("line", 1), number("part", 2), number("supp", 3))
    of = lambda when, position, effect, a, b: F.when(when, F.struct(F.lit(position).alias("position"), F.lit(effect).alias("effect"), F.lit(a).alias("a"), F.lit(b).alias("b")))
    rows = F.array(
        of(F.col("supp") % 2 == 0, 1, "exposure", 0.3, 0.0),
        of(F.col("line") % 2 == 0, 2, "contrast", 1.1, 0.18),
        of(F.col("part") % 3 == 0, 3, "saturation", 0.8, 0.0),
        of(F.lit(True), 4, "audio.gate", 1.0, 0.0),
        of(F.col("part") % 7 == 0, 5, "temperature", 0.3, -0.2),
        of(F.col("part") % 13 == 0, 6, "tonemap", 0.0, 0.0),
    )
    return c.select("timeline", "clip", F.inline(F.array_compact(rows)))


def frames(spark, d):
    by = Window.partitionBy("label")
    f = V.frames(spark, d, "label").where("label is not null")
    return f.select(F.col("label").cast("long").alias("asset"), (F.row_number().over(by.orderBy("frame")) - 1).cast("long").alias("k"), F.count("*").over(by).alias("n"), "r", "g", "b")


_CLIPS = f"""WITH RECURSIVE li AS (SELECT *, concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, (l_extendedprice::DECIMAL(12,2))::VARCHAR) AS clip FROM lineitem),
  c AS (SELECT l_orderkey AS timeline, l_returnflag AS track, clip, l_linenumber::BIGINT * 45000 AS s, l_quantity::BIGINT * 6000 AS dur, round(l_discount * 100)::BIGINT * 600 AS off,
        [0, 30000, 120000][l_suppkey % 3 + 1] AS fin, 30000 AS fout, ['wipe', 'dip', 'crossfade', NULL][l_suppkey % 4 + 1] AS transition, ['left', 'right', 'up', 'down'][l_partkey % 4 + 1] AS direction,
        l_partkey % 11 AS asset, 1 + l_suppkey % 2 * 0.5::DOUBLE AS retime, l_partkey, l_suppkey, l_linenumber FROM li WHERE l_linenumber % 5 IN (1, 2, 3)),
  a AS (SELECT *, CASE WHEN {AT} < s OR {AT} >= s + dur THEN 0 WHEN fin > 0 AND {AT} - s < fin THEN ({AT} - s) / fin::DOUBLE WHEN s + dur - {AT} < fout THEN (s + dur - {AT}) / fout::DOUBLE ELSE 1 END AS alpha FROM c),
  m AS (SELECT *, count(*) OVER (PARTITION BY timeline) AS n, row_number() OVER (PARTITION BY timeline ORDER BY track, s, clip) AS o1, row_number() OVER (PARTITION BY timeline ORDER BY s, clip) AS o2 FROM a WHERE alpha > 0),
  l AS (SELECT *, CASE WHEN n = 2 THEN o2 ELSE o1 END AS o FROM m),
  two AS (SELECT x.timeline, y.transition, y.direction,
        CASE WHEN y.fin > 0 AND {AT} - y.s <= y.fin THEN ({AT} - y.s) / y.fin::DOUBLE WHEN {AT} >= x.s + x.dur - x.fout THEN 1 - (x.s + x.dur - {AT}) / x.fout::DOUBLE ELSE y.alpha / (x.alpha + y.alpha) END AS progress
        FROM l x JOIN l y ON y.timeline = x.timeline AND x.o = 1 AND y.o = 2 WHERE x.n = 2),
  tl AS (SELECT DISTINCT l_orderkey AS timeline FROM lineitem),
  plan AS (SELECT tl.timeline, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'empty' WHEN n = 1 THEN 'single' WHEN n > 2 THEN 'over' WHEN transition IN ('wipe', 'dip') THEN transition ELSE 'crossfade' END AS composite, progress, direction
        FROM tl LEFT JOIN (SELECT DISTINCT timeline, n FROM l) k USING (timeline) LEFT JOIN two USING (timeline))"""


@query(
    "compiled_timelines",
    _CLIPS + """, fx AS (SELECT timeline, string_agg(concat_ws('>', o::VARCHAR, CASE WHEN l_suppkey % 2 = 0 THEN 'exposure' END, CASE WHEN l_linenumber % 2 = 0 THEN 'contrast' END, CASE WHEN l_partkey % 3 = 0 THEN 'saturation' END,
        CASE WHEN l_partkey % 7 = 0 THEN 'temperature' END, CASE WHEN l_partkey % 13 = 0 THEN 'tonemap' END), ' ' ORDER BY o) AS chains, sum(alpha) AS alpha FROM l GROUP BY timeline)
      SELECT timeline, n::INTEGER AS layers, composite, round(progress, 9) AS progress, chains, round(alpha, 9) AS alpha FROM plan LEFT JOIN fx USING (timeline)""",
)
def compiled_timelines(spark, d):
    """Each timeline's layers, their chains of effects and their composite at one time."""
    plans = render.compile_at(clips(spark, d), effects(spark, d), AT)
    chain = F.transform("layers", lambda la, i: F.concat_ws(">", (i + 1).cast("string"), F.transform(la["chain"], lambda fx: fx["effect"])))
    alpha = F.aggregate("layers", F.lit(0.0), lambda s, la: s + la["alpha"])
    some = F.size("layers") > 0
    return plans.select("timeline", F.size("layers").alias("layers"), "composite", F.round("progress", 9).alias("progress"), F.when(some, F.concat_ws(" ", chain)).alias("chains"), F.when(some, F.round(alpha, 9)).alias("alpha"))


def _pixels_sql() -> str:
    unit = {"r": "0.5 + v * 2", "g": "0.45 + v", "b": "0.4 - v"}
    s = Steps("shown").then([f"CASE WHEN l_partkey % 5 = 0 THEN {c} ELSE {_decode(c)} END" for c in RGB]).then(_mat(P.REC709_TO_ACESCG, RGB))
    s.then([f"CASE WHEN l_suppkey % 2 = 0 THEN {c} * {2**0.3} ELSE {c} END" for c in RGB])
    s.then([f"CASE WHEN l_linenumber % 2 = 0 THEN ({c} - 0.18) * 1.1 + 0.18 ELSE {c} END" for c in RGB])
    s.then([f"CASE WHEN l_partkey % 3 = 0 THEN {LAP1} * (1 - 0.8::DOUBLE) + {c} * 0.8 ELSE {c} END" for c in RGB])
    s.then([f"CASE WHEN l_partkey % 7 = 0 THEN {c} + {k} ELSE {c} END" for c, k in zip(RGB, (0.03, -0.02, -0.03))])
    s.then([f"CASE WHEN l_partkey % 13 = 0 THEN {_film(c)} ELSE {c} END" for c in RGB])
    mixed = ", ".join(
        f"CASE composite WHEN 'single' THEN x.{c} WHEN 'crossfade' THEN x.{c} * (1 - progress) + y.{c} * progress "
        f"WHEN 'dip' THEN CASE WHEN progress < 0.5 THEN x.{c} * (1 - progress * 2) + {k} * progress * 2 ELSE {k} * (1 - (progress - 0.5) * 2) + y.{c} * (progress - 0.5) * 2 END "
        f"WHEN 'wipe' THEN CASE WHEN CASE direction WHEN 'right' THEN x.x / 7::DOUBLE >= 1 - progress WHEN 'up' THEN x.y / 7::DOUBLE <= progress WHEN 'down' THEN x.y / 7::DOUBLE >= 1 - progress ELSE x.x / 7::DOUBLE <= progress END THEN y.{c} ELSE x.{c} END END AS {c}"
        for c, k in zip(RGB, (0.1, 0.0, 0.2))
    )
    step = ", ".join(f"b.{c} * b.alpha + w.{c} * w.a * w.before * (1 - b.alpha)" for c in RGB)
    parts = [
        _CLIPS,
        "fr AS (SELECT label AS asset, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS nf, embedding FROM embeddings WHERE label IS NOT NULL)",
        f"asked AS (SELECT l.*, greatest(0, least(floor((({AT} - s) + off) * retime / {TICKS}), nf - 1)) AS k FROM l LEFT JOIN (SELECT DISTINCT asset, nf FROM fr) z USING (asset))",
        "seen AS (SELECT asked.*, embedding[i + 1]::DOUBLE AS v, (i % 8)::INTEGER AS x, (i // 8)::INTEGER AS y FROM asked LEFT JOIN fr USING (asset, k), (SELECT unnest(range(64)) AS i))",
        f"shown AS (SELECT *, {', '.join(f'coalesce(CASE WHEN v IS NOT NULL THEN {_clamp(e)} END, 0) AS {c}' for c, e in unit.items())} FROM seen)",
        *s.parts,
        f"px AS MATERIALIZED (SELECT timeline, o, n, alpha, x, y, r, g, b FROM {s.last})",
        f"few AS (SELECT x.timeline, x.x, x.y, {mixed} FROM plan JOIN px x ON x.timeline = plan.timeline AND x.o = 1 LEFT JOIN px y ON y.timeline = x.timeline AND y.o = 2 AND y.x = x.x AND y.y = x.y WHERE plan.n <= 2)",
        f"w AS (SELECT timeline, o, n, x, y, r, g, b, 1::DOUBLE AS a, alpha AS before FROM px WHERE n > 2 AND o = 1 UNION ALL SELECT b.timeline, b.o, b.n, b.x, b.y, {step}, b.alpha + w.a * w.before * (1 - b.alpha), b.alpha FROM w JOIN px b ON b.timeline = w.timeline AND b.o = w.o + 1 AND b.x = w.x AND b.y = w.y)",
        "dark AS (SELECT timeline, (i % 8)::INTEGER AS x, (i // 8)::INTEGER AS y, 0::DOUBLE AS r, 0::DOUBLE AS g, 0::DOUBLE AS b FROM plan, (SELECT unnest(range(64)) AS i) WHERE n = 0)",
        "met AS (SELECT * FROM few UNION ALL SELECT timeline, x, y, r, g, b FROM w WHERE o = n UNION ALL SELECT * FROM dark)",
    ]
    out = _sweet(Steps("met")).then([_curve(_zero(c)) for c in RGB]).then(_mat(P.ACESCG_TO_REC709, RGB)).then([_clamp(c) for c in RGB]).then([_encode(c) for c in RGB])
    renamed = [p.replace("s", "o", 1) if p.startswith("s") else p for p in out.parts]
    renamed = [p.replace(f"FROM s{k - 1})", f"FROM o{k - 1})") for k, p in enumerate(renamed)]
    means = ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in RGB)
    return ", ".join([*parts, *renamed]) + f" SELECT timeline, {means}, round(max(r) FILTER (x = 0 AND y = 0), 6) AS first_r, round(max(b) FILTER (x = 7 AND y = 7), 6) AS last_b FROM o{len(out.parts) - 1} GROUP BY timeline"


@query("rendered_timelines", _pixels_sql())
def rendered_timelines(spark, d):
    """Every timeline's picture at one time: its mean colour and two of its corners."""
    plans = render.compile_at(clips(spark, d), effects(spark, d), AT)
    p = render.pictures(plans, frames(spark, d), 8, 8, TICKS)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / 64
    return p.select("timeline", *[F.round(mean(c), 6).alias(f"mean_{c}") for c in RGB], F.round(F.get("r", F.lit(0)), 6).alias("first_r"), F.round(F.get("b", F.lit(63)), 6).alias("last_b"))
