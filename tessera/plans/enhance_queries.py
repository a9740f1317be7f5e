"""The enhance job: colour and sound of every source proposed, judged on a budget of evidence, and changed until accepted."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import enhance, scenes
from tessera.plans.registry import Registry
from tessera.sources import views as V
from tessera.sources.scratch import written

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

CYCLES, SLOTS = 4, 8
# For colour and sound: the first value, aim, how near is accepted and how near asks for more evidence, and the largest step.
COLOUR = (1.0, 0.14, 0.004, 0.02, 0.4)
SOUND = (0.0, 0.55, 0.01, 0.04, 0.05)


def evidence(spark, d):
    """What each of a source's slots of samples adds up to; a cycle looks at one slot, more evidence is that of a second."""
    nth = F.row_number().over(Window.partitionBy("src").orderBy("t", "pos")) - 1
    s = V.samples(spark, d).withColumn("slot", nth % SLOTS)
    return written(s.groupBy("src", "slot").agg(F.sum("luma").alias("luma"), F.sum("skin").alias("skin"), F.count("*").alias("n")), "evidence")


def judge_with(stats):
    def judge(open_, cycle, more):
        slots = [cycle % SLOTS] + ([(cycle + SLOTS // 2) % SLOTS] if more else [])
        seen = stats.where(F.col("slot").isin(slots)).groupBy("src").agg((F.sum("luma") / F.sum("n")).alias("luma"), (F.sum("skin") / F.sum("n")).alias("skin"))
        by_job = lambda k: F.when(F.col("job") == "colour", COLOUR[k]).otherwise(SOUND[k])
        level = F.when(F.col("job") == "colour", F.col("luma") * F.col("value")).otherwise(F.col("skin") + F.col("value"))
        far = F.coalesce(F.abs(level - by_job(1)), F.lit(9.0))
        return open_.join(seen, "src", "left").withColumns({"accepted": far <= by_job(2), "asks": (far > by_job(2)) & (far <= by_job(3))})

    return judge


def edit(judged):
    """Towards the aim by a bounded step; without evidence nothing changes."""
    bounded = lambda x, most: F.least(F.lit(most), F.greatest(F.lit(-most), x))
    gain = F.least(F.lit(4.0), F.greatest(F.lit(0.25), F.col("value") + bounded(COLOUR[1] / F.col("luma") - F.col("value"), COLOUR[4])))
    shift = F.col("value") + bounded(SOUND[1] - F.col("skin") - F.col("value"), SOUND[4])
    return judged.withColumn("value", F.coalesce(F.when(F.col("job") == "colour", gain).otherwise(shift), "value"))


def _case(k: int) -> str:
    return f"CASE WHEN job = 'colour' THEN {COLOUR[k]} ELSE {SOUND[k]} END::DOUBLE"


_LEVEL = "CASE WHEN job = 'colour' THEN {luma} * value ELSE {skin} + value END"
_SIDES = ", ".join(f"round(max(value) FILTER (job = '{j}'), 6) AS {n}, max(cycle) FILTER (job = '{j}')::INTEGER AS {n}_cycles, max(outcome) FILTER (job = '{j}') AS {n}_outcome" for j, n in (("colour", "gain"), ("sound", "level")))


@query(
    "enhanced_sources",
    V.ctes("samples") + f""", st AS (SELECT src, slot, sum(luma) AS l, sum(skin) AS s, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY t, pos) - 1) % {SLOTS} AS slot FROM samples) GROUP BY src, slot),
      e AS (SELECT x.src, c, x.l / x.n AS luma, x.s / x.n AS skin, (x.l + y.l) / (x.n + y.n) AS luma2, (x.s + y.s) / (x.n + y.n) AS skin2 FROM range({CYCLES}) t(c) JOIN st x ON x.slot = c % {SLOTS} JOIN st y ON y.src = x.src AND y.slot = (c + {SLOTS // 2}) % {SLOTS}),
      r AS (SELECT src, job, CASE WHEN job = 'colour' THEN {COLOUR[0]} ELSE {SOUND[0]} END::DOUBLE AS value, 0 AS cycle, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT src FROM samples), (VALUES ('colour'), ('sound')) j(job)
        UNION ALL
        SELECT src, job, CASE WHEN kind IS NOT NULL OR cycle = {CYCLES - 1} THEN value WHEN job = 'colour' THEN least(4, greatest(0.25, value + least({COLOUR[4]}, greatest(-{COLOUR[4]}, {COLOUR[1]} / lu - value)))) ELSE value + least({SOUND[4]}, greatest(-{SOUND[4]}, {SOUND[1]} - sk - value)) END,
          cycle + 1, CASE WHEN kind IS NOT NULL THEN kind WHEN cycle = {CYCLES - 1} THEN 'exhausted' END
        FROM (SELECT *, CASE WHEN far <= {_case(2)} THEN 'accepted' WHEN far <= {_case(3)} AND far2 <= {_case(2)} THEN 'escalated' END AS kind, CASE WHEN far > {_case(2)} AND far <= {_case(3)} THEN luma2 ELSE luma END AS lu, CASE WHEN far > {_case(2)} AND far <= {_case(3)} THEN skin2 ELSE skin END AS sk
          FROM (SELECT r.*, e.* EXCLUDE (src, c), abs({_LEVEL.format(luma='luma', skin='skin')} - {_case(1)}) AS far, abs({_LEVEL.format(luma='luma2', skin='skin2')} - {_case(1)}) AS far2 FROM r JOIN e ON e.src = r.src AND e.c = r.cycle WHERE outcome IS NULL)))
      SELECT src, {_SIDES} FROM r WHERE outcome IS NOT NULL GROUP BY src""",
)
def enhanced_sources(spark, d):
    """For each source its gain and level, the cycles they took, and whether they were accepted, only on more evidence, or not at all."""
    sources = V.samples(spark, d).select("src").distinct()
    jobs = sources.select("src", F.explode(F.array(*[F.struct(F.lit(j).alias("job"), F.lit(v[0]).alias("value")) for j, v in (("colour", COLOUR), ("sound", SOUND))])).alias("j")).select("src", "j.*")
    done = enhance.feedback_loop(jobs, judge_with(evidence(spark, d)), edit, cycles=CYCLES)
    side = lambda job, c: F.max(F.when(F.col("job") == job, F.col(c)))
    return done.groupBy("src").agg(*[out for job, name in (("colour", "gain"), ("sound", "level")) for out in (F.round(side(job, "value"), 6).alias(name), side(job, "cycles").alias(f"{name}_cycles"), side(job, "outcome").alias(f"{name}_outcome"))])


_CELLS = (0, 27, 63)
_COLOURS = "[" + ", ".join(f"struct_pack(r := r[{k + 1}], g := g[{k + 1}], b := b[{k + 1}])" for k in _CELLS) + "]"


@query(
    "scene_labels",
    f"""WITH u AS (SELECT vec_id // 16 AS src, list_transform(embedding, lambda v: least(1, greatest(0, 0.35::DOUBLE + v::DOUBLE * 2))) AS r, list_transform(embedding, lambda v: least(1, greatest(0, 0.3::DOUBLE + v::DOUBLE))) AS g, list_transform(embedding, lambda v: least(1, greatest(0, 0.25::DOUBLE - v::DOUBLE))) AS b FROM embeddings),
      s AS (SELECT src, {_COLOURS} AS cs, 0.2126 * list_avg(r) + 0.7152 * list_avg(g) + 0.0722 * list_avg(b) AS luma, len(list_filter(r, lambda v: v > 0.9)) / 64::DOUBLE AS skin FROM u),
      q AS (SELECT src, avg(luma) AS luma, avg(skin) AS skin, greatest(avg((len(list_filter(cs, lambda c: c.b > c.r + 0.06 AND c.b > c.g + 0.06 AND c.b > 0.35)) > 0)::INT), avg((len(list_filter(cs, lambda c: c.g > c.r + 0.05 AND c.g > c.b + 0.05 AND c.g > 0.30)) > 0)::INT),
          avg((len(list_filter(cs, lambda c: greatest(c.g, c.b) > c.r + 0.06 AND greatest(c.g, c.b) > 0.35)) > 0)::INT)) AS cue, avg((cs[1].r > cs[1].b + 0.08 AND cs[1].r > cs[1].g + 0.03)::INT) AS warm FROM s GROUP BY src),
      p AS (SELECT *, CASE WHEN luma > 0.30 AND cue > 0.35 THEN 'outdoor' WHEN luma < 0.28 AND warm > 0.45 THEN 'indoor' ELSE 'unknown' END AS place, CASE WHEN skin < 0.02 THEN 0.1 ELSE 0 END AS less FROM q),
      c AS (SELECT *, CASE place WHEN 'outdoor' THEN least(0.95, 0.55 + 0.4 * least(1, (cue - 0.35) / 0.65)) WHEN 'indoor' THEN least(0.9, 0.55 + 0.35 * least(1, (warm - 0.45) / 0.55)) ELSE 0.2 END AS sure FROM p),
      l AS (SELECT *, CASE WHEN place = 'outdoor' THEN 'natural' WHEN place = 'indoor' THEN CASE WHEN warm > 0.5 THEN 'artificial' ELSE 'mixed' END WHEN warm > 0.55 AND luma < 0.30 THEN 'artificial' WHEN cue > 0.60 AND luma > 0.35 THEN 'natural' ELSE 'unknown' END AS light FROM c)
      SELECT src, place, round(greatest(0, sure - less), 6) AS place_conf, light, round(greatest(0, CASE WHEN place = 'outdoor' THEN least(0.95, greatest(sure, 0.6)) WHEN place = 'indoor' THEN CASE WHEN warm > 0.5 THEN least(0.9, 0.6 + 0.3 * warm) ELSE 0.55 END WHEN light = 'unknown' THEN 0.2 ELSE 0.6 END - less), 6) AS light_conf FROM l""",
)
def scene_labels(spark, d):
    """Place and light of every sixteen frames, by the colours at three places of each."""
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    of = lambda f: F.transform("embedding", lambda v: unit(f(v.cast("double"))))
    u = V.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("src"), of(lambda v: 0.35 + v * 2).alias("r"), of(lambda v: 0.3 + v).alias("g"), of(lambda v: 0.25 - v).alias("b"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    colours = F.array(*[F.struct(*[F.get(c, F.lit(k)).alias(c) for c in "rgb"]) for k in _CELLS])
    s = u.select("src", colours.alias("colours"), (0.2126 * mean("r") + 0.7152 * mean("g") + 0.0722 * mean("b")).alias("luma"), (F.size(F.filter("r", lambda v: v > 0.9)) / 64.0).alias("skin"))
    return scenes.scene_labels(s).withColumns({c: F.round(c, 6) for c in ("place_conf", "light_conf")})


BUDGET = 6


@query(
    "evidence_frames",
    V.ctes("samples", "segments") + f""", n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, pos) - 1 AS nth, count(*) OVER (PARTITION BY src) AS many FROM samples),
      a AS (SELECT src, arg_min(t, row(luma, t, pos)) AS t, 'min_luma' AS tag, 2 AS priority FROM samples GROUP BY src UNION ALL SELECT src, arg_min(t, row(-luma, t, pos)), 'max_luma', 2 FROM samples GROUP BY src
        UNION ALL SELECT src, t, 'midpoint', 2 FROM n WHERE nth = many // 2 UNION ALL SELECT src, e * f, 'anchor', 3 FROM (SELECT src, max(t) AS e FROM samples GROUP BY src) x, (SELECT unnest([0.15::DOUBLE, 0.35, 0.65, 0.85]) AS f) y WHERE e > 0
        UNION ALL SELECT src, ("start" + "end") * 0.5, CASE WHEN seg % 40 = 0 THEN 'avoid_heavy_grade' ELSE 'grade_confidence_low' END, 1 FROM segments WHERE seg % 40 IN (0, 7) UNION ALL SELECT src, unnest([1.0::DOUBLE, 2.5, -1.0]), 'escalation', 0 FROM (SELECT DISTINCT src FROM samples WHERE src % 3 = 0) z),
      g AS (SELECT src, round(t * 1000)::BIGINT AS ms, min(priority) AS priority, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM a WHERE t >= 0 GROUP BY src, round(t * 1000)::BIGINT)
      SELECT * FROM (SELECT src, row_number() OVER (PARTITION BY src ORDER BY priority, ms, tags)::INTEGER AS n, ms, priority, tags FROM g) WHERE n <= {BUDGET}""",
)
def evidence_frames(spark, d):
    """The six frames of each source that a judge is shown."""
    s = V.samples(spark, d)
    seg = F.col("seg") % 40
    descriptors = V.segments(spark, d).select("src", F.when(seg == 0, "avoid_heavy_grade").when(seg == 7, "grade_confidence_low").otherwise("safe_for_beauty").alias("label"), "start", "end")
    asked = s.where("src % 3 = 0").select("src").distinct().select("src", F.explode(F.array(F.lit(1.0), F.lit(2.5), F.lit(-1.0))).alias("t"))
    return scenes.evidence_frames(s, descriptors, asked, BUDGET)
