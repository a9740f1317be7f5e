"""Noise fields, stars, grain, leaks and remaps, with SQL beside them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.operators import procedural as N
from tessera.plans.grading_queries import Steps
from tessera.plans.pixel_queries import LAP1, RGB, _clamp, _grid, _select, _smooth, rounded
from tessera.plans.registry import Registry
from tessera.sources import views as V

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_WORD = (1 << 32) - 1


def _times32(e: str, factor: int) -> str:
    return f"(((({e}) & 65535) * {factor} + (((({e}) >> 16) * {factor}) & 65535) * 65536) & {_WORD})"


def _mixed(parts: list[str], last: str, seed: str, name: str) -> str:
    parts.append(f"{name}a AS (SELECT *, {seed} AS {name} FROM {last})")
    last = f"{name}a"
    for n, (shift, factor) in enumerate(N.MIXER):
        parts.append(f"{name}{n} AS (SELECT * REPLACE ({_times32(f'xor({name}, {name} >> {shift})', factor)} AS {name}) FROM {last})")
        last = f"{name}{n}"
    parts.append(f"{name}z AS (SELECT * REPLACE (({name} & 16777215) / 16777216::DOUBLE AS {name}) FROM {last})")
    return f"{name}z"


def _stars() -> str:
    parts = ["at0 AS (SELECT x, y, y::BIGINT * 256 + x AS pos FROM gr)"]
    last = "at0"
    for (factor, more), name in zip(N.SEEDS, ("r0", "r1")):
        last = _mixed(parts, last, f"(({_times32('pos', factor)} + {more}) & {_WORD})", name)
    star = "CASE WHEN r0 < 0.00045 + 0.00030 * (0.5 + 0.5 * sin((x + 0.5) / 256 * 17)) THEN 0.08 + 0.92 * power(greatest(1 - r1, 1e-6), 6) ELSE 0 END"
    return _grid(256, 144) + ", " + ", ".join(parts) + _select([f"0.002 + 0.004 * (1 - (y + 0.5) / 144) + {star}"] * 3, last, "x, y")


@query("px_starfield", _stars())
def starfield(spark, d):
    return rounded(N.starfield(spark))


def _fr(e: str) -> str:
    return f"(({e}) - floor({e}))"


def _place(s: Steps, px: str, py: str, name: str) -> Steps:
    s.then(n0=_fr(f"({px}) * 0.1031"), n1=_fr(f"({py}) * 0.1031")).then(n2="n0 * (n1 + 33.33) + n1 * (n0 + 33.33) + n0 * (n0 + 33.33)")
    return s.then(**{name: _fr("(n0 + n1 + n2 * 2) * (n0 + n2)")}).drop("n0", "n1", "n2")


_grain = Steps()
_place(_place(_grain, "x / 1.3::DOUBLE + 50", "y / 1.3::DOUBLE + 100", "u1"), "x / 1.3::DOUBLE + 50 + 1000", "y / 1.3::DOUBLE + 100 + 1000", "u2")
_grain.then(normal=f"sqrt(-2 * ln(least(0.99999, greatest(0.00001, u1)))) * cos({2 * math.pi} * u2)", luma=LAP1)
_grain.then(grain=f"least(0.5, greatest(-0.5, normal * 0.2 * (1 - 0.7 * {_smooth(0.7, 1.0, 'luma')}) * (1 + 1.0 * (1 - {_smooth(0.0, 0.5, 'luma')}))))").then([f"{c} + grain" for c in RGB])


@query("px_film_grain", _grain.sql().replace(", 9)", ", 5)"))
def film_grain(spark, d):
    return N.film_grain(V.pixels(spark, d)).select("frame", "x", "y", *[F.round(c, 5).alias(c) for c in "rgb"])


def _simplex(s: Steps, px: str, py: str) -> Steps:
    wrap = lambda e: f"(({e}) - floor(({e}) / 289) * 289)"
    s.then(px=px, py=py).then(i=f"floor(px + (px + py) * {N.SKEW})", j=f"floor(py + (px + py) * {N.SKEW})")
    s.then(x0=f"px - i + (i + j) * {N.UNSKEW}", y0=f"py - j + (i + j) * {N.UNSKEW}").then(di1="CASE WHEN x0 > y0 THEN 1 ELSE 0 END", mi=wrap("i"), mj=wrap("j"))
    for n, (di, dj) in enumerate((("0", "0"), ("di1", "(1 - di1)"), ("1", "1"))):
        s.then(**{f"cx{n}": f"x0 - {di} + {n * N.UNSKEW}", f"cy{n}": f"y0 - {dj} + {n * N.UNSKEW}", f"q{n}": wrap(f"((mj + {dj}) * 34 + 1) * (mj + {dj})")})
        s.then(**{f"w{n}": f"q{n} + mi + {di}"}).then(**{f"p{n}": wrap(f"(w{n} * 34 + 1) * w{n}")}).then(**{f"b{n}": f"2 * {_fr(f'p{n} / 41')} - 1"})
        s.then(**{f"h{n}": f"abs(b{n}) - 0.5", f"a{n}": f"b{n} - floor(b{n} + 0.5)", f"m{n}": f"power(greatest(0.5 - (cx{n} * cx{n} + cy{n} * cy{n}), 0), 4)"})
    return s.then(noise="130 * (" + " + ".join(f"m{n} * (1.79284291400159 - 0.85373472095314 * (a{n} * a{n} + h{n} * h{n})) * (a{n} * cx{n} + h{n} * cy{n})" for n in range(3)) + ")")


_ca, _sa, _wob = math.cos(0.7), math.sin(0.7), math.sin(0.3 * 6.28318) * 0.1 * 0.05
_leak = Steps().then(lx=f"(x / 8::DOUBLE - 0.2) * {_ca} + (y / 8::DOUBLE - 0.3) * {_sa} + {_wob}", ly=f"(x / 8::DOUBLE - 0.2) * {-_sa} + (y / 8::DOUBLE - 0.3) * {_ca}")
_simplex(_leak, "lx * 3 + 0.3", "ly * 3 + 0.3").then(leak=f"0.6 * (1 - {_smooth(0.0, 1.4, 'sqrt(power(lx / 0.75, 2) + power(ly / 0.5, 2)) + noise * 0.3')})").then([f"{c} + leak * {t}" for c, t in zip(RGB, (1.0, 0.5, 0.2))])


@query("px_light_leak", _leak.sql())
def light_leak(spark, d):
    return rounded(N.light_leak(V.pixels(spark, d)))


_field = Steps("gr")
_simplex(_field, "x / 5::DOUBLE - 3", "y / 5::DOUBLE + 2")


@query("noise_field", _grid(48, 27) + ", " + ", ".join(_field.parts) + f" SELECT x, y, round(noise, 9) AS noise FROM {_field.last}")
def noise_field(spark, d):
    q = N.simplex(N.grid(spark, 48, 27), F.col("x") / 5 - 3, F.col("y") / 5 + 2, "noise")
    return q.withColumn("noise", F.round("noise", 9))


_bins = f"least(9, greatest(0, floor((noise + 1) * 5)))"


@query("density_histogram", _grid(48, 27) + ", " + ", ".join(_field.parts) + f" SELECT {_bins}::INTEGER AS bin, count(*) AS n FROM {_field.last} GROUP BY 1")
def density_histogram(spark, d):
    q = N.simplex(N.grid(spark, 48, 27), F.col("x") / 5 - 3, F.col("y") / 5 + 2, "noise")
    return q.groupBy(F.least(F.lit(9), F.greatest(F.lit(0), F.floor((F.col("noise") + 1) * 5))).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def _dispersed(angle: float) -> str:
    ux, uy = ("(dx + 0.0001) / far1", "(dy + 0.0001) / far1") if angle == 0 else (str(math.cos(angle)), str(math.sin(angle)))
    s = Steps().then(dx="x / 8::DOUBLE - 0.5", dy="y / 8::DOUBLE - 0.5").then(far1="sqrt(power(dx + 0.0001, 2) + power(dy + 0.0001, 2))", amount=f"power(sqrt(dx * dx + dy * dy), 1.2) * 0.8 * {900 / 1080}")
    for c, side in (("r", "-"), ("b", "+")):
        s.then(**{f"{c}x": f"trunc(least(7, greatest(0, (x / 8::DOUBLE {side} {ux} * amount) * 8)))::INTEGER", f"{c}y": f"trunc(least(7, greatest(0, (y / 8::DOUBLE {side} {uy} * amount) * 8)))::INTEGER"})
    return V.ctes("pixels") + ", " + ", ".join(s.parts) + f""" SELECT a.frame, a.x, a.y, round(a.r * {1 - 0.8}::DOUBLE + p.r * 0.8::DOUBLE, 9) AS r, round(a.g, 9) AS g, round(a.b * {1 - 0.8}::DOUBLE + q.b * 0.8::DOUBLE, 9) AS b
      FROM {s.last} a JOIN pixels p ON p.frame = a.frame AND p.x = a.rx AND p.y = a.ry JOIN pixels q ON q.frame = a.frame AND q.x = a.bx AND q.y = a."by" """


for _name, _angle in (("px_dispersion", 0.0), ("px_dispersion_angle", 0.9)):
    query(_name, _dispersed(_angle).replace("AS by", 'AS "by"'))(lambda spark, d, a=_angle: rounded(N.dispersion(V.pixels(spark, d), angle=a)))


def sampled_sql(at: str, name: str, channels: dict[str, str], frame: bool = False) -> str:
    """CTE ``name``: sums of channels of ``pixels`` read bilinearly at (sx, sy) of each (x, y, k) of ``at``,
    in pixels from the first one's centre, edges repeated. ``channels``: new name to channel."""
    corners = "(SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(i, j))"
    keys = "p.frame, a.x, a.y, a.k"
    return f"""{name}_at AS (SELECT a.*, least(7, greatest(0, floor(sx) + i))::INTEGER AS px, least(7, greatest(0, floor(sy) + j))::INTEGER AS py,
        CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END * CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END AS part FROM {at} a, {corners} c),
      {name} AS (SELECT {keys}, {', '.join(f'sum(a.part * p.{c}) AS {n}' for n, c in channels.items())} FROM {name}_at a JOIN pixels p ON p.x = a.px AND p.y = a.py{' AND p.frame = a.frame' if frame else ''} GROUP BY ALL)"""


_CENTRED = "cen AS (SELECT x, y, 0 AS k, x / 8::DOUBLE - 0.5 AS cx, y / 8::DOUBLE - 0.5 AS cy FROM gr), rad AS (SELECT *, cx * cx + cy * cy AS r2 FROM cen)"
_GR = "gr AS (SELECT (i % 8)::INTEGER AS x, (i // 8)::INTEGER AS y FROM (SELECT unnest(range(0, 64)) AS i) n)"


@query(
    "px_radial_distortion",
    V.ctes("pixels") + f", {_GR}, {_CENTRED}, sc AS (SELECT *, 1 - 0.3 * r2 + 0.9 * r2 * r2 AS s FROM rad), uv AS (SELECT x, y, k, cx * s + 0.5 AS u, cy * s + 0.5 AS v FROM sc), spot AS (SELECT *, u * 8 - 0.5 AS sx, v * 8 - 0.5 AS sy FROM uv), "
    + sampled_sql("spot", "got", {"r": "r", "g": "g", "b": "b"}) + f", fin AS (SELECT g0.frame, g0.x, g0.y, {', '.join(f'CASE WHEN u < 0 OR u > 1 OR v < 0 OR v > 1 THEN 0 ELSE g0.{c} END AS {c}' for c in RGB)} FROM got g0 JOIN uv USING (x, y))" + _select(RGB, "fin"),
)
def radial_distortion(spark, d):
    return rounded(N.radial_distortion(V.pixels(spark, d)))


def _fringe(side: int) -> str:
    return f"(SELECT x, y, 0 AS k, (cx * (1 + {side * 0.4} * r2) + 0.5) * 8 - 0.5 AS sx, (cy * (1 + {side * 0.4} * r2) + 0.5) * 8 - 0.5 AS sy FROM rad)"


@query(
    "px_colour_fringes",
    V.ctes("pixels") + f", {_GR}, {_CENTRED}, " + ", ".join(f"spot_{c} AS {_fringe(s)}, " + sampled_sql(f"spot_{c}", f"got_{c}", {c: c}) for c, s in (("r", -1), ("g", 0), ("b", 1)))
    + ", fin AS (SELECT * FROM got_r JOIN got_g USING (frame, x, y) JOIN got_b USING (frame, x, y))" + _select(RGB, "fin"),
)
def colour_fringes(spark, d):
    return rounded(N.colour_fringes(V.pixels(spark, d)))


STAR = [(0.5, 0.05), (0.62, 0.4), (0.95, 0.4), (0.68, 0.6), (0.8, 0.95), (0.5, 0.72), (0.2, 0.95), (0.32, 0.6), (0.05, 0.4), (0.38, 0.4)]
_edges = ", ".join(str((*a, *b)) for a, b in zip(STAR, STAR[1:] + STAR[:1]))


@query(
    "polygon_mask",
    _grid(24, 16) + f""", edge(ax, ay, bx, "by") AS (VALUES {_edges}), hit AS (SELECT x, y, count(*) AS n FROM gr, edge
      WHERE (ay > (y + 0.5) / 16) <> ("by" > (y + 0.5) / 16) AND (x + 0.5) / 24 < ((y + 0.5) / 16 - ay) * (bx - ax) / ("by" - ay) + ax GROUP BY 1, 2)
      SELECT x, y, CASE WHEN n % 2 = 1 THEN 255 ELSE 0 END AS mask FROM gr LEFT JOIN hit USING (x, y)""",
)
def polygon_mask(spark, d):
    return N.polygon_mask(spark, STAR)
