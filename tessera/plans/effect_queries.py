"""Lens and camera effects, false colour and resampling over frames of 8 by 8 pixels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.operators import effects as E
from tessera.operators import pixels as P
from tessera.plans.pixel_queries import L709, PAIR, RGB, _clamp, _select, rounded
from tessera.plans.registry import Registry
from tessera.sources import views as V

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

NOISE = "((52.9829189 * ((0.06711056 * x + 0.00583715 * y) - floor(0.06711056 * x + 0.00583715 * y))) - floor(52.9829189 * ((0.06711056 * x + 0.00583715 * y) - floor(0.06711056 * x + 0.00583715 * y))))"
CUT = [f"least({c}, 0.9)" for c in RGB]
BRIGHT = f"greatest({', '.join(CUT)})"
SOFT = f"least(0.4, greatest(0, {BRIGHT} - 0.4 + 0.2))"
GAIN = f"(greatest({SOFT} * {SOFT} / {4 * 0.2 + 1e-4}, {BRIGHT} - 0.4) / greatest({BRIGHT}, 1e-4))"
PX, PY = "abs(((x + 0.5) / 8 - 0.5) * 36)", "abs(((y + 0.5) / 8 - 0.5) * 36)"
DIST = f"(greatest({PX}, {PY}) * 0.4 + sqrt({PX} * {PX} + {PY} * {PY}) * 0.6)"
FALL = f"power(35 / sqrt(35 * 35 + {DIST} * {DIST}), 6)"
T = _clamp(f"power({L709} * {2**0.2}, {1 / 1.2})")
SQL = {
    "bloom_prefilter": [f"{c} * {GAIN}" for c in CUT],
    "vignette": [f"{c} * ({FALL} * 0.8 + 0.2) + ({NOISE} - 0.5) * 0.002" for c in RGB],
    "false_color": [_clamp(" + ".join(f"({v}) * power({T}, {i})" for i, v in enumerate(k))) for k in E.TURBO],
    "hlg_output": [f"CASE WHEN {c} <= {1 / 12} THEN sqrt(3 * {c}) ELSE 0.17883277 * ln(greatest(12 * {c} - 0.28466892, 1e-9)) + 0.55991073 END" for c in RGB],
    "asinh_stretch": [f"asinh(5 * {_clamp(f'({c} - 0.1) / 0.8')}) / {math.asinh(5.0)}" for c in RGB],
}
for _name, _kernel in E.POINT_EFFECTS.items():
    query("px_" + _name, V.ctes("pixels") + _select(SQL[_name]))(lambda spark, d, k=_kernel: rounded(P.put(V.pixels(spark, d), k())))


@query("px_bloom_composite", PAIR + _select([f"{c} + {c}2 * 0.5 + ({NOISE} - 0.5) / 255" for c in RGB], "two"))
def bloom_composite(spark, d):
    return rounded(P.put(V.pixel_neighbours(spark, d, 2), E.bloom_composite()).drop("r2", "g2", "b2"))


def _tent(c, side):
    s = f"(q.scale * (1 + {side * 0.2} * q.r2))"
    return f"""{c}s AS (SELECT p.frame, q.x, q.y, sum(p.{c} * greatest(0, 1 - abs((q.cx * {s} + 0.5) * 8 - 0.5 - k.i)) * greatest(0, 1 - abs((q.cy * {s} + 0.5) * 8 - 0.5 - k.j))) AS v
      FROM q, k JOIN pixels p ON p.x = least(7, greatest(0, k.i)) AND p.y = least(7, greatest(0, k.j)) GROUP BY 1, 2, 3)"""


@query(
    "px_lens",
    V.ctes("pixels") + """, g AS (SELECT x, y, x / 8::DOUBLE - 0.5 AS cx, y / 8::DOUBLE - 0.5 AS cy FROM (SELECT unnest(range(0, 8)) AS x) a, (SELECT unnest(range(0, 8)) AS y) b),
      q AS (SELECT *, cx * cx + cy * cy AS r2, 1 - 0.3 * (cx * cx + cy * cy) - 0.1 * (cx * cx + cy * cy) * (cx * cx + cy * cy) AS scale FROM g),
      k AS (SELECT i, j FROM (SELECT unnest(range(-2, 10)) AS i) a, (SELECT unnest(range(-2, 10)) AS j) b), """ + ", ".join(_tent(c, s) for c, s in (("r", -1), ("g", 0), ("b", 1)))
    + " SELECT rs.frame, rs.x::INTEGER AS x, rs.y::INTEGER AS y, round(rs.v, 9) AS r, round(gs.v, 9) AS g, round(bs.v, 9) AS b FROM rs JOIN gs USING (frame, x, y) JOIN bs USING (frame, x, y)",
)
def lens(spark, d):
    return rounded(E.lens(V.pixels(spark, d)))


def _cat(d):
    return f"CASE WHEN abs({d}) <= 1 THEN 1.5 * power(abs({d}), 3) - 2.5 * power(abs({d}), 2) + 1 WHEN abs({d}) < 2 THEN -0.5 * power(abs({d}), 3) + 2.5 * power(abs({d}), 2) - 4 * abs({d}) + 2 ELSE 0 END"


_dx, _dy = "((o.x + 0.5) / 5 * 8 - 0.5 - k.i)", "((o.y + 0.5) / 5 * 8 - 0.5 - k.j)"


@query(
    "px_resize_bicubic",
    V.ctes("pixels") + """, o AS (SELECT (i % 5)::INTEGER AS x, (i // 5)::INTEGER AS y FROM (SELECT unnest(range(0, 25)) AS i) n),
      k AS (SELECT a.i, b.j FROM (SELECT unnest(range(-3, 11)) AS i) a, (SELECT unnest(range(-3, 11)) AS j) b),""" + f"""
      t AS (SELECT o.x, o.y, least(7, greatest(0, k.i)) AS px, least(7, greatest(0, k.j)) AS py, ({_cat(_dx)}) * ({_cat(_dy)}) AS w FROM o, k WHERE abs({_dx}) < 2 AND abs({_dy}) < 2)
      SELECT p.frame, t.x, t.y, """ + ", ".join(f"round(sum(t.w * p.{c}) / sum(t.w), 9) AS {c}" for c in RGB) + " FROM t JOIN pixels p ON p.x = t.px AND p.y = t.py GROUP BY 1, 2, 3",
)
def resize_bicubic(spark, d):
    return rounded(E.bicubic_resize(V.pixels(spark, d), 5, 5))


def _box(axis, src):
    other = "y" if axis == "x" else "x"
    return f"SELECT a.frame, a.x, a.y, " + ", ".join(f"avg(s.{c}) AS {c}" for c in RGB) + f" FROM {src} a, (SELECT unnest([-1, 0, 1]) AS d) k JOIN {src} s ON s.frame = a.frame AND s.{other} = a.{other} AND s.{axis} = least(7, greatest(0, a.{axis} + k.d)) GROUP BY 1, 2, 3"


@query("px_box_blur", V.ctes("pixels") + f", h AS ({_box('x', 'pixels')}), v AS ({_box('y', 'h')})" + _select(RGB, "v"))
def box_blur(spark, d):
    return rounded(E.box_blur(V.pixels(spark, d)))
