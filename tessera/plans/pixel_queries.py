"""Image kernels over frames of 8 by 8 pixels, and generated frames."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.operators import pixels as P
from tessera.plans.registry import Registry
from tessera.sources import views as V

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def rounded(df):
    return df.select(*[c for c in df.columns if c not in ("r", "g", "b")], *[F.round(c, 9).alias(c) for c in "rgb"])


def _select(exprs, source="pixels", extra="frame, x, y"):
    return f" SELECT {extra}, " + ", ".join(f"round({e}, 9) AS {c}" for c, e in zip("rgb", exprs)) + f" FROM {source}"


def _clamp(e):
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {e}))"


def _mat(m, p):
    return [f"({row[0]} * ({p[0]}) + {row[1]} * ({p[1]}) + {row[2]} * ({p[2]}))" for row in m]


def _decode(c):
    return f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE power(({c} + 0.055) / 1.055, 2.4) END"


def _film(c):
    return _clamp(f"(({c}) * (2.51 * ({c}) + 0.03)) / (({c}) * (2.43 * ({c}) + 0.59) + 0.14)")


def _smooth(a, b, x):
    t = _clamp(f"(({x}) - {a}) / ({b} - {a})")
    return f"({t} * {t} * (3 - 2 * {t}))"


L709 = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"
LAP1 = "(0.2722287 * r + 0.6740818 * g + 0.0536895 * b)"
RGB = ["r", "g", "b"]
CDL = [f"power(greatest({c} * 1.1 - 0.02, 0), 0.9)" for c in RGB]
GRADE = [f"(0.5 * (1 - 1.1) + {c} * {2**0.2} * 1.1)" for c in RGB]
EXPOSED = [f"({c} * {2**0.3})" for c in RGB]
PQ = "power((0.8359375 + 18.8515625 * power({x}, 0.1593017578125)) / (1 + 18.6875 * power({x}, 0.1593017578125)), 78.84375)"
MASK = f"(1 - {_smooth(0.1, 0.3, 'greatest(abs(r - 0.6), abs(g - 0.5), abs(b - 0.4))')})"

POINT_SQL = {
    "exposure_adjust": _select([f"{c} * {2**0.5}" for c in RGB]),
    "contrast_adjust": _select([f"({c} - 0.18) * 1.2 + 0.18" for c in RGB]),
    "cdl_correct": f", c AS (SELECT frame, x, y, {CDL[0]} AS r, {CDL[1]} AS g, {CDL[2]} AS b FROM pixels), l AS (SELECT *, 0.2722287 * r + 0.6740818 * g + 0.0536895 * b AS lum FROM c)"
    + _select([f"lum + 1.2 * ({c} - lum)" for c in RGB], "l"),
    "idt_rec709_to_acescg": _select(_mat(P.REC709_TO_ACESCG, [_decode(c) for c in RGB])),
    "idt_linear_rec709_to_acescg": _select(_mat(P.REC709_TO_ACESCG, RGB)),
    "aces_tonemap": _select([_film(c) for c in RGB]),
    "fx_tonemap_aces": _select([f"power({_film(e)}, {1 / 2.2})" for e in _mat(P.ACESCG_TO_REC709, EXPOSED)]),
    "fx_color_grade_simple": f", c AS (SELECT frame, x, y, {GRADE[0]} AS r, {GRADE[1]} AS g, {GRADE[2]} AS b FROM pixels)"
    + _select([f"({L709} * 0.1 + r * 0.9) + 0.03", f"({L709} * 0.1 + g * 0.9) - 0.02", f"({L709} * 0.1 + b * 0.9) - 0.03"], "c"),
    "fx_bloom_threshold": _select([f"CASE WHEN {LAP1} > 0.45 THEN {c} ELSE 0 END" for c in RGB]),
    "fx_anamorphic_threshold": _select([f"CASE WHEN greatest(r, g, b) > 0.6 THEN {c} ELSE 0 END" for c in RGB]),
    "watermark_diagonal_stripes": _select([f"CASE WHEN (x + y) % 5 < 2 THEN {c} * 0.825 ELSE {c} END" for c in RGB]),
    "pq_output": _select([PQ.format(x=f"({c} * 0.1)") for c in RGB]),
    "masked_grade": _select([f"{c} * (1 - {MASK}) + {c} * {2**0.5} * {MASK}" for c in RGB]),
}

for _name, _kernel in P.POINT_KERNELS.items():
    query("px_" + _name, V.ctes("pixels") + POINT_SQL[_name] if _name in POINT_SQL else None)(
        lambda spark, d, k=_kernel: rounded(P.put(V.pixels(spark, d), k()))
    )

def _mix(a, b, t):
    return f"({a} * (1 - {t}) + {b} * {t})"


_UNIT = {"r": "0.5 + {e} * 2", "g": "0.45 + {e}", "b": "0.4 - {e}"}


def frames_beside(n: int) -> str:
    """``many``: every frame's pixels with those of the next ones, channels r, g, b, r2, g2, b2, r3..."""
    joins = " ".join(f"JOIN v v{k} ON v{k}.frame = v1.frame + {k - 1}" for k in range(2, n + 1))
    values = ", ".join(f"{_clamp(e.format(e=f'e{k}[i + 1]'))} AS {c}{k if k > 1 else ''}" for k in range(1, n + 1) for c, e in _UNIT.items())
    return f"""WITH v AS (SELECT vec_id AS frame, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings),
      together AS (SELECT v1.frame, {', '.join(f'v{k}.e AS e{k}' for k in range(1, n + 1))} FROM v v1 {joins}),
      many AS (SELECT frame, (i % 8)::INTEGER AS x, (i // 8)::INTEGER AS y, {values} FROM (SELECT *, unnest(range(0, 64)) AS i FROM together) u)"""


PAIR = frames_beside(2) + ", two AS (SELECT * FROM many)"
FALL = f"(1 - {_smooth(0.3, 1.0, 'sqrt(power((x + 0.5) / 8 - 0.5, 2) + power((y + 0.5) / 8 - 0.5, 2)) * 2')})"
TWO_SQL = {
    "crossfade": [f"{c} * 0.7 + {c}2 * 0.3" for c in RGB],
    "alpha_blend": [f"{c} * 0.6 + {c}2 * 0.8 * 0.4" for c in RGB],
    "dip": [f"{k} * {1 - (0.83 - 0.5) * 2} + {c}2 * {(0.83 - 0.5) * 2}" for c, k in zip(RGB, (0.1, 0.0, 0.2))],
    "wipe": [f"CASE WHEN x / 7::DOUBLE >= 0.6 THEN {c}2 ELSE {c} END" for c in RGB],
    "tinted_add": [f"{c} + {c}2 * {k} * 0.4" for c, k in zip(RGB, (0.5, 0.8, 1.0))],
    "halation": [f"{c} + {c}2 * {k} * 0.4 * {FALL}" for c, k in zip(RGB, (1.0, 0.4, 0.2))],
}
for _name, _kernel in P.TWO_FRAME_KERNELS.items():
    query("px_" + _name, PAIR + _select(TWO_SQL[_name], "two"))(
        lambda spark, d, k=_kernel: rounded(P.put(V.pixel_neighbours(spark, d, 2), k()).drop("r2", "g2", "b2"))
    )


def _grid(w, h):
    return f"WITH gr AS (SELECT (i % {w})::INTEGER AS x, (i // {w})::INTEGER AS y FROM (SELECT unnest(range(0, {w * h})) AS i) n)"


def _case(colours, u, n):
    return [f"CASE least({len(colours) - 1}, floor({u} * {n}))::INTEGER " + " ".join(f"WHEN {i} THEN {c[k]}" for i, c in enumerate(colours)) + " END" for k in range(3)]


_bars = [f"CASE WHEN y / 36::DOUBLE < 0.67 THEN {a} WHEN y / 36::DOUBLE < 0.75 THEN {b} ELSE {c} END"
         for a, b, c in zip(_case(P.BARS_TOP, "(x / 64::DOUBLE)", 7), _case(P.BARS_MIDDLE, "(x / 64::DOUBLE)", 7), _case(P.BARS_LOW, "(x / 64::DOUBLE)", 6))]


@query("px_smpte_bars", _grid(64, 36) + _select(_bars, "gr", "x, y"))
def smpte_bars(spark, d):
    return rounded(P.smpte_bars(spark))


_cell = "(floor(y / 40::DOUBLE * 4) * 6 + floor(x / 60::DOUBLE * 6))"
_patch = [f"CASE {_cell}::INTEGER " + " ".join(f"WHEN {i} THEN {c[k]}" for i, c in enumerate(P.MACBETH)) + " END" for k in range(3)]
_fu, _fv = "(x / 60::DOUBLE * 6 - floor(x / 60::DOUBLE * 6))", "(y / 40::DOUBLE * 4 - floor(y / 40::DOUBLE * 4))"


@query("px_macbeth", _grid(60, 40) + _select([f"CASE WHEN {_fu} < 0.05 OR {_fu} > 0.95 OR {_fv} < 0.05 OR {_fv} > 0.95 THEN 0.02 ELSE {p} END" for p in _patch], "gr", "x, y"))
def macbeth(spark, d):
    return rounded(P.macbeth(spark))


_c, _s, _k = math.cos(0.75), math.sin(0.75), 50 + 40 * math.sin(0.3)


@query(
    "px_zone_plate",
    _grid(64, 36) + f", uv AS (SELECT x, y, (x / 64::DOUBLE * 2 - 1) * {64 / 36} AS u, y / 36::DOUBLE * 2 - 1 AS v FROM gr), r2 AS (SELECT x, y, power(u * {_c} - v * {_s}, 2) + power(u * {_s} + v * {_c}, 2) AS q FROM uv)"
    + _select([f"0.5 + 0.5 * sin({_k} * q)"] * 3, "r2", "x, y"),
)
def zone_plate(spark, d):
    return rounded(P.zone_plate(spark))


@query("px_linear_ramp", _grid(64, 4) + _select(["x / 64::DOUBLE * 5"] * 3, "gr", "x, y"))
def linear_ramp(spark, d):
    return rounded(P.linear_ramp(spark))


@query("px_test_color", _grid(64, 4) + _select(["x / 64::DOUBLE", "x / 64::DOUBLE * 0.5", "1 - x / 64::DOUBLE"], "gr", "x, y"))
def test_color(spark, d):
    return rounded(P.test_color(spark))


_dist = "(power((g.x / 16::DOUBLE - (f.x + f.w / 2)) / (f.w / 2), 2) + power((g.y / 9::DOUBLE - (f.y + f.h / 2)) / (f.h / 2), 2))"


@query(
    "px_face_mask",
    V.ctes("faces") + ", gr AS (SELECT (i % 16)::INTEGER AS x, (i // 16)::INTEGER AS y FROM (SELECT unnest(range(0, 144)) AS i) n)"
    + f" SELECT f.pos, g.x, g.y, round(max(1 - {_smooth(0.5, 1.5, _dist)}), 6) AS mask FROM faces f, gr g GROUP BY 1, 2, 3",
)
def face_mask(spark, d):
    return P.face_mask(V.faces(spark, d), spark).withColumn("mask", F.round("mask", 6))


def _blur_sql(axis):
    taps = [(i, math.exp(-i * i / 2.0)) for i in range(-2, 3)]
    total = sum(w for _, w in taps)
    rows = ", ".join(f"({i}, {w / total})" for i, w in taps)
    other = "y" if axis == "x" else "x"
    return (V.ctes("pixels") + f", tap(i, w) AS (VALUES {rows}) SELECT a.frame, a.x, a.y, " + ", ".join(f"round(sum(tap.w * s.{c}), 9) AS {c}" for c in RGB)
            + f" FROM pixels a, tap JOIN pixels s ON s.frame = a.frame AND s.{other} = a.{other} AND s.{axis} = least(7, greatest(0, a.{axis} + tap.i)) GROUP BY 1, 2, 3")


@query("px_blur_h", _blur_sql("x"))
def blur_h(spark, d):
    return rounded(P.gaussian_blur(V.pixels(spark, d), "x"))


@query("px_blur_v", _blur_sql("y"))
def blur_v(spark, d):
    return rounded(P.gaussian_blur(V.pixels(spark, d), "y"))


_wx = "(1 - abs((o.x + 0.5) / 5 * 8 - 0.5 - k.i))"
_wy = "(1 - abs((o.y + 0.5) / 5 * 8 - 0.5 - k.j))"


@query(
    "px_resize_bilinear",
    V.ctes("pixels") + """, o AS (SELECT (i % 5)::INTEGER AS x, (i // 5)::INTEGER AS y FROM (SELECT unnest(range(0, 25)) AS i) n),
      k AS (SELECT a.i, b.j FROM (SELECT unnest(range(-1, 9)) AS i) a, (SELECT unnest(range(-1, 9)) AS j) b),""" + f"""
      t AS (SELECT o.x, o.y, least(7, greatest(0, k.i)) AS px, least(7, greatest(0, k.j)) AS py, {_wx} * {_wy} AS w FROM o, k WHERE {_wx} > 0 AND {_wy} > 0)
      SELECT p.frame, t.x, t.y, """ + ", ".join(f"round(sum(t.w * p.{c}), 9) AS {c}" for c in RGB) + " FROM t JOIN pixels p ON p.x = t.px AND p.y = t.py GROUP BY 1, 2, 3",
)
def resize_bilinear(spark, d):
    return rounded(P.bilinear_resize(V.pixels(spark, d), 5, 5))
