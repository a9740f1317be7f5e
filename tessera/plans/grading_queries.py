"""Colour grading, viewing transforms, tables and composites over frames of 8 by 8 pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.half import round_half
from tessera.operators import grading as G
from tessera.operators import pixels as P
from tessera.plans.pixel_queries import L709, LAP1, PQ, RGB, _clamp, _mat, _mix, _select, _smooth, frames_beside, rounded
from tessera.plans.registry import Registry
from tessera.sources import views as V

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

L2020 = "(0.2627 * r + 0.6780 * g + 0.0593 * b)"
SPREAD = "sqrt(power(r - luma, 2) + power(g - luma, 2) + power(b - luma, 2))"
RED = _smooth(0.0, 0.25, "r - greatest(g, b)")


class Steps:
    """Common table expressions over (frame, x, y, r, g, b) and what else a step adds, one after another."""

    def __init__(self, source: str = "pixels") -> None:
        self.last, self.parts = source, []

    def then(self, channels: list[str] | None = None, **more: str) -> Steps:
        name = f"s{len(self.parts)}"
        new = dict(zip(RGB, channels)) if channels else {}
        self.parts.append(f"{name} AS (SELECT * REPLACE ({', '.join(f'({e}) AS {c}' for c, e in new.items())}) FROM {self.last})" if new else f"{name} AS (SELECT *, {', '.join(f'({e}) AS {c}' for c, e in more.items())} FROM {self.last})")
        self.last = name
        return self

    def drop(self, *names: str) -> Steps:
        name = f"s{len(self.parts)}"
        self.parts.append(f"{name} AS (SELECT * EXCLUDE ({', '.join(names)}) FROM {self.last})")
        self.last = name
        return self

    def sql(self, head: str = "") -> str:
        return (head or V.ctes("pixels")) + ", " + ", ".join(self.parts) + _select(RGB, self.last)


def _zero(e: str) -> str:
    return f"greatest({e}, 0)"


def _curve(e: str) -> str:
    return f"(({e}) * (({e}) + 0.0245786) - 0.000090537) / (({e}) * (0.983729 * ({e}) + 0.4329510) + 0.238081)"


def _encode(c: str) -> str:
    return _clamp(f"CASE WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * power({c}, {1 / 2.4}) - 0.055 END")


def _sweet(s: Steps, high: float = 0.12, red: float = 0.06) -> Steps:
    s.then(luma=LAP1).then(hi=f"{high} * {_smooth(1.0, 4.0, 'greatest(luma, 0)')}").then([_mix(c, "luma", "hi") for c in RGB])
    return s.then(pull=f"{red} * {RED} * {_smooth(0.03, 0.25, SPREAD)}").then([_mix("r", "luma", "pull"), "g", "b"]).drop("luma", "hi", "pull")


def _rendering(s: Steps) -> Steps:
    s.then([_zero(c) for c in RGB]).then(luma=LAP1).then(gain=f"1 + 0.06 * {_smooth(0.02, 0.20, SPREAD)} * {_smooth(0.10, 2.0, 'luma')}").then([f"{c} * gain" for c in RGB]).drop("luma", "gain")
    s.then(luma=LAP1).then(pull=f"0.10 * {RED} * {_smooth(0.02, 0.25, SPREAD)} * {_smooth(0.10, 3.0, 'luma')}").then([_mix("r", "luma", "pull"), "g", "b"]).drop("luma", "pull")
    return _sweet(s).then([_curve(c) for c in RGB])


def _squeeze(s: Steps, luma: str, threshold: str, limit: str, strength: str) -> Steps:
    s.then(luma=luma, th=threshold, lim=limit, k=_clamp(strength)).then(sat=f"{SPREAD} / greatest(luma, 1e-4)")
    s.then(sc=f"CASE WHEN sat > 1e-6 THEN (CASE WHEN sat <= th THEN sat ELSE th + (sat - th) * greatest(lim - th, 1e-3) / ((sat - th) + greatest(lim - th, 1e-3)) END) / sat ELSE 1 END")
    return s.then([_zero(_mix(c, f"(luma + ({c} - luma) * sc)", "k")) for c in RGB]).drop("luma", "th", "lim", "k", "sat", "sc")


def _sdr(gamut: float = 0.0, high: float = 0.12, red: float = 0.06) -> str:
    s = _sweet(Steps(), high, red).then([_curve(_zero(c)) for c in RGB]).then(_mat(P.ACESCG_TO_REC709, RGB))
    if gamut:
        s.then([_zero(c) for c in RGB]).then(bright=_smooth(0.25, 1.0, LAP1)).then(lim0="2.4 * (1 - bright) + 1.35 * bright")
        _squeeze(s, LAP1, "0.85 * lim0", "lim0", str(gamut)).drop("bright", "lim0")
    return s.then([_clamp(c) for c in RGB]).then([_encode(c) for c in RGB]).sql()


def _hdr(nits: float) -> str:
    s = _rendering(Steps()).then([_zero(e) for e in _mat(G.ACESCG_TO_REC2020, RGB)]).then(bright=f"0.60 * {_smooth(100.0, 600.0, f'{L2020} * {nits / 10}')}")
    return _squeeze(s, L2020, "1.20", "1.50", "bright").then([PQ.format(x=f"({c} * {nits / 100000})") for c in RGB]).sql()


def _hdr_tuned() -> str:
    s = _rendering(Steps()).then([_zero(e) for e in _mat(G.ACESCG_TO_REC2020, RGB)]).then(bright=f"0.7 * {_smooth(100.0, 600.0, f'{L2020} * 1000 * 0.12')}")
    s = _squeeze(s, L2020, "1.20", "1.50", "bright").then(luma=L2020).then(fade=_clamp(f"0.3 * {_clamp('luma')}")).then([_mix(c, "luma", "fade") for c in RGB]).drop("luma", "fade")
    s = s.then(luma=L2020).then(gain=f"1000 * {_mix('0.10', '0.12', _smooth(0.02, 0.20, 'luma'))}").then([f"{c} * gain" for c in RGB])
    return s.then([PQ.format(x=f"({c} / (1 + {c} / 800) / 10000)") for c in RGB]).sql()


def of_pixels(name: str, oracle: str, kernel) -> None:
    query("px_" + name, oracle)(lambda spark, d: rounded(kernel(V.pixels(spark, d))))


SCENE = 3.0  # what a frame's 1 is in scene light, so that highlights are met
BRIGHT = [f"{c} * {SCENE}" for c in RGB]


def scene(frames):
    return G.step(frames, P.source().each(lambda c: c * SCENE))


def _scene_sql(sql: str) -> str:
    """``sql`` on brighter frames."""
    return sql.replace("s0 AS (SELECT", f"scene AS (SELECT frame, x, y, {', '.join(f'{e} AS {c}' for c, e in zip(RGB, BRIGHT))} FROM pixels), s0 AS (SELECT", 1).replace("FROM pixels)", "FROM scene)").replace("FROM scene), s0", "FROM pixels), s0", 1)


of_pixels("odt_acescg_to_rec709", _sdr(), G.to_rec709)
of_pixels("odt_studio", _scene_sql(_sdr()), lambda p: G.to_rec709(scene(p)))
of_pixels("odt_studio_tuned", _scene_sql(_sdr(0.8, 0.3, 0.2)), lambda p: G.to_rec709(scene(p), gamut=0.8, highlights=0.3, reds=0.2))
of_pixels("tonemap_pq", _scene_sql(_hdr(600.0)), lambda p: G.to_pq(scene(p), 600.0))
of_pixels("odt_pq1000", _scene_sql(_hdr(1000.0)), lambda p: G.to_pq(scene(p)))
of_pixels("odt_pq1000_tuned", _scene_sql(_hdr_tuned()), lambda p: G.to_pq_tuned(scene(p)))
of_pixels("clear_color", V.ctes("pixels") + _select(["0.1::DOUBLE", "0.2::DOUBLE", "0.3::DOUBLE"]), lambda p: P.put(p, P.Rgb(F.lit(0.1), F.lit(0.2), F.lit(0.3))))
of_pixels("depth_one", V.ctes("pixels") + _select(["1::DOUBLE"] * 3), lambda p: P.put(p, P.Rgb(*[F.lit(1.0)] * 3)))
of_pixels("source_texture", V.ctes("pixels") + _select(RGB), lambda p: p)
of_pixels("rgba_to_bgra", V.ctes("pixels") + _select(["b", "g", "r"]), lambda p: P.put(p, P.Rgb(F.col("b"), F.col("g"), F.col("r"))))
of_pixels("halation_threshold", V.ctes("pixels") + _select([f"CASE WHEN {LAP1} > 0.5 THEN {c} ELSE 0 END" for c in RGB]), lambda p: P.put(p, P.source().each(lambda c: F.when(P.dot(P.source(), P.LUMA_AP1) > 0.5, c).otherwise(0.0))))


# Lightness models and log encoding.
def _hsl_steps(s: Steps) -> Steps:
    s.then(top="greatest(r, g, b)", low="least(r, g, b)").then(d="top - low", l="(top + low) / 2")
    s.then(sat="CASE WHEN d = 0 THEN 0 WHEN l > 0.5 THEN d / (2 - top - low) ELSE d / (top + low) END")
    return s.then(h="CASE WHEN d = 0 THEN 0 WHEN top = r THEN (g - b) / d + CASE WHEN g < b THEN 6 ELSE 0 END WHEN top = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END / 6")


def _from_hsl(s: Steps) -> Steps:
    s.then(hi="CASE WHEN l < 0.5 THEN l * (1 + sat) ELSE l + sat - l * sat END").then(lo="2 * l - hi")
    wrap = lambda e: f"CASE WHEN {e} < 0 THEN {e} + 1 WHEN {e} > 1 THEN {e} - 1 ELSE {e} END"
    s.then(hr=wrap(f"(h + {1 / 3})"), hg=wrap("(h + 0)"), hb=wrap(f"(h + {-1 / 3})"))
    ramp = lambda t: f"CASE WHEN sat = 0 THEN l WHEN 6 * {t} < 1 THEN lo + (hi - lo) * 6 * {t} WHEN 2 * {t} < 1 THEN hi WHEN 3 * {t} < 2 THEN lo + (hi - lo) * ({2 / 3} - {t}) * 6 ELSE lo END"
    return s.then([ramp("h" + c) for c in RGB]).drop("top", "low", "d", "l", "sat", "h", "hi", "lo", "hr", "hg", "hb")


_hsl = _hsl_steps(Steps())


@query("px_rgb_to_hsl", V.ctes("pixels") + ", " + ", ".join(_hsl.parts) + f" SELECT frame, x, y, round(h, 9) AS h, round(sat, 9) AS s, round(l, 9) AS l FROM {_hsl.last}")
def rgb_to_hsl(spark, d):
    return G.with_hsl(V.pixels(spark, d)).select("frame", "x", "y", *[F.round(c, 9).alias(c) for c in "hsl"])


# Adding a seventh of a turn makes every branch of the way back be met.
of_pixels("hue_turned", _from_hsl(_hsl_steps(Steps()).then(h2="h + 0.14").drop("h").then(h="h2").drop("h2")).sql(), lambda p: G.from_hsl(G.with_hsl(p).withColumn("h", F.col("h") + 0.14)))


def _cct(c: str) -> str:
    return f"CASE WHEN {c} <= 0.0078125 THEN 10.5402377416545 * {c} + 0.0729055341958355 ELSE (log2(greatest({c}, 0.0078125)) + 9.72) / 17.52 END"


def _from_cct(c: str) -> str:
    return f"CASE WHEN {c} <= 0.155251141552511 THEN ({c} - 0.0729055341958355) / 10.5402377416545 ELSE power(2.0::DOUBLE, {c} * 17.52 - 9.72) END"


of_pixels("log_encode", V.ctes("pixels") + _select([_cct(c) for c in RGB]), lambda p: P.put(p, P.source().each(G.cct_encode)))
of_pixels("log_decode", V.ctes("pixels") + _select([_from_cct(c) for c in RGB]), lambda p: P.put(p, P.source().each(G.cct_decode)))


# Keyed grades.
def _graded(mask: str, hue: float, saturation: float, exposure: float) -> str:
    s = Steps().then(mask=mask, r0="r", g0="g", b0="b").then([f"{c} * {2**exposure}" for c in RGB])
    _hsl_steps(s).then(h2=f"h + {hue}").drop("h").then(h="CASE WHEN h2 > 1 THEN h2 - 1 WHEN h2 < 0 THEN h2 + 1 ELSE h2 END").drop("h2")
    return _from_hsl(s).then(luma=LAP1).then([_mix(c + "0", _mix("luma", c, saturation), "mask") for c in RGB]).sql()


KEY = f"1 - {_smooth(0.1, 0.3, 'greatest(abs(r - 0.6), abs(g - 0.5), abs(b - 0.4))')}"
of_pixels("grade_by_key", _graded(KEY, 0.3, 0.8, 0.5), lambda p: G.keyed_grade(p, key=(0.6, 0.5, 0.4), hue=0.3, saturation=0.8, exposure=0.5))
of_pixels("grade_by_mask", _graded("1 - (x / 7::DOUBLE)", -0.2, 1.3, -0.3), lambda p: G.keyed_grade(p, mask=F.col("x") / 7, invert=True, hue=-0.2, saturation=1.3, exposure=-0.3))


# A three-dimensional table made by a rule.
SIDE = 5
CORNER = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]


def warm_table(n: int = SIDE) -> np.ndarray:
    i, j, k = np.meshgrid(*[np.arange(n) / (n - 1)] * 3, indexing="ij")
    return np.stack([i**0.8, 0.1 + 0.8 * j * (0.5 + 0.5 * i), k * k * 0.9], axis=-1)


def _table_sql(source: str) -> str:
    """Channels of ``source`` through the table, as cells, weights and a join."""
    at = {c: f"least({SIDE - 1}, greatest(0, least(1, greatest(0, {c})) * {SIDE} - 0.5))" for c in RGB}
    low = ", ".join(f"floor({e})::INTEGER AS {c}i, {e} - floor({e}) AS {c}f" for c, e in at.items())
    weight = " * ".join(f"CASE WHEN d{n} = 1 THEN {c}f ELSE 1 - {c}f END" for n, c in enumerate(RGB))
    cells = ", ".join(f"least({SIDE - 1}, {c}i + d{n}) AS {c}c" for n, c in enumerate(RGB))
    return f"""cube AS (SELECT i, j, k, power(i / {SIDE - 1}::DOUBLE, 0.8) AS lr, 0.1 + 0.8 * (j / {SIDE - 1}::DOUBLE) * (0.5 + 0.5 * (i / {SIDE - 1}::DOUBLE)) AS lg, power(k / {SIDE - 1}::DOUBLE, 2) * 0.9 AS lb
        FROM (SELECT unnest(range(0, {SIDE})) AS i) a, (SELECT unnest(range(0, {SIDE})) AS j) b, (SELECT unnest(range(0, {SIDE})) AS k) c),
      corner(d0, d1, d2) AS (VALUES {', '.join(map(str, CORNER))}), cell AS (SELECT *, {low} FROM {source}),
      part AS (SELECT cell.*, {weight} AS w, {cells} FROM cell, corner),
      looked AS (SELECT frame, x, y, sum(w * lr) AS r, sum(w * lg) AS g, sum(w * lb) AS b FROM part JOIN cube ON i = rc AND j = gc AND k = bc GROUP BY 1, 2, 3)"""


of_pixels("lut_apply_3d", V.ctes("pixels") + ", " + _table_sql("pixels") + _select(RGB, "looked"), lambda p: G.apply_table(p, warm_table()))


def _half(e: str) -> str:
    """SQL of the nearest half-precision number of a normal or smaller one."""
    step = f"power(2::DOUBLE, greatest(floor(log2(abs({e}))), -14) - 10)"
    return f"CASE WHEN {e} = 0 THEN 0 ELSE round_even({e} / {step}, 0) * {step} END"


def in_half(frames):
    return G.step(frames, P.source().each(round_half))


of_pixels(
    "lut_apply_3d_half",
    V.ctes("pixels") + f", half AS (SELECT frame, x, y, {', '.join(f'{_half(c)} AS {c}' for c in RGB)} FROM pixels), "
    + _table_sql("half").replace("cube AS (SELECT i, j, k,", "wide AS (SELECT i, j, k,", 1).replace("corner(d0", f"cube AS (SELECT i, j, k, {', '.join(f'{_half(c)} AS {c}' for c in ('lr', 'lg', 'lb'))} FROM wide), corner(d0", 1)
    + _select([_half(c) for c in RGB], "looked"),
    lambda p: in_half(G.apply_table(in_half(p), warm_table().astype(np.float16))),
)
_logged = Steps().then([_cct(c) for c in RGB])
of_pixels(
    "apply_lut",
    V.ctes("pixels") + ", " + ", ".join(_logged.parts) + ", " + _table_sql(_logged.last)
    + " SELECT p.frame, p.x, p.y, " + ", ".join(f"round(p.{c} * {1 - 0.7}::DOUBLE + ({_from_cct('k.' + c)}) * 0.7::DOUBLE, 9) AS {c}" for c in RGB) + " FROM pixels p JOIN looked k USING (frame, x, y)",
    lambda p: G.apply_table_in_log(p, warm_table(), 0.7),
)


# Several layers, regions and bands.
def _over(c: str) -> str:
    return f"((({c} * 0.9) * (1 - 0.5) + {c}2 * 0.5) * (1 - 0.25) + {c}3 * 0.25)"


@query("px_multi_layer", frames_beside(3) + _select([_over(c) for c in RGB], "many"))
def multi_layer(spark, d):
    p = V.pixel_neighbours(spark, d, 3)
    return rounded(P.put(p, G.layers_over(["", "2", "3"], [0.9, 0.5, 0.25])).select("frame", "x", "y", "r", "g", "b"))


@query("px_person_mask", frames_beside(2) + _select(["r2"] * 3, "many"))
def person_mask(spark, d):
    p = V.pixel_neighbours(spark, d, 2)
    return rounded(p.select("frame", "x", "y", *[F.col("r2").alias(c) for c in "rgb"]))


@query(
    "px_volumetric_composite",
    frames_beside(2) + f""", n AS (SELECT *, coalesce(lead(g2) OVER w, g2) AS ar, coalesce(lag(g2) OVER w, g2) AS al, coalesce(lead(g2) OVER h, g2) AS au, coalesce(lag(g2) OVER h, g2) AS ad FROM many
        WINDOW w AS (PARTITION BY frame, y ORDER BY x), h AS (PARTITION BY frame, x ORDER BY y)),
      b AS (SELECT *, (abs(ar - al) + abs(au - ad)) / (abs(ar - al) + abs(au - ad) + 0.15) AS edge, {L709} / ({L709} + 0.08) AS star FROM n)"""
    + _select([f"({c}2 + {c}2 * 0.03 * star * edge) + {c} * (1 - 0.05 * star * edge * (0.25 + 0.75 * g2)) * (1 - g2)" for c in RGB], "b"),
)
def volumetric_composite(spark, d):
    p = V.pixel_neighbours(spark, d, 2).withColumn("a2", F.col("g2"))
    return rounded(G.volumetric_over(p))


def _white(c: str) -> str:
    s = 0.6
    return f"(({_mix(L709, c, 1 - 0.25 * s)} + {0.05 * s} - 0.5) * {1 + 0.06 * s} + 0.5)"


of_pixels("whitening", V.ctes("pixels") + _select([f"CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 3 AND 6 THEN {_white(c)} ELSE {c} END" for c in RGB]), lambda p: G.whiten(p, F.col("x").between(2, 5) & F.col("y").between(3, 6), 0.6))

BANDS = ((0.7, 0.2, 0.1), (0.2, 0.6, 0.2), (0.0, 0.3, 0.7))
_band = Steps().then([f"{w[0]} * r + {w[1]} * g + {w[2]} * b" for w in BANDS]).then(most="greatest(max(r) OVER (PARTITION BY frame), max(g) OVER (PARTITION BY frame), max(b) OVER (PARTITION BY frame), 1e-6)")
_band.then([f"1 - exp(-1.2 * greatest({c}, 0) / most)" for c in RGB]).then([_clamp(f"({c} - 0.5) * 1.1 + 0.5") for c in RGB]).then(luma=L709).then([_clamp(_mix("luma", c, 1.15)) for c in RGB]).then([f"power({c}, {1 / 2.2})" for c in RGB])
of_pixels("band_composite", _band.sql(), lambda p: G.band_composite(p.withColumnsRenamed({"r": "b0", "g": "b1", "b": "b2"}), BANDS))
