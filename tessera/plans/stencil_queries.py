"""Stencils over frames of 8 by 8 pixels kept as arrays; SQL reads the same places by joins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.operators import stencils as S
from tessera.plans.effect_queries import NOISE
from tessera.plans.pixel_queries import L709, LAP1, RGB, _clamp, _grid, _select, _smooth, rounded
from tessera.plans.procedural_queries import _GR, sampled_sql
from tessera.plans.registry import Registry
from tessera.sources import views as V

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
RGB_SELF = {c: c for c in RGB}


def _run(name: str, oracle: str | None, kernel: S.Kernel, mask: str | None = None) -> None:
    """Register a kernel on all frames; ``mask`` names the channel that also serves as a fourth one."""

    def run(spark, d):
        frames = V.frames(spark, d)
        return rounded(S.to_pixels(S.apply(frames.withColumn("m", F.col(mask)) if mask else frames, kernel, 8, 8)))

    query("px_" + name, oracle)(run)


def _taps(taps: list[tuple]) -> str:
    return f"tap(k, dx, dy, w) AS (VALUES {', '.join(f'({k}, {dx}::DOUBLE, {dy}::DOUBLE, {w}::DOUBLE)' for k, (dx, dy, w) in enumerate(taps))})"


HEAD = V.ctes("pixels") + ", " + _GR
_spot = "spot AS (SELECT x, y, k, x + dx AS sx, y + dy AS sy FROM gr, tap)"

_run(
    "bokeh",
    f"{HEAD}, {_taps([(*t, 1) for t in S.spiral(3.0)])}, {_spot}, " + sampled_sql("spot", "got", RGB_SELF)
    + f", sums AS (SELECT frame, x, y, {', '.join(f'sum({c} * (1 + 4 * {LAP1})) / sum(1 + 4 * {LAP1}) AS n{c}' for c in RGB)} FROM got GROUP BY ALL)" + _select(["n" + c for c in RGB], "sums"),
    S.bokeh(3.0),
)
_run(
    "bloom_down",
    _grid(4, 4).replace("WITH gr", V.ctes("pixels") + ", gr") + f", {_taps(S.DOWN_TAPS)}, spot AS (SELECT x, y, k, (x + 0.5) * 2 - 0.5 + dx AS sx, (y + 0.5) * 2 - 0.5 + dy AS sy FROM gr, tap), " + sampled_sql("spot", "got", RGB_SELF)
    + f", sums AS (SELECT frame, x, y, {', '.join(f'sum({c} * w) AS n{c}' for c in RGB)} FROM got JOIN tap USING (k) GROUP BY ALL)" + _select(["n" + c for c in RGB], "sums"),
    S.bloom_down,
)
_run(
    "spectral_blur",
    f"{HEAD}, spot AS (SELECT x, y, k, x + k + ({NOISE} - 0.5) * 0.5 AS sx, y::DOUBLE AS sy, k + ({NOISE} - 0.5) * 0.5 AS off FROM gr, (SELECT unnest(range(-16, 17)) AS k) t), " + sampled_sql("spot", "got", RGB_SELF)
    + ", sums AS (SELECT frame, x, y, " + ", ".join(f"sum({c} * exp(-(off * off) / {2 * max(3.0 * s / 2, 0.01) ** 2})) / greatest(sum(exp(-(off * off) / {2 * max(3.0 * s / 2, 0.01) ** 2})), 0.001) AS n{c}" for c, s in zip(RGB, (1.0, 0.7, 1.4)))
    + " FROM got JOIN spot USING (x, y, k) GROUP BY ALL)" + _select(["n" + c for c in RGB], "sums"),
    S.spectral_blur(3.0, (1.0, 0.7, 1.4)),
)


def _level(n: int, source: str) -> str:
    return f"lev{n} AS (SELECT frame, x // 2 AS x, y // 2 AS y, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM {source} GROUP BY ALL)"


def _read_level(n: int, size: int) -> str:
    """CTE ``rd{n}``: level n, of ``size`` by ``size``, read at the full frame's places."""
    s = sampled_sql(f"pl{n}", f"rd{n}", RGB_SELF).replace("JOIN pixels p", f"JOIN lev{n} p").replace("least(7,", f"least({size - 1},")
    return f"pl{n} AS (SELECT x, y, 0 AS k, (x + 0.5) * {size / 8} - 0.5 AS sx, (y + 0.5) * {size / 8} - 0.5 AS sy FROM gr), {s}"


LEVELS = f"{_level(1, 'pixels')}, {_level(2, 'lev1')}, {_level(3, 'lev2')}, {_read_level(1, 4)}, {_read_level(2, 2)}, {_read_level(3, 1)}"
_lod = math.log2(3.0)
_run(
    "mip_blur",
    f"{HEAD}, {LEVELS}" + f" SELECT a.frame, a.x, a.y, {', '.join(f'round(a.{c} * {2 - _lod} + b.{c} * {_lod - 1}, 9) AS {c}' for c in RGB)} FROM rd1 a JOIN rd2 b USING (frame, x, y)",
    S.mip_blur(3.0),
)
_run(
    "masked_blur",
    f"{HEAD}, {LEVELS}, m AS (SELECT *, least(1, greatest(0, (g - 0.3) / 0.7)) AS m FROM pixels), every AS (SELECT 0 AS n, * FROM rd1 UNION ALL SELECT 1, * FROM rd2 UNION ALL SELECT 2, * FROM rd3),"
    + f" soft AS (SELECT m.frame, m.x, m.y, {', '.join(f'sum(e.{c} * greatest(0, 1 - abs(m.m * {_lod} - e.n))) AS {c}' for c in RGB)} FROM m JOIN every e USING (frame, x, y) GROUP BY ALL)"
    + f" SELECT m.frame, m.x, m.y, {', '.join(f'round(CASE WHEN m.g < 0.3 THEN m.{c} ELSE m.{c} * (1 - m.m) + s.{c} * m.m END, 9) AS {c}' for c in RGB)} FROM m JOIN soft s USING (frame, x, y)",
    S.masked_blur(3.0, 0.3),
    mask="g",
)

_up = S.up_taps(1.5)
_small = _grid(4, 4).replace("WITH gr", ", gr4").replace("gr4 AS", "gr4 AS", 1)
_run(
    "bloom_up",
    f"{HEAD}{_small}, {_taps(S.DOWN_TAPS)}, spot AS (SELECT x, y, k, (x + 0.5) * 2 - 0.5 + dx AS sx, (y + 0.5) * 2 - 0.5 + dy AS sy FROM gr4, tap), " + sampled_sql("spot", "got", RGB_SELF)
    + f", lev1 AS (SELECT frame, x, y, {', '.join(f'sum({c} * w) AS {c}' for c in RGB)} FROM got JOIN tap USING (k) GROUP BY ALL), "
    + _taps(_up).replace("tap(", "tup(") + ", us AS (SELECT x, y, k, (x + 0.5) / 2 - 0.5 + dx AS sx, (y + 0.5) / 2 - 0.5 + dy AS sy FROM gr, tup), "
    + sampled_sql("us", "ug", RGB_SELF).replace("JOIN pixels p", "JOIN lev1 p").replace("least(7,", "least(3,")
    + f", wide AS (SELECT frame, x, y, {', '.join(f'sum({c} * w) / {sum(k for *_, k in _up)} AS {c}' for c in RGB)} FROM ug JOIN tup USING (k) GROUP BY ALL)"
    + f" SELECT p.frame, p.x, p.y, {', '.join(f'round(p.{c} + 0.4 * s.{c}, 9) AS {c}' for c in RGB)} FROM pixels p JOIN wide s USING (frame, x, y)",
    S.bloom_up(1.5, 0.4),
)

# Skin: an ellipse of colour differences, and four neighbours weighed by likeness.
_CB, _CR = "(-0.1146 * r - 0.3854 * g + 0.5 * b + 0.5)", "(0.5 * r - 0.4542 * g - 0.0458 * b + 0.5)"
SKIN = f"(1 - {_smooth(0.5, 1.3, f'sqrt(power(({_CB} - 0.38) / 0.14, 2) + power(({_CR} - 0.56) / 0.18, 2))')}) * {_smooth(0.03, 0.15, L709)} * (1 - {_smooth(0.88, 0.98, L709)})"


def _smoothed(strength: float) -> str:
    reach, sigma = 0.5 + strength * 0.5, 0.02 + strength * 0.03
    like = f"0.25 * exp(-(power(t.r - p.r, 2) + power(t.g - p.g, 2) + power(t.b - p.b, 2)) / {2 * sigma * sigma})"
    sums = ", ".join(f"(p.{c} + sum(t.{c} * ({like}))) / (1 + sum({like})) AS s{c}" for c in RGB)
    return f"{_taps([(-reach, 0, 1), (reach, 0, 1), (0, -reach, 1), (0, reach, 1)])}, {_spot}, {sampled_sql('spot', 'got', RGB_SELF)}, sm AS (SELECT p.frame, p.x, p.y, p.r, p.g, p.b, {sums} FROM pixels p JOIN got t ON t.frame = p.frame AND t.x = p.x AND t.y = p.y GROUP BY 1, 2, 3, 4, 5, 6), sk AS (SELECT *, {SKIN} AS skin FROM sm)"


_run("beauty_enhance", f"{HEAD}, {_smoothed(0.7)}" + _select([f"CASE WHEN skin < 0.01 THEN {c} ELSE {c} + (s{c} - {c}) * skin * 0.8 * {0.25 + 0.55 * 0.7} END" for c in RGB], "sk"), S.beauty(0.7, 0.8))


def _face() -> str:
    smooth, correct, intensity = 0.6, 0.5, 0.9
    first = f"bo AS (SELECT *, r AS mask, sqrt(r * greatest(skin, 0.3)) AS joint FROM sk), e1 AS (SELECT frame, x, y, mask, joint, r AS r0, g AS g0, b AS b0, {', '.join(f'{c} + (s{c} - {c}) * joint * {smooth * 0.4} AS {c}' for c in RGB)} FROM bo)"
    hsl = """e2 AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM e1), e3 AS (SELECT *, top - low AS d, (top + low) / 2 AS l FROM e2),
      e4 AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN l > 0.5 THEN d / (2 - top - low) ELSE d / (top + low) END AS sat,
        CASE WHEN d = 0 THEN 0 WHEN top = r THEN (g - b) / d + CASE WHEN g < b THEN 6 ELSE 0 END WHEN top = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END / 6 AS h FROM e3),
      e5 AS (SELECT *, CASE WHEN h - 0.08 > 0.5 THEN h - 1.08 WHEN h - 0.08 < -0.5 THEN h + 0.92 ELSE h - 0.08 END AS off FROM e4)"""
    turn = f"e6 AS (SELECT *, h - off * {correct * 0.1} AS h1 FROM e5), e7 AS (SELECT *, CASE WHEN h1 < 0 THEN h1 + 1 WHEN h1 > 1 THEN h1 - 1 ELSE h1 END AS h2, CASE WHEN l < 0.5 THEN l * (1 + sat) ELSE l + sat - l * sat END AS hi FROM e6), e8 AS (SELECT *, 2 * l - hi AS lo FROM e7)"
    wrap = lambda e: f"CASE WHEN {e} < 0 THEN {e} + 1 WHEN {e} > 1 THEN {e} - 1 ELSE {e} END"
    turns = f"e9 AS (SELECT *, {', '.join(f'{wrap(f'(h2 + {k / 3})')} AS t{c}' for c, k in zip(RGB, (1, 0, -1)))} FROM e8)"
    ramp = lambda t: f"CASE WHEN sat = 0 THEN l WHEN 6 * {t} < 1 THEN lo + (hi - lo) * 6 * {t} WHEN 2 * {t} < 1 THEN hi WHEN 3 * {t} < 2 THEN lo + (hi - lo) * ({2 / 3} - {t}) * 6 ELSE lo END"
    last = f"f AS (SELECT *, {', '.join(f'CASE WHEN abs(off) > 0.06 THEN {c} + (({ramp("t" + c)}) - {c}) * joint * {correct * 0.3} ELSE {c} END AS n{c}' for c in RGB)} FROM e9)"
    return f"{HEAD}, {_smoothed(smooth)}, {first}, {hsl}, {turn}, {turns}, {last}" + _select([f"CASE WHEN mask < 0.01 THEN {c}0 ELSE {c}0 + (n{c} - {c}0) * {intensity} * mask END" for c in RGB], "f")


_run("face_enhance", _face(), S.face_enhance(0.6, 0.5, 0.9), mask="r")

_shaft = f"""{HEAD}, ray AS (SELECT x, y, (x + 0.5) / 8 AS u, (y + 0.5) / 8 AS v, {NOISE} AS jit FROM gr),
  spot AS (SELECT x, y, k, (u - (u - 0.3) / 12 * 0.9 * (jit + k)) * 8 - 0.5 AS sx, (v - (v - 0.2) / 12 * 0.9 * (jit + k)) * 8 - 0.5 AS sy FROM ray, (SELECT unnest(range(1, 13)) AS k) t), {sampled_sql('spot', 'got', RGB_SELF)},
  lit AS (SELECT *, min(CASE WHEN g < 0.4 THEN k ELSE 1000 END) OVER (PARTITION BY frame, x, y) AS stop FROM got),
  sums AS (SELECT frame, x, y, {', '.join(f'sum(CASE WHEN k < stop THEN {c} * 0.1 * power(0.9::DOUBLE, k - 1) ELSE 0 END) * {t * 1.2} AS n{c}' for c, t in zip(RGB, (1.0, 0.9, 0.7)))} FROM lit GROUP BY ALL)"""
_run("light_shafts", _shaft + _select(["n" + c for c in RGB], "sums"), S.light_shafts((0.3, 0.2)), mask="g")
