import math

import numpy as np
import pytest

from tessera.operators.nebula import Nebula, march
from tessera.plans import nebula_queries


def scene(seed, rows=2):
    rng = np.random.default_rng(seed)
    grids = np.clip(rng.normal(0.3, 0.5, (rows, 4, 4, 4)), -0.5, 2.0)
    camera = np.array([[0.3, -0.2, -9.0], [12.0, 1.0, 0.5]])[:rows]
    forward = np.array([[0.01, 0.05, 1.0], [-1.0, 0.03, 0.02]])[:rows]
    right = np.array([[1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])[:rows]
    up = np.array([[0.0, 1.0, 0.0], [0.0, 1.0, 0.0]])[:rows]
    depth = rng.uniform(0.05, 1.3, (rows, 20))
    return grids, camera, forward, right, up, depth


def mix(a, b, t):
    return [x * (1 - t) + y * t for x, y in zip(a, b)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def plain(grid, camera, forward, right, up, depth, px, py, width, height, c):
    """One ray, step by step."""

    def between(p):
        out = 0.0
        for dx in (0, 1):
            for dy in (0, 1):
                for dz in (0, 1):
                    w, at = 1.0, []
                    for v, d in zip(p, (dx, dy, dz)):
                        low = math.floor(v)
                        w *= (v - low) if d else 1 - (v - low)
                        at.append((low + d) % 4)
                    out += w * grid[at[0]][at[1]][at[2]]
        return out

    def density(p):
        q = [(v + w * c.time) * c.frequency for v, w in zip(p, c.wind)]
        total = sum(c.gain**k * between([v * c.lacunarity**k for v in q]) for k in range(c.octaves))
        return max(0.0, total / sum(c.gain**k for k in range(c.octaves))) * c.density_scale

    tan = math.tan(c.fov * 0.5 * math.pi / 180)
    nx, ny = (px + 0.5) / width * 2 - 1, (py + 0.5) / height * 2 - 1
    ray = [f + r * nx * tan * c.aspect + u * ny * tan for f, r, u in zip(forward, right, up)]
    ray = [v / math.sqrt(dot(ray, ray)) for v in ray]
    near, far = -math.inf, math.inf
    for o, r, lo, hi in zip(camera, ray, c.low, c.high):
        a, b = (lo - o) / r, (hi - o) / r
        near, far = max(near, min(a, b)), min(far, max(a, b))
    if near > far or far < 0:
        return [0.0] * 4
    far = min(far, depth * 100 if depth < 1 else 1e10)
    fract = lambda v: v - math.floor(v)
    t = max(near, 0.0) + fract(52.9829189 * fract(0.06711056 * px + 0.00583715 * py)) * c.step
    light = [-v / math.sqrt(dot(c.light, c.light)) for v in c.light]
    cos = dot(ray, light)
    phase = (1 - c.phase**2) / (4 * math.pi * (1 + c.phase**2 - 2 * c.phase * cos) ** 1.5)
    luma = (0.2126, 0.7152, 0.0722)
    colour, left, edge, sums, n = [0.0] * 3, 1.0, 1e9, [0.0, 0.0], 0
    steps = 0
    while steps < c.steps and t < far and left > 0.01:
        steps += 1
        p = [o + r * t for o, r in zip(camera, ray)]
        raw = density(p)
        d = raw * (raw / (raw + 0.0015))
        pre = min(1.0, d / c.density_scale)
        eps = max(c.step * 0.75, 0.01)
        slope = []
        for axis in range(3):
            hi, lo = list(p), list(p)
            hi[axis] += eps
            lo[axis] -= eps
            slope.append(between([v * c.frequency for v in hi]) - between([v * c.frequency for v in lo]))
        wide = 1 / (1 + math.sqrt(dot(slope, slope)) / (2 * eps) * 2.5)
        edge = min(edge, wide)
        post = min(1.0, d * (pre / (pre + wide * 0.45)) / c.density_scale)
        if 0.30 <= post < 0.60:
            s = lambda u: 1 / (1 + math.exp(-8 * (u - 0.5)))
            post = 0.30 + 0.30 * (s((post - 0.30) / 0.30) - s(0)) / (s(1) - s(0))
        final = post * c.density_scale
        sums[0] += pre
        sums[1] += post
        n += 1
        scattering, absorption = c.scattering * (0.9 + 0.5 * post), c.absorption * (0.9 + 2.2 * post * post)
        ext = (scattering + absorption) * final
        shade = 0.0
        for k in range(c.shadow_steps):
            q = [v + w * c.step * 2 * (k + 1) for v, w in zip(p, light)]
            if any(v < lo or v > hi for v, lo, hi in zip(q, c.low, c.high)):
                break
            shade += density(q) * (c.scattering + c.absorption) * c.step * 2
        rim = max(0.0, cos) ** 6 / (1 + ext * 0.35)
        ins = [v * math.exp(-shade) * phase * scattering * final for v in mix(c.light_colour, [dot(c.light_colour, luma)] * 3, rim)]
        em = mix(c.cool, c.warm, post)
        apart = min(0.03, max(-0.03, 0.06 * (post - 0.5)))
        em = mix(em, [em[0] * (1 + apart), em[1], em[2] * (1 - apart)], 0.85)
        strong = dot(ins, luma) * 6
        em = mix(em, [dot(em, luma)] * 3, strong / (1 + strong))
        em = [v * c.emission * (0.35 + 0.65 * (1 - post)) * final for v in em]
        amb = [v * c.ambient * 0.95 * final for v in c.light_colour]
        through = math.exp(-ext * c.step)
        colour = [o + left * (a + b + g) * (1 - through) * c.hdr for o, a, b, g in zip(colour, ins, em, amb)]
        left *= through
        t += c.step
    alpha = 1 - left
    total = max(1e-6, sum(colour))
    blue = colour[2] / total
    if alpha > 0.40 and blue > 0.65:
        excess = colour[2] - 0.65 * total
        colour = [colour[0] + excess / 2, colour[1] + excess / 2, colour[2] - excess]
    if c.debug == 1:
        return [blue, colour[2] / max(1e-6, sum(colour)), 0.0, 1.0] if alpha > 0.4 else [0.0, 0.0, 0.0, 1.0]
    if c.debug == 2:
        return [1 - edge, 0.25 + 0.75 * (1 - abs(edge - 0.5) * 2), edge, 1.0]
    if c.debug == 3:
        return [sums[0] / max(1, n), sums[1] / max(1, n), 0.0, 1.0]
    return [*colour, alpha]


@pytest.mark.parametrize("c", [Nebula(), Nebula(debug=1), Nebula(debug=2), Nebula(debug=3), Nebula(octaves=1, density_scale=4.0, steps=60), Nebula(cool=(0.0, 0.0, 3.0), warm=(0.0, 0.1, 3.0), light_colour=(0.0, 0.0, 0.4), density_scale=2.0), Nebula(phase=-0.5, light=(0.0, 0.0, 1.0), shadow_steps=6)])
def test_equals_one_ray_after_another(c):
    width, height = 5, 4
    parts = scene(3)
    got = march(*parts, width, height, c)
    for row in range(2):
        grid, camera, forward, right, up, depth = (p[row].tolist() for p in parts)
        want = [plain(grid, camera, forward, right, up, depth[y * width + x], x, y, width, height, c) for y in range(height) for x in range(width)]
        assert np.allclose(got[row], want, rtol=1e-9, atol=1e-12)
    if not c.debug:
        assert (got[..., 3] > 0.01).any()


def test_rays_stop_when_dark_and_at_the_scene():
    parts = scene(5)
    dense = march(*parts[:5], np.ones((2, 20)), 5, 4, Nebula(octaves=1, density_scale=60.0, steps=200, step=0.05))
    assert dense[..., 3].max() > 0.99
    near = march(*parts[:5], np.full((2, 20), 1e-4), 5, 4, Nebula())
    assert not near.any()


def test_query(spark):
    rows = nebula_queries.px_nebula(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 500 * 64
    frames = nebula_queries.frames(spark, "/root/testdata/sf0.001").where("frame in (3, 401)").collect()
    got = {(r.frame, r.x, r.y): (r.r, r.g, r.b, r.a) for r in rows}
    c = Nebula()
    for f in frames:
        grid = np.array(f.density).reshape(4, 4, 4).tolist()
        for x, y in ((0, 0), (3, 4), (7, 2)):
            assert got[f.frame, x, y] == pytest.approx(plain(grid, f.camera, f.forward, f.right, f.up, f.depth[y * 8 + x], x, y, 8, 8, c), abs=1e-8)
    assert len({r.a for r in rows}) > 1000
