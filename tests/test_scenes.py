import random

import pytest

from tessera.operators import scenes


def plain_scene(rows):
    n = len(rows)
    luma, skin = sum(r[0] for r in rows) / n, sum(r[1] for r in rows) / n
    rate = lambda f: sum(any(f(*c) for c in r[2]) for r in rows) / n
    cue = max(rate(lambda r, g, b: b > r + 0.06 and b > g + 0.06 and b > 0.35), rate(lambda r, g, b: g > r + 0.05 and g > b + 0.05 and g > 0.30), rate(lambda r, g, b: max(g, b) > r + 0.06 and max(g, b) > 0.35))
    warm = sum(bool(r[2]) and r[2][0][0] > r[2][0][2] + 0.08 and r[2][0][0] > r[2][0][1] + 0.03 for r in rows) / n
    place, conf = "unknown", 0.2
    if luma > 0.30 and cue > 0.35:
        place, conf = "outdoor", min(0.95, 0.55 + 0.4 * min(1, (cue - 0.35) / 0.65))
    elif luma < 0.28 and warm > 0.45:
        place, conf = "indoor", min(0.9, 0.55 + 0.35 * min(1, (warm - 0.45) / 0.55))
    light, sure = "unknown", 0.2
    if place == "outdoor":
        light, sure = "natural", min(0.95, max(conf, 0.6))
    elif place == "indoor":
        light, sure = ("artificial", min(0.9, 0.6 + 0.3 * warm)) if warm > 0.5 else ("mixed", 0.55)
    elif warm > 0.55 and luma < 0.30:
        light, sure = "artificial", 0.6
    elif cue > 0.60 and luma > 0.35:
        light, sure = "natural", 0.6
    less = 0.1 if skin < 0.02 else 0
    return place, max(0, conf - less), light, max(0, sure - less)


def test_scenes_equal_plain_votes(spark):
    rng = random.Random(3)
    sources = {}
    for src in range(150):
        base, bright = [rng.random() for _ in range(3)], rng.uniform(0.1, 0.5)
        near = lambda: tuple(min(1.0, max(0.0, v + rng.uniform(-0.2, 0.2))) for v in base)  # noqa: E731, B023
        sources[src] = [(rng.uniform(bright - 0.1, bright + 0.1), rng.choice([0.0, 0.05]), [near() for _ in range(rng.randrange(3))]) for _ in range(rng.randrange(1, 12))]
    rows = [(s, *r) for s, rs in sources.items() for r in rs]
    got = scenes.scene_labels(spark.createDataFrame(rows, "src long, luma double, skin double, colours array<struct<r:double,g:double,b:double>>")).collect()
    assert len(got) == len(sources)
    for r in got:
        place, conf, light, sure = plain_scene(sources[r.src])
        assert (r.place, r.light) == (place, light) and (r.place_conf, r.light_conf) == (pytest.approx(conf), pytest.approx(sure))
    assert {"outdoor", "indoor", "unknown"} == {r.place for r in got}


def test_frames_of_one_millisecond_are_one(spark):
    samples = spark.createDataFrame([(1, 0.0, 1, 0.5), (1, 1.0, 2, 0.1), (1, 2.0, 3, 0.9), (1, 10.0, 4, 0.9)], "src long, t double, pos long, luma double")
    marks = spark.createDataFrame([(1, "avoid_heavy_grade", 1.0, 3.0), (1, "safe_for_beauty", 0.0, 9.0), (1, "grade_confidence_low", None, 3.0)], "src long, label string, start double, end double")
    asked = spark.createDataFrame([(1, 1.0004), (1, -1.0), (1, float("nan")), (1, float("inf"))], "src long, t double")
    got = [tuple(r) for r in scenes.evidence_frames(samples, marks, asked, 9).orderBy("n").collect()]
    assert got == [(1, 1, 1000, 0, "escalation,min_luma"), (1, 2, 2000, 1, "avoid_heavy_grade,max_luma,midpoint"), (1, 3, 1500, 3, "anchor"), (1, 4, 3500, 3, "anchor"), (1, 5, 6500, 3, "anchor"), (1, 6, 8500, 3, "anchor")]
    assert scenes.evidence_frames(samples, marks, asked, 0).count() == 0
