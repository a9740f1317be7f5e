from tessera.operators import render
from tessera.plans import render_queries as Q

FOLDER = "/root/testdata/sf0.001"


def test_pictures_stay_arrays_to_the_end(spark):
    """Nothing makes a row of a pixel, and no effect runs pixel by pixel in Spark's lambdas."""
    plan = Q.rendered_timelines(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "explode(sequence" not in plan


def test_pixels_are_those_of_the_pictures(spark):
    plans, frames = render.compile_at(Q.clips(spark, FOLDER), Q.effects(spark, FOLDER), Q.AT), Q.frames(spark, FOLDER)
    whole = {r.timeline: r for r in render.pictures(plans, frames, 8, 8, Q.TICKS).collect()}
    pixels = render.render(plans, frames, 8, 8, Q.TICKS).collect()
    assert len(pixels) == 64 * len(whole)
    assert all(tuple(p[c] for c in "rgb") == tuple(whole[p.timeline][c][p.y * 8 + p.x] for c in "rgb") for p in pixels)
