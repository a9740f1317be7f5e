"""Work and memory that grow no faster than the tables."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import pixels as P
from tessera.plans import pixel_queries, source_queries
from tessera.sources import fits

FOLDER = "/root/testdata/sf0.001"


def test_documents_share_files(spark):
    df = source_queries.json_documents(spark, FOLDER)
    assert df.count() >= 10 and len(df.inputFiles()) <= 2


def test_masks_are_not_grouped_by_pixel(spark):
    plan = pixel_queries.face_mask(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pos" in plan and not any("x#" in part.split(")")[0] for part in plan.split("hashpartitioning(")[1:])


def test_masks_of_many_faces(spark):
    faces = [(0.1, 0.1, 0.1, 0.2), (0.5, 0.3, 0.2, 0.2), (0.7, 0.7, 0.1, 0.1), (0.9, 0.1, 0.2, 0.3), (0.3, 0.8, 0.2, 0.2)]
    got = {(r.pos, r.x, r.y): r.mask for r in P.face_mask(spark.createDataFrame([(p, *f) for p in (1, 2) for f in faces[: 5 if p == 1 else 1]], "pos long, x double, y double, w double, h double"), spark).collect()}
    assert len(got) == 2 * 144
    for (pos, x, y), mask in got.items():
        d = [((x / 16 - (fx + w / 2)) / (w / 2)) ** 2 + ((y / 9 - (fy + h / 2)) / (h / 2)) ** 2 for fx, fy, w, h in faces[: 5 if pos == 1 else 1]]
        t = np.clip(np.array(d) - 0.5, 0, 1)
        assert mask == pytest.approx((1 - t * t * (3 - 2 * t)).max())


def test_images_pass_through_python_a_bounded_number_at_a_time():
    whole = pd.DataFrame({"vec_id": range(5000), "embedding": [[1.0] * 64] * 5000})
    files = list(source_queries._as_fits(iter([whole])))
    assert max(map(len, files)) <= 256 and sum(map(len, files)) == 5000
    lines = list(fits._lines(0, None)(iter(files)))
    assert sum(map(len, lines)) == 40000 and len(lines) < 50 and max(map(len, lines)) * 72 <= 2 * fits._VALUES_AT_ONCE
