import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import json_text
from tessera.functions.half import round_half


def halves(spark, values):
    df = spark.createDataFrame([(n, float(v)) for n, v in enumerate(values)], "n long, v double")
    return [r.h for r in df.select("n", round_half(F.col("v")).alias("h")).orderBy("n").collect()]


def same(got, want):
    got, want = np.array(got, float), np.array(want, float)
    return np.array_equal(got, want, equal_nan=True)


def test_every_half_is_itself(spark):
    every = np.arange(65536, dtype=np.uint16).view(np.float16).astype(float)
    assert same(halves(spark, every), every)


def test_between_halves_ties_go_to_even(spark):
    up = np.arange(0x7C00, dtype=np.uint16).view(np.float16).astype(float)
    middle = (up[:-1] + up[1:]) / 2
    values = np.concatenate([middle, np.nextafter(middle, 0), np.nextafter(middle, np.inf), -middle, [65504, 65519.99, 65520, 1e300, -65520, np.inf, -np.inf, np.nan, 2.0**-25, 2.0**-26, 1e-300]])
    with np.errstate(over="ignore"):
        assert same(halves(spark, values), values.astype(np.float16))


def test_random_numbers(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=4000) * 10.0 ** rng.integers(-9, 5, 4000)
    with np.errstate(over="ignore"):
        assert same(halves(spark, values), values.astype(np.float16))


CASES = [
    ("no json", "none", None),
    (None, "none", None),
    ('x ```json {"action": "cut", "target": "a", "params": {"n": 2}} ``` y', "valid", {"n": 2.0}),
    ('```json\n{"action": "cut", "target": "a", "params": {"n": 2.5}}\n```', "valid", {"n": 2.5}),  # a fence of several lines is none, its braces count
    ('{"action": "cut", "target": "a", "params": {}}', "valid", {}),
    ('{"action": "cut", "target": "a", "params": {"n": -1e3}, "more": [1, {"x": null}]}', "valid", {"n": -1000.0}),
    ('{"action": "cut", "target": "a", "params": {"n": {"deep": 1}}}', "undecodable", None),
    ('{"action": "cut", "target": "a", "params": {"n": "2"}}', "undecodable", None),
    ('{"action": "cut", "target": "a", "params": {"n": null}}', "undecodable", None),
    ('{"action": "cut", "target": "a", "params": [1]}', "undecodable", None),
    ('{"action": "cut", "target": "a"}', "undecodable", None),
    ('{"action": "fly", "target": "a", "params": {}}', "undecodable", None),
    ('{"action": 3, "target": "a", "params": {}}', "undecodable", None),
    ('{"action": "unknown", "target": "a", "params": {}}', "invalid", {}),
    ('{"action": "cut", } and {"x": 1}', "malformed", None),
    ('{"action": "cut", "target": "a", "params": {}} and {}', "malformed", None),
    ('{"action": "cut", "target": "a", "params": {}}, {}', "malformed", None),
    ('{"action": "cut", "target": "a", "params": {}} ] [ {}', "malformed", None),
    ('{"action": "cut", "target": "a", "params": {}} } { "v": {}', "malformed", None),
    ("} {", "none", None),
    ("{", "none", None),
    ("```json ``` {}", "malformed", None),
    ("```json [1, 2] ```", "undecodable", None),
]


def test_json_in_texts(spark):
    df = spark.createDataFrame([(n, c[0]) for n, c in enumerate(CASES)], "n long, text string")
    found = json_text.intent(json_text.json_found(F.col("text")), json_text.json_part(F.col("text")))
    got = {r.n: (r.i.status, r.i.params) for r in df.select("n", found.alias("i")).collect()}
    assert [(got[n][0], got[n][1]) for n in range(len(CASES))] == [c[1:] for c in CASES]


@pytest.mark.parametrize("path, kind, want", [("$.b[1].c", "string", "x"), ("$.a", "int", 1), ("$.b[9]", "int", None), ("$.a", "boolean", True)])
def test_nested_fields(spark, path, kind, want):
    df = spark.createDataFrame([('see {"a": 1, "b": [0, {"c": "x"}]} there',)], "text string")
    assert df.select(F.try_variant_get(json_text.json_found(F.col("text")), path, kind).alias("v")).collect()[0].v == want
