import random

from pyspark.sql import functions as F

from tessera.operators import enhance


def test_equals_one_source_after_another(spark):
    rng = random.Random(1)
    sources = {n: [rng.uniform(0, 1) for _ in range(2)] for n in range(200)}  # the aim as one sample and as two see it

    def judge(open_, cycle, more):
        aim = (F.col("a") + F.col("b")) / 2 if more else F.col("a") * (1 + 0.05 * cycle)
        far = F.abs(F.col("value") - aim)
        return open_.withColumns({"aim": aim, "accepted": far <= 0.02, "asks": (far > 0.02) & (far < 0.3)})

    def edit(judged):
        return judged.withColumn("value", F.col("value") + F.least(F.lit(0.2), F.greatest(F.lit(-0.2), F.col("aim") - F.col("value"))))

    def plain(a, b, cycles):
        value = 0.5
        for cycle in range(cycles):
            aim, more = a * (1 + 0.05 * cycle), False
            if 0.02 < abs(value - aim) < 0.3:
                aim, more = (a + b) / 2, True
            if abs(value - aim) <= 0.02:
                return value, cycle + 1, "escalated" if more else "accepted"
            if cycle < cycles - 1:
                value += min(0.2, max(-0.2, aim - value))
        return value, cycles, "exhausted"

    df = spark.createDataFrame([(n, a, b, 0.5) for n, (a, b) in sources.items()], "src long, a double, b double, value double")
    for cycles in (1, 3, 6):
        got = {r.src: (r.value, r.cycles, r.outcome) for r in enhance.feedback_loop(df, judge, edit, cycles=cycles).collect()}
        want = {n: plain(a, b, cycles) for n, (a, b) in sources.items()}
        assert got.keys() == want.keys()
        assert all(abs(got[n][0] - w[0]) < 1e-12 and got[n][1:] == w[1:] for n, w in want.items())
        if cycles == 3:
            assert {w[2] for w in want.values()} == {"accepted", "escalated", "exhausted"}


def test_stops_when_nothing_is_open(spark):
    rounds = []

    def judge(open_, cycle, more):
        rounds.append((cycle, more))
        return open_.withColumns({"accepted": F.lit(True), "asks": F.lit(False)})

    df = spark.createDataFrame([(1, 0.0)], "src long, value double")
    assert [tuple(r) for r in enhance.feedback_loop(df, judge, lambda j: j, cycles=9).collect()] == [(1, 0.0, 1, "accepted")]
    assert {c for c, _ in rounds} == {0}
    assert enhance.feedback_loop(df.limit(0), judge, lambda j: j, cycles=9).collect() == []
