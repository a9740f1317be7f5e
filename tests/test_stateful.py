import random

import pytest

from tessera.operators import folds, masks
from tessera.streaming import stateful


def run(spark, tmp_path, batches, schema, stream):
    """The batches as files of a stream, one after another, and at last a row far later that lets the watermark pass them all."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        (tmp_path / "wait").mkdir(exist_ok=True)
    with stateful.rocks(spark):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("ts", stateful.F.timestamp_micros("us")).drop("us")
        name = "s" + str(abs(hash(str(tmp_path))))
        query = stream(source).writeStream.outputMode("append").format("memory").queryName(name).start()
        try:
            query.processAllAvailable()
            return [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()]
        finally:
            query.stop()


def shuffled(rng, rows, spread):
    """Rows (us, ...) come up to ``spread`` seconds late."""
    return sorted(rows, key=lambda r: r[1] + rng.random() * spread * 1e6)


def parts(rows, n):
    return [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]


END = 10**15


def test_out_of_order_frames(spark, tmp_path):
    rng = random.Random(1)
    rows = [(src, (n * 40 + rng.randrange(10)) * 1000, src * 1000 + n) for src in (1, 2) for n in range(60)]
    late = shuffled(rng, rows, 0.5)
    rows = [(*r, at) for at, r in enumerate(late)]
    batches = [*parts(rows, 4), [(1, END, 1999, 10**6), (2, END, 2999, 10**6)], [(1, 2 * END, 0, 10**6 + 1), (2, 2 * END, 0, 10**6 + 1)]]
    # a row later than allowed is dropped, not put in order
    batches.insert(4, [(3, 60_000_000, 3000, 0), (1, 60_000_000, 1998, 10**5)])
    batches.insert(5, [(1, 1, 1997, 0)])
    got = [r for r in run(spark, tmp_path, batches, "src long, us long, id long, arrived long", lambda s: stateful.deltas(s, late="1 second")) if r[1] % 1000 < 60 and r[1] < 3000]
    want = []
    for src in (1, 2):
        last, latest, overtaken = None, -1, 0
        for _, us, name, at in sorted(r for r in rows if r[0] == src):
            overtaken += last is not None and at < latest
            want.append((src, name, None if last is None else us - last, overtaken))
            last, latest = us, max(at, latest)
    assert sorted(got) == sorted(want)


def test_sticky_speaker_equals_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for src in (1, 2):
        for n in range(50):
            ids = rng.sample("ABC", rng.randrange(4))
            scores = [rng.choice([0.2, 0.21, 0.25, 0.3]) for _ in ids]
            rows.append((src, 10**6 + n * 100_000, src * 100 + n, ids or None, scores if ids else None))
    batch = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "src long, word_id long, tracks array<string>, scores array<double>")
    want = sorted(tuple(r) for r in folds.sticky_speaker(batch).collect())
    batches = [*parts(shuffled(rng, rows, 1.0), 5), [(s, END, 900, None, None) for s in (1, 2)], [(s, 2 * END, 901, None, None) for s in (1, 2)]]
    got = run(spark, tmp_path, batches, "src long, us long, id long, tracks array<string>, scores array<double>", lambda s: stateful.speakers(s, late="2 seconds"))
    assert sorted(r for r in got if r[1] < 900) == want


def test_reacquired_tracks_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(1, 10**6 + n * 100_000, n, rng.sample("ABCDE", rng.randrange(3))) for n in range(80)]
    want, before, seen = [], None, {}
    for _, us, n, ids in rows:
        missing = [us - at for t, at in seen.items() if t not in ids]
        want.append((1, n, len(ids), bool(ids and before and not set(ids) & before), max(missing) if missing else None))
        before = set(ids) or before
        seen.update({t: us for t in ids})
    batches = [*parts(shuffled(rng, rows, 0.7), 3), [(1, END, 900, [])], [(1, 2 * END, 901, [])]]
    got = run(spark, tmp_path, batches, "src long, us long, id long, tracks array<string>", lambda s: stateful.tracks(s, late="1 second"))
    assert sorted(r for r in got if r[1] < 900) == want


def test_forgotten_tracks_leave_the_map(spark, tmp_path):
    rows = [(1, (n + 1) * 1_000_000, n, [f"T{n}"]) for n in range(20)]
    got = run(spark, tmp_path, [rows, [(1, END, 900, [])], [(1, 2 * END, 901, [])]], "src long, us long, id long, tracks array<string>", lambda s: stateful.tracks(s, forget_seconds=3.0, late="0 seconds"))
    missing = {r[1]: r[4] for r in got if r[1] < 900}
    assert missing[1] == 1_000_000 and max(v for v in missing.values() if v) == 4_000_000


def test_masks_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    flow = lambda: [rng.randrange(-2, 3) for _ in range(64)]
    rows = [(s, 10**6 + n * 40_000, n, [rng.randrange(2) for _ in range(64)], flow(), flow()) for s in (1, 2) for n in range(30)]
    batch = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "src long, key long, own array<int>, dx array<int>, dy array<int>")
    want = sorted((tuple(r) for r in masks.propagate_masks(batch, every=5).collect()), key=lambda r: r[:2])
    none = [0] * 64
    batches = [*parts(shuffled(rng, rows, 0.3), 3), [(s, END, 900, none, none, none) for s in (1, 2)], [(s, 2 * END, 901, none, none, none) for s in (1, 2)]]
    got = run(spark, tmp_path, batches, "src long, us long, id long, own array<int>, dx array<int>, dy array<int>", lambda s: stateful.masks(s, every=5, late="1 second"))
    got = sorted((r for r in got if r[1] < 900), key=lambda r: r[:2])
    assert [r[:3] for r in got] == [r[:3] for r in want]
    for g, w in zip(got, want):
        assert g[3:] == pytest.approx(w[3:])


def test_the_session_keeps_its_store(spark):
    before = spark.conf.get(stateful.PROVIDER)
    with stateful.rocks(spark):
        assert spark.conf.get(stateful.PROVIDER) == stateful.ROCKS
    assert spark.conf.get(stateful.PROVIDER) == before


class Counted:
    """States in memory that count their uses, each of which is a call to the JVM in a stream."""

    def __init__(self):
        self.calls, self.lists, self.values, self.maps = 0, {}, {}, {}

    def registerTimer(self, at):
        self.calls += 1

    def _state(self, **uses):
        def counted(use):
            def call(*args):
                self.calls += 1
                return use(*args)

            return staticmethod(call)

        return type("State", (), {name: counted(use) for name, use in uses.items()})

    def getListState(self, name, schema):
        held = self.lists.setdefault(name, [])
        return self._state(appendList=held.extend, exists=lambda: bool(held), get=lambda: list(held), clear=held.clear, put=lambda rows: held.__setitem__(slice(None), rows))

    def getValueState(self, name, schema):
        return self._state(exists=lambda: name in self.values, get=lambda: self.values[name], update=lambda v: self.values.__setitem__(name, v))

    def getMapState(self, name, *schema):
        of = self.maps.setdefault(name, {})
        return self._state(exists=lambda: bool(of), iterator=lambda: list(of.items()), updateValue=of.__setitem__, removeKey=of.pop)


@pytest.mark.parametrize("rows", [20, 400])
def test_states_are_used_as_often_for_few_rows_as_for_many(rows):
    """every row read and wrote all states of its source."""
    handle, processor = Counted(), stateful.Tracks(10**12)
    processor.init(handle)
    frame = stateful.pd.DataFrame([((n + 1) * 1000, n, [f"T{n % 3}"]) for n in range(rows)], columns=["us", "id", "tracks"])
    list(processor.handleInputRows((1,), iter([frame]), None))
    watermark = type("Watermark", (), {"getCurrentWatermarkInMs": lambda self: rows - 1})()
    made = stateful.pd.concat(processor.handleExpiredTimer((1,), watermark, None))
    assert handle.calls <= 16
    assert made["id"].tolist() == list(range(rows - 1)) and len(handle.lists["held"]) == 1
    assert set(handle.maps["seen"]) == {("T0",), ("T1",), ("T2",)}
