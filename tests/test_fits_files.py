import struct

import numpy as np
import pytest

from tessera.sources import fits, fits_files


def unit(bits, axes, data, first="SIMPLE  =                    T"):
    cards = [first, f"BITPIX  = {bits:>20}", f"NAXIS   = {len(axes):>20}", *[f"NAXIS{k + 1}  = {n:>20}" for k, n in enumerate(axes)], "OBJECT  = 'a b'    / of what", "END"]
    head = "".join(c.ljust(80) for c in cards)
    return head.ljust(-(-len(head) // 2880) * 2880).encode() + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def image(height, width, seed=0):
    return np.random.default_rng(seed).normal(size=(height, width)).astype(np.float32)


@pytest.fixture
def folder(tmp_path):
    big = image(400, 30)
    (tmp_path / "big.fits").write_bytes(unit(-32, [], b"") + unit(-32, [5], struct.pack(">5f", *range(5)), "XTENSION= 'BINTABLE'") + unit(-32, [30, 400], big.astype(">f4").tobytes(), "XTENSION= 'IMAGE'"))
    (tmp_path / "small.fits").write_bytes(unit(16, [3, 2], struct.pack(">6h", -1, 2, 3, 4, 5, 600)))
    (tmp_path / "none.fits").write_bytes(unit(-32, [], b""))
    (tmp_path / "cut.fits").write_bytes(b"SIMPLE  =")
    (tmp_path / "_hidden").write_bytes(b"x")
    return str(tmp_path), big


@pytest.mark.parametrize("split", [1000, 4097, 1 << 25])
def test_lines_of_splits(spark, folder, split):
    path, big = folder
    rows = fits_files.read_lines(spark, path, split).collect()
    found = {(r.file.rsplit("/", 1)[1], r.y): r.row for r in rows}
    assert len(rows) == len(found) == 402
    assert all(found["big.fits", y] == big[y].astype(float).tolist() for y in range(400))
    assert found["small.fits", 1] == [4.0, 5.0, 600.0]


def test_only_the_asked_bytes_are_read(spark, folder):
    path, big = folder
    lines = fits_files.read_lines(spark, path)
    head = 3 * 2880 + 0  # three headers of a block each, and none of the data between them
    for where, ys in [("y = 7", [7]), ("y > 396", [397, 398, 399]), ("y >= 3 and y <= 5 and width = 30", [3, 4, 5]), ("y in (2, 5)", range(2, 6)), ("y < 0", [])]:
        rows = lines.where("bitpix = -32").where(where).collect()
        assert sorted(r.y for r in rows) == [y for y in ys if y in (2, 5) or "in" not in where]
        read = sum(r.bytes_read for r in rows)
        if "in" not in where:
            assert read == (head + len(ys) * 120 if ys else 0)
        assert [r.row for r in sorted(rows, key=lambda r: r.y)][:1] == [big[y].astype(float).tolist() for y in list(ys)[:1]]


def test_bytes_that_the_file_gives(monkeypatch, folder):
    """The reader alone, over a file that counts."""
    path, _ = folder
    given = []

    class Counting:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, at):
            self.file.seek(at)

        def size(self):
            return self.file.size()

        def read(self, n):
            out = self.file.read(n)
            given.append(len(out))
            return out

    class System:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return (lambda p: Counting(self.system.open_input_file(p))) if name == "open_input_file" else getattr(self.system, name)

    opened = fits_files._opened
    monkeypatch.setattr(fits_files, "_opened", lambda p: (System(opened(p)[0]), opened(p)[1]))
    reader = fits_files.LinesReader(path + "/big.fits", 1 << 25)
    left = list(reader.pushFilters([fits_files.GreaterThanOrEqual(("y",), 100), fits_files.LessThan(("y",), 110), fits_files.EqualTo(("width",), 30)]))
    assert [f.attribute for f in left] == [("width",)]
    rows = [r for s in reader.partitions() for r in reader.read(s)]
    assert [r[4] for r in rows] == list(range(100, 110))
    assert sum(given) == 3 * 2880 + 10 * 120 == sum(r[6] for r in rows)


def test_other_pixels_fail(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(unit(-64, [2, 2], b"\0" * 32))
    with pytest.raises(Exception, match="BITPIX -64"):
        fits_files.read_lines(spark, str(tmp_path)).collect()


def test_images_written_and_read(spark, tmp_path):
    pixels = {f"i{n}": image(n + 1, 7, n) for n in range(5)}
    df = spark.createDataFrame([(k, 7, v.ravel().tolist()) for k, v in pixels.items()], "file string, width int, pixels array<float>")
    for _ in range(2):  # a task that runs again writes the same
        fits_files.write_images(df.repartition(3), f"{tmp_path}/out")
    rows = fits_files.read_lines(spark, f"file://{tmp_path}/out").collect()
    assert len(rows) == 15
    assert all(r.row == pixels[r.file.rsplit("/", 1)[1][:-5]][r.y].astype(float).tolist() for r in rows)


def brute(values, shares):
    v = [x for x in values if np.isfinite(x)]
    if not v:
        return [0.0] * (3 + len(shares))
    lo, hi = min(v), max(v)
    bins = np.bincount([int((x - lo) / (hi - lo) * 9999) if hi > lo else 0 for x in v], minlength=10_000)
    at = [int(np.argmax(np.cumsum(bins) >= max(1, int(len(v) * s)))) for s in shares]
    return [lo, hi, float(np.mean(v)), *[lo + a / 9999 * (hi - lo) for a in at]]


def test_statistics_of_every_file(spark):
    rng = np.random.default_rng(3)
    files = {"a": rng.normal(size=(20, 9)), "b": np.full((3, 2), 4.5), "c": np.array([[np.nan, np.inf], [1.0, -np.inf]]), "d": np.full((2, 2), np.nan), "e": rng.integers(0, 9, (4, 4)).astype(float)}
    rows = [(f, -32, y, r.tolist()) for f, m in files.items() for y, r in enumerate(m)] + [("i", 16, 0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "file string, bitpix int, y int, row array<double>")
    got = {r.file: list(r) for r in fits.statistics(df).select("file", "lo", "hi", "mean", "p50", "p90", "p99").collect()}
    want = {f: brute(m.ravel(), (0.5, 0.9, 0.99)) for f, m in files.items()} | {"i": [0.0] * 6}
    assert got.keys() == want.keys()
    for f, w in want.items():
        assert got[f][1:] == pytest.approx(w), f
    ranges = {r.file: (r.black, r.white) for r in fits.stretch_range(df, 0.1, 0.95).collect()}
    for f, m in files.items():
        assert ranges[f] == pytest.approx(brute(m.ravel(), (0.1, 0.95))[3:]), f
    assert ranges["i"] == pytest.approx((1.0, 1.0))  # of an int16 image too
