"""FITS images: header cards and pixel rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK, CARD = 2880, 80
_VALUES_AT_ONCE = 1 << 18
#: Values that a line's header and other columns count as.
_LINE_COST = 64
TYPES = {-32: ">f4", 16: ">i2"}
_LINES = "file string, header map<string,string>, width int, height int, bitpix int, y int, row array<double>"


def _header(content: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Cards up to END and the offset of the data behind them."""
    cards: dict[str, str] = {}
    while at + CARD <= len(content):
        card = content[at : at + CARD].decode("ascii", "replace")
        at += CARD
        if card[:8].strip() == "END":
            return cards, -(-at // BLOCK) * BLOCK
        if card[8:10] == "= ":
            cards[card[:8].strip()] = card[10:].split("/")[0].strip().strip("'").strip()
    return None


def _first_image(path: str, content: bytes) -> tuple[dict[str, str], int, int, int, int] | None:
    """Cards, width, height, bits and offset of the first unit with two axes; other pixel types than float32 and
    int16 are an error."""
    at = 0
    while (found := _header(content, at)) is not None:
        cards, data = found
        axes = [int(cards.get(f"NAXIS{k + 1}", 0)) for k in range(int(cards.get("NAXIS", 0)))]
        bits = int(cards.get("BITPIX", 8))
        if len(axes) >= 2:
            if bits not in TYPES:
                raise ValueError(f"{path}: pixels of BITPIX {bits} are not supported")
            return cards, axes[0], axes[1], bits, data
        at = data + -(-int(np.prod(axes, initial=1) if axes else 0) * abs(bits) // 8 // BLOCK) * BLOCK
    return None


def _lines(first: int, last: int | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Scan lines from ``first`` to before ``last``, a block of them at a time."""

    columns = ["file", "header", "width", "height", "bitpix", "y", "row"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, held = [], 0
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                found = _first_image(path, content)
                if found is None:
                    continue
                cards, width, height, bits, data = found
                some = max(1, _VALUES_AT_ONCE // max(1, width))
                for y in range(first, height if last is None else min(last, height), some):
                    n = min(some, (height if last is None else min(last, height)) - y)
                    rows = np.frombuffer(content, TYPES[bits], width * n, data + y * width * abs(bits) // 8).astype(float).reshape(n, width)
                    made += [(path, cards, width, height, bits, y + k, row) for k, row in enumerate(rows)]
                    held += n * (width + _LINE_COST)
                    if held >= _VALUES_AT_ONCE:
                        yield pd.DataFrame(made, columns=columns)
                        made, held = [], 0
        if made:
            yield pd.DataFrame(made, columns=columns)

    return read


def scan_lines(files: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """Scan lines of the first image of each file (path, content), all or a range of them; only the bytes of
    those lines are decoded. Files without an image give none; float32 and int16 pixels only, others fail."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
    return files.select("path", "content").mapInPandas(_lines(first, last), _LINES)


def read_fits(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """``scan_lines`` of the files at a path."""
    return scan_lines(spark.read.format("binaryFile").load(path), first, last)


BINS = 10_000


def histograms(lines: DataFrame, by: str = "file", bins: int = BINS) -> DataFrame:
    """Rows (by, lo, hi, mean, n, bin, k): how many of the finite pixels of each image fall in each bin between its least and greatest.

    Images without a finite pixel have one row without a bin, those of one value one bin. Only counts are shuffled, so an image may have any size.
    """
    finite = F.filter("row", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    pixels = lines.select(by, finite.alias("row"))
    total = F.aggregate("row", F.lit(0.0), lambda s, v: s + v)
    ranges = pixels.groupBy(by).agg(F.min(F.array_min("row")).alias("lo"), F.max(F.array_max("row")).alias("hi"), F.try_divide(F.sum(total), F.sum(F.size("row"))).alias("mean"), F.sum(F.size("row")).cast("long").alias("n"))
    within = pixels.join(ranges, by).select(by, "lo", "hi", F.explode("row").alias("v"))
    place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (bins - 1))).otherwise(0)
    counts = within.groupBy(by, place.cast("int").alias("bin")).agg(F.count("*").alias("k"))
    return ranges.join(counts, by, "left")


def percentiles(histogram: DataFrame, shares: dict[str, float], by: str = "file", bins: int = BINS) -> DataFrame:
    """One row for each image: lo, hi, mean, n and the value under which each of ``shares`` of its pixels lie, read off its histogram.

    A percentile is the lower edge of the first bin up to which as many pixels are counted, but at least one; an image of one value has that
    everywhere, one without finite pixels has zeros."""
    up_to = F.sum("k").over(Window.partitionBy(by).orderBy("bin"))
    counted = histogram.withColumn("up_to", up_to)
    first = [F.min(F.when(F.col("up_to") >= F.greatest(F.lit(1), F.floor(F.col("n") * share)), F.col("bin"))).alias(name) for name, share in shares.items()]
    found = counted.groupBy(by).agg(*[F.first(c).alias(c) for c in ("lo", "hi", "mean", "n")], *first)
    value = lambda c: F.col("lo") + F.col(c) / (bins - 1) * (F.col("hi") - F.col("lo"))
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    return found.select(by, *[or_zero(F.col(c)).alias(c) for c in ("lo", "hi", "mean")], F.coalesce("n", F.lit(0)).alias("n"), *[or_zero(value(c)).alias(c) for c in shares])


def statistics(lines: DataFrame) -> DataFrame:
    """Range, mean, median and upper percentiles of the finite float32 pixels of every file; files of int16 have zeros."""
    floats = lines.withColumn("row", F.when(F.col("bitpix") == -32, F.col("row")).otherwise(F.array().cast("array<double>")))
    return percentiles(histograms(floats), {"p50": 0.50, "p90": 0.90, "p99": 0.99})


def stretch_range(lines: DataFrame, black: float, white: float) -> DataFrame:
    """The values between which each file's image is stretched."""
    return percentiles(histograms(lines), {"black": black, "white": white}).select("file", "black", "white")
