"""A data source over FITS files that reads only the scan lines that are asked for.

``spark.read.format("fits_lines").load(folder)`` gives one row for each line of the first image of each file. Files are cut into
splits of so many bytes and small ones share a task. A task seeks: it reads header blocks, skips what comes before the image, and then reads the
bytes of the lines of its split that the pushed filters on ``y`` leave. ``df.write.format("fits_lines").save(folder)`` writes images.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.sources.fits import BLOCK, CARD, TYPES

LINES = "file string, width int, height int, bitpix int, y int, row array<double>, bytes_read long"
IMAGES = "file string, width int, pixels array<float>"
#: Bytes of a split, and of the lines that are read at once.
SPLIT, AT_ONCE = 32 << 20, 1 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Unit:
    """The cards of a header and where its data begin; ``read`` bytes were read to find them."""

    cards: dict[str, str]
    data: int
    read: int

    def number(self, name: str, default: int = 0) -> int:
        return int(self.cards.get(name, default))

    @property
    def axes(self) -> list[int]:
        return [self.number(f"NAXIS{k + 1}") for k in range(self.number("NAXIS"))]

    @property
    def end(self) -> int:
        return self.data + -(-int(np.prod(self.axes, initial=1) if self.axes else 0) * abs(self.number("BITPIX", 8)) // 8 // BLOCK) * BLOCK


def _unit(file: pa.NativeFile, at: int) -> Unit | None:
    """The unit whose header begins at a byte, a block after the other; None at the file's end."""
    cards, read = {}, 0
    while True:
        file.seek(at)
        block = file.read(BLOCK)
        read += len(block)
        at += BLOCK
        if len(block) < BLOCK:
            return None
        for k in range(0, BLOCK, CARD):
            card = block[k : k + CARD].decode("ascii", "replace")
            if card[:8].strip() == "END":
                return Unit(cards, at, read)
            if card[8:10] == "= ":
                cards[card[:8].strip()] = card[10:].split("/")[0].strip().strip("'").strip()


def image_unit(file: pa.NativeFile, path: str) -> Unit | None:
    """The first unit with two axes, with all bytes read so far; pixels other than float32 and int16 are an error."""
    at, read, size = 0, 0, file.size()
    while at < size:
        unit = _unit(file, at)
        if unit is None:
            return None
        read += unit.read
        if len(unit.axes) >= 2:
            if unit.number("BITPIX") not in TYPES:
                raise ValueError(f"{path}: pixels of BITPIX {unit.number('BITPIX')} are not supported")
            return Unit(unit.cards, unit.data, read)
        at = unit.end
    return None


@dataclass
class Split(InputPartition):
    """Parts (path, first byte, byte behind the last) of files."""

    parts: list[tuple[str, int, int]]


class LinesReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split
        self.first, self.last = 0, 1 << 31  # lines that the filters leave

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ranges of ``y`` say which lines are read; all others are Spark's to apply."""
        for f in filters:
            if getattr(f, "attribute", None) != ("y",) or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In):
                yield f
                continue
            low, high = 0, 1 << 31
            if isinstance(f, In):
                asked = [v for v in f.value if v is not None]
                low, high = (min(asked), max(asked) + 1) if asked else (0, 0)
                yield f  # there may be gaps
            elif isinstance(f, EqualTo):
                low, high = f.value, f.value + 1
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                low = f.value + isinstance(f, GreaterThan)
            else:
                high = f.value + isinstance(f, LessThanOrEqual)
            self.first, self.last = max(self.first, low), min(self.last, high)

    def partitions(self) -> list[Split]:
        """Only names and sizes of files are looked at."""
        system, path = _opened(self.path)
        found = system.get_file_info(path)
        files = [found] if found.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(path, recursive=True))
        splits, parts, size = [], [], 0
        for info in sorted((f for f in files if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            for at in range(0, max(1, info.size), self.split):
                end = min(at + self.split, info.size)
                if parts and size + end - at > self.split:
                    splits.append(Split(parts))
                    parts, size = [], 0
                parts.append((info.path, at, end))
                size += end - at
        return [*splits, Split(parts)]

    def read(self, partition: Split) -> Iterator[tuple]:
        system, _ = _opened(self.path)
        for path, begin, end in partition.parts:
            with system.open_input_file(path) as file:
                yield from self._lines(file, path, begin, end)

    def _lines(self, file: pa.NativeFile, path: str, begin: int, end: int) -> Iterator[tuple]:
        unit = image_unit(file, path)
        if unit is None:
            return
        width, height = unit.axes[:2]
        kind = np.dtype(TYPES[unit.number("BITPIX")])
        line = width * kind.itemsize
        if not line:
            return
        # a line belongs to the split that its first byte is in
        at = lambda byte: max(0, -(-(byte - unit.data) // line))
        first, last = max(self.first, at(begin)), min(self.last, at(end), height)
        read = unit.read
        for y in range(first, last, max(1, AT_ONCE // line)):
            n = min(max(1, AT_ONCE // line), last - y)
            file.seek(unit.data + y * line)
            values = np.frombuffer(file.read(n * line), kind).astype(np.float64).reshape(n, width)
            for k, row in enumerate(values):
                yield path, width, height, unit.number("BITPIX"), y + k, row.tolist(), line + read
                read = 0  # the header counts once


@dataclass
class Done(WriterCommitMessage):
    files: int


class ImagesWriter(DataSourceWriter):
    """One file for each row. A file appears under its name when it is whole, so a task that runs again writes the same."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[tuple]) -> Done:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        n = 0
        for name, width, pixels in iterator:
            data = np.asarray(pixels, ">f4")
            cards = [("SIMPLE", "T"), ("BITPIX", -32), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", len(data) // max(1, width))]
            head = "".join(f"{k:<8}= {v:>20}".ljust(CARD) for k, v in cards) + "END".ljust(CARD)
            body = data.tobytes()
            part = f"{folder}/.{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(head.ljust(-(-len(head) // BLOCK) * BLOCK).encode())
                out.write(body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0"))
            system.move(part, f"{folder}/{name}.fits")
            n += 1
        return Done(n)


class FitsLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> ImagesWriter:
        return ImagesWriter(self.options["path"])


def read_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The lines of all images at a path; Spark pushes filters to such sources only with a setting, which this turns on."""
    spark.dataSource.register(FitsLines)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("fits_lines").option("splitBytes", str(split)).load(path)


def write_images(images: DataFrame, path: str) -> None:
    """Rows (file, width, pixels) as one float32 image each."""
    images.sparkSession.dataSource.register(FitsLines)
    images.select("file", "width", "pixels").write.format("fits_lines").mode("append").save(path)
