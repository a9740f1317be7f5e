"""Folds over a source's rows in order, cut into blocks that tasks handle side by side.

Rows are range-partitioned by source and order, so a source may lie in any number of tasks. What a fold makes of a block is one
map from the state before to the state after it. The maps of a source's blocks, one small row each, are applied one after
another; then every block is replayed from its own state, all of it at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.folds import ordered_fold
from tessera.sources.scratch import written

Batches = Iterator[pa.RecordBatch]


def _runs(column: pa.Array) -> np.ndarray:
    """Where runs of equal values begin, and the length; nulls are equal."""
    codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]]).astype(np.int32)


def in_blocks(rows: DataFrame, *, by: str, order: list[str]) -> DataFrame:
    """Rows (by, block, and the other columns as arrays): consecutive rows of a source, as many as a batch holds.

    Blocks of a source are numbered in order.
    """
    others = [c for c in rows.columns if c != by]
    kind = rows.schema[by].dataType
    schema = T.StructType([T.StructField(by, kind), T.StructField("block", T.LongType()), *[T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in others]])

    def cut(batches: Batches) -> Batches:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            at = _runs(batch.column(by))
            n = len(at) - 1
            lists = [pa.ListArray.from_arrays(pa.array(at), batch.column(c)) for c in others]
            yield pa.RecordBatch.from_arrays([batch.column(by).take(pa.array(at[:-1])), pa.array(np.arange(block, block + n)), *lists], names=[by, "block", *others])
            block += n

    return written(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).mapInArrow(cut, schema), "blocks")


def _flat(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    return np.asarray(column.flatten(), kind)


def _each(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Block by block."""
    for batch in batches:
        for n in range(batch.num_rows):
            yield batch.slice(n, 1)


def _unpacked(block: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [block.column(c).flatten() for c in names]


def replayed(blocks: DataFrame, entries: DataFrame, replay: Callable[[Batches], Batches], schema: str | T.StructType) -> DataFrame:
    """Blocks beside the state that they begin with (block, state columns), which are few and written for the planner to know so."""
    return blocks.join(written(entries, "entries"), "block").mapInArrow(replay, schema)


def _matrix(block: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of arrays of one length as rows of a matrix."""
    inner = block.column(column).flatten()
    return np.asarray(inner.flatten(), np.float64).reshape(len(inner), -1)


def affine_scan(rows: DataFrame, *, by: str, order: list[str], keep: list[str], step: str, decay: list[float], settled: bool = False) -> DataFrame:
    """Rows (by, keep..., state, before) of the recurrence state = decay * state + step, from zero on; ``before`` is the state of the row before.

    ``step`` is a column of arrays of one length; ``decay`` has one number for each element or one for all. With ``settled`` a source
    begins as if its first step had gone on forever before it. No task holds a source: a block's map is its decay over all its rows and what its own steps
    add up to.
    """
    power = np.array(decay, np.float64)
    blocks = in_blocks(rows.select(by, *dict.fromkeys([*order, *keep]), F.col(step).alias("__step")), by=by, order=order)

    def summarise(batches: Batches) -> Batches:
        for block in _each(batches):
            b = _matrix(block, "__step")
            weights = power[None, :] ** np.arange(len(b) - 1, -1, -1)[:, None]
            end, first = (weights * b).sum(axis=0), b[0] / (1 - power) if settled else np.zeros(b.shape[1])
            doubles = lambda a: pa.array([a.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([block.column(by), block.column("block"), pa.array([len(b)]), doubles(end), doubles(first)], names=[by, "block", "n", "end", "first"])

    kind = rows.schema[by].dataType.simpleString()
    maps = blocks.mapInArrow(summarise, f"{by} {kind}, block long, n long, end array<double>, first array<double>")

    def follow(state: np.ndarray | None, row: tuple) -> tuple[np.ndarray, list[tuple]]:
        _, block, n, end, first = row
        state = np.asarray(first) if state is None else state
        return power**n * state + end, [(block, state.tolist())]

    entries = ordered_fold(maps, by=by, order=["block"], start=lambda: None, step=follow, schema="block long, entry array<double>")
    schema = T.StructType([rows.schema[by], *[rows.schema[c] for c in keep], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("state", "before")]])

    def replay(batches: Batches) -> Batches:
        for block in _each(batches):
            s, entry = _matrix(block, "__step").copy(), np.asarray(block.column("entry").flatten())
            s[0] += power * entry
            shift = 1
            while shift < len(s):  # every row then holds what the last 2 * shift rows add up to
                s[shift:] += power**shift * s[:-shift].copy()
                shift *= 2
            before = np.concatenate([entry[None], s[:-1]])
            offsets = pa.array(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32))
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(a.ravel())) for a in (s, before)]
            source = block.column(by).take(pa.array(np.zeros(len(s), np.int64)))
            yield pa.RecordBatch.from_arrays([source, *_unpacked(block, keep), *arrays], names=[by, *keep, "state", "before"])

    return replayed(blocks, entries, replay, schema)


def _next_apart(t: np.ndarray, gap: float) -> np.ndarray:
    """For each of ascending times the first that is at least ``gap`` later, or the length."""
    n = len(t)
    at = np.searchsorted(t, t + gap)
    late = np.append(t, np.inf)
    while (low := (at < n) & (late[at] - t < gap)).any():  # t + gap is rounded, so it may be a little off
        at[low] += 1
    while (high := (at > np.arange(n) + 1) & (late[np.maximum(at - 1, 0)] - t >= gap)).any():
        at[high] -= 1
    return np.maximum(at, np.arange(n) + 1)


def spaced(rows: DataFrame, *, by: str, t: str, key: str, gap: float) -> DataFrame:
    """Rows (by, t, key) at least ``gap`` after the last accepted one of their source, the first one included.

    Every row points to the next one that is far enough behind it. Inside a block pointers are doubled until they lead to the last row that is accepted, so a
    block maps the row by which it is entered, one of its first ``gap``, to the row that leads on. Rows without a time are left out.
    """
    blocks = in_blocks(rows.select(by, t, key).where(F.col(t).isNotNull()), by=by, order=[t, key])

    def ends(pointer: np.ndarray) -> np.ndarray:
        n = len(pointer)
        last = np.where(pointer < n, pointer, np.arange(n))
        for _ in range(n.bit_length()):
            last = last[last]
        return last

    def summarise(batches: Batches) -> Batches:
        for block in _each(batches):
            at = _flat(block.column(t))
            pointer = _next_apart(at, gap)
            doors = np.arange(min(int(pointer[0]) + 1, len(at)))
            doubles = lambda a: pa.array([a.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([block.column(by), block.column("block"), doubles(at[doors]), doubles(at[ends(pointer)[doors]])], names=[by, "block", "doors", "exits"])

    kind = rows.schema[by].dataType.simpleString()
    maps = blocks.mapInArrow(summarise, f"{by} {kind}, block long, doors array<double>, exits array<double>")

    def follow(last: float | None, row: tuple) -> tuple[float | None, list[tuple]]:
        _, block, doors, exits = row
        apart = np.asarray(doors) - last >= gap if last is not None else np.ones(1, bool)
        if not apart.any():
            return last, []
        door = int(apart.argmax())
        return float(exits[door]), [(block, door)]

    entries = ordered_fold(maps, by=by, order=["block"], start=lambda: None, step=follow, schema="block long, door long")

    def replay(batches: Batches) -> Batches:
        for block in _each(batches):
            at = _flat(block.column(t))
            n = len(at)
            pointer = np.append(_next_apart(at, gap), n)
            reached = np.zeros(n + 1, bool)
            reached[block.column("door")[0].as_py()] = True
            for _ in range(n.bit_length()):
                reached[pointer[reached]] = True
                pointer = pointer[pointer]
            taken = pa.array(np.flatnonzero(reached[:n]))
            source = block.column(by).take(pa.array(np.zeros(len(taken), np.int64)))
            yield pa.RecordBatch.from_arrays([source, *[a.take(taken) for a in _unpacked(block, [t, key])]], names=[by, t, key])

    return replayed(blocks, entries, replay, T.StructType([rows.schema[by], rows.schema[t], rows.schema[key]]))


def _op_runs(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, start and length of each run of equal steps."""
    at = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [len(kinds)]])
    return kinds[at[:-1]], at[:-1], np.diff(at)


_OTHER, _EDIT, _UNDO, _REDO = range(4)


def _after(kind: int, n: int, depth, top):
    """Depth and top of the stack after n steps of a kind; numbers or arrays of them."""
    if kind == _EDIT:
        return depth + n, depth + n
    if kind == _UNDO:
        return np.maximum(depth - n, 0), top
    return (np.minimum(depth + n, top), top) if kind == _REDO else (depth, top)


def undo_redo(edits: DataFrame) -> DataFrame:
    """Edits (doc, seq, kind, value) to (doc, seq, value, undoable, redoable): the value in force after each step.

    An undo takes the last step back and a redo the last one undone forward again; a new edit forgets what was undone. Other kinds change nothing.

    The stack's depth alone says how far undo and redo reach, and a block maps it: runs of steps move all depths that a block may be entered with at once,
    and beyond as many as it has undos the map goes on in parallel. The value in force is that of the last edit that left the stack at the depth of now, in the block
    or, for depths that a block only returns to, in one before it. No task holds a document or its stack.
    """
    code = F.when(F.col("kind") == "edit", _EDIT).when(F.col("kind") == "undo", _UNDO).when(F.col("kind") == "redo", _REDO).otherwise(_OTHER)
    blocks = in_blocks(edits.select("doc", "seq", code.alias("code"), "value"), by="doc", order=["seq"])

    def summarise(batches: Batches) -> Batches:
        for block in _each(batches):
            kinds, _, sizes = _op_runs(_flat(block.column("code"), np.int64))
            runs = list(zip(kinds.tolist(), sizes.tolist()))
            first = next((n for n, (k, _) in enumerate(runs) if k == _EDIT), len(runs))
            # before its first edit a block only moves the depth that it begins with
            head, rest = [v for run in runs[:first] for v in run], runs[first:]
            depth = top = np.arange(sum(n for k, n in rest if k == _UNDO) + 1) if rest else np.empty(0, np.int64)
            for k, n in rest:
                depth, top = _after(k, n, depth, top)
            longs = lambda a: pa.array([[int(v) for v in a]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([block.column("doc"), block.column("block"), longs(head), longs(depth), longs(top)], names=["doc", "block", "head", "depth", "top"])

    kind = edits.schema["doc"].dataType.simpleString()
    maps = blocks.mapInArrow(summarise, f"doc {kind}, block long, head array<long>, depth array<long>, top array<long>")

    def follow(state: tuple[int, int], row: tuple) -> tuple[tuple[int, int], list[tuple]]:
        _, block, head, depths, tops = row
        depth, top = state
        for k, n in zip(head[::2], head[1::2]):
            depth, top = _after(k, n, depth, top)
        if len(depths):
            at = min(int(depth), len(depths) - 1)
            depth, top = depths[at] + depth - at, tops[at] + depth - at
        return (int(depth), int(top)), [(block, *state)]

    entries = ordered_fold(maps, by="doc", order=["block"], start=lambda: (0, 0), step=follow, schema="block long, depth long, top long")
    value = edits.schema["value"].dataType

    def replay(batches: Batches) -> Batches:
        for block in _each(batches):
            codes = _flat(block.column("code"), np.int64)
            depths, tops = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
            depth, top = block.column("depth")[0].as_py(), block.column("top")[0].as_py()
            for k, at, n in zip(*(a.tolist() for a in _op_runs(codes))):
                depths[at : at + n], tops[at : at + n] = _after(k, np.arange(1, n + 1), depth, top)
                depth, top = int(depths[at + n - 1]), int(tops[at + n - 1])
            # the last edit at each depth: sorted by depth and place, the greatest place so far that is an edit
            n = len(codes)
            by_depth = np.lexsort((np.arange(n), depths))
            edit = np.where(codes == _EDIT, np.arange(n), -1)[by_depth]
            group = np.flatnonzero(np.concatenate([[True], np.diff(depths[by_depth]) > 0]))
            base = np.repeat(np.arange(len(group)), np.diff(np.append(group, n))) * (n + 1)
            last = np.empty(n, np.int64)
            last[by_depth] = np.maximum.accumulate(base + edit) - base
            seq, values = _unpacked(block, ["seq", "value"])
            known = values.take(pa.array(np.maximum(last, 0), mask=last < 0))
            source = block.column("doc").take(pa.array(np.zeros(n, np.int64)))
            owner = block.column("block").take(pa.array(np.zeros(n, np.int64)))
            yield pa.RecordBatch.from_arrays([source, owner, seq, pa.array(depths), pa.array(tops - depths), pa.array(codes == _EDIT), pa.array(last >= 0), known], names=["doc", "block", "seq", "depth", "redoable", "edit", "here", "value"])

    schema = T.StructType([edits.schema["doc"], T.StructField("block", T.LongType()), edits.schema["seq"], *[T.StructField(c, T.LongType()) for c in ("depth", "redoable")], *[T.StructField(c, T.BooleanType()) for c in ("edit", "here")], T.StructField("value", value)])
    steps = written(replayed(blocks, entries, replay, schema), "steps")
    # one row for each depth that a block leaves an edit at or returns to
    left = steps.groupBy("doc", "depth", "block").agg(F.max_by(F.when(F.col("edit"), F.struct("value")), F.when(F.col("edit"), F.col("seq"))).alias("left"))
    earlier = Window.partitionBy("doc", "depth").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.withColumn("carried", F.last("left", ignorenulls=True).over(earlier)["value"]).select("doc", "depth", "block", "carried")
    out = steps.alias("s").join(carried.alias("c"), F.col("s.doc").eqNullSafe(F.col("c.doc")) & (F.col("s.depth") == F.col("c.depth")) & (F.col("s.block") == F.col("c.block")))
    in_force = F.when(F.col("s.depth") > 0, F.when(F.col("here"), F.col("value")).otherwise(F.col("carried")))
    return out.select("s.doc", "seq", in_force.alias("value"), F.col("s.depth").alias("undoable"), "redoable")


# The poles and gains of the pink filter, and of what it takes from a sample and from the one before.
PINK_POLES = (0.99886, 0.99332, 0.96900, 0.86650, 0.55000, -0.7616)
PINK_GAINS = (0.0555179, 0.0750759, 0.1538520, 0.3104856, 0.5329522, -0.0168980)
PINK_NOW, PINK_HELD, PINK_LEVEL = 0.5362, 0.115926, 0.11


def pink_noise(white: DataFrame) -> DataFrame:
    """The pink filter over white samples (src, i, value): six leaking sums, the sample and one of the sample before."""
    steps = F.array(*[F.col("value") * g for g in (*PINK_GAINS, PINK_HELD)])
    scanned = affine_scan(white.withColumn("steps", steps), by="src", order=["i"], keep=["i", "value"], step="steps", decay=[*PINK_POLES, 0.0])
    parts = [F.col("state")[k] for k in range(len(PINK_POLES))] + [F.col("before")[len(PINK_POLES)], F.col("value") * PINK_NOW]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return scanned.select("src", "i", (total * PINK_LEVEL).alias("value"))


def accumulate(rows: DataFrame, *, by: str, order: list[str], key: str, value: str, weight: float) -> DataFrame:
    """Rows (by, key, acc) of the moving average acc = mix(acc, value, weight), which begins as a source's first value.

    ``value`` is a number, or an array of the numbers of a frame, each of which has its own average."""
    frame = isinstance(rows.schema[value].dataType, T.ArrayType)
    steps = F.transform(value, lambda v: v.cast("double") * weight) if frame else F.array(F.col(value).cast("double") * weight)
    scanned = affine_scan(rows.withColumn("steps", steps), by=by, order=order, keep=[key], step="steps", decay=[1 - weight], settled=True)
    return scanned.select(by, key, (F.col("state") if frame else F.col("state")[0]).alias("acc"))
