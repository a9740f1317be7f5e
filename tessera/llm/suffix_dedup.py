"""Deduplication of repeated substrings with suffix arrays.

Every window of ``LENGTH`` bytes has an anchor: its leftmost ``GRAM``-byte string of smallest hash.
Equal windows have equal anchors at the same place, so only text around anchors that occur again
needs to be compared. Occurrences with the same bytes around an anchor are one context. The contexts
of a bounded number of anchors are joined to one text, whose suffix array, built by linear grouping, has
equal windows side by side: those in one interval of common prefixes as long as a window are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import discard, materialise, table
from tessera.llm.shingles import _BYTE, _powers, bodies, finish, in_chunks
from tessera.llm.suffix_sort import suffix_order

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM  # places that an anchor can have in a window, less one
# Bits of the filter of repeated anchors at most: a fixed bound of 32 MB. A full filter only
# lets more anchors through.
MOST_FILTER_BITS = 1 << 28
# Contexts of one anchor that a task compares; anchors with more are compared window by window.
MOST_CONTEXTS = 2048
_GROUP_ROWS, _SORT_ROWS = 16384, 2048
_PIECE = 1 << 20
_ODD = np.uint64(0x9FB21C651E98DF25)
_PLACE = np.uint64((1 << 30) - 1)  # texts are shorter than 1 GB


def _anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The anchors of all windows of all texts: text, place x, first and last window start, hashes."""
    lengths = np.array([len(t) for t in texts])
    joined = np.frombuffer(b"".join(texts), np.uint8)
    n = len(joined)
    none = {k: np.empty(0, np.int64) for k in ("text", "x", "low", "high", "key", "context", "base")}
    if n < LENGTH:
        return none
    up, down = _powers(n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[joined] * up[:n], dtype=np.uint64)])
    grams = finish((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    # the place in the low bits makes the smallest value also the leftmost one
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, 32, SPAN + 1 - 64):
        least = np.minimum(least[:-step], least[step:])
    begins = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    edge = np.zeros(n + 1, np.int32)
    whole = lengths >= LENGTH
    np.add.at(edge, begins[whole], 1)
    np.add.at(edge, begins[whole] + lengths[whole] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(starts):
        return none
    x = (least[starts] & _PLACE).view(np.int64)
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
    x, low, high = x[first], starts[first], starts[last]
    context = finish((sums[high + LENGTH] - sums[low]) * down[low] + (x - low).astype(np.uint64) * _ODD + (high - low).astype(np.uint64))
    text = np.searchsorted(begins, low, side="right") - 1
    # empty texts share a begin with the next one, which is the one that holds the window
    return {"text": text, "x": x - begins[text], "low": low, "high": high, "key": grams[x].view(np.int64), "context": context.view(np.int64), "base": begins[text]}


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Texts of about a megabyte together: the place of the first, the bytes before it, the texts. A longer text
    comes in pieces that overlap by a window less one byte, so that every window is in one piece."""
    for at, chunk in in_chunks(bodies(column), _PIECE):
        if len(chunk) == 1 and len(chunk[0]) > _PIECE:
            for start in range(0, len(chunk[0]) - LENGTH + 1, _PIECE):
                yield at, start, [chunk[0][start : start + _PIECE + LENGTH - 1]]
        else:
            yield at, 0, chunk


def _anchor_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, chunk in _pieces(batch.column("body")):
            keys, counts = np.unique(_anchors(chunk)["key"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts > 1)], names=["key", "again"])


def _filter_slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    k = keys.view(np.uint64)
    return (k % np.uint64(bits)).astype(np.int64), (finish(k ^ _ODD) % np.uint64(bits)).astype(np.int64)


def _filter_parts(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            for slots in _filter_slots(np.asarray(batch.column("key")), bits):
                seen[slots] = True
        packed = np.packbits(seen).reshape(-1, min(bits // 8, 1 << 16))
        full = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([packed[i].tobytes() for i in full], pa.binary())], names=["part", "body"])

    return build


def _merge_parts(rows):
    rows = rows.reset_index(drop=True)
    merged = np.frombuffer(rows["body"][0], np.uint8).copy()
    for body in rows["body"][1:]:
        merged |= np.frombuffer(body, np.uint8)
    return rows.iloc[:1].assign(body=[merged.tobytes()])


def _repeated_filter(keys: DataFrame, count: int) -> np.ndarray:
    """Bits that are set for all repeated anchors and few others, in at most ``MOST_FILTER_BITS``."""
    bits = 1 << 16
    while bits < min(12 * count, MOST_FILTER_BITS):
        bits *= 2
    parts = keys.mapInArrow(_filter_parts(bits), "part int, body binary").groupBy("part").applyInPandas(_merge_parts, "part int, body binary").collect()
    out = np.zeros((max(1, bits // 8 >> 16), min(bits // 8, 1 << 16)), np.uint8)
    for row in parts:
        out[row["part"]] = np.frombuffer(row["body"], np.uint8)
    return out.ravel()


def _occurrences(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences of anchors that may be repeated; the bytes around one once for each context and chunk."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            docs, uids = np.asarray(batch.column("doc")), np.asarray(batch.column("uid"))
            for at, before, chunk in _pieces(batch.column("body")):
                found = _anchors(chunk)
                keep = np.ones(len(found["key"]), bool)
                for slots in _filter_slots(found["key"], len(bits) * 8):
                    keep &= (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1
                found = {k: v[keep] for k, v in found.items()}
                if not len(found["key"]):
                    continue
                joined = b"".join(chunk)
                _, once = np.unique(found["context"], return_index=True)
                bodies: list[bytes | None] = [None] * len(found["key"])
                x = found["x"] + found["base"]
                for n, low, at_x, high in zip(once.tolist(), found["low"][once].tolist(), x[once].tolist(), found["high"][once].tolist()):
                    bodies[n] = joined[low:at_x] + joined[at_x + GRAM : high + LENGTH]  # the anchor itself is the key's
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found["key"]), pa.array(found["context"]), pa.array(docs[at + found["text"]]), pa.array(uids[at + found["text"]]), pa.array(found["x"] + before),
                        pa.array((x - found["high"]).astype(np.int32)), pa.array((x - found["low"]).astype(np.int32)), pa.array(bodies, pa.binary()),
                    ],
                    names=["key", "context", "doc", "uid", "x", "least", "most", "body"],
                )

    return scan


_CONTEXT = ("key", "context", "doc", "uid", "x", "n", "least", "most")
_RUNS = "key long, context long, a_from int, a_to int, e_doc long, e_uid long, e_x long"


def _shared(parts: list[bytes]) -> tuple[int, list[int]]:
    """How many leading bytes all parts share, and of each part how many can tell it from the others: one more
    than it shares with any of them."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    kept, fewest = [0] * len(parts), len(parts[0])
    for i, j in zip(order, order[1:]):
        n = min(len(parts[i]), len(parts[j]))
        differ = np.flatnonzero(np.frombuffer(parts[i], np.uint8, n) != np.frombuffer(parts[j], np.uint8, n))
        n = int(differ[0]) if len(differ) else n
        fewest = min(fewest, n)
        kept[i], kept[j] = max(kept[i], n + 1), max(kept[j], n + 1)
    return fewest, [min(k, len(part)) for k, part in zip(kept, parts)]


def _joined(keys: np.ndarray, bodies: list[bytes], most: list[int]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One text of all contexts, and for each where its anchor stands, how many bytes left and right of it
    it shares with all contexts of its anchor, and how many bytes left of it the text has. Anchor and shared bytes are
    one symbol, which names the anchor; bytes behind those in which a context differs from all others can be in no
    equal window and are left out; 0 ends a context."""
    text: list[int] = []
    at, left, right, kept = (np.empty(len(bodies), np.int64) for _ in range(4))
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])).tolist()
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        before, back = _shared([body[:m][::-1] for body, m in zip(bodies[a:b], most[a:b])])
        after, on = _shared([body[m:] for body, m in zip(bodies[a:b], most[a:b])])
        left[a:b], right[a:b], kept[a:b] = before, after, back
        for i in range(a, b):
            body, m = bodies[i], most[i]
            text += [c + 1 for c in body[m - back[i - a] : m - before]]
            at[i] = len(text)
            text.append(257 + n)
            text += [c + 1 for c in body[m + after : m + on[i - a]]]
            text.append(0)
    return text, at, left, right, kept


def _common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Of neighbouring suffixes in order, the length of their common prefix, up to ``most``."""
    padded = np.concatenate([text, np.full(most, -1)])
    out, open_ = np.zeros(len(order) - 1, np.int64), np.arange(len(order) - 1)
    for k in range(most):
        open_ = open_[padded[order[open_] + k] == padded[order[open_ + 1] + k]]
        if not len(open_):
            break
        out[open_] += 1
    return out


def _compare(rows: dict[str, np.ndarray], bodies: list[bytes]) -> dict[str, np.ndarray]:
    """Of all contexts of some anchors: for ranges of windows, the earliest occurrence of the same bytes.

    A window is named by its context and the number of bytes before the anchor. The suffix array of the joined
    contexts has equal windows in one interval of common prefixes as long as they are."""
    n = len(bodies)
    text, at, left, right, kept = _joined(rows["key"], bodies, rows["most"].tolist())
    order = np.array(suffix_order(text), np.int64)
    rank = np.empty(len(text), np.int64)
    rank[order] = np.arange(len(text))
    common = _common_prefixes(np.array(text), order, SPAN + 1)

    least, sizes = rows["least"].astype(np.int64), (rows["most"] - rows["least"] + 1).astype(np.int64)
    row = np.repeat(np.arange(n), sizes)
    a = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + least[row]
    ahead, behind = np.maximum(0, a - left[row]), np.maximum(0, SPAN - a - right[row])
    known = a <= kept[row]
    place, need = rank[np.where(known, at[row] - ahead, 0)], np.where(known, ahead + 1 + behind, 0)
    interval = -1 - np.arange(len(row))  # what starts before the text is like no other
    by_need = np.argsort(need, kind="stable")
    bounds = np.searchsorted(need[by_need], np.arange(SPAN + 3))
    for length in range(1, SPAN + 2):
        some = by_need[bounds[length] : bounds[length + 1]]
        if len(some):
            interval[some] = np.concatenate([[0], np.cumsum(common < length)])[place[some]]

    age = np.empty(n, np.int64)
    age[np.lexsort((rows["x"], rows["uid"], rows["doc"]))] = np.arange(n)
    anchor = np.cumsum(np.concatenate([[0], rows["key"][1:] != rows["key"][:-1]]))
    by = np.lexsort((age[row], interval, a, anchor[row]))
    same = (np.diff(interval[by]) == 0) & (np.diff(a[by]) == 0) & (np.diff(anchor[row[by]]) == 0)
    new = np.concatenate([[True], ~same])
    group = np.cumsum(new) - 1
    again = (np.bincount(group)[group] > 1) | (rows["n"][row[by]] > 1)
    earliest = np.full((n, SPAN + 2), -1, np.int64)
    earliest[row[by], a[by]] = np.where(again, row[by[new]][group], -1)
    flat = earliest.ravel()
    change = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    stop = np.concatenate([change[1:], [len(flat)]])
    real = flat[change] >= 0
    change, stop = change[real], stop[real]
    row, e = change // (SPAN + 2), flat[change]
    return {
        "key": rows["key"][row], "context": rows["context"][row], "a_from": (change % (SPAN + 2)).astype(np.int32), "a_to": ((stop - 1) % (SPAN + 2)).astype(np.int32),
        "e_doc": rows["doc"][e], "e_uid": rows["uid"][e], "e_x": rows["x"][e],
    }


def _compare_some(rows: dict[str, np.ndarray], bodies: list[bytes]) -> Iterator[dict[str, np.ndarray]]:
    """``_compare`` for about ``_SORT_ROWS`` contexts at a time, whole anchors together."""
    edges = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1], [True]]))
    start = 0
    for end in edges[1:].tolist():
        if end - start >= _SORT_ROWS or end == len(bodies):
            yield _compare({c: v[start:end] for c, v in rows.items()}, bodies[start:end])
            start = end


def _compare_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, compared a number of whole keys at a time."""

    def done(part: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = {c: np.asarray(part.column(c)) for c in _CONTEXT}
        edge = np.concatenate([[True], rows["key"][1:] != rows["key"][:-1], [True]])
        single = edge[1:] & edge[:-1]
        # an anchor with one context is the same wherever it stands
        same = single & (rows["n"] > 1)
        took = {"key": "key", "context": "context", "a_from": "least", "a_to": "most", "e_doc": "doc", "e_uid": "uid", "e_x": "x"}
        yield pa.RecordBatch.from_arrays([pa.array(rows[c][same]) for c in took.values()], names=list(took))
        if not single.all():
            several = np.flatnonzero(~single)
            for out in _compare_some({c: v[several] for c, v in rows.items()}, part.column("body").take(pa.array(several)).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], names=list(out))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _GROUP_ROWS:
            whole = pa.Table.from_batches(held)
            keys = np.asarray(whole.column("key"))
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if cut:
                yield from done(whole.slice(0, cut))
            held = whole.slice(cut).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield from done(pa.Table.from_batches(held))


def _each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of very common anchors to their windows, hashed."""
    for batch in batches:
        rows = {c: np.asarray(batch.column(c)) for c in _CONTEXT}
        at, hashes = [], []
        for i, body in enumerate(batch.column("body").to_pylist()):
            for a in range(int(rows["least"][i]), int(rows["most"][i]) + 1):
                o = int(rows["most"][i]) - a
                at.append((i, a))
                hashes.append(hashlib.blake2b(body[o : o + SPAN], digest_size=16).digest())
        if at:
            i, a = np.array(at).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["key"][i]), pa.array(rows["context"][i]), pa.array(a.astype(np.int32)), pa.array(hashes, pa.binary())] + [pa.array(rows[c][i]) for c in ("doc", "uid", "x", "n")],
                names=["key", "context", "a", "window", "doc", "uid", "x", "n"],
            )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, hashes, sizes, kept = [], [], [], [], []
        for body, ranges in zip(batch.column("body").to_pylist(), batch.column("ranges").to_pylist()):
            parts, at, cut, n = [], 0, 0, 0
            end = -1
            for r in sorted((r["start"], r["stop"]) for r in ranges or ()):
                if r[0] > end:
                    if end >= 0:
                        cut += end - begin
                        at = end
                    parts.append(body[at : r[0]])
                    n += 1
                    begin, end = r
                else:
                    end = max(end, r[1])
            if end >= 0:
                cut += end - begin
                at = end
            parts.append(body[at:])
            rest = b"".join(parts)
            removed.append(cut)
            spans.append(n)
            sizes.append(len(body))
            kept.append(rest)
            hashes.append(hashlib.sha256(rest).hexdigest())
        long = pa.int64()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, long), pa.array(removed, long), pa.array(spans, long), pa.array(hashes, pa.string()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"],
        )


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes (binary).

    Every byte goes that a 100-byte string covers which also starts earlier: in a document with a smaller
    identifier, or earlier in the same one. What is left is judged on the input alone.

    Nulls: a null text is empty; a null identifier is the smallest. Rows with one identifier and different
    texts are ordered by a hash of the text; rows that repeat both are one document, each with its result.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("body")).select(
        "doc_id", "body", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.xxhash64("body").alias("uid")
    )
    keys = named.select("body").mapInArrow(_anchor_keys, "key long, again boolean")
    repeated = materialise(keys.groupBy("key").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("key"), "repeated")
    shared = spark.sparkContext.broadcast(_repeated_filter(repeated, repeated.count()))
    discard(repeated)
    occurrences = materialise(
        named.select("doc", "uid", "body").mapInArrow(_occurrences(shared), "key long, context long, doc long, uid long, x long, least int, most int, body binary"), "occurrences"
    )
    first = F.min(F.struct("doc", "uid", "x"))
    contexts = occurrences.groupBy("key", "context").agg(first.alias("f"), F.count("*").alias("n"), F.max("least").alias("least"), F.max("most").alias("most"), F.max("body").alias("body"))
    contexts = materialise(contexts.select("key", "context", "f.doc", "f.uid", "f.x", "n", "least", "most", "body"), "contexts")

    per_key = contexts.groupBy("key").agg(F.count("*").alias("n_contexts"))
    common = materialise(per_key.where(F.col("n_contexts") > MOST_CONTEXTS).select("key"), "common")
    rest = contexts.join(common, "key", "left_anti")
    runs = rest.repartition("key").sortWithinPartitions("key").mapInArrow(_compare_sorted, _RUNS)

    windows = contexts.join(common, "key", "left_semi").select(*_CONTEXT, "body").mapInArrow(
        _each_window, "key long, context long, a int, window binary, doc long, uid long, x long, n long"
    )
    windows = materialise(windows, "windows")
    same = windows.groupBy("key", "window", "a").agg(first.alias("e"), F.sum("n").alias("n")).where("n > 1").select("key", "window", "a", "e")
    more = windows.join(same, ["key", "window", "a"]).select("key", "context", F.col("a").alias("a_from"), F.col("a").alias("a_to"), F.col("e.doc").alias("e_doc"), F.col("e.uid").alias("e_uid"), F.col("e.x").alias("e_x"))
    runs = materialise(runs.unionByName(more), "runs")
    discard(contexts, common, windows)

    later = ~((F.col("doc") == F.col("e_doc")) & (F.col("uid") == F.col("e_uid")) & (F.col("x") == F.col("e_x")))
    covered = occurrences.select("context", "doc", "uid", "x").join(runs.drop("key"), "context").where(later)
    covered = covered.select("doc", "uid", (F.col("x") - F.col("a_to")).alias("start"), (F.col("x") - F.col("a_from") + LENGTH).alias("stop"))
    # ranges that touch become one, so a text has as many as it has removed runs
    by = Window.partitionBy("doc", "uid").orderBy("start")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.coalesce((F.col("start") > F.col("reach")).cast("int"), F.lit(1))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    islands = covered.withColumn("reach", reach).withColumn("island", island).groupBy("doc", "uid", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    ranges = materialise(islands.groupBy("doc", "uid").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")), "ranges")
    discard(occurrences, runs)
    return named.join(ranges, ["doc", "uid"], "left").select("doc_id", "body", "ranges").mapInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_bytes")
