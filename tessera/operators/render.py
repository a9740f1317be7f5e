"""Timelines compiled at a time into layers, effect chains and one composite, and rendered to pixels.

A compiled timeline is a row: what each layer shows, the chain of effects on it, and how the layers meet. Rendering takes the rows of
all timelines through the same plan: frames are fetched by one join, and pixels go through input transform, chain, composite and output
transform as numpy arrays of some timelines at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.pixels import ACESCG_TO_REC709, LUMA_AP1, REC709_TO_ACESCG, Rgb, dot, matrix, mix
from tessera.operators.timeline import clip_alpha, transition_progress

_PIXELS_AT_ONCE = 1 << 17
WIPES = ("left", "right", "up", "down")


def _decoded(x: np.ndarray) -> np.ndarray:
    return np.where(x <= 0.04045, x / 12.92, ((np.fmax(x, 0.0) + 0.055) / 1.055) ** 2.4)


def _clamp(x: np.ndarray) -> np.ndarray:
    return np.fmin(1.0, np.fmax(0.0, x))


def _film(x: np.ndarray) -> np.ndarray:
    return _clamp(x * (x * 2.51 + 0.03) / (x * (x * 2.43 + 0.59) + 0.14))


def _smooth(a: float, b: float, x: np.ndarray) -> np.ndarray:
    t = _clamp((x - a) / (b - a))
    return t * t * (3 - 2 * t)


def _rec709(p: Rgb) -> Rgb:
    """``grading.to_rec709`` on arrays, with its usual strengths."""
    luma = dot(p, LUMA_AP1)
    high = _smooth(1.0, 4.0, np.fmax(luma, 0.0)) * 0.12
    p = p.each(lambda c: mix(c, luma, high))
    spread = np.sqrt(sum((c - luma) ** 2 for c in p))
    pull = _smooth(0.0, 0.25, p.r - np.fmax(p.g, p.b)) * _smooth(0.03, 0.25, spread) * 0.06
    p = p._replace(r=mix(p.r, luma, pull)).each(lambda c: np.fmax(c, 0.0))
    p = p.each(lambda x: (x * (x + 0.0245786) - 0.000090537) / (x * (x * 0.983729 + 0.4329510) + 0.238081))
    p = Rgb(*matrix(p, ACESCG_TO_REC709)).each(_clamp)
    return p.each(lambda c: _clamp(np.where(c <= 0.0031308, c * 12.92, c ** (1 / 2.4) * 1.055 - 0.055)))


# What an effect makes of pixels (layers, pixels) with its two parameters (layers, 1).
EFFECTS: dict[str, Callable[[Rgb, np.ndarray, np.ndarray], Rgb]] = {
    "exposure": lambda p, a, b: p.each(lambda c: c * 2.0**a),
    "contrast": lambda p, a, b: p.each(lambda c: (c - b) * a + b),
    "saturation": lambda p, a, b: p.each(lambda c: mix(dot(p, LUMA_AP1), c, a)),
    "temperature": lambda p, a, b: Rgb(p.r + a * 0.1, p.g + b * 0.1, p.b - a * 0.1),
    "tonemap": lambda p, a, b: p.each(_film),
}


def compile_at(clips: DataFrame, effects: DataFrame, t: int) -> DataFrame:
    """One row for each timeline: timeline, composite, progress, direction, dip, layers.

    Clips are (timeline, track, kind, clip, start, dur, off, fade_in, fade_out, transition, direction, dip, asset, retime, linear), effects (timeline, clip,
    position, effect, a, b). Only video clips with some weight at tick ``t`` are layers, by track, start and name; their local time follows offset and
    retiming. Effects of sound stay out, unknown ones are an error. One layer is shown alone; of two the later one comes in by its transition, as far as that has come, else as far as the
    earlier one has left, or by the share of its weight; more lie over each other. A timeline that shows nothing has no layers.
    """
    known = F.col("effect").isin(*EFFECTS)
    chains = (
        effects.where(~F.col("effect").startswith("audio."))
        .withColumn("effect", F.when(known, F.col("effect")).otherwise(F.raise_error(F.concat(F.lit("unknown effect "), F.coalesce("effect", F.lit("null"))))))
        .groupBy("timeline", "clip")
        .agg(F.array_sort(F.collect_list(F.struct("position", "effect", "a", "b"))).alias("chain"))
    )
    alpha = clip_alpha(F.lit(t), F.col("start"), F.col("dur"), F.col("fade_in"), F.col("fade_out"))
    shown = clips.where("kind = 'video'").withColumn("alpha", alpha).where("alpha > 0").withColumn("local", ((t - F.col("start")) + F.col("off")) * F.col("retime"))
    layer = F.struct("track", "start", "clip", "alpha", "asset", "local", "linear", "fade_in", "fade_out", "dur", "transition", "direction", "dip", "chain")
    stacks = shown.join(chains, ["timeline", "clip"], "left").groupBy("timeline").agg(F.array_sort(F.collect_list(layer)).alias("layers"))
    every = clips.select("timeline").distinct().join(stacks, "timeline", "left")
    in_time = F.array_sort("layers", lambda x, y: F.when(F.struct(x["start"], x["clip"]) < F.struct(y["start"], y["clip"]), -1).otherwise(1))
    every = every.withColumn("layers", F.when(F.size("layers") == 2, in_time).otherwise(F.coalesce("layers", F.array())))
    a, b = F.get("layers", F.lit(0)), F.get("layers", F.lit(1))
    two = F.size("layers") == 2
    share = F.when(a["alpha"] + b["alpha"] > 0, b["alpha"] / (a["alpha"] + b["alpha"])).otherwise(0.5)
    composite = F.when(F.size("layers") == 0, "empty").when(F.size("layers") == 1, "single").when(~two, "over").when(b["transition"].isin("wipe", "dip"), b["transition"]).otherwise("crossfade")
    leaving = 1 - transition_progress(F.lit(t), F.lit(t) * 2 - a["start"] - a["dur"], a["fade_out"])
    progress = F.when(two, F.coalesce(transition_progress(F.lit(t), b["start"], b["fade_in"]), leaving, share))
    return every.select("timeline", composite.alias("composite"), progress.alias("progress"), F.when(two, b["direction"]).alias("direction"), F.when(two, b["dip"]).alias("dip"), "layers")


def _column(array: pa.Array) -> np.ndarray:
    """Numbers with NaN for null."""
    return array.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _starts(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins in ``flatten()``, and its length; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(sizes) - sizes, sizes


def _channel(lists: pa.ListArray, n: int) -> np.ndarray:
    """Arrays of pixels as (layers, n); what is missing is black."""
    starts, sizes = _starts(lists)
    values = np.nan_to_num(_column(lists.flatten()), nan=0.0, posinf=np.inf, neginf=-np.inf)
    if len(sizes) and (sizes == n).all():
        return values.reshape(-1, n)
    out = np.zeros((len(sizes), n))
    at = np.arange(n)
    there = at < sizes[:, None]
    out[there] = values[(starts[:, None] + at)[there]]
    return out


def _shaded(layers: pa.StructArray, n: int) -> Rgb:
    """The layers' pixels in the working space, each through its chain."""
    linear = pc.fill_null(layers.field("linear"), False).to_numpy(zero_copy_only=False).astype(bool)[:, None]
    raw = Rgb(*[_channel(layers.field(c), n) for c in "rgb"])
    p = np.stack(matrix(raw.each(lambda c: np.where(linear, c, _decoded(c))), REC709_TO_ACESCG))
    starts, sizes = _starts(layers.field("chain"))
    chain = layers.field("chain").flatten()
    names, a, b = chain.field("effect").to_numpy(zero_copy_only=False), _column(chain.field("a")), _column(chain.field("b"))
    for step in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > step)
        at = starts[rows] + step
        for name, effect in EFFECTS.items():
            some = names[at] == name
            if some.any():
                own = rows[some]
                p[:, own] = effect(Rgb(*p[:, own]), a[at[some]][:, None], b[at[some]][:, None])
    return Rgb(*p)


def _met(batch: pa.RecordBatch, width: int, height: int) -> Rgb:
    """The layers of each timeline of a batch met by its composite, as (timelines, pixels)."""
    n = width * height
    lists = batch.column("layers")
    starts, sizes = _starts(lists)
    layers = lists.flatten()
    shaded, alpha = np.stack(_shaded(layers, n)), _column(layers.field("alpha"))
    out = np.zeros((3, len(sizes), n))
    composite = batch.column("composite").to_numpy(zero_copy_only=False)
    t = np.fmin(1.0, np.fmax(0.0, _column(batch.column("progress"))))[:, None]
    one = np.flatnonzero(composite == "single")
    out[:, one] = shaded[:, starts[one]]
    two = np.flatnonzero(np.isin(composite, ("crossfade", "wipe", "dip")))
    kind, t, a, b = composite[two][:, None], t[two], shaded[:, starts[two]], shaded[:, starts[two] + 1]
    u, v = np.arange(n) % width / max(1, width - 1), np.arange(n) // width / max(1, height - 1)
    direction = batch.column("direction").to_numpy(zero_copy_only=False)[two][:, None]
    incoming = np.select([direction == "right", direction == "up", direction == "down"], [u >= 1 - t, v <= t, v >= 1 - t], u <= t)
    colour = _channel(batch.column("dip"), 3)[two].T[:, :, None]
    dipped = np.where(t < 0.5, mix(a, colour, t * 2), mix(colour, b, (t - 0.5) * 2))
    out[:, two] = np.where(kind == "crossfade", mix(a, b, t), np.where(kind == "dip", dipped, np.where(incoming, b, a)))
    over = np.flatnonzero(composite == "over")
    p, weight, before = shaded[:, starts[over]], np.ones(len(over)), alpha[starts[over]]
    for k in range(1, int(sizes[over].max(initial=0))):
        rows = np.flatnonzero(sizes[over] > k)
        at = starts[over[rows]] + k
        below, own = weight[rows] * before[rows], alpha[at]
        p[:, rows] = shaded[:, at] * own[:, None] + p[:, rows] * (below * (1 - own))[:, None]
        weight[rows], before[rows] = own + below * (1 - own), own
    out[:, over] = p
    return Rgb(*out)


def pictures(plans: DataFrame, frames: DataFrame, width: int, height: int, ticks: int) -> DataFrame:
    """Pictures (timeline, composite, r, g, b) of compiled timelines as arrays by rows, ready for a standard display.

    ``frames`` are (asset, k, n, r, g, b): the k-th of an asset's n frames as arrays by rows, ``ticks`` apart. Beyond an asset's last frame that one is
    shown, before its first the first; what an asset doesn't have is black. Layers are shaded and met as arrays, some timelines at a time.
    """
    each = plans.select("timeline", "composite", "progress", "direction", "dip", F.posexplode_outer("layers").alias("order", "layer"))
    sizes = frames.groupBy("asset").agg(F.max("n").alias("n"))
    asked = each.withColumn("asset", F.col("layer.asset")).join(sizes, "asset", "left").withColumn("k", F.greatest(F.lit(0), F.least(F.floor(F.col("layer.local") / ticks), F.col("n") - 1)))
    fetched = asked.join(frames.select("asset", "k", "r", "g", "b"), ["asset", "k"], "left")
    one = F.struct("order", F.col("layer.alpha").alias("alpha"), F.col("layer.linear").alias("linear"), F.col("layer.chain").alias("chain"), "r", "g", "b")
    stacked = fetched.groupBy("timeline", "composite", "progress", "direction", "dip").agg(F.array_sort(F.collect_list(F.when(F.col("order").isNotNull(), one))).alias("layers"))
    at_once = max(1, _PIXELS_AT_ONCE // (width * height))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, at_once):
                batch = whole.slice(begin, at_once)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (width * height)), pa.array(c.ravel())) for c in _rec709(_met(batch, width, height))]
                yield pa.RecordBatch.from_arrays([batch.column("timeline"), batch.column("composite"), *lists], names=["timeline", "composite", "r", "g", "b"])

    kind = plans.schema["timeline"].dataType.simpleString()
    return stacked.mapInArrow(met, f"timeline {kind}, composite string, r array<double>, g array<double>, b array<double>")


def render(plans: DataFrame, frames: DataFrame, width: int, height: int, ticks: int) -> DataFrame:
    """The pixels (timeline, composite, x, y, r, g, b) of ``pictures``."""
    i = F.col("i")
    placed = pictures(plans, frames, width, height, ticks).select("timeline", "composite", F.posexplode(F.arrays_zip("r", "g", "b")).alias("i", "p"))
    return placed.select("timeline", "composite", (i % width).alias("x"), F.floor(i / width).cast("int").alias("y"), "p.r", "p.g", "p.b")
