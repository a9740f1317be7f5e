"""Proposals judged and changed again until they are accepted, for all sources at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import written


def feedback_loop(proposals: DataFrame, judge: Callable[[DataFrame, int, bool], DataFrame], edit: Callable[[DataFrame], DataFrame], *, cycles: int) -> DataFrame:
    """The proposals with ``cycles`` they took and ``outcome``: accepted, escalated (accepted on more evidence) or exhausted.

    ``judge(open, cycle, more)`` adds ``accepted`` and ``asks`` to open proposals, on the evidence of a cycle, or on more of it; who asks and isn't accepted is judged
    once more on that. ``edit`` changes those that are still open. A round handles only open proposals and is written down, so a source stops for itself, the plan
    doesn't grow with the cycles, and an executor that is lost takes no earlier round with it.
    """
    columns = proposals.columns
    open_, done = written(proposals, "proposals"), []
    for cycle in range(max(1, cycles)):
        first = judge(open_, cycle, False)
        again = judge(first.where("NOT accepted AND asks").select(*columns), cycle, True)
        judged = first.where("accepted OR NOT asks").withColumn("more", F.lit(False)).unionByName(again.withColumn("more", F.lit(True)), allowMissingColumns=True)
        judged = written(judged, "judged")
        outcome = F.when(F.col("accepted"), F.when(F.col("more"), "escalated").otherwise("accepted")).otherwise("exhausted")
        last = cycle == max(1, cycles) - 1
        done.append((judged if last else judged.where("accepted")).select(*columns, F.lit(cycle + 1).alias("cycles"), outcome.alias("outcome")))
        if last or (left := judged.where("NOT accepted")).isEmpty():
            break
        open_ = written(edit(left).select(*columns), "proposals")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
