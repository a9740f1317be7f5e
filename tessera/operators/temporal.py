"""Joins and sequence operators on time.

Range conditions become equi-joins on time buckets, so rows meet only their neighbours in time and
no source is gathered in one task by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(t: Column, width: Column | float) -> Column:
    return F.floor(t / width)


def asof_nearest(left: DataFrame, right: DataFrame, *, by: str, t: str, key: str, pos: str, tolerance: float | str, later_wins: bool = False) -> DataFrame:
    """Left rows with the right row nearest in time within ``tolerance``; no match gives nulls.

    ``tolerance`` is a number, or a column that both sides have and that is the same for all rows of a
    source. ``key`` identifies left rows. Equal distances go to the smaller ``pos`` of the right side, or with
    ``later_wins`` to the later time. Result: left columns, ``pos`` and ``dt``.
    """
    reach = F.col(tolerance) if isinstance(tolerance, str) else F.lit(float(tolerance))
    width = F.greatest(reach, F.lit(1e-9))
    # of rows at one time of a source the one with the smallest ``pos`` stands for all on the right, and any on the left
    reach_of = [tolerance] if isinstance(tolerance, str) else []
    first = right.groupBy(by, t).agg(F.min(pos).alias("_pos"), *[F.first(c).alias(c) for c in reach_of])
    times = left.groupBy(by, t).agg(*[F.first(c).alias(c) for c in reach_of]) if reach_of else left.select(by, t).distinct()
    r = first.select(F.col(by).alias("_by"), F.col(t).alias("_t"), "_pos", F.explode(F.array(*[_bucket(F.col(t), width) + d for d in (-1, 0, 1)])).alias("_b"))
    l = times.withColumn("_b", _bucket(F.col(t), width))
    dt = F.abs(F.col("_t") - F.col(t))
    met = l.join(r, (l[by] == r["_by"]) & (l["_b"] == r["_b"])).where(dt <= reach)
    order = F.struct(dt, -F.col("_t"), F.col("_pos")) if later_wins else F.struct(dt, F.col("_pos"))
    best = met.groupBy(by, t).agg(F.min_by(F.struct(F.col("_pos").alias(pos), dt.alias("dt")), order).alias("_m")).select(by, t, F.col(f"_m.{pos}").alias(pos), "_m.dt")
    return left.join(best, [by, t], "left")


def asof_bracket(left: DataFrame, right: DataFrame, *, by: str, t: str, key: str, pos: str, later_wins: bool = True) -> DataFrame:
    """The nearest right row without a tolerance: of the rows before and after, the later on a tie or the
    earlier; of several at one time the one with the smallest ``pos``."""
    l = left.select(F.col(by), F.col(t), F.col(key), F.lit(None).cast("long").alias("_pos"), F.lit(0).alias("_side"))
    r = right.select(F.col(by), F.col(t), F.lit(None).cast("long").alias(key), F.col(pos).cast("long").alias("_pos"), F.lit(1).alias("_side"))
    order = [F.col(t), F.col("_side").desc(), F.col("_pos").desc()]
    mark = F.when(F.col("_side") == 1, F.struct(F.col(t).alias("t"), F.col("_pos").alias("pos")))
    # the next mark is the last one on the way back, so either window only adds rows at its end
    back = [F.col(t).desc(), F.col("_side"), F.col("_pos").desc()]
    before, after = (Window.partitionBy(by).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (order, back))
    both = l.unionByName(r).withColumn("_p", F.last(mark, True).over(before)).withColumn("_n", F.last(mark, True).over(after)).where("_side = 0")
    to_next, to_last = F.abs(F.col("_n.t") - F.col(t)), F.abs(F.col(t) - F.col("_p.t"))
    take_next = F.col("_p").isNull() | (to_next <= to_last if later_wins else to_next < to_last)
    chosen = F.when(F.coalesce(take_next, F.lit(False)), F.col("_n")).otherwise(F.col("_p"))
    return both.select(by, key, chosen["pos"].alias(pos), F.abs(chosen["t"] - F.col(t)).alias("dt"))


def interval_join(points: DataFrame, intervals: DataFrame, *, by: str, t: str, closed: bool = False, before: float = 0.0, after: float = 0.0, width: float | None = 4.0, how: str = "inner") -> DataFrame:
    """Every pair of a point and an interval of the same source that holds it; with ``left_semi`` the points that some interval holds.

    ``before`` and ``after`` widen the interval; ``closed`` includes its end. Intervals are laid
    into the buckets of ``width`` that they touch; None takes their mean length, so they touch two or three each and
    a bucket holds about as many as a point lies in, however dense they are.
    """
    lo, hi = F.col("start") - before, F.col("end") + after
    if width is None:
        width = max(1e-6, intervals.agg(F.avg(F.when(hi >= lo, hi - lo))).first()[0] or 0.0)
    i = intervals.withColumnRenamed(by, "_by").withColumn("_b", F.explode(F.sequence(_bucket(lo, width), _bucket(hi, width))))
    p = points.withColumn("_pb", _bucket(F.col(t), width))
    inside = (F.col(t) >= lo) & ((F.col(t) <= hi) if closed else (F.col(t) < hi))
    return p.join(i, (p[by] == i["_by"]) & (p["_pb"] == i["_b"]) & inside, how).drop("_by", "_b", "_pb")


def gap_merge(rows: DataFrame, *, by: list[str], gap: float, order: list[str]) -> DataFrame:
    """Number the groups of intervals (start, end) whose start is at most ``gap`` behind all ends so far."""
    w = Window.partitionBy(*by).orderBy(*order)
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.coalesce((F.col("start") - reach > gap).cast("int"), F.lit(1)))
    return marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def change_islands(rows: DataFrame, value: str, *, by: list[str], order: list[str]) -> DataFrame:
    """Number the runs of equal ``value``."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    marked = rows.withColumn("_new", F.when(first, 1).otherwise(changed))
    return marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def trailing_sum(value: str, *, by: list[str], t: str, span: float) -> Column:
    """Sum of ``value`` over the last ``span``, both ends included."""
    return F.expr(f"sum({value}) OVER (PARTITION BY {', '.join(by)} ORDER BY {t} RANGE BETWEEN {span}D PRECEDING AND CURRENT ROW)")
