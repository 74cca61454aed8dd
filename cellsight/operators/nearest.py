"""Exact nearest feature by branch and bound over a pyramid of square buckets; nearest record in time."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.operators.vector import bucket_segments

BLOCK = 4096
STEP, SLACK = 2, 1e-14
PARTS = 128


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, ((px - x1) * dx + (py - y1) * dy) / length).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt(F.pow(px - (x1 + t * dx), 2) + F.pow(py - (y1 + t * dy), 2))


def _box_distance(level: int, size: float) -> Column:
    """Distance of (px, py) to the box of bucket (bx, by) of a level: no segment point in the bucket is nearer."""
    width = size * 2.0**level
    off = lambda p, b: F.greatest(F.col(b) * width - F.col(p), F.col(p) - (F.col(b) + 1) * width, F.lit(0.0))
    dx, dy = off("px", "bx"), off("py", "by")
    return F.sqrt(dx * dx + dy * dy)


def nearest_candidates(points: DataFrame, segments: DataFrame, size: float, point: str = "area_id", line: str = "line_id") -> DataFrame:
    """(point, px, py, line, x1, y1, x2, y2): the segments that a branch-and-bound descent leaves for every point.

    Buckets with segments form a pyramid from one to four buckets that hold everything down to buckets of ``size``. Each bucket knows one
    true segment point. A step goes down ``STEP`` levels: of all buckets still open for a point, those farther (at their box) than the
    nearest known segment point are closed. The open ones of a point lie in a ring about as wide as a bucket, at any distance: only the rounding
    of coordinates, ``SLACK`` (45 units in the last place) of the greatest one, widens it. Points are few bytes that become many pairs, so they
    are dealt over at least ``PARTS`` tasks.
    """
    points = points.repartition(max(PARTS, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))), point)
    fine = bucket_segments(segments.select(line, "x1", "y1", "x2", "y2"), size)
    reach = segments.agg(*[f(g(a, b)).alias(n) for n, f, g, a, b in (("w", F.min, F.least, "x1", "x2"), ("e", F.max, F.greatest, "x1", "x2"), ("s", F.min, F.least, "y1", "y2"), ("n", F.max, F.greatest, "y1", "y2"))]).first()
    west, east, south, north = (0 if v is None else math.floor(float(v) / size) + d for v, d in zip(reach, (-1, 1, -1, 1)))
    widest = max((abs(float(v)) for v in reach if v is not None), default=0.0)
    top = 0
    while (east >> top) - (west >> top) > 1 or (north >> top) - (south >> top) > 1:
        top += 1
    # the point of the segment nearest to the middle of the bucket
    cx, cy = (F.col("bx") + 0.5) * size, (F.col("by") + 0.5) * size
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((cx - F.col("x1")) * dx + (cy - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    stands = fine.select("bx", "by", F.struct((F.col("x1") + t * dx).alias("mx"), (F.col("y1") + t * dy).alias("my")).alias("m"))
    roots = [F.struct(F.lit(bx).cast("long").alias("bx"), F.lit(by).cast("long").alias("by")) for bx in range(west >> top, (east >> top) + 1) for by in range(south >> top, (north >> top) + 1)]
    open_ = points.select(point, "px", "py", F.explode(F.array(*roots)).alias("b")).select(point, "px", "py", "b.*")
    level = top
    while level > 0:
        step = min(STEP, level)
        level -= step
        held = stands.groupBy(F.shiftright("bx", level).alias("bx"), F.shiftright("by", level).alias("by")).agg(F.min("m").alias("m"))
        below = held.select(F.shiftright("bx", step).alias("up_x"), F.shiftright("by", step).alias("up_y"), "bx", "by", "m")
        above = open_.select(point, "px", "py", F.col("bx").alias("up_x"), F.col("by").alias("up_y"))
        known = F.sqrt(F.pow(F.col("px") - F.col("m.mx"), 2) + F.pow(F.col("py") - F.col("m.my"), 2))
        met = above.join(below, ["up_x", "up_y"]).select(point, "px", "py", "bx", "by", _box_distance(level, size).alias("low"), known.alias("known"))
        bound = F.min("known").over(W.partitionBy(point))
        rounding = SLACK * F.greatest(F.abs("px"), F.abs("py"), F.lit(widest))
        open_ = met.withColumn("bound", bound).where(F.col("low") <= F.col("bound") + rounding).select(point, "px", "py", "bx", "by")
    return open_.join(fine, ["bx", "by"]).drop("bx", "by")


def nearest_segment(points: DataFrame, segments: DataFrame, size: float, point: str = "area_id", line: str = "line_id") -> DataFrame:
    """(point, line, distance) of the nearest segment, ties to the smallest line id; without segments there are no rows.

    ``points`` has (point, px, py), one row for each, and ``segments`` (line, x1, y1, x2, y2), planar units. Only the candidates of
    ``nearest_candidates`` are measured; none is cut off and no point is too far.
    """
    pairs = nearest_candidates(points, segments, size, point, line)
    distance = point_segment_distance(F.col("px"), F.col("py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    best = pairs.groupBy(point).agg(F.min(F.struct(distance.alias("d"), F.col(line).alias("line"))).alias("best"))
    return best.select(point, F.col("best.line").alias(line), F.col("best.d").alias("distance"))


def nearest_in_time(requests: DataFrame, items: DataFrame, request: str, wanted: str, item: str, stamp: str, days: int = 2, slices: int = 64) -> DataFrame:
    """Item closest to the requested time within +-``days``; on a tie the first in (time, id) order.

    An as-of merge, linear in both sides: items and requests are ordered together inside narrow time slices, each
    request takes the last item before it and the first one after it. Where its slice has none, the border items of
    slices are handed on in two steps, inside blocks of ``BLOCK`` slices and between blocks. All frames run from the start of their
    order. A block is a fixed span of time, so the calendar bounds the one window over blocks.
    """
    micros = F.unix_micros
    slice_of = lambda t: F.floor(t / (86400e6 * days / slices))
    at = F.struct(F.col("_t"), F.col("_id"))
    offered = items.where(F.col(stamp).isNotNull()).groupBy(micros(stamp).alias("_t")).agg(F.min(item).alias("_id"))
    offered = offered.select(slice_of(F.col("_t")).alias("_b"), "_t", at.alias("_item"))
    asked = requests.where(F.col(wanted).isNotNull()).select(request, micros(wanted).alias("_t")).withColumn("_b", slice_of(F.col("_t")))
    both = asked.withColumn("_item", F.lit(None).cast(offered.schema["_item"].dataType)).unionByName(offered.withColumn(request, F.lit(None).cast(requests.schema[request].dataType)))
    both = both.withColumn("_asks", F.col("_item").isNull())
    ahead = W.partitionBy("_b").orderBy("_t", "_asks").rowsBetween(W.unboundedPreceding, 0)
    behind = W.partitionBy("_b").orderBy(F.desc("_t"), "_asks").rowsBetween(W.unboundedPreceding, 0)
    met = both.select(request, "_t", "_b", "_asks", F.last("_item", True).over(ahead).alias("_before"), F.last("_item", True).over(behind).alias("_after")).where("_asks")
    border = offered.schema["_item"].dataType
    edges = asked.select("_b").distinct().withColumns({"_low": F.lit(None).cast(border), "_high": F.lit(None).cast(border)})
    edges = edges.unionByName(offered.groupBy("_b").agg(F.min("_item").alias("_low"), F.max("_item").alias("_high")))
    edges = edges.groupBy("_b").agg(F.max("_low").alias("_low"), F.max("_high").alias("_high")).withColumn("_g", F.floor(F.col("_b") / BLOCK))
    up, down = (W.partitionBy("_g").orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc("_b"), F.desc("_b")))
    inside = edges.select("_b", "_g", F.last("_high", True).over(up).alias("_earlier"), F.last("_low", True).over(down).alias("_later"))
    blocks = edges.groupBy("_g").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    up, down = (W.orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc("_g"), F.desc("_g")))
    between = blocks.select("_g", F.last("_high", True).over(up).alias("_past"), F.last("_low", True).over(down).alias("_next"))
    carried = inside.join(between, "_g").select("_b", F.coalesce("_earlier", "_past").alias("_earlier"), F.coalesce("_later", "_next").alias("_later"))
    near = met.join(carried, "_b").withColumns({"_before": F.coalesce("_before", "_earlier"), "_after": F.coalesce("_after", "_later")})
    gap = lambda c: F.struct(F.abs(F.col("_t") - F.col(f"{c}._t")).alias("gap"), F.col(f"{c}._t").alias("at"), F.col(f"{c}._id").alias("id"))
    choice = F.array_min(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), gap(c)) for c in ("_before", "_after")])))
    best = near.withColumn("_best", choice).where(F.col("_best.gap") <= days * 86400 * 1_000_000)
    return best.select(request, F.col("_best.id").alias(item), F.timestamp_micros("_best.at").alias(stamp), (F.col("_best.gap") / 1e6).alias("gap_seconds"))


def nearest_in_month(months: DataFrame, items: DataFrame, month: str, item: str, stamp: str) -> DataFrame:
    """Item nearest to noon on the 21st, within two days if there is one, else within the month.

    One aggregation per month decides both stages: the preferred flag sorts before the distance.
    """
    wanted = F.to_timestamp(F.concat(F.date_format(month, "yyyy-MM"), F.lit("-21 12:00:00")))
    gap = F.abs(F.unix_micros(stamp) - F.unix_micros(wanted))
    stamped = items.withColumn(month, F.trunc(stamp, "month"))
    ranked = stamped.groupBy(month).agg(
        F.min(F.struct((gap > 2 * 86400 * 1_000_000).alias("far"), gap.alias("gap"), F.col(stamp).alias("at"), F.col(item).alias("id"))).alias("best")
    )
    return months.select(month).join(ranked, month, "left").select(
        month,
        F.col("best.id").alias(item),
        F.col("best.at").alias(stamp),
        F.when(F.col("best").isNull(), "unavailable").when(F.col("best.far"), "whole_month").otherwise("near_21st").alias("selection"),
    )


def latest_in_slot(slots: DataFrame, items: DataFrame, keys: Sequence[str], item: str, stamp: str) -> DataFrame:
    """Latest record strictly inside each (year, month) slot; empty slots are reported."""
    dated = items.withColumn("year", F.year(stamp)).withColumn("month", F.month(stamp))
    best = dated.groupBy("year", "month").agg(F.max(F.struct(F.col(stamp).alias("at"), F.col(item).alias("id"))).alias("best"))
    return slots.join(best, list(keys), "left").select(
        *keys, F.col("best.id").alias(item), F.col("best.at").alias(stamp), F.col("best").isNull().alias("missing")
    )
