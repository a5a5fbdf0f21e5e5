"""Column expressions over boxes: struct<x0, y0, x1, y1: double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def valid(b: Column) -> Column:
    return F.coalesce((b.x1 > b.x0) & (b.y1 > b.y0), F.lit(False))


def area(b: Column) -> Column:
    return F.greatest(b.x1 - b.x0, F.lit(0.0)) * F.greatest(b.y1 - b.y0, F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection; boxes that only touch have none."""
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def overlap_ratio(item: Column, region: Column) -> Column:
    """Share of the item inside the region; an item without area counts as of area 1."""
    a = area(item)
    return overlap(item, region) / F.when(a > 0, a).otherwise(1.0)


def merged(b: Column) -> Column:
    """Aggregate: the least box around all; null of none."""
    found = F.struct(F.min(b.x0).alias("x0"), F.min(b.y0).alias("y0"), F.max(b.x1).alias("x1"), F.max(b.y1).alias("y1"))
    return F.when(F.count(b.x0) > 0, found)


def from_array(v: Column) -> Column:
    """Of an array of exactly four numbers, else null."""
    at = lambda i: F.try_element_at(v, F.lit(i))
    return F.when(F.size(v) == 4, box(at(1), at(2), at(3), at(4)))


def from_polygon(p: Column) -> Column:
    """The envelope of an array of points, null of none."""
    xs, ys = F.transform(p, lambda q: F.try_element_at(q, F.lit(1))), F.transform(p, lambda q: F.try_element_at(q, F.lit(2)))
    return F.when(F.size(p) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def crop_box(b: Column, region_type: Column, width: Column, height: Column) -> Column:
    """struct<left, top, right, bottom: int> of an image crop with its margin, null where the box is empty or the crop
    smaller than 48. Margins: tables 5 and 8 per cent, at least 28; figures 8 and 12 per cent, at least 36; cut to whole
    numbers toward zero."""
    w, h = b.x1 - b.x0, b.y1 - b.y0
    table = region_type == "table"
    pad_x = F.when(table, F.greatest(F.lit(28), (w * 0.05).cast("int"))).otherwise(F.greatest(F.lit(36), (w * 0.08).cast("int")))
    pad_y = F.when(table, F.greatest(F.lit(28), (h * 0.08).cast("int"))).otherwise(F.greatest(F.lit(36), (h * 0.12).cast("int")))
    left, top = F.greatest(F.lit(0), (b.x0 - pad_x).cast("int")), F.greatest(F.lit(0), (b.y0 - pad_y).cast("int"))
    right, bottom = F.least(width, (b.x1 + pad_x).cast("int")), F.least(height, (b.y1 + pad_y).cast("int"))
    fits = (w > 1) & (h > 1) & (right - left >= 48) & (bottom - top >= 48)
    return F.when(fits, F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))
