"""Similarity transforms between arrays of points, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mean(points: Column, axis: str) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(points)


def similarity(source: Column, target: Column) -> Column:
    """Struct (a, b, x, y) of the rotation, scale and shift that take the ``source`` points (arrays of
    structs x, y) nearest to the ``target`` points in least squares: (u, v) goes to
    (a u - b v + x, b u + a v + y).

    In the plane the best similarity without reflection is a complex regression: a + b i is the sum of
    conjugate(u) v over the sum of |u|^2, both about their means. Null where the arrays differ in size,
    have fewer than two points, or all source points are one.
    """
    sx, sy, tx, ty = _mean(source, "x"), _mean(source, "y"), _mean(target, "x"), _mean(target, "y")
    moments = F.aggregate(
        F.zip_with(source, target, lambda s, t: F.struct((s["x"] - sx).alias("u"), (s["y"] - sy).alias("v"), (t["x"] - tx).alias("p"), (t["y"] - ty).alias("q"))),
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im")),
        lambda m, d: F.struct((m["n"] + d["u"] * d["u"] + d["v"] * d["v"]).alias("n"), (m["re"] + d["u"] * d["p"] + d["v"] * d["q"]).alias("re"), (m["im"] + d["u"] * d["q"] - d["v"] * d["p"]).alias("im")))
    fine = (F.size(source) == F.size(target)) & (F.size(source) >= 2)
    a, b = F.try_divide(moments["re"], moments["n"]), F.try_divide(moments["im"], moments["n"])
    fitted = F.struct(a.alias("a"), b.alias("b"), (tx - a * sx + b * sy).alias("x"), (ty - b * sx - a * sy).alias("y"))
    return F.when(fine & (moments["n"] > 0), fitted)


def moved(transform: Column, points: Column) -> Column:
    """The points after a transform; null where there is none."""
    return F.when(transform.isNotNull(), F.transform(points, lambda p: F.struct(
        (transform["a"] * p["x"] - transform["b"] * p["y"] + transform["x"]).alias("x"), (transform["b"] * p["x"] + transform["a"] * p["y"] + transform["y"]).alias("y"))))


def mean_distance(left: Column, right: Column) -> Column:
    """Mean distance of paired points; null where the arrays differ in size or are empty."""
    total = F.aggregate(F.zip_with(left, right, lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))), F.lit(0.0), lambda s, d: s + d)
    return F.when((F.size(left) == F.size(right)) & (F.size(left) > 0), total / F.size(left))


def points_of(flat: Column) -> Column:
    """An array of coordinates x0, y0, x1, y1, ... as points; an odd last one is left out."""
    half = F.floor(F.size(flat) / 2).cast("int")
    places = F.when(half > 0, F.sequence(F.lit(0), half - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.get(flat, 2 * i).cast("double").alias("x"), F.get(flat, 2 * i + 1).cast("double").alias("y")))
