"""Camera pose and road width from the edges of the road in a photo, as folds over arrays without Python.

A photo has the arrays ``left`` and ``right``: for each row of a small raster, from the top, the column of the road's
edge, or a negative number where no road was found.  ``seg_width`` is the small raster's width, ``image_width`` and
``image_height`` are those of the photo, ``f35`` its focal length (of a 35 mm film).  Metres are ahead of the camera.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.operators.signals import ground_to_image

# Rows and points that a fit needs, limits of plausible poses, film diagonal and focal length.
LEAST_ROWS, LEAST_POINTS, LEAST_NEAR, LEAST_WIDTHS, ROUNDS = 30, 10, 20, 5, 3
UPPER_SHARE, MARGIN_LEFT, MARGIN_RIGHT, LEAST_OPENING = 0.3, 2, 3, 1e-4
PITCH, YAW, RATIO = (-5.0, 40.0), 25.0, (1.2, 9.0)
FILM_MM, FOCAL_MM = 43.267, 26.0
AROUND_M = 1.0


def focal_pixels(f35: Column, width: Column, height: Column) -> Column:
    known = F.when(f35 > 0, f35.cast("double")).otherwise(FOCAL_MM)
    return known / FILM_MM * F.sqrt(width * width + height * height)


def edge_rows(left: Column, right: Column) -> Column:
    """Rows with a road as an array of (y, l, r).

    The arrays are zipped: looked up row by row, ``right`` would be made anew for each row of ``left`` wherever its
    expression is merged into this one.
    """
    none = F.array().cast("array<int>")
    both = F.arrays_zip(left.alias("l"), F.when(left.isNotNull(), F.coalesce(right, none)).alias("r"))
    rows = F.transform(both, lambda e, y: F.struct(y.cast("long").alias("y"), e["l"].cast("long").alias("l"), e["r"].cast("long").alias("r")))
    return F.filter(rows, lambda e: e["l"] >= 0)


def _edge(rows: Column, side: str, seg_width: Column) -> Column:
    """The points of an edge that are not at the raster's border, as an array of (y, v, yy, yv)."""
    inside = F.filter(rows, lambda e: (e[side] > MARGIN_LEFT) & (e[side] < seg_width - MARGIN_RIGHT))
    return F.transform(inside, lambda e: F.struct(e["y"].alias("y"), e[side].alias("v"), (e["y"] * e["y"]).alias("yy"), (e["y"] * e[side]).alias("yv")))


def _within(rows: Column, low: Column, high: Column) -> Column:
    return F.filter(rows, lambda e: (e["y"] >= low) & (e["y"] <= high))


def _sums(points: Column) -> Column:
    """n and whole sums of y, v, y*y and y*v over the points of an edge."""
    zero = F.lit(0).cast("long")
    names = ("n", "y", "v", "yy", "yv")
    return F.aggregate(
        points, F.struct(*[zero.alias(n) for n in names]),
        lambda s, e: F.struct((s["n"] + 1).alias("n"), *[(s[n] + e[n]).alias(n) for n in names[1:]]),
    )


def _line(sums: str, scale: Column) -> tuple[Column, Column]:
    """Slope and intercept of the least-squares line in the photo's pixels."""
    n, y, v, yy, yv = (F.col(f"{sums}.{k}").cast("double") for k in ("n", "y", "v", "yy", "yv"))
    slope = F.try_divide(n * yv - y * v, n * yy - y * y)
    return slope, (v - slope * y) / (n * scale)


def row_of(metres: Column, theta: Column, psi: Column, height: Column, focal: Column, cy: Column) -> Column:
    """The photo's row of the ground point straight ahead."""
    return ground_to_image(F.lit(0.0), metres, theta, psi, height, focal, F.lit(0.0), cy)[1]


def edge_pose(photos: DataFrame, from_m: float, to_m: float, height_m: float) -> DataFrame:
    """Photos with ``theta`` (pitch), ``psi`` (yaw), ``ratio`` of road width to camera height, or an ``error``.

    Lines are fitted to both edges, first over the lower 70 % of the road's rows, then, twice more, over the rows
    that the pose so found gives for the range measured, one metre wider at both ends; fewer than 20 such rows
    end the refitting.  The lines' crossing is the vanishing point.  Errors, the first that holds: no_lane (under
    30 rows), edge_missing (under 10 points of an edge within the raster), not_converging, pitch, yaw, ratio; a
    photo with an error or with null arrays (no_lane) has no pose.
    """
    scale = F.col("seg_width") / F.col("image_width")
    cx, cy = F.col("image_width") / 2, F.col("image_height") / 2
    focal = focal_pixels(F.col("f35"), F.col("image_width"), F.col("image_height"))
    rows = photos.withColumn("_e", F.coalesce(edge_rows(F.col("left"), F.col("right")), F.expr("array()").cast("array<struct<y: bigint, l: bigint, r: bigint>>")))
    rows = rows.withColumns({f"_p{side}": _edge(F.col("_e"), side, F.col("seg_width")) for side in "lr"})
    first, last = F.get("_e", F.lit(0))["y"], F.element_at(F.col("_e"), -1)["y"]
    rows = rows.withColumn("_low", F.when(F.size("_e") > 0, first + UPPER_SHARE * (last - first))).withColumn("_high", F.lit(float("inf")))
    none = F.lit(None).cast("double")
    rows = rows.withColumns({"_error": F.when(F.size("_e") < LEAST_ROWS, "no_lane"), "_on": F.lit(True), "_pose": F.struct(none.alias("theta"), none.alias("psi"), none.alias("ratio"))})
    for _ in range(ROUNDS):
        rows = rows.withColumns({f"_{side}": _sums(_within(F.col(f"_p{side}"), F.col("_low"), F.col("_high"))) for side in "lr"})
        (al, bl), (ar, br) = _line("_l", scale), _line("_r", scale)
        rows = rows.withColumns({"_al": al, "_bl": bl, "_ar": ar, "_br": br})
        yh = (F.col("_br") - F.col("_bl")) / (F.col("_al") - F.col("_ar"))
        few = F.least("_l.n", "_r.n") < LEAST_POINTS
        flat = F.coalesce(F.col("_ar") - F.col("_al") < LEAST_OPENING, F.lit(True))
        going = F.col("_on") & F.col("_error").isNull()
        rows = rows.withColumn("_error", F.when(going & few, "edge_missing").when(going & flat, "not_converging").otherwise(F.col("_error")))
        going = F.col("_on") & F.col("_error").isNull()
        rows = rows.withColumn("_yh", F.when(going, yh)).withColumn("_theta", F.atan((cy - F.col("_yh")) / focal))
        xh = F.col("_al") * F.col("_yh") + F.col("_bl")
        pose = F.struct(F.col("_theta").alias("theta"), (-F.atan((xh - cx) * F.cos("_theta") / focal)).alias("psi"), ((F.col("_ar") - F.col("_al")) / F.cos("_theta")).alias("ratio"))
        rows = rows.withColumn("_pose", F.when(going, pose).otherwise(F.col("_pose")))
        at = lambda m: row_of(F.lit(m), F.col("_pose.theta"), F.col("_pose.psi"), F.lit(height_m), focal, cy) * scale  # noqa: B023, E731
        rows = rows.withColumns({"_low2": at(to_m + AROUND_M), "_high2": at(max(from_m - AROUND_M, 1.0))})
        on = going & (F.size(_within(F.col("_e"), F.col("_low2"), F.col("_high2"))) >= LEAST_NEAR)
        rows = rows.withColumn("_on", F.coalesce(on, F.lit(False)))
        rows = rows.withColumns({"_low": F.when(F.col("_on"), F.col("_low2")).otherwise(F.col("_low")), "_high": F.when(F.col("_on"), F.col("_high2")).otherwise(F.col("_high"))})
    pitch, yaw, ratio = F.degrees("_pose.theta"), F.degrees("_pose.psi"), F.col("_pose.ratio")
    error = (
        F.when(F.col("_error").isNotNull(), F.col("_error")).when(~((pitch > PITCH[0]) & (pitch < PITCH[1])), "pitch").when(F.abs(yaw) > YAW, "yaw").when(~((ratio > RATIO[0]) & (ratio < RATIO[1])), "ratio")
    )
    out = rows.withColumn("error", error)
    return out.select(*photos.columns, *[F.when(F.col("error").isNull(), F.col(f"_pose.{c}")).alias(c) for c in ("theta", "psi", "ratio")], "error")


def ground_across(u: Column, v: Column, theta: Column, psi: Column, height: Column, focal: Column, cx: Column, cy: Column) -> Column:
    """Metres to the right of the camera of the ground point that a pixel shows: the inverse of the projection."""
    a, b = (u - cx) / focal, (v - cy) / focal
    ahead = height * (F.cos(theta) - b * F.sin(theta)) / (F.sin(theta) + b * F.cos(theta))
    right = a * (ahead * F.cos(theta) + height * F.sin(theta))
    return right * F.cos(psi) + ahead * F.sin(psi)


def _median(values: Column) -> Column:
    """Median of an array, the mean of the middle two where their number is even."""
    ordered, n = F.array_sort(values), F.size(values)
    at = lambda k: F.get(ordered, k.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def road_width(photos: DataFrame, from_m: float, to_m: float) -> DataFrame:
    """Photos (with theta, psi, height in use) with ``road_width`` and ``road_centre`` in metres: medians over the rows of
    the range measured, with both edges within the raster.  Null under five such rows, and without a pose."""
    scale = F.col("seg_width") / F.col("image_width")
    cx, cy = F.col("image_width") / 2, F.col("image_height") / 2
    focal = focal_pixels(F.col("f35"), F.col("image_width"), F.col("image_height"))
    pose = (F.col("theta"), F.col("psi"), F.col("height"))
    at = lambda m: row_of(F.lit(float(m)), *pose, focal, cy) * scale
    rows = photos.withColumns({"_low": at(to_m), "_high": at(from_m)})
    near = F.filter(_within(edge_rows(F.col("left"), F.col("right")), F.col("_low"), F.col("_high")), lambda e: (e["l"] > MARGIN_LEFT) & (e["r"] < F.col("seg_width") - MARGIN_RIGHT))
    across = lambda e, side: ground_across(e[side] / scale, e["y"] / scale, *pose, focal, cx, cy)
    rows = rows.withColumn("_x", F.transform(near, lambda e: F.struct(across(e, "l").alias("l"), across(e, "r").alias("r"))))
    enough = F.size("_x") >= LEAST_WIDTHS
    width = _median(F.transform("_x", lambda p: p["r"] - p["l"]))
    centre = _median(F.transform("_x", lambda p: (p["r"] + p["l"]) / 2))
    return rows.select(*photos.columns, F.when(enough, width).alias("road_width"), F.when(enough, centre).alias("road_centre"))
