"""One-dimensional forms of the image operators, on arrays and pixel rows, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Limits of photo quality and of crack types.
DARK, BRIGHT, GLARE, GLARE_SHARE, BLURRED = 60.0, 190.0, 245.0, 0.15, 60.0
CRACK_MIN_M, CRACK_MAX_WIDTH_M, NET_BOX_M, NET_BRANCHES, NET_ELONGATION = 0.40, 0.08, 0.3, 6, 4.0


def pixels(rows: DataFrame, key: str, array: str) -> DataFrame:
    return rows.select(key, F.posexplode(array).alias("i", "v"))


def islands(px: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """Runs of values above ``low``: (key, first, last, n, peak, kept); kept if a value is above ``high``."""
    order = Window.partitionBy(key).orderBy("i")
    rows = px.withColumn("on", F.col("v") > low)
    start = F.when(F.col("on") & ~F.coalesce(F.lag("on").over(order), F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("start", start)
    rows = rows.withColumn("island", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("on")
    runs = rows.groupBy(key, "island").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n"), F.max("v").alias("peak"))
    return runs.withColumn("kept", F.col("peak") > high)


def laplacian(px: DataFrame, key: str, width: int) -> DataFrame:
    """Five-point stencil of the inner pixels of a raster given as (key, i, v), i counted by rows.

    Neighbours come from one window a raster: lags of 1 and of a row's width.
    """
    order = Window.partitionBy(key).orderBy("i")
    x, y = F.col("i") % width, F.floor(F.col("i") / width)
    around = [F.lag("v", 1).over(order), F.lead("v", 1).over(order), F.lag("v", width).over(order), F.lead("v", width).over(order)]
    rows = px.withColumn("l", 4 * F.col("v") - around[0] - around[1] - around[2] - around[3])
    return rows.where(x.between(1, width - 2) & F.col("l").isNotNull()).withColumn("y", y)


def photo_hints(mean: Column, glare_share: Column, sharpness: Column) -> Column:
    """dark, overexposed, blurred: those that hold, in this order."""
    tests = ((mean < DARK, "dark"), ((mean > BRIGHT) | (glare_share > GLARE_SHARE), "overexposed"), (sharpness < BLURRED, "blurred"))
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))


def crack_type(length_m: Column, mean_width_m: Column, box_w_m: Column, box_h_m: Column, skeleton_m: Column, branches: Column, elongation: Column, angle: Column) -> Column:
    """Type of a connected crack from its features; null if it is too short or too wide."""
    branched = (skeleton_m > 3 * length_m / 1.15) & (branches >= NET_BRANCHES)
    net = (box_w_m > NET_BOX_M) & (box_h_m > NET_BOX_M) & (branched | ((branches >= NET_BRANCHES) & (elongation < NET_ELONGATION)))
    kind = F.when(net, "net").when(angle <= 45, "longitudinal").otherwise("transverse")
    return F.when((length_m >= CRACK_MIN_M) & (mean_width_m <= CRACK_MAX_WIDTH_M), kind)


def principal_direction(points: DataFrame, key: str) -> DataFrame:
    """(key, angle, elongation) of points x, y: closed form of the 2 by 2 covariance's eigenvectors."""
    m = points.groupBy(key).agg(F.var_samp("x").alias("a"), F.var_samp("y").alias("c"), F.covar_samp("x", "y").alias("b"))
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.pow(F.col("b"), 2))
    big, small = half + root, half - root
    vx = F.when(F.abs("b") > 1e-12, big - F.col("c")).otherwise(F.when(F.col("a") >= F.col("c"), 1.0).otherwise(0.0))
    vy = F.when(F.abs("b") > 1e-12, F.col("b")).otherwise(F.when(F.col("a") >= F.col("c"), 0.0).otherwise(1.0))
    return m.select(key, F.degrees(F.atan2(F.abs(vx), F.abs(vy))).alias("angle"), F.sqrt(big / F.greatest(small, F.lit(1e-6))).alias("elongation"))


def ground_to_image(x: Column, d: Column, theta: Column, psi: Column, height: Column, focal: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pinhole projection of a ground point (x to the right, d ahead, metres) to pixels."""
    right, ahead = x * F.cos(psi) - d * F.sin(psi), x * F.sin(psi) + d * F.cos(psi)
    depth, down = ahead * F.cos(theta) + height * F.sin(theta), height * F.cos(theta) - ahead * F.sin(theta)
    return cx + focal * right / depth, cy + focal * down / depth
