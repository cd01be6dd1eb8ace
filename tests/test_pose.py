"""Poses that are known beforehand come out of their edges."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.operators import pose

W, H, SEG_W, HEIGHT, F35 = 4000, 3000, 1600, 1.6, 26
FOCAL = F35 / 43.267 * math.hypot(W, H)
SCHEMA = "name string, left array<int>, right array<int>, seg_width int, image_width int, image_height int, f35 int"


def edges_of(theta, psi, width, centre=0.0, rows=1200, noise=0):
    """Columns of both edges of a straight road in each row of the raster, by intersection of the row's ray with the ground."""
    rng, left, right = np.random.default_rng(1), [], []
    for y in range(rows):
        b = (y * W / SEG_W - H / 2) / FOCAL
        down = math.sin(theta) + b * math.cos(theta)
        if down < 0.02:
            left.append(-1)
            right.append(-1)
            continue
        ahead = HEIGHT * (math.cos(theta) - b * math.sin(theta)) / down
        depth = ahead * math.cos(theta) + HEIGHT * math.sin(theta)
        at = lambda x: (W / 2 + FOCAL * ((x - ahead * math.sin(psi)) / math.cos(psi)) / depth) * SEG_W / W  # noqa: B023, E731
        l, r = (round(at(centre + s * width / 2)) + (rng.integers(-noise, noise + 1) if noise else 0) for s in (-1, 1))
        left.append(int(min(max(l, 0), SEG_W - 1)))
        right.append(int(min(max(r, 0), SEG_W - 1)))
    return left, right


@pytest.mark.parametrize("theta,psi,width,centre,noise", [(0.25, 0.0, 4.0, 0.0, 0), (0.2, 0.1, 3.5, 0.3, 0), (0.35, -0.15, 5.5, -0.4, 0), (0.3, 0.05, 4.5, 0.2, 3)])
def test_pose_and_width(spark, theta, psi, width, centre, noise):
    left, right = edges_of(theta, psi, width, centre, noise=noise)
    photos = spark.createDataFrame([("p", left, right, SEG_W, W, H, F35)], SCHEMA)
    found = pose.edge_pose(photos, 4.0, 9.0, HEIGHT)
    r = pose.road_width(found.withColumn("height", F.lit(HEIGHT)), 4.0, 9.0).first()
    assert r["error"] is None
    assert r["theta"] == pytest.approx(theta, abs=0.01) and r["psi"] == pytest.approx(psi, abs=0.01)
    assert r["ratio"] * HEIGHT == pytest.approx(width, rel=0.02)
    assert r["road_width"] == pytest.approx(width, rel=0.02) and r["road_centre"] == pytest.approx(centre, abs=0.06)


def test_errors(spark):
    left, right = edges_of(0.25, 0.0, 4.0)
    cases = {
        "fine": (left, right), "null": (None, None), "none": ([], []), "short": ([-1] * 1180 + left[1180:], right), "no right edge": (left, [SEG_W - 1] * len(right)),
        "parallel": ([v if v < 0 else 500 for v in left], [900] * len(right)), "crossed": (right, left), "right too short": (left, right[:300]),
        "steep": edges_of(0.75, 0.0, 2.2), "aside": edges_of(0.25, 0.5, 2.0), "narrow": edges_of(0.25, 0.0, 1.5), "wide": edges_of(0.25, 0.0, 20.0),
    }
    photos = spark.createDataFrame([(n, a, b, SEG_W, W, H, None) for n, (a, b) in cases.items()], SCHEMA)
    rows = pose.road_width(pose.edge_pose(photos, 4.0, 9.0, HEIGHT).withColumn("height", F.lit(HEIGHT)), 4.0, 9.0)
    got = {r["name"]: r for r in rows.collect()}
    error = {n: r["error"] for n, r in got.items()}
    assert error == {
        "fine": None, "null": "no_lane", "none": "no_lane", "short": "no_lane", "no right edge": "edge_missing", "parallel": "not_converging", "crossed": "not_converging", "right too short": "edge_missing",
        "steep": "pitch", "aside": error["aside"], "narrow": "ratio", "wide": error["wide"],
    }
    assert error["aside"] in ("yaw", "edge_missing") and error["wide"] in ("ratio", "edge_missing")
    assert all((r["road_width"] is None) == (r["error"] is not None) for r in got.values())
    assert pose.edge_pose(photos.limit(0), 4.0, 9.0, HEIGHT).count() == 0


def test_edges_that_are_expressions_are_made_once(spark):
    """No edge that the plan computes stands within the other's loop, where each row of a photo would make it anew."""
    made = lambda slope: F.transform(F.sequence(F.lit(0), F.lit(1199)), lambda y: (800 + F.col("id") + slope * y / 4).cast("int"))
    photos = spark.range(3).select("id", made(-1).alias("left"), made(1).alias("right"), F.lit(SEG_W).alias("seg_width"), F.lit(W).alias("image_width"), F.lit(H).alias("image_height"), F.lit(None).cast("int").alias("f35"))
    found = pose.edge_pose(photos, 4.0, 9.0, HEIGHT).select("id", "theta", "psi", "ratio", "error")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\)\[lambda ", plan), "an array is looked up within a loop"
    kept = spark.createDataFrame(photos.collect(), photos.schema)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pose.edge_pose(kept, 4.0, 9.0, HEIGHT).select(*found.columns).collect()))
