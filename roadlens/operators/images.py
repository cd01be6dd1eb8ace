"""Measures of photos, over Spark's image source in Arrow batches.

Only pixels are handled here; thresholds and all aggregation are column expressions (see signals and kpis).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.operators.signals import GLARE
from roadlens.session import ship

GREY = np.array([0.114, 0.587, 0.299])  # weights of blue, green and red


def grey_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rows of BGR (or grey) bytes as grey values."""
    raster = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return raster[..., 0] if channels == 1 else raster[..., :3] @ GREY


def shrunk(grey: np.ndarray, width: int) -> np.ndarray:
    """Mean over areas, for rasters wider than ``width``."""
    h, w = grey.shape
    if w <= width:
        return grey
    rows = np.linspace(0, h, max(2, round(h * width / w)) + 1).astype(int)
    columns = np.linspace(0, w, width + 1).astype(int)
    sums = np.add.reduceat(np.add.reduceat(grey, rows[:-1], axis=0), columns[:-1], axis=1)
    return sums / (np.diff(rows)[:, None] * np.diff(columns)[None, :])


def stencil(grey: np.ndarray) -> np.ndarray:
    return 4 * grey[1:-1, 1:-1] - grey[1:-1, :-2] - grey[1:-1, 2:] - grey[:-2, 1:-1] - grey[2:, 1:-1]


def upright(raster: np.ndarray, orientation: int | None) -> np.ndarray:
    """A raster (rows, columns, channels) turned and mirrored as its EXIF orientation says; unknown ones stay."""
    turned = {
        2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: a.swapaxes(0, 1),
        6: lambda a: np.rot90(a, -1), 7: lambda a: a[::-1, ::-1].swapaxes(0, 1), 8: lambda a: np.rot90(a),
    }
    return turned.get(orientation, lambda a: a)(raster)


def oriented(images: DataFrame, headers: DataFrame) -> DataFrame:
    """Images of Spark's image source, upright by the orientation of their EXIF headers (path, orientation).

    Paths are matched whether they are written with one slash or three.  An image without a header, or of a size
    that its bytes don't have, stays as it is.
    """
    ship(images.sparkSession)
    place = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    rows = images.select("image", place(F.col("image.origin")).alias("place"))
    known = headers.where("orientation between 2 and 8").select(place(F.col("path")).alias("place"), "orientation")
    rows = rows.join(known, "place", "left").select("image", "orientation")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, out = batch.schema.field("image").type, []
            for image, orientation in zip(batch.column("image").to_pylist(), batch.column("orientation").to_pylist(), strict=True):
                h, w, n = image["height"], image["width"], image["nChannels"]
                if orientation is not None and len(image["data"]) == h * w * n:
                    raster = upright(np.frombuffer(image["data"], np.uint8).reshape(h, w, n), orientation)
                    image |= {"height": raster.shape[0], "width": raster.shape[1], "data": raster.tobytes()}
                out.append(image)
            yield pa.RecordBatch.from_arrays([pa.array(out, kind)], ["image"])

    return rows.mapInArrow(run, images.select("image").schema)


def photo_measures(images: DataFrame, width: int = 320) -> DataFrame:
    """Images of Spark's image source to (path, mean, glare, sharpness, error); a broken one has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    g = shrunk(grey_of(bytes(r.data), r.height, r.width, r.channels), width)
                    lap = stencil(g)[g.shape[0] // 2 :]
                    out.append((r.path, g.mean(), float((g > GLARE).mean()), float(lap.var(ddof=1)) if lap.size > 1 else 0.0, None))
                except ValueError as e:
                    out.append((r.path, None, None, None, str(e)[:80]))
            yield pd.DataFrame(out, columns=["path", "mean", "glare", "sharpness", "error"])

    ship(images.sparkSession)  # bounds the bytes of a batch
    flat = images.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return flat.mapInPandas(run, "path string, mean double, glare double, sharpness double, error string")
