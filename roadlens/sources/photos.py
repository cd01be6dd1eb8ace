"""Photo folders: one folder a street; EXIF headers and pixels are read in Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from roadlens.session import path_exists, ship

# Suffixes, EXIF tags, and how much of a file is searched for its header.
SUFFIXES = r"(?i)\.(jpg|jpeg|png)\z"
HEADER_BYTES = 256 * 1024
TAG_MODEL, TAG_ORIENTATION, TAG_TIME, TAG_EXIF, TAG_GPS, TAG_ORIGINAL, TAG_F35 = 0x0110, 0x0112, 0x0132, 0x8769, 0x8825, 0x9003, 0xA405
GPS_LAT_REF, GPS_LAT, GPS_LON_REF, GPS_LON, GPS_ACCURACY = 1, 2, 3, 4, 31
EXIF_SCHEMA = "path string, time string, model string, f35 int, lat double, lon double, accuracy double, orientation int"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def photo_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, street, file, modified, bytes[, content]) of all photos below ``root``.

    Without ``content`` the column is pruned, so files are listed and not read.
    """
    return _photos(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), content)


def _named(rows: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return rows.withColumns({"street": F.element_at(parts, -2), "file": F.element_at(parts, -1)})


def _photos(files: DataFrame, content: bool) -> DataFrame:
    photos = _named(files.where(F.col("path").rlike(SUFFIXES)))
    return photos.select("path", "street", "file", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), *(["content"] if content else []))


def evaluate_new_photos(spark: SparkSession, root: str, measures: str, checkpoint: str, evaluate: Callable[[DataFrame, int], None], measure: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Take in the photos that have come to the folders of streets below ``root`` since the last run, and end.

    The photos of a micro-batch are read and measured once (``measure``: photos with content to rows with path; EXIF headers
    by default) and appended to the table ``measures``, with street and file.  Then ``evaluate`` gets the
    measures of all photos, old and new, of the streets that the batch has touched, and no others.  Old photos are
    not read again.  The checkpoint remembers files by name: a photo that was replaced under its old name is
    found by stale_streets instead.  A batch that is run again after a crash replaces its own part of ``measures``.
    """
    ship(spark)
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).load(root)

    def batch(rows: DataFrame, n: int) -> None:
        found = _named((measure or read_exif)(_photos(rows, content=True)))
        found.write.mode("overwrite").parquet(f"{measures}/batch={n}")
        touched = spark.read.parquet(f"{measures}/batch={n}").select("street").distinct()
        if not touched.isEmpty():
            evaluate(spark.read.parquet(measures).join(touched, "street", "left_semi"), n)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def street_folders(spark: SparkSession, root: str, named: str | None = None) -> list[str]:
    """Folders to scan, one a street: the named one, as a path or below ``root``, else all folders below ``root``."""
    if named:
        found = [p for p in (named, f"{root.rstrip('/')}/{named}") if path_exists(spark, p)]
        if not found:
            raise FileNotFoundError(f"no folder {named}, neither as a path nor below {root}")
        return found[:1]
    if not path_exists(spark, root):
        raise FileNotFoundError(f"no folder {root}")
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    entries = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    folders = sorted(e.getPath().toString() for e in entries if e.isDirectory())
    if not folders:
        raise FileNotFoundError(f"no folders of streets below {root}")
    return folders


def stale_streets(photos: DataFrame, reports: DataFrame) -> DataFrame:
    """Streets without a report (street, reported), or with a photo newer than it."""
    newest = photos.groupBy("street").agg(F.max("modified").alias("newest"))
    return newest.join(reports, "street", "left").where("reported is null or newest > reported").select("street")


class _Tiff:
    """Tag tables of a TIFF header in either byte order."""

    def __init__(self, data: bytes):
        self.data = data
        self.order = "<" if data[:2] == b"II" else ">"

    def read(self, kind: str, at: int) -> tuple:
        return struct.unpack_from(self.order + kind, self.data, at)

    def table(self, at: int) -> dict[int, tuple[int, int, int]]:
        """tag: (type, count, place of the value)."""
        if not 0 < at <= len(self.data) - 2:
            return {}
        n = min(self.read("H", at)[0], (len(self.data) - at - 2) // 12)
        rows = (self.read("HHI", at + 2 + 12 * k) + (at + 10 + 12 * k,) for k in range(n))
        return {tag: (kind, count, place) for tag, kind, count, place in rows}

    def text(self, entry: tuple[int, int, int] | None) -> str | None:
        if entry is None:
            return None
        _, count, place = entry
        start = self.read("I", place)[0] if count > 4 else place
        return self.data[start : start + count].split(b"\0")[0].decode("latin-1").strip() or None

    def number(self, entry: tuple[int, int, int] | None) -> int | None:
        return None if entry is None else self.read("H" if entry[0] == 3 else "I", entry[2])[0]

    def ratios(self, entry: tuple[int, int, int] | None, n: int) -> list[float] | None:
        if entry is None or entry[1] < n:
            return None
        pairs = self.read(f"{2 * n}I", self.read("I", entry[2])[0])
        return None if 0 in pairs[1::2] else [a / b for a, b in zip(pairs[::2], pairs[1::2], strict=True)]


def _header(content: bytes) -> bytes | None:
    """The TIFF part of a JPEG's first EXIF segment."""
    at = 2 if content[:2] == b"\xff\xd8" else len(content)
    while at + 10 < len(content):
        marker, size = struct.unpack_from(">HH", content, at)
        if marker == 0xFFE1 and content[at + 4 : at + 8] == b"Exif":
            return content[at + 10 : at + 2 + size]
        if marker >> 8 != 0xFF or marker == 0xFFDA:
            return None
        at += 2 + size
    return None


def exif_of(content: bytes) -> dict:
    """Capture time, model, focal length and position; a position of (0, 0) is none."""
    data = _header(content[:HEADER_BYTES])
    if data is None:
        return {}
    try:
        t = _Tiff(data)
        main = t.table(t.read("I", 4)[0])
        more = t.table(t.number(main.get(TAG_EXIF)) or 0)
        gps = t.table(t.number(main.get(TAG_GPS)) or 0)
        out = {"model": t.text(main.get(TAG_MODEL)), "time": t.text(more.get(TAG_ORIGINAL)) or t.text(main.get(TAG_TIME)), "f35": t.number(more.get(TAG_F35)), "orientation": t.number(main.get(TAG_ORIENTATION))}
        place = [t.ratios(gps.get(k), 3) for k in (GPS_LAT, GPS_LON)]
        if all(place):
            lat, lon = (d + m / 60 + s / 3600 for d, m, s in place)
            if lat or lon:
                out["lat"] = -lat if t.text(gps.get(GPS_LAT_REF)) == "S" else lat
                out["lon"] = -lon if t.text(gps.get(GPS_LON_REF)) == "W" else lon
                out["accuracy"] = (t.ratios(gps.get(GPS_ACCURACY), 1) or [None])[0]
        return out
    except (struct.error, UnicodeDecodeError):
        return {}


def read_exif(photos: DataFrame) -> DataFrame:
    """Photos (path, content) to (path, time, model, f35, lat, lon, accuracy)."""
    names = [c.split()[0] for c in EXIF_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"path": p} | exif_of(bytes(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=names).astype({"f35": "Int32", "orientation": "Int32"})

    return photos.select("path", F.substring("content", 1, HEADER_BYTES).alias("content")).mapInPandas(run, EXIF_SCHEMA)


def in_order(photos: DataFrame) -> DataFrame:
    """Photos of a street by capture time, then name."""
    by = Window.partitionBy("street").orderBy(F.coalesce("time", F.lit("")), "file")
    return photos.withColumn("place", F.row_number().over(by))
