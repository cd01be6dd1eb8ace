"""What comes in: files and photos of a survey chosen, ordered, matched and set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Suffixes of photos where a browser names no type, and photos of one upload.
PHOTO_NAMES, MOST_PHOTOS = r"(?i)\.(jpg|jpeg|png|heic|heif)\z", 25


def accepted_files(files: DataFrame, group: str, order: list[str], room: Column | int = MOST_PHOTOS) -> DataFrame:
    """Files (group, name, type, ...) that are images, by type or by suffix, in their order as far as there is room.

    ``room`` is a number or a column with what a group still takes; a null type or name is none.  Adds ``place``.
    """
    image = F.coalesce(F.col("type").startswith("image/"), F.lit(False)) | F.coalesce(F.col("name").rlike(PHOTO_NAMES), F.lit(False))
    placed = files.where(image).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return placed.where(F.col("place") <= (F.lit(room) if isinstance(room, int) else room))


def set_apart(photos: DataFrame, names: DataFrame) -> DataFrame:
    """Photos with ``excluded``: whether ``names`` (name) has their name, in whatever case.

    The list may be of any size and hold names twice; a photo without a name is not excluded.
    """
    listed = names.select(F.lower("name").alias("_name")).where("_name is not null").distinct().withColumn("excluded", F.lit(True))
    rows = photos.withColumn("_name", F.lower("name")).join(listed, "_name", "left").drop("_name")
    return rows.withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def repeated_numbers(sections: DataFrame, group: str = "route_id", nr: str = "nr") -> DataFrame:
    """Groups in which a number occurs twice; a missing number repeats nothing."""
    return sections.where(F.col(nr).isNotNull()).groupBy(group, nr).count().where("count > 1").select(group).distinct()


def zipped(left: DataFrame, right: DataFrame, group: str, place: str) -> DataFrame:
    """Left rows with the right row of their group at the same place, counted from 0 in order of ``place``; nulls where
    the right side is shorter.  What the right side has beyond the left is dropped.  Right columns besides the
    group must have names of their own."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(place)) - 1
    first = left.withColumn("_at", at)
    return first.join(right.withColumn("_at", at).drop(place), [group, "_at"], "left").drop("_at")


def queue_positions(jobs: DataFrame, queue: str, order: list[str]) -> DataFrame:
    """Waiting jobs with their ``place`` in their queue, from 1."""
    return jobs.withColumn("place", F.row_number().over(Window.partitionBy(queue).orderBy(*order)))


def last_rows(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    back = F.row_number().over(Window.partitionBy(group).orderBy(F.col(order).desc()))
    return rows.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")


def last_known(rows: DataFrame, group: str, order: str, *columns: str) -> DataFrame:
    """Rows with each column's latest value that is not null, up to the row: ``last_<column>``."""
    sofar = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"last_{c}": F.last(c, ignorenulls=True).over(sofar) for c in columns})


def numbered_sections(photos: DataFrame, step_m: float, from_m: float, length_m: float) -> DataFrame:
    """Evaluated photos (route_id, pos, ...) as sections: ``number`` from 1 without gaps, ``from_m`` and ``to_m``.

    Photos that were left out take no number and no stretch of the road; both ends are rounded to two digits.
    """
    from roadlens.functions.scalar import py_round

    k = F.row_number().over(Window.partitionBy("route_id").orderBy("pos")) - 1
    rows = photos.withColumn("_k", k).withColumn("number", F.col("_k") + 1)
    rows = rows.withColumn("from_m", py_round(F.lit(float(step_m)) * F.col("_k") + float(from_m), 2))
    return rows.withColumn("to_m", py_round(F.col("from_m") + float(length_m), 2)).drop("_k")
