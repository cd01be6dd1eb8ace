"""JSON sources with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.session import path_exists

#: Raw measurements of one street, as a photo evaluation writes them.
RAW_RESULT = """titel string, ort string, version string,
    abschnitte array<struct<datei: string, zeit: string, lat: double, lon: double, gps_genauigkeit: double, fahrbahnbreite: double, bezugsflaeche: double,
        laengsriss: double, querriss: double, netzriss_flaeche: double, flickflaeche: double, schadflaeche: double, schadanteil: double,
        kalibrierung: string, modell: string, nr: int, von: double, bis: double>>,
    nicht_ausgewertet variant"""


def route_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as (doc, json); nothing is inferred, broken files stay in for the quarantine."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("json"))


def raw_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Measurements (route_id, pos, ...) and rejected photos (route_id, photo, reason), pairs or objects."""
    rows = spark.read.schema(RAW_RESULT).option("multiLine", True).json(path).withColumn("route_id", F.col("_metadata.file_path"))
    items = rows.select("route_id", F.posexplode("abschnitte").alias("pos", "a")).select(
        "route_id", "pos", "a.nr", F.col("a.datei").alias("photo"), F.col("a.zeit").alias("time"), F.col("a.fahrbahnbreite").alias("width"), F.col("a.bezugsflaeche").alias("area"), F.col("a.von").alias("from_m"),
        F.col("a.bis").alias("to_m"), F.col("a.laengsriss").alias("longitudinal"), F.col("a.querriss").alias("transverse"), F.col("a.netzriss_flaeche").alias("net"), F.col("a.flickflaeche").alias("patch"),
        F.col("a.schadflaeche").alias("damage"), F.col("a.schadanteil").alias("share"), F.col("a.kalibrierung").alias("calibration"), "a.lat", "a.lon",
    )
    bad = rows.select("route_id", F.explode(F.try_variant_get("nicht_ausgewertet", "$", "array<variant>")).alias("x"))
    pick = lambda at, name: F.coalesce(F.try_variant_get("x", f"$[{at}]", "string"), F.try_variant_get("x", f"$.{name}", "string"))
    return items, bad.select("route_id", pick(0, "foto").alias("photo"), pick(1, "grund").alias("reason")).where("photo is not null")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """A catalog's files that are there, in whatever store Spark reads."""
    return [p for p in paths if path_exists(spark, p)]
