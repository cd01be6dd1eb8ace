"""The test tables as surveys: orders are routes, line items sections, events requests and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlens.functions.scalar import condition_class

QUALITY_OF = {"R": "unbrauchbar", "A": "maessig"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sections of their order; one shuffle by route, which all branches of a query and later groupings reuse.

    The key has its later name before the window: of a key renamed beside it Spark doesn't know that rows are already
    dealt by it, and would shuffle them again for each grouping and join.  Everything but the window's own columns is
    derived behind the window, and the order names every column that is read (the last two settle nothing but rows
    alike in all others), so that no branch prunes or derives columns below its shuffle that another one keeps: the
    shuffles are the same, and Spark makes one of them.
    """
    quantity = F.col("l_quantity").cast("decimal(10,2)").alias("quantity")
    raw = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag"]
    by = Window.partitionBy("route_id").orderBy(*raw, "quantity")
    placed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route_id"), *raw, quantity)
    placed = placed.withColumns({"nr": F.row_number().over(by), "sofar": F.sum("quantity").over(by.rowsBetween(Window.unboundedPreceding, 0))})
    area, share = F.col("quantity"), F.col("l_discount").cast("decimal(4,2)") * 500
    rows = placed.select(
        "route_id",
        "nr",
        (F.col("nr") - 1).alias("pos"),
        F.col("sofar").cast("double").alias("station_to_m"),
        area.cast("double").alias("area_m2"),
        (area * share / 100).cast("double").alias("damage_m2"),
        share.cast("double").alias("share_pct"),
        (F.col("l_tax").cast("decimal(4,2)") * 100).cast("double").alias("longitudinal_m"),
        (F.col("l_partkey") % 7).cast("double").alias("transverse_m"),
        ((F.col("l_suppkey") % 5) / 4).cast("double").alias("net_m2"),
        ((F.col("l_linenumber") % 3) / 2).cast("double").alias("patch_m2"),
        F.when(F.col("l_returnflag") == "R", "unbrauchbar").when(F.col("l_returnflag") == "A", "maessig").otherwise("gut").alias("quality"),
        F.concat(F.lit("IMG_"), F.col("l_partkey").cast("string"), F.lit(".jpg")).alias("photo"),
        F.when(F.col("l_partkey") % 10 != 0, 48 + (F.col("l_partkey") % 1000) / 10_000).alias("lat"),
        F.when(F.col("l_partkey") % 10 != 0, 15 + (F.col("l_suppkey") % 100) / 1000).alias("lon"),
        F.col("l_shipdate").alias("captured"),
    )
    return rows.withColumn("station_from_m", F.col("station_to_m") - F.col("area_m2")).withColumn("condition", condition_class(F.col("share_pct")))


#: The same in SQL.
SECTIONS_SQL = """
    s0 AS (
        SELECT l_orderkey AS route_id,
               row_number() OVER w AS nr, row_number() OVER w - 1 AS pos,
               CAST(sum(CAST(l_quantity AS DECIMAL(10,2))) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS station_to_m,
               CAST(CAST(l_quantity AS DECIMAL(10,2)) AS DOUBLE) AS area_m2,
               CAST(CAST(l_quantity AS DECIMAL(10,2)) * CAST(CAST(l_discount AS DECIMAL(4,2)) * 500 AS DECIMAL(10,2)) AS DOUBLE) / 100 AS damage_m2,
               CAST(CAST(l_discount AS DECIMAL(4,2)) * 500 AS DOUBLE) AS share_pct,
               CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS DOUBLE) AS longitudinal_m,
               CAST(l_partkey % 7 AS DOUBLE) AS transverse_m, (l_suppkey % 5) / 4.0::DOUBLE AS net_m2, (l_linenumber % 3) / 2.0::DOUBLE AS patch_m2,
               CASE l_returnflag WHEN 'R' THEN 'unbrauchbar' WHEN 'A' THEN 'maessig' ELSE 'gut' END AS quality,
               'IMG_' || l_partkey || '.jpg' AS photo,
               CASE WHEN l_partkey % 10 <> 0 THEN 48 + (l_partkey % 1000) / 10000.0::DOUBLE END AS lat,
               CASE WHEN l_partkey % 10 <> 0 THEN 15 + (l_suppkey % 100) / 1000.0::DOUBLE END AS lon,
               l_shipdate AS captured
        FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax)
    ),
    s AS (
        SELECT *, station_to_m - area_m2 AS station_from_m,
               CASE WHEN share_pct < 10 THEN 1 WHEN share_pct < 20 THEN 2 WHEN share_pct < 30 THEN 3 WHEN share_pct < 40 THEN 4 ELSE 5 END AS condition
        FROM s0
    )
"""

#: Indicators of each route in SQL, over SECTIONS_SQL.
KPIS_SQL = (
    SECTIONS_SQL
    + """,
    t AS (
        SELECT route_id, count(*) AS sections, count(*) FILTER (WHERE ok) AS usable, 0::BIGINT AS rejected,
               CAST(sum(CAST(station_to_m - station_from_m AS DECIMAL(18,6))) AS DOUBLE) AS length,
               coalesce(CAST(sum(CAST(area_m2 AS DECIMAL(18,6))) FILTER (WHERE ok) AS DOUBLE), 0) AS area,
               coalesce(CAST(sum(CAST(damage_m2 AS DECIMAL(18,6))) FILTER (WHERE ok) AS DOUBLE), 0) AS damage,
               coalesce(CAST(sum(CAST(longitudinal_m AS DECIMAL(18,6))) FILTER (WHERE ok) AS DOUBLE), 0) AS lo,
               coalesce(CAST(sum(CAST(transverse_m AS DECIMAL(18,6))) FILTER (WHERE ok) AS DOUBLE), 0) AS tr,
               coalesce(CAST(sum(CAST(net_m2 AS DECIMAL(18,6))) FILTER (WHERE ok) AS DOUBLE), 0) AS ne,
               coalesce(CAST(sum(CAST(patch_m2 AS DECIMAL(18,6))) FILTER (WHERE ok) AS DOUBLE), 0) AS pa,
               first(nr ORDER BY share_pct DESC, station_from_m, pos) FILTER (WHERE ok) AS worst_nr,
               max(condition) FILTER (WHERE ok) AS worst_class,
               count(*) FILTER (WHERE ok AND condition = 1) AS class_1, count(*) FILTER (WHERE ok AND condition = 2) AS class_2,
               count(*) FILTER (WHERE ok AND condition = 3) AS class_3, count(*) FILTER (WHERE ok AND condition = 4) AS class_4,
               count(*) FILTER (WHERE ok AND condition = 5) AS class_5
        FROM (SELECT *, quality <> 'unbrauchbar' AS ok FROM s) GROUP BY route_id
    ),
    u AS (
        SELECT *, CASE WHEN area > 0 THEN damage / area * 100 ELSE 0 END AS raw,
               CAST(printf('%.2f', (1 - usable / (sections + rejected)::DOUBLE)::DOUBLE) AS DOUBLE) AS unusable_share
        FROM t
    ),
    k AS (
        SELECT route_id, sections, usable, rejected, unusable_share, CAST(printf('%.1f', (length)::DOUBLE) AS DOUBLE) AS length_m, CAST(printf('%.1f', (area)::DOUBLE) AS DOUBLE) AS area_m2,
               CAST(printf('%.2f', (damage)::DOUBLE) AS DOUBLE) AS damage_m2, CAST(printf('%.1f', (raw)::DOUBLE) AS DOUBLE) AS share_pct,
               CASE WHEN CAST(printf('%.1f', (raw)::DOUBLE) AS DOUBLE) < 10 THEN 1 WHEN CAST(printf('%.1f', (raw)::DOUBLE) AS DOUBLE) < 20 THEN 2 WHEN CAST(printf('%.1f', (raw)::DOUBLE) AS DOUBLE) < 30 THEN 3
                    WHEN CAST(printf('%.1f', (raw)::DOUBLE) AS DOUBLE) < 40 THEN 4 ELSE 5 END AS overall_class,
               CASE WHEN raw < 10 THEN 1 WHEN raw < 20 THEN 2 WHEN raw < 30 THEN 3 WHEN raw < 40 THEN 4 ELSE 5 END AS overall_class_raw,
               CAST(printf('%.1f', (lo)::DOUBLE) AS DOUBLE) AS longitudinal_m, CAST(printf('%.1f', (tr)::DOUBLE) AS DOUBLE) AS transverse_m, CAST(printf('%.2f', (ne)::DOUBLE) AS DOUBLE) AS net_m2, CAST(printf('%.2f', (pa)::DOUBLE) AS DOUBLE) AS patch_m2,
               worst_nr, worst_class, class_1, class_2, class_3, class_4, class_5
        FROM u
    ),
    r AS (
        SELECT *, CASE WHEN usable = 0 OR unusable_share >= 0.3 THEN 'neu_aufnehmen' WHEN worst_class >= 4 THEN 'dringend_melden'
                       WHEN worst_class = 3 OR share_pct >= 20 THEN 'sanierung_planen' ELSE 'beobachten' END AS rule
        FROM k
    )
"""
)
