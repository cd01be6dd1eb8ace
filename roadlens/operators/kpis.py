"""Route indicators from sections.

A section row has route_id, pos (order in the document), nr, station_from_m, station_to_m, area_m2, damage_m2,
share_pct, condition, longitudinal_m, transverse_m, net_m2, patch_m2, quality.  Sums run in decimals, so that
they don't depend on the order of rows; only aggregates are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlens.functions.scalar import condition_class, decimal_comma_grouped, py_round

UNUSABLE = "unbrauchbar"
# Texts of a report's head.
CAPTURED, CLOCK, NORTH, EAST, NO_POSITION = "Aufnahme ", " Uhr", "° N · ", "° O", "ohne GPS"


def usable() -> Column:
    return F.col("quality") != UNUSABLE


def exact_sum(x: Column, where: Column | None = None) -> Column:
    x = x.cast("decimal(18,6)")
    return F.coalesce(F.sum(x if where is None else F.when(where, x)), F.lit(0).cast("decimal(18,6)")).cast("double")


def share_of(damage: Column, area: Column) -> Column:
    return F.when(area > 0, damage / area * 100).otherwise(F.lit(0.0))


def first_worst() -> Column:
    """nr of the usable section with the largest share; the first by station on ties."""
    order = F.struct((-F.col("share_pct")).alias("s"), "station_from_m", "pos")
    return F.min(F.when(usable(), F.struct(order.alias("order"), "nr")))["nr"]


def route_kpis(sections: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """One row a route with the sixteen indicators, one aggregation.

    ``rejected`` (route_id, rejected) has the numbers of photos that could not be evaluated.  The length counts
    all sections, areas and damage the usable ones; the class is that of the rounded share (overall_class) and
    of the exact one (overall_class_raw).
    """
    ok = usable()
    total = sections.groupBy("route_id").agg(
        F.count("*").alias("sections"),
        F.count_if(ok).alias("usable"),
        exact_sum(F.col("station_to_m") - F.col("station_from_m")).alias("length"),
        exact_sum(F.col("area_m2"), ok).alias("area"),
        exact_sum(F.col("damage_m2"), ok).alias("damage"),
        *[exact_sum(F.col(c), ok).alias(c) for c in ("longitudinal_m", "transverse_m", "net_m2", "patch_m2")],
        first_worst().alias("worst_nr"),
        F.max(F.when(ok, F.col("condition"))).alias("worst_class"),
        *[F.count_if(ok & (F.col("condition") == k)).alias(f"class_{k}") for k in range(1, 6)],
    )
    if rejected is None:
        total = total.withColumn("rejected", F.lit(0).cast("long"))
    else:
        total = total.join(rejected, "route_id", "left").withColumn("rejected", F.coalesce("rejected", F.lit(0)).cast("long"))
    raw = share_of(F.col("damage"), F.col("area"))
    share = py_round(raw, 1)
    return total.select(
        "route_id", "sections", "usable", "rejected",
        py_round(1 - F.col("usable") / (F.col("sections") + F.col("rejected")), 2).alias("unusable_share"),
        py_round(F.col("length"), 1).alias("length_m"), py_round(F.col("area"), 1).alias("area_m2"), py_round(F.col("damage"), 2).alias("damage_m2"),
        share.alias("share_pct"), condition_class(share).alias("overall_class"), condition_class(raw).alias("overall_class_raw"),
        py_round(F.col("longitudinal_m"), 1).alias("longitudinal_m"), py_round(F.col("transverse_m"), 1).alias("transverse_m"),
        py_round(F.col("net_m2"), 2).alias("net_m2"), py_round(F.col("patch_m2"), 2).alias("patch_m2"),
        "worst_nr", "worst_class", *[f"class_{k}" for k in range(1, 6)],
    )


def priorities(sections: DataFrame, k: int = 5, least_class: int = 3) -> DataFrame:
    """(route_id, priority): the worst usable sections from a class on, share descending, then by station."""
    order = Window.partitionBy("route_id").orderBy(F.col("share_pct").desc(), "station_from_m", "pos")
    top = sections.where(usable() & (F.col("condition") >= least_class)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    ranked = F.array_sort(F.collect_list(F.struct("place", "nr")))
    return top.groupBy("route_id").agg(F.transform(ranked, lambda p: p["nr"]).alias("priority"))


def upper_median(x: Column, default: float) -> Column:
    """Aggregate: the upper middle of the positive values."""
    values = F.sort_array(F.collect_list(F.when(x > 0, x)))
    return F.when(F.size(values) > 0, F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))).otherwise(F.lit(default))


def robust_scale(rows: DataFrame, key: str, x: str) -> DataFrame:
    """(key, middle, deviation): median, and 1.4826 times the median distance from it."""
    middle = rows.groupBy(key).agg(F.median(x).alias("middle"))
    return rows.join(middle, key).groupBy(key).agg(F.first("middle").alias("middle"), (1.4826 * F.median(F.abs(F.col(x) - F.col("middle")))).alias("deviation"))


def class_lengths(sections: DataFrame, step_m: float) -> DataFrame:
    """Sections and metres of every class of a route, empty classes included."""
    counts = sections.groupBy("route_id").agg(*[F.count_if(F.col("condition") == k).alias(f"c{k}") for k in range(1, 6)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), F.col(f"c{k}").alias("n")) for k in range(1, 6)]))
    return counts.select("route_id", rows.alias("r")).select("route_id", "r.condition", "r.n", (F.col("r.n") * step_m).alias("length_m"))


def worst_and_best(sections: DataFrame) -> DataFrame:
    """(route_id, worst, best): numbers of the usable sections with the largest and the smallest share, the first by
    station on ties."""
    first = lambda o: F.min(F.struct(o.alias("o"), "station_from_m", "pos", "nr"))["nr"]
    return sections.where(usable()).groupBy("route_id").agg(first(-F.col("share_pct")).alias("worst"), first(F.col("share_pct")).alias("best"))


def report_summary(sections: DataFrame, *keys: str) -> DataFrame:
    """The head of a report, one row for each value of ``keys`` (none: one row): all sections count, usable or not.

    Sums of areas and lengths; ``share_raw`` and ``class_raw`` from them, unrounded; first and last ``time`` (texts
    yyyy:MM:dd HH:mm:ss, empty ones passed over) and ``captured_text``, which shows the first as it is if one of both is
    no time, and is empty without times; mean position and ``position_text``; sections without position; sections
    of each class.
    """
    time = F.nullif(F.col("time"), F.lit(""))
    mean = lambda c: F.try_divide(F.sum(F.col(c).cast("decimal(18,6)")).cast("double"), F.count(c)).alias(f"mean_{c}")
    sums = ("area_m2", "damage_m2", "net_m2", "patch_m2", "longitudinal_m", "transverse_m")
    rows = sections.groupBy(*keys).agg(
        F.count("*").alias("sections"), *[exact_sum(F.col(c)).alias(c) for c in sums], F.min(time).alias("first_time"), F.max(time).alias("last_time"), mean("lat"), mean("lon"),
        F.count_if(F.col("lat").isNull()).alias("without_gps"), *[F.count_if(F.col("condition") == k).alias(f"class_{k}") for k in range(1, 6)],
    )
    raw = share_of(F.col("damage_m2"), F.col("area_m2"))
    begin, end = (F.try_to_timestamp(c, F.lit("yyyy:MM:dd HH:mm:ss")) for c in ("first_time", "last_time"))
    clock = F.concat(F.lit(CAPTURED), F.date_format(begin, "dd.MM.yyyy, HH:mm"), F.lit("–"), F.date_format(end, "HH:mm"), F.lit(CLOCK))
    captured = F.coalesce(clock, F.concat(F.lit(CAPTURED), "first_time"), F.lit(""))
    place = F.concat(decimal_comma_grouped(F.col("mean_lat"), 4), F.lit(NORTH), decimal_comma_grouped(F.col("mean_lon"), 4), F.lit(EAST))
    return rows.withColumns({"share_raw": raw, "class_raw": condition_class(raw), "captured_text": captured, "position_text": F.coalesce(place, F.lit(NO_POSITION))})
