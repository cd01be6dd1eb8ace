"""Chat histories, uploads and result translation: ordered text work as windows and array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlens.functions.scalar import CONTROL, clamped, exif_time, full_match, lenient_number, py_round

# Limits of histories and uploads.
LAST_TURNS, USER_CHARS, ASSISTANT_CHARS = 12, 600, 2000
MIN_PHOTOS, MAX_PHOTOS, MAX_PHOTO_BYTES, MAX_PIXELS = 2, 25, 30_000_000, 120_000_000
PHOTO_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".heif")


def chat_history(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, turn, role, text) to (histories (conv_id, place, role, text), rejected (conv_id, error)).

    The last LAST_TURNS count.  A null text or a role other than user and assistant rejects a conversation;
    blank turns go, neighbours of one role become one, turns before the first user turn go.  The last turn
    must be the user's, and its raw text not longer than USER_CHARS.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    from_end = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    rows = turns.withColumn("back", F.row_number().over(from_end)).where(F.col("back") <= LAST_TURNS)
    clean = F.regexp_replace(F.regexp_replace("text", CONTROL, ""), r"(?U)^\s+|\s+$", "")
    limit = F.when(F.col("role") == "user", USER_CHARS).otherwise(ASSISTANT_CHARS)
    rows = rows.withColumn("clean", clean).withColumn("cut", F.substring(F.col("clean"), F.lit(1), limit))
    wrong = ~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)) | F.col("text").isNull()
    whole = rows.groupBy("conv_id").agg(F.max(wrong).alias("wrong"), F.max(F.when(F.col("back") == 1, F.length("text"))).alias("last_length"))
    some = rows.where(~wrong & (F.col("clean") != ""))
    island = F.sum(F.when(F.lag("role").over(by_turn) == F.col("role"), 0).otherwise(1)).over(by_turn.rowsBetween(Window.unboundedPreceding, 0))
    some = some.withColumn("island", island)
    joined = some.groupBy("conv_id", "island").agg(
        F.first("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "cut"))), lambda t: t["cut"]), "\n").alias("text")
    )
    joined = joined.where((F.col("island") > 1) | (F.col("role") == "user"))
    ends = joined.groupBy("conv_id").agg(F.max_by("role", "island").alias("last_role"))
    state = whole.join(ends, "conv_id", "left").select(
        "conv_id",
        F.when(F.col("wrong"), "invalid").when(F.col("last_role").isNull() | (F.col("last_role") != "user"), "no_question").when(F.col("last_length") > USER_CHARS, "too_long").alias("error"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("island"))
    good = joined.join(state.where("error is null"), "conv_id", "left_semi").select("conv_id", place.alias("place"), "role", "text")
    return good, state.where("error is not null")


def phone_meta(m: DataFrame) -> DataFrame:
    """Metadata from a phone (lat, lon, accuracy, time, f35, model) without what is not credible."""
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    ok = F.coalesce(ok, F.lit(False))
    accuracy = F.when(ok & (F.col("accuracy") > 0) & (F.col("accuracy") < 10_000), F.col("accuracy"))
    model = F.substring(F.regexp_replace("model", r"(?U)[^\w .,()+-]", ""), 1, 40)
    return m.withColumns({
        "lat": F.when(ok, F.col("lat")), "lon": F.when(ok, F.col("lon")), "accuracy": accuracy, "time": F.when(full_match(F.col("time"), r"\d{4}:\d\d:\d\d \d\d:\d\d:\d\d"), F.col("time")),
        "f35": F.when(F.col("f35").between(10, 300), F.floor("f35").cast("int")), "model": model,
    })


def merged_exif(photo: str = "exif", phone: str = "phone") -> list[Column]:
    """The photo's own values first; a position only as a whole."""
    a, b = (lambda c: F.col(f"{photo}.{c}")), (lambda c: F.col(f"{phone}.{c}"))
    own = a("lat").isNotNull() & a("lon").isNotNull()
    place = [F.when(own, a(c)).otherwise(b(c)).alias(c) for c in ("lat", "lon", "accuracy")]
    return place + [F.coalesce(F.nullif(a(c), F.lit("")), b(c)).alias(c) for c in ("time", "model")] + [F.coalesce(a("f35"), b("f35")).alias("f35")]


def upload_errors(files: DataFrame) -> DataFrame:
    """Uploads: files (upload_id, bytes, pixels, width_text) to (upload_id, photos, width, error)."""
    width = F.try_cast(F.replace(F.max("width_text"), F.lit(","), F.lit(".")), "double") if hasattr(F, "try_cast") else F.replace(F.max("width_text"), F.lit(","), F.lit(".")).try_cast("double")
    rows = files.groupBy("upload_id").agg(
        F.count("*").alias("photos"), width.alias("width"), F.max("width_text").alias("given"), F.min("bytes").alias("least"), F.max("bytes").alias("most"), F.max("pixels").alias("pixels")
    )
    error = (
        F.when(F.col("photos") < MIN_PHOTOS, "too_few").when(F.col("photos") > MAX_PHOTOS, "too_many").when(F.col("least") <= 0, "empty_photo").when(F.col("most") > MAX_PHOTO_BYTES, "photo_bytes")
        .when(F.col("pixels") > MAX_PIXELS, "photo_pixels").when((F.col("given") != "") & (F.col("width").isNull() | ~F.col("width").between(2, 20)), "width")
    )
    return rows.select("upload_id", "photos", "width", error.alias("error"))


def safe_name(name: Column, place: Column) -> Column:
    """NN_stem.suffix: letters, digits, _ and - only, 40 characters of the stem; other suffixes become .jpg."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    stem = F.substring(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[^A-Za-z0-9_-]", "_"), 1, 40)
    kind = F.when(suffix.isin(*PHOTO_SUFFIXES), suffix).otherwise(F.lit(".jpg"))
    return F.concat(F.lpad(place.cast("string"), 2, "0"), F.lit("_"), stem, kind)


def translated(raw: DataFrame, images: DataFrame, base: Column) -> DataFrame:
    """Raw measurements (route_id, pos, photo, width, ...) as sections: names, rounding, clamps, links.

    ``images`` (route_id, file) lists the images that exist; links to others are null.
    """
    from roadlens.operators.kpis import upper_median

    width = raw.groupBy("route_id").agg(upper_median(lenient_number(F.col("width"), F.lit(0.0)), 5.0).alias("route_width"))
    rows = raw.join(width, "route_id")
    n = lambda c, d=0.0: lenient_number(F.col(c), F.lit(d))
    area = F.coalesce(F.nullif(n("area"), F.lit(0.0)), F.col("route_width") * 5)
    own = F.coalesce(F.col("calibration") == "eigen", F.lit(False))
    rows = rows.withColumns({
        "nr": F.coalesce(F.nullif(F.col("nr"), F.lit(0)), F.col("pos") + 1).cast("int"), "station_from_m": n("from_m"), "station_to_m": lenient_number(F.col("to_m"), n("from_m") + 5),
        "longitudinal_m": py_round(n("longitudinal"), 2), "transverse_m": py_round(n("transverse"), 2), "net_m2": py_round(n("net"), 3), "patch_m2": py_round(n("patch"), 3),
        "damage_m2": py_round(n("damage"), 3), "area_m2": F.nullif(py_round(area, 3), F.lit(0.0)), "share_pct": py_round(clamped(n("share")), 2),
        "quality": F.when(own, "gut").otherwise("maessig"), "file": F.concat("photo", F.lit("_foto.jpg")),
    })
    rows = rows.join(images.withColumn("have", F.lit(True)), ["route_id", "file"], "left")
    link = F.when(F.col("have"), F.concat(base, F.lit("/bilder/"), F.col("file")))
    return rows.select(
        "route_id", "pos", "nr", "station_from_m", "station_to_m", "longitudinal_m", "transverse_m", "net_m2", "patch_m2", "damage_m2", "area_m2", "share_pct",
        F.regexp_replace("photo", r"^\d{2}_", "").alias("photo"), "quality", link.alias("image"), py_round(F.col("route_width"), 2).alias("route_width"),
    )


def capture_time(raw: DataFrame) -> DataFrame:
    """(route_id, captured): the smallest non-empty time as ISO text; empty if that is no time."""
    return raw.groupBy("route_id").agg(exif_time(F.min(F.nullif(F.col("time"), F.lit("")))).alias("captured"))


def progress(lines: DataFrame) -> DataFrame:
    """Log lines (job, ord, line) with the number of photos done so far."""
    from roadlens.functions.scalar import progress_of

    done = F.sum(progress_of(F.col("line"))["done"].cast("long")).over(Window.partitionBy("job").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("done", done)
