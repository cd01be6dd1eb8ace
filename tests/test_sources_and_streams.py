import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.operators import images, signals
from roadlens.sources import photos, routes
from roadlens.streaming import events


def jpeg_with_exif(order, lat=48.466911, lon=-15.658644, south=False):
    e = "<" if order == b"II" else ">"
    base = bytearray(order + struct.pack(e + "HI", 42, 8) + b"\0" * 600)
    free = [200]

    def put(data):
        at = free[0]
        base[at : at + len(data)] = data
        free[0] += len(data) + len(data) % 2
        return at

    def entry(tag, kind, count, value):
        return struct.pack(e + "HHI", tag, kind, count) + (value if isinstance(value, bytes) else struct.pack(e + "I", value)).ljust(4, b"\0")

    def table(at, rows):
        data = struct.pack(e + "H", len(rows)) + b"".join(rows) + b"\0" * 4
        base[at : at + len(data)] = data

    def degrees(x):
        x = abs(x)
        d, m = int(x), int((x - int(x)) * 60)
        s = round((x - d - m / 60) * 3600 * 10000)
        return put(struct.pack(e + "6I", d, 1, m, 1, s, 10000))

    time, model = b"2026:10:01 08:10:44\0", b"Phone 12\0"
    gps = [entry(1, 2, 2, b"S\0" if south else b"N\0"), entry(2, 5, 3, degrees(lat)), entry(3, 2, 2, b"W\0" if lon < 0 else b"E\0"), entry(4, 5, 3, degrees(lon)), entry(31, 5, 1, put(struct.pack(e + "2I", 450, 100)))]
    table(8, [entry(0x0110, 2, len(model), put(model)), entry(0x8769, 4, 1, 80), entry(0x8825, 4, 1, 120)])
    table(80, [entry(0x9003, 2, len(time), put(time)), entry(0xA405, 3, 1, struct.pack(e + "H", 24))])
    table(120, gps)
    body = b"Exif\0\0" + bytes(base)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\0"


@pytest.mark.parametrize("order", [b"II", b"MM"])
def test_exif_in_both_byte_orders(order):
    got = photos.exif_of(jpeg_with_exif(order, south=True))
    assert got["time"] == "2026:10:01 08:10:44" and got["model"] == "Phone 12" and got["f35"] == 24 and got["accuracy"] == 4.5
    assert got["lat"] == pytest.approx(-48.466911, abs=1e-6) and got["lon"] == pytest.approx(-15.658644, abs=1e-6)
    assert "lat" not in photos.exif_of(jpeg_with_exif(order, 0.0, 0.0))


@pytest.mark.parametrize("data", [b"", b"\xff\xd8", b"GIF89a", b"\xff\xd8\xff\xe1\0\x20Exif\0\0II*\0\xff\xff\xff\xff", b"\xff\xd8" + b"\0" * 50])
def test_broken_headers_give_nothing(data):
    assert photos.exif_of(data) in ({}, {"model": None, "time": None, "f35": None, "orientation": None})


def test_photo_folder(spark, tmp_path):
    for street, name in (("a", "2.JPG"), ("a", "1.jpg"), ("b", "x.jpeg"), ("b", "note.txt")):
        (tmp_path / street).mkdir(exist_ok=True)
        (tmp_path / street / name).write_bytes(jpeg_with_exif(b"II"))
    files = photos.photo_files(spark, str(tmp_path), content=True)
    assert {(r["street"], r["file"]) for r in files.collect()} == {("a", "2.JPG"), ("a", "1.jpg"), ("b", "x.jpeg")}
    meta = photos.read_exif(files)
    assert meta.where("f35 = 24 and accuracy = 4.5").count() == 3
    ordered = photos.in_order(files.drop("content").join(meta, "path")).where("street = 'a'").orderBy("place")
    assert [r["file"] for r in ordered.collect()] == ["1.jpg", "2.JPG"]
    reports = spark.createDataFrame([("a", "2999-01-01 00:00:00"), ("b", "1999-01-01 00:00:00")], "street string, t string").select("street", F.to_timestamp("t").alias("reported"))
    assert [r["street"] for r in photos.stale_streets(files, reports).collect()] == ["b"]


def test_street_folders(spark, tmp_path):
    for street in ("a", "b"):
        (tmp_path / street).mkdir()
    names = lambda paths: [p.rsplit("/", 1)[1] for p in paths]
    assert names(photos.street_folders(spark, str(tmp_path))) == ["a", "b"]
    assert names(photos.street_folders(spark, str(tmp_path), "b")) == ["b"] and names(photos.street_folders(spark, "/nowhere", str(tmp_path / "a"))) == ["a"]
    for root, named in ((str(tmp_path), "c"), (str(tmp_path / "a"), None), (str(tmp_path / "none"), None)):
        with pytest.raises(FileNotFoundError):
            photos.street_folders(spark, root, named)


def test_json_sources(spark, tmp_path):
    doc = {"titel": "t", "abschnitte": [{"datei": "p", "nr": 1, "von": 4.0, "bis": 9.0, "schadanteil": 7.5}], "nicht_ausgewertet": [["x.jpg", "dark"], {"foto": "y.jpg", "grund": "blurred"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    items, bad = routes.raw_results(spark, str(tmp_path / "a.json"))
    assert items.first()["share"] == 7.5
    assert {(r["photo"], r["reason"]) for r in bad.collect()} == {("x.jpg", "dark"), ("y.jpg", "blurred")}
    assert routes.route_texts(spark, str(tmp_path)).count() == 1
    assert routes.existing(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]) == [str(tmp_path / "a.json")]


def test_photo_measures(spark):
    dark, sharp = np.full((40, 40, 3), 20, np.uint8), np.zeros((40, 40, 3), np.uint8)
    sharp[::2] = 220
    kind = "struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
    rows = spark.createDataFrame([(("d", 40, 40, 3, 16, bytearray(dark.tobytes())),), (("s", 40, 40, 3, 16, bytearray(sharp.tobytes())),), (("b", 9, 9, 3, 16, bytearray(b"x")),)], f"image {kind}")
    out = {r["path"]: r for r in images.photo_measures(rows).withColumn("hints", signals.photo_hints(F.col("mean"), F.col("glare"), F.col("sharpness"))).collect()}
    assert out["d"]["hints"] == ["dark", "blurred"] and out["s"]["hints"] == [] and out["b"]["error"] is not None


def run_stream(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams(spark, tmp_path):
    path = str(tmp_path / "ts")
    spark.createDataFrame([("a", "2026-01-01 00:00:00", 1), ("a", "2026-01-01 00:00:05", 2), ("b", "2026-01-01 00:00:01", 3)], "key string, s string, v int").select("key", F.to_timestamp("s").alias("ts"), "v").coalesce(1).write.parquet(path)
    stream = lambda: spark.readStream.schema("key string, ts timestamp, v int").parquet(path)
    assert {r["key"] for r in run_stream(spark, events.first_deliveries_stream(stream()), "firsts").collect()} == {"a", "b"}
    assert {(r["key"], r["v"]) for r in run_stream(spark, events.latest_position_stream(stream()), "latest", "complete").collect()} == {("a", 2), ("b", 3)}
