"""Sinks that deliver, and photos that come in over time."""

import json
import os
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources_and_streams import jpeg_with_exif

from roadlens.operators import images, sinks
from roadlens.plans import survey
from roadlens.sources import deliveries, photos

RECEIVER = """
    import os, signal

    def receive(row):
        name = row["decision_id"]
        if name.startswith("refused"):
            return 422
        if name.startswith("down"):
            raise OSError("unreachable")
        with open("{folder}/got", "a") as out:
            out.write(name + "\\n")
        if name == "d07" and not os.path.exists("{folder}/died"):
            open("{folder}/died", "w").close()
            {die}
        return 200
"""


@pytest.fixture
def receiver(spark, tmp_path):
    """A receiver of a name of its own that appends ids to a file; ``die`` happens at the eighth row, once."""

    def made(name, die="pass"):
        path = tmp_path / f"{name}.py"
        path.write_text(textwrap.dedent(RECEIVER).format(folder=tmp_path, die=die))
        spark.sparkContext.addPyFile(str(path))
        return f"{name}:receive"

    made.got = lambda: sorted((tmp_path / "got").read_text().split())
    return made


def runs(journal):
    return [json.loads(p.read_text()) for p in sorted((journal / "runs").iterdir(), key=os.path.getmtime)]


def test_each_id_is_delivered_once(spark, tmp_path, receiver):
    names = [f"d{k:02d}" for k in range(20)] + ["refused1", "down1", "d03", "d03"]
    rows = spark.createDataFrame([(n, k, [n, None]) for k, n in enumerate(names)], "decision_id string, value long, list array<string>").repartition(3)
    journal = tmp_path / "journal"
    to = receiver("steady_receiver")
    for _ in range(2):
        deliveries.deliver_once(rows, to, f"file://{journal}", pause=0)
    assert receiver.got() == [f"d{k:02d}" for k in range(20)]
    assert runs(journal) == [{"sent": 20, "known": 0, "failed": 2}, {"sent": 0, "known": 20, "failed": 2}]
    failed = [r for p in (journal / "failed").iterdir() for r in json.loads(p.read_text())["rows"]]
    assert sorted((r["id"], r["status"], r["attempts"]) for r in failed) == [("down1", 0, 2)] * 2 + [("refused1", 422, 1)] * 2


def test_a_killed_task_goes_on_where_it_was(spark, tmp_path, receiver):
    """The worker dies after the receiver had the row and before its mark: that row comes twice, all others once."""
    rows = spark.createDataFrame([(f"d{k:02d}",) for k in range(16)], "decision_id string").repartition(1)
    journal = tmp_path / "journal"
    to = receiver("dying_receiver", "os.kill(os.getpid(), signal.SIGKILL)")
    with pytest.raises(Exception, match="(?i)abort|crash|exit|lost"):
        deliveries.deliver_once(rows, to, f"file://{journal}", pause=0)
    before = receiver.got()
    assert "d07" in before and not (journal / "runs").exists()
    deliveries.deliver_once(rows, to, f"file://{journal}", pause=0)
    assert receiver.got() == sorted([f"d{k:02d}" for k in range(16)] + ["d07"])
    assert runs(journal)[0]["known"] + 1 == len(before)


def test_an_error_of_the_receiver_delivers_each_id_once(spark, tmp_path, receiver):
    """A task that fails between two rows: the next run sends the rest, and nothing twice."""
    rows = spark.createDataFrame([(f"d{k:02d}",) for k in range(16)], "decision_id string").repartition(1)
    path = tmp_path / "journal"
    to = receiver("broken_receiver", 'raise ValueError("broken")')
    with pytest.raises(Exception, match="broken"):
        deliveries.deliver_once(rows.where("decision_id <> 'd07'").unionByName(rows.where("decision_id = 'd07'")), to, f"file://{path}", pause=0)
    deliveries.deliver_once(rows, to, f"file://{path}", pause=0)
    assert [n for n in receiver.got() if n != "d07"] == [f"d{k:02d}" for k in range(16) if k != 7]


def test_rows_without_a_key(spark, tmp_path, receiver):
    rows = spark.createDataFrame([(None, 1), (None, 1), (None, 2)], "decision_id string, v int")
    deliveries.deliver_once(rows, receiver("keyless_receiver"), f"file://{tmp_path}/journal", pause=0)
    assert len(receiver.got()) == 2
    deliveries.deliver_once(rows.limit(0), "keyless_receiver:receive", f"file://{tmp_path}/journal")


SECTIONS = "route_id string, nr int, station_from_m double, share_pct double, damage_m2 double, area_m2 double, photo string"


def test_summaries_leave_by_batch_and_failures_are_logged(spark, tmp_path):
    rows = [("a", 2, 5.0, 9.996, 2.9988, 30.0, "y"), ("a", 1, 0.0, 10.0, 3.0, 30.0, "x"), ("b", 1, 0.0, 0.0, 0.0, 0.0, None)]
    spark.createDataFrame(rows, SECTIONS).coalesce(1).write.parquet(f"{tmp_path}/in")
    routes = spark.createDataFrame([("a", "Straße „A“", "Ort"), ("b", None, None)], "route_id string, title string, place string")
    place = str(tmp_path / "got")

    def send(message):
        if message["route_id"] == "b":
            raise KeyError("any failure")
        with open(place, "a") as out:
            out.write(json.dumps(message | {"rows": json.loads(message["rows"])}) + "\n")
        return 200

    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(SECTIONS).parquet(f"{tmp_path}/in")
        sinks.send_summaries(stream, routes, send, f"{tmp_path}/log", f"{tmp_path}/c").awaitTermination()
    (message,) = [json.loads(line) for line in open(place)]
    assert (message["sections"], message["share_pct"], message["overall_class"], message["title"]) == (2, 10.0, 1, "Straße „A“")
    assert [r["nr"] for r in message["rows"]] == [1, 2] and message["rows"][1] == {"nr": 2, "station_from_m": 5.0, "share_pct": 10.0, "damage_m2": 3.0, "area_m2": 30.0, "photo": "y"}
    log = {r["route_id"]: (r["status"], r["attempts"]) for r in spark.read.parquet(f"{tmp_path}/log").collect()}
    assert log == {"a": (200, 1), "b": (0, 1)}


def test_photos_are_taken_in_once(spark, tmp_path):
    """Two runs over a growing folder: each photo is measured once, only touched streets are evaluated, from all their photos."""
    root, seen = tmp_path / "photos", []

    def add(street, name):
        (root / street).mkdir(parents=True, exist_ok=True)
        (root / street / name).write_bytes(jpeg_with_exif(b"II"))

    def run():
        def evaluate(rows, n):
            seen.append({(r["street"], r["n"]) for r in rows.groupBy("street").agg(F.count("*").alias("n")).collect()})

        query = photos.evaluate_new_photos(spark, str(root), f"{tmp_path}/measures", f"{tmp_path}/c", evaluate)
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    for street, name in (("a", "1.jpg"), ("a", "2.JPG"), ("b", "1.jpeg")):
        add(street, name)
    add("b", "note.txt")
    assert run() == 4 and seen == [{("a", 2), ("b", 1)}]
    add("b", "2.jpg")
    add("c", "1.png")
    assert run() == 2 and seen[1:] == [{("b", 2), ("c", 1)}]
    assert run() == 0 and len(seen) == 2
    table = spark.read.parquet(f"{tmp_path}/measures")
    assert table.count() == table.select("path").distinct().count() == 5 and table.where("f35 = 24").count() == 5


#: What a camera stores for a raster that is [[1, 2, 3], [4, 5, 6]] when upright.
STORED = {1: [[1, 2, 3], [4, 5, 6]], 2: [[3, 2, 1], [6, 5, 4]], 3: [[6, 5, 4], [3, 2, 1]], 4: [[4, 5, 6], [1, 2, 3]], 5: [[1, 4], [2, 5], [3, 6]], 6: [[3, 6], [2, 5], [1, 4]], 7: [[6, 3], [5, 2], [4, 1]], 8: [[4, 1], [5, 2], [6, 3]]}


def test_images_are_turned_upright(spark):
    rows, headers = [], []
    for orientation, raster in [*STORED.items(), (None, STORED[1]), (99, STORED[1])]:
        a = np.array(raster, np.uint8)[..., None].repeat(3, axis=2)
        rows.append(((f"file:///p/{orientation}.jpg", a.shape[0], a.shape[1], 3, 16, bytearray(a.tobytes())),))
        headers.append((f"file:/p/{orientation}.jpg", orientation))
    rows.append((("file:///p/broken.jpg", 5, 5, 3, 16, bytearray(b"x")),))
    headers.append(("file:/p/broken.jpg", 6))
    kind = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
    out = images.oriented(spark.createDataFrame(rows, kind), spark.createDataFrame(headers, "path string, orientation int"))
    got = {r["image"]["origin"]: r["image"] for r in out.collect()}
    assert got.pop("file:///p/broken.jpg")["data"] == b"x" and len(got) == 10
    for image in got.values():
        assert np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], 3)[..., 0].tolist() == [[1, 2, 3], [4, 5, 6]]


def test_report_mail(spark):
    parts = [("r", 7, 2, 1000.0, 1005.5, 41.25, 5, 4.05, 0.15, 48.1, 15.2), ("r", 3, 1, 5.0, 10.0, 33.0, 4, 1.0, 2.0, None, None), ("r", 1, 0, 0.0, 5.0, 1.0, 1, 0.0, 0.0, 1.0, 1.0)]
    sections = spark.createDataFrame(parts, "route_id string, nr int, pos int, station_from_m double, station_to_m double, share_pct double, condition int, longitudinal_m double, transverse_m double, lat double, lon double")
    routes = spark.createDataFrame([("r", "Weg", "Ort", "2026-03-01T10:00:00")], "route_id string, name string, place string, captured string")

    def body(priority):
        decisions = spark.createDataFrame([("r", priority)], "route_id string, priority array<int>")
        return survey.report_mails(decisions, sections, routes, "https://m/?q=", "S").first()["body"]

    seven = "- Abschnitt 07, Station 1 000–1 006 m: 41,3 % Schadanteil (Klasse 5), 4,1 m Längsrisse, 0,2 m Querrisse\n  Karte: https://m/?q=48.100000,15.200000"
    three = "- Abschnitt 03, Station 5–10 m: 33,0 % Schadanteil (Klasse 4), 1,0 m Längsrisse, 2,0 m Querrisse"
    assert "„Weg“ (Ort) am 01.03.2026 wurden" in body([7, 99]) and f":\n\n{seven}\n\nWir" in body([7, 99])
    assert f"\n\n{seven}\n{three}\n\n" in body([7, 3]) and f"\n\n{three}\n{seven}\n\n" in body([]) == body(None)
