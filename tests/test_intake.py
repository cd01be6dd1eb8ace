"""What is chosen, ordered and matched, with nulls, ties and empty tables."""

import pytest

from roadlens.operators import intake, kpis


def test_accepted_files_fill_the_room(spark):
    rows = [("a", 1, "x.txt", "image/png"), ("a", 2, "y.HEIC", None), ("a", 3, "z.txt", None), ("a", 4, None, "image/jpeg"), ("a", 5, "w.jpg", "text/plain"), ("b", 1, "v.jpg\n", None), ("b", 2, None, None)]
    files = spark.createDataFrame(rows, "up string, k int, name string, type string")
    got = {(r["up"], r["k"], r["place"]) for r in intake.accepted_files(files, "up", ["k"], 3).collect()}
    assert got == {("a", 1, 1), ("a", 2, 2), ("a", 4, 3)}
    assert intake.accepted_files(files, "up", ["k"]).count() == 4 and intake.accepted_files(files.limit(0), "up", ["k"]).count() == 0


def test_set_apart(spark):
    photos = spark.createDataFrame([("A.jpg", 1), ("b.JPG", 2), ("c.jpg", 3), (None, 4)], "name string, k int")
    names = spark.createDataFrame([("a.JPG",), ("B.jpg",), ("B.JPG",), (None,)], "name string")
    assert {(r["k"], r["excluded"]) for r in intake.set_apart(photos, names).collect()} == {(1, True), (2, True), (3, False), (4, False)}
    assert intake.set_apart(photos, names.limit(0)).where("excluded").isEmpty()


def test_places_and_numbers(spark):
    rows = spark.createDataFrame([("r", 0, 1.0), ("r", 3, None), ("r", 4, 2.0), ("q", 9, None)], "route_id string, pos int, v double")
    assert [(r["pos"], r["number"], r["from_m"], r["to_m"]) for r in intake.numbered_sections(rows, 5.005, 4, 5).where("route_id = 'r'").orderBy("pos").collect()] == [(0, 1, 4.0, 9.0), (3, 2, 9.0, 14.0), (4, 3, 14.01, 19.01)]
    assert [(r["pos"], r["last_v"]) for r in intake.last_known(rows, "route_id", "pos", "v").orderBy("route_id", "pos").collect()] == [(9, None), (0, 1.0), (3, 1.0), (4, 2.0)]
    assert {(r["route_id"], r["pos"]) for r in intake.last_rows(rows, "route_id", "pos", 2).collect()} == {("r", 3), ("r", 4), ("q", 9)}
    other = spark.createDataFrame([("r", 7, "x"), ("r", 8, "y"), ("q", 1, "z"), ("q", 2, "over")], "route_id string, pos int, w string")
    assert {(r["route_id"], r["pos"], r["w"]) for r in intake.zipped(rows, other, "route_id", "pos").collect()} == {("r", 0, "x"), ("r", 3, "y"), ("r", 4, None), ("q", 9, "z")}
    twice = spark.createDataFrame([("r", 1), ("r", 1), ("q", 1), ("p", None), ("p", None)], "route_id string, nr int")
    assert [r["route_id"] for r in intake.repeated_numbers(twice).collect()] == ["r"]


def test_report_summary(spark):
    kind = "route_id string, area_m2 double, damage_m2 double, net_m2 double, patch_m2 double, longitudinal_m double, transverse_m double, time string, lat double, lon double, condition int"
    row = lambda route, time, lat, area=10.0: (route, area, 1.0, 0.0, 0.0, 0.5, 0.25, time, lat, None if lat is None else 15.5, 2)
    rows = [row("a", "2026:10:01 08:10:44", 48.25), row("a", "2026:10:01 09:05:00", None), row("b", "gestern", None, 0.0), row("b", "", None, 0.0), row("c", None, 1000.5)]
    got = {r["route_id"]: r for r in kpis.report_summary(spark.createDataFrame(rows, kind), "route_id").collect()}
    assert got["a"]["captured_text"] == "Aufnahme 01.10.2026, 08:10–09:05 Uhr" and got["a"]["position_text"] == "48,2500° N · 15,5000° O"
    assert got["b"]["captured_text"] == "Aufnahme gestern" and got["b"]["position_text"] == "ohne GPS" and got["b"]["share_raw"] == 0.0
    assert got["c"]["captured_text"] == "" and got["c"]["position_text"] == "1.000,5000° N · 15,5000° O"
    assert (got["a"]["share_raw"], got["a"]["class_raw"], got["a"]["without_gps"], got["a"]["class_2"]) == (pytest.approx(10.0), 2, 1, 2)
    assert kpis.report_summary(spark.createDataFrame(rows, kind)).first()["sections"] == 5
