"""The whole way of survey documents: texts to routes, indicators, decisions and export rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions.scalar import local_number, map_link, padded
from roadlens.operators import decide, kpis
from roadlens.operators.validate import Origins, validate_routes

NO_PROPOSALS = "route_id string, course string, text string, step string, priority array<int>"


# The text of a report to the road authority.
MAIL_SUBJECT = ("Straßenschaden ", ": Bitte um Begutachtung")
MAIL_HEAD = ("Sehr geehrte Damen und Herren,\n\nbei der Zustandsaufnahme der Strecke „", "“", " am ", " wurden folgende Abschnitte als vordringlich eingestuft:\n\n")
MAIL_SECTION = ("- Abschnitt ", ", Station ", " m: ", " % Schadanteil (Klasse ", "), ", " m Längsrisse, ", " m Querrisse", "\n  Karte: ")
MAIL_END = "\n\nWir bitten um Begutachtung vor Ort und Rückmeldung zu möglichen Maßnahmen.\n\nHinweis: Automatische Auswertung mit {}, Werte etwa ±10 %.\n\nMit freundlichen Grüßen"
MAIL_CLASS = 4


@dataclass
class Survey:
    """Results of an evaluation, all lazy: routes, sections, indicators, decisions, export rows, quarantine."""

    routes: DataFrame
    sections: DataFrame
    kpis: DataFrame
    decisions: DataFrame
    export: DataFrame
    quarantine: DataFrame


def evaluate(raw: DataFrame, origins: Origins, link_prefix: str, proposals: DataFrame | None = None, sent_at: str = "") -> Survey:
    """Evaluate documents (doc, json).  ``proposals`` (route_id, course, text, step, priority) may tighten decisions.

    Sections are shuffled by document for validation; everything after works on aggregates.
    """
    routes, sections, quarantine = validate_routes(raw, origins)
    rejected = routes.select("route_id", F.size("rejected_photos").cast("long").alias("rejected"))
    indicators = kpis.route_kpis(sections, rejected)
    ruled = decide.rule_decision(decide.disposition(indicators), sections, kpis.priorities(sections))
    if proposals is None:
        proposals = raw.sparkSession.createDataFrame([], NO_PROPOSALS)
    decisions = decide.enriched(decide.merge_proposals(ruled, proposals, sections))
    named = routes.select("route_id", "name", "place", "captured", "simulated", F.lit(sent_at).alias("sent_at"))
    return Survey(routes, sections, indicators, decisions, decide.export_rows(decisions, sections, named, link_prefix), quarantine)


def reminders(decisions: DataFrame, routes: DataFrame) -> DataFrame:
    """(route_id, event): a calendar event twelve months after capture for each route that is only observed."""
    from roadlens.functions.scalar import due_date

    rows = decisions.where("decision = 'beobachten'").join(routes.select("route_id", "name", "captured"), "route_id")
    due = F.date_format(due_date(F.to_date(F.try_to_timestamp("captured")), F.current_date()), "yyyyMMdd")
    lines = ["BEGIN:VCALENDAR", "VERSION:2.0", "BEGIN:VEVENT", F.concat(F.lit("UID:"), "decision_id"), F.concat(F.lit("DTSTART;VALUE=DATE:"), due), F.concat(F.lit("SUMMARY:"), "name"), "END:VEVENT", "END:VCALENDAR"]
    return rows.select("route_id", F.concat_ws("\r\n", *[F.lit(x) if isinstance(x, str) else x for x in lines]).alias("event"))


def report_mails(decisions: DataFrame, sections: DataFrame, routes: DataFrame, link_prefix: str, software: str) -> DataFrame:
    """(route_id, subject, body) of the report for each decision: its priority sections in their order, else those of
    class 4 or worse in station order.  ``decisions`` has route_id, priority; ``routes`` route_id, name, place, captured.

    Numbers of sections that the route lacks are passed over; without a place or a readable date these stay out.
    """
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    a = MAIL_SECTION
    link = map_link(F.col("lat"), F.col("lon"), link_prefix)
    station = text(local_number(F.col("station_from_m"), 0), "–", local_number(F.col("station_to_m"), 0))
    line = text(
        a[0], padded(F.col("nr")), a[1], station, a[2], local_number(F.col("share_pct")), a[3], F.col("condition").cast("string"), a[4],
        local_number(F.col("longitudinal_m")), a[5], local_number(F.col("transverse_m")), a[6], F.when(link == "", "").otherwise(text(a[7], link)),
    )
    chosen = decisions.select("route_id", "priority")
    rows = sections.join(chosen, "route_id")
    named = F.size(F.coalesce("priority", F.array().cast("array<int>"))) > 0
    at = F.array_position("priority", F.col("nr").cast("int"))
    rows = rows.where(F.when(named, at > 0).otherwise(F.col("condition") >= MAIL_CLASS))
    order = F.struct(F.when(named, at).otherwise(0).alias("at"), "station_from_m", "pos", line.alias("t"))
    lines = rows.groupBy("route_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["t"]), "\n").alias("lines"))
    day = F.coalesce(F.date_format(F.try_to_timestamp("captured"), "dd.MM.yyyy"), F.lit(""))
    place = F.when(F.coalesce("place", F.lit("")) == "", "").otherwise(text(" (", F.col("place"), ")"))
    h = MAIL_HEAD
    body = text(h[0], F.col("name"), h[1], place, h[2], day, h[3], F.coalesce("lines", F.lit("")), MAIL_END.format(software))
    return chosen.join(routes, "route_id").join(lines, "route_id", "left").select("route_id", text(MAIL_SUBJECT[0], F.col("name"), MAIL_SUBJECT[1]).alias("subject"), body.alias("body"))
