"""Rules that route a survey to one of four courses of action, proposals that may tighten them, export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions.scalar import DECIDED_BY, clean_text, counted, decimal_comma, map_link, padded, short_number
from roadlens.operators.kpis import usable

# Courses with their severity, title and short text, and the texts of decisions.
COURSES = (
    ("neu_aufnehmen", 0, "Bitte neu aufnehmen", "Die Fotos reichen für eine sichere Bewertung nicht aus"),
    ("beobachten", 1, "Kein Handlungsbedarf", "Beobachten und in 12 Monaten erneut befahren"),
    ("sanierung_planen", 2, "Sanierung einplanen", "Abschnitte für die nächste Bausaison vormerken"),
    ("dringend_melden", 3, "Zeitnah handeln", "Schlechte Abschnitte an die Straßenmeisterei melden"),
)
NEXT_STEPS = {
    "neu_aufnehmen": "Strecke bei gleichmäßigem Licht erneut fotografieren, Abstand ca. 5 m, Kamera auf Augenhöhe.",
    "beobachten": "Wiederholungsbefahrung in 12 Monaten einplanen.",
    "sanierung_planen": "Abschnitte in die Sanierungsliste für die nächste Bausaison aufnehmen.",
    "dringend_melden": "Abschnitte vor Ort begutachten und an die Straßenmeisterei melden.",
}
REASONS = {
    "neu_aufnehmen": "%s %% der Fotos sind nicht auswertbar.",
    "dringend_melden": "%s in Klasse 4 oder schlechter.",
    "sanierung_planen": "%s in Klasse 3, keiner schlechter.",
    "beobachten": "Alle Abschnitte in Klasse 1 oder 2.",
}
LIES = ("Abschnitt liegt", "Abschnitte liegen")
RULE_TEXTS = {
    "unsure": "%s Eine Bewertung wäre unsicher.",
    "acting": "%s Am stärksten betroffen ist Abschnitt %s (Station %s–%s m) mit %s %%.",
    "calm": "Der Schadanteil liegt bei %s %%, kein Abschnitt erreicht Klasse 3. Ein Eingriff ist derzeit nicht nötig.",
}
NOTES = {
    "offline": "Offline-Modus: Entscheidung nach Regeln, ohne KI.",
    "invalid": "KI-Antwort ungültig. Entscheidung nach Regeln.",
    "error": "KI nicht erreichbar (%s). Entscheidung nach Regeln.",
    "overruled": "Die KI schlug „%s“ vor. Die Messwerte verlangen mindestens „%s“, daher gilt die strengere Einstufung.",
}
ROUTE_TEXT_COLUMNS = "Abschnitte (Nr | Station | Schadanteil | Klasse | Längsrisse m | Querrisse m | Netzrisse m² | Flicken m² | Bildqualität | Foto):"
REJECTED_HEAD, LIMITS_HEAD = "Fotos, die nicht ausgewertet werden konnten:", "Bekannte Grenzen der Auswertung:"
CLASSES_LINE = "Klassen nach Projektvorgabe: 1 <10 %, 2 <20 %, 3 <30 %, 4 <40 %, 5 ab 40 % Schadanteil."
RE_RECORD_SHARE, PLAN_SHARE = 0.3, 20.0


def _by_course(course: Column, values: dict[str, object]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), course)


def severity(course: Column) -> Column:
    return F.when(course.isin(*[c[0] for c in COURSES]), _by_course(course, {c[0]: c[1] for c in COURSES}))


def disposition(kpis: DataFrame) -> DataFrame:
    """The least course for each route, in this order of tests, and its reason."""
    redo = (F.col("usable") == 0) | (F.col("unusable_share") >= RE_RECORD_SHARE)
    plan = (F.col("worst_class") == 3) | (F.col("share_pct") >= PLAN_SHARE)
    rule = F.when(redo, "neu_aufnehmen").when(F.col("worst_class") >= 4, "dringend_melden").when(plan, "sanierung_planen").otherwise("beobachten")
    about = {
        "neu_aufnehmen": F.bround(F.col("unusable_share") * 100).cast("long").cast("string"),
        "dringend_melden": counted(F.col("class_4") + F.col("class_5"), *LIES),
        "sanierung_planen": counted(F.col("class_3"), *LIES),
    }
    reason = F.lit(REASONS["beobachten"])
    for course, value in about.items():
        reason = F.when(F.col("rule") == course, F.format_string(REASONS[course], value)).otherwise(reason)
    return kpis.withColumn("rule", rule).withColumn("reason", reason)


def rule_decision(ruled: DataFrame, sections: DataFrame, priority: DataFrame) -> DataFrame:
    """Reason text, next step and priorities of the rule's course."""
    worst = sections.select("route_id", F.col("nr").alias("worst_nr"), F.col("station_from_m").alias("w_from"), F.col("station_to_m").alias("w_to"), F.col("share_pct").alias("w_share"))
    rows = ruled.join(worst, ["route_id", "worst_nr"], "left").join(priority, "route_id", "left")
    acts = F.col("rule").isin("dringend_melden", "sanierung_planen")
    acting = F.format_string(RULE_TEXTS["acting"], F.col("reason"), padded(F.col("worst_nr")), short_number(F.col("w_from")), short_number(F.col("w_to")), decimal_comma(F.col("w_share").cast("double")))
    calm = F.format_string(RULE_TEXTS["calm"], decimal_comma(F.col("share_pct")))
    text = F.when(F.col("rule") == "neu_aufnehmen", F.format_string(RULE_TEXTS["unsure"], F.col("reason"))).when(acts, acting).otherwise(calm)
    none = F.array().cast(priority.schema["priority"].dataType)
    return rows.withColumn("rule_text", text).withColumn("rule_step", _by_course(F.col("rule"), NEXT_STEPS)).withColumn(
        "rule_priority", F.when(acts, F.coalesce("priority", none)).otherwise(none)
    ).drop("w_from", "w_to", "w_share", "priority")


def merge_proposals(decided: DataFrame, proposals: DataFrame, sections: DataFrame) -> DataFrame:
    """Proposals (route_id, course, text, step, priority[, error]) may tighten a rule's course and never relax it.

    A route that must be recorded again takes no proposal.  Priorities are kept in order where the route has
    such a section, five at most; absent ones are none.  ``note`` says why a proposal did not count: there is
    none, it failed (``error``), its course is unknown, or the rule is stricter.
    """
    if "error" not in proposals.columns:
        proposals = proposals.withColumn("error", F.lit(None).cast("string"))
    proposals = proposals.withColumn("proposed", F.lit(True))
    numbers = sections.groupBy("route_id").agg(F.collect_set("nr").alias("numbers"))
    rows = decided.join(proposals.withColumnsRenamed({"text": "p_text", "step": "p_step", "priority": "p_priority", "error": "p_error"}), "route_id", "left").join(numbers, "route_id", "left")
    judged = F.col("rule") != "neu_aufnehmen"
    valid = severity(F.col("course")).isNotNull() & judged & F.col("p_error").isNull()
    redo = F.col("course") == "neu_aufnehmen"
    milder = redo | (severity(F.col("course")) < severity(F.col("rule")))
    overruled = valid & (F.col("course") != F.col("rule")) & milder & ~(redo & (F.col("unusable_share") > 0))
    named = F.slice(F.filter(F.coalesce("p_priority", F.array().cast(proposals.schema["priority"].dataType)), lambda n: F.array_contains("numbers", n)), 1, 5)
    own = valid & ~overruled
    text = F.when(own, clean_text(F.col("p_text"), 600)).otherwise(F.col("rule_text"))
    titles = {c[0]: c[2] for c in COURSES}
    note = (
        F.when(~judged, "")
        .when(F.col("proposed").isNull(), NOTES["offline"])
        .when(F.col("p_error").isNotNull(), F.format_string(NOTES["error"], F.col("p_error")))
        .when(~valid, NOTES["invalid"])
        .when(overruled, F.format_string(NOTES["overruled"], _by_course(F.col("course"), titles), _by_course(F.col("rule"), titles)))
        .otherwise("")
    )
    return rows.withColumns({
        "decision": F.when(own, F.col("course")).otherwise(F.col("rule")),
        "decided_by": F.when(~F.coalesce(valid, F.lit(False)), "regel").when(overruled, "ki+regel").otherwise("ki"),
        "decision_text": F.when(F.coalesce(text, F.lit("")) == "", F.col("rule_text")).otherwise(text),
        "next_step": F.when(own, clean_text(F.col("p_step"), 300)).otherwise(F.col("rule_step")),
        "priority": F.when(own, named).when(overruled & (F.size("rule_priority") == 0), named).otherwise(F.col("rule_priority")),
        "note": note,
    }).drop("course", "p_text", "p_step", "p_priority", "p_error", "proposed", "numbers")


def course_table(spark) -> DataFrame:
    return spark.createDataFrame(COURSES, "decision string, severity int, title string, short string")


def enriched(decided: DataFrame) -> DataFrame:
    """Title and short text from the courses (four rows), and an id made of the decision itself."""
    named = decided.join(F.broadcast(course_table(decided.sparkSession)), "decision", "left")
    code = F.concat_ws("|", F.col("route_id").cast("string"), "decision", "decided_by", "decision_text", "next_step", F.to_json("priority"))
    return named.withColumn("decision_id", F.substring(F.sha2(code.cast("binary"), 256), 1, 12))


def fingerprint(payload: Column, secret: str) -> Column:
    """HMAC-SHA256 of a text, from its definition: two keyed digests.

    Column only: the padded keys are constants of the plan, hexadecimal digests are decoded between.
    """
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), payload.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def decision_payload(route: Column) -> Column:
    """What a decision's fingerprint covers: its six fields and the route, as JSON with sorted keys.

    ``route`` is the route's own JSON text with sorted keys.
    """
    quoted = lambda c: F.coalesce(F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)"), F.lit("null"))
    numbers = F.concat(F.lit("["), F.array_join(F.col("priority").cast("array<string>"), ", "), F.lit("]"))
    fields = [("begruendung", quoted("decision_text")), ("entscheidung_id", quoted("decision_id")), ("naechster_schritt", quoted("next_step")), ("prioritaet_abschnitte", F.coalesce(numbers, F.lit("null"))), ("quelle", quoted("decided_by")), ("route", quoted("decision"))]
    parts = [F.concat(F.lit(f'"{name}": '), value) for name, value in fields]
    return F.concat(F.lit('{"e": {'), F.concat_ws(", ", *parts), F.lit('}, "s": '), route, F.lit("}"))


def confirmed(payload: Column, code: Column, secret: str) -> Column:
    """Whether ``code`` is the payload's fingerprint; an absent one is not."""
    return F.coalesce(fingerprint(payload, secret) == code, F.lit(False))


def route_text(routes: DataFrame, sections: DataFrame, kpis: DataFrame) -> DataFrame:
    """(route_id, t): a route, its sections in order, rejected photos and limits as one plain text.

    ``routes`` has route_id, name, place, captured, simulated, method, width_m, rejected_photos (photo, reason)
    and limitations; ``sections`` may have a ``note``.
    """
    de = lambda c, n=1: decimal_comma(F.col(c).cast("double"), n)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    station = text(short_number(F.col("station_from_m")), "–", short_number(F.col("station_to_m")), " m")
    one = F.concat_ws(
        " | ", padded(F.col("nr")), station, text(de("share_pct"), " %"), F.col("condition").cast("string"), de("longitudinal_m"), de("transverse_m"),
        de("net_m2", 2), de("patch_m2", 2), "quality", F.coalesce("photo", F.lit("")),
        *([F.when(F.col("note") != "", text("Hinweis: ", F.col("note")))] if "note" in sections.columns else []),
    )
    ordered = F.array_sort(F.collect_list(F.struct("station_from_m", "pos", one.alias("t"))))
    body = sections.groupBy("route_id").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "\n").alias("body"))
    own = ["route_id", "name", "place", "captured", "simulated", "method", "width_m", "rejected_photos", "limitations"]
    rows = kpis.join(routes.select(*own), "route_id").join(body, "route_id")
    listed = lambda head, items: F.when(F.size(items) > 0, F.concat_ws("\n", F.lit(head), F.array_join(items, "\n")))
    whole = F.concat_ws(
        "\n",
        text("Strecke: ", F.col("name"), " (", F.col("place"), "), Aufnahme ", F.col("captured")),
        text("Simulierte Daten: ", F.when(F.col("simulated"), "ja").otherwise("nein, echte Messung")),
        text("Methode: ", F.col("method")),
        text("Fahrbahnbreite ", de("width_m", 2), " m, ", F.col("sections").cast("string"), " Abschnitte, Länge ", de("length_m"), " m"),
        text(
            "Gesamt: Schadanteil ", de("share_pct"), " %, Klasse ", F.col("overall_class").cast("string"), ", Schadfläche ", de("damage_m2", 2), " m², Längsrisse ", de("longitudinal_m"),
            " m, Querrisse ", de("transverse_m"), " m, Netzrisse ", de("net_m2", 2), " m², Flickstellen ", de("patch_m2", 2), " m²",
        ),
        F.lit(ROUTE_TEXT_COLUMNS), "body",
        listed(REJECTED_HEAD, F.transform("rejected_photos", lambda x: text("- ", x["photo"], ": ", x["reason"]))),
        listed(LIMITS_HEAD, F.transform("limitations", lambda x: text("- ", x))),
        F.lit(CLASSES_LINE),
    )
    return rows.select("route_id", whole.alias("t"))


def detail_text(sections: DataFrame) -> DataFrame:
    """(route_id, detail): every section as "NN: x,y % (Kz)", in station order."""
    one = F.concat(padded(F.col("nr")), F.lit(": "), decimal_comma(F.col("share_pct").cast("double")), F.lit(" % (K"), F.col("condition").cast("string"), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("station_from_m", "pos", one.alias("t"))))
    return sections.groupBy("route_id").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "; ").alias("detail"))


def export_rows(decided: DataFrame, sections: DataFrame, routes: DataFrame, link_prefix: str) -> DataFrame:
    """One flat row a route, 22 columns, no nested values.

    ``routes`` has route_id, name, place, captured, simulated, sent_at.
    """
    worst = sections.select("route_id", F.col("nr").alias("worst_nr"), "lat", "lon")
    rows = decided.join(worst, ["route_id", "worst_nr"], "left").join(detail_text(sections), "route_id", "left").join(routes, "route_id", "left")
    order = F.array_join(F.transform("priority", lambda n: padded(n)), ", ")
    by = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DECIDED_BY.items() for x in kv]), F.col("decided_by")), F.lit(""))
    return rows.select(
        "sent_at", "decision_id", "route_id", "name", "place", "captured", F.when(F.col("simulated"), "ja").otherwise("nein").alias("simulated"),
        "sections", "length_m", "share_pct", "damage_m2", "overall_class",
        F.coalesce(padded(F.col("worst_nr")), F.lit("")).alias("worst_section"), F.coalesce(F.col("worst_class").cast("string"), F.lit("")).alias("worst_class"),
        "decision", F.coalesce("title", F.lit("")).alias("title"), by.alias("decided_by"), clean_text(F.col("decision_text"), 600).alias("reason"),
        clean_text(F.col("next_step"), 300).alias("next_step"), order.alias("priority"), map_link(F.col("lat"), F.col("lon"), link_prefix).alias("map"),
        F.coalesce("detail", F.lit("")).alias("detail"),
    )


def calibration_consensus(photos: DataFrame, given_width: float | None = None) -> DataFrame:
    """Photos (route_id, photo, ok, theta, psi, height, width) with the calibration each one uses.

    Medians over the good photos of a route; a photo keeps its own values if it is good, its theta within 8
    degrees and its height within 0.8 to 1.25 of the median's, else takes the route's.  A route without a good
    photo has error true.  The route's width is the given one, else the median to one digit, else 6.0.
    """
    good = F.col("ok")
    middle = photos.groupBy("route_id").agg(
        *[F.median(F.when(good, F.col(c))).alias(f"{c}_mid") for c in ("theta", "psi", "height")], F.median(F.when(good, F.col("width"))).alias("width_mid"), F.count_if(good).alias("n_good")
    )
    rows = photos.join(middle, "route_id")
    ratio = F.try_divide(F.col("height"), F.col("height_mid"))
    own = good & (F.abs(F.col("theta") - F.col("theta_mid")) < 8) & (ratio > 0.8) & (ratio < 1.25)
    pick = lambda c: F.when(own, F.col(c)).otherwise(F.col(f"{c}_mid")).alias(f"used_{c}")
    from roadlens.functions.scalar import py_round

    width = F.lit(given_width) if given_width is not None else F.coalesce(py_round(F.col("width_mid"), 1), F.lit(6.0))
    calibration = F.when(own, "own").otherwise("route").alias("calibration")
    return rows.select("route_id", "photo", pick("theta"), pick("psi"), pick("height"), width.alias("route_width"), calibration, (F.col("n_good") == 0).alias("error"))


def usable_sections(sections: DataFrame) -> DataFrame:
    return sections.where(usable())
