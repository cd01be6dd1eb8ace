"""Validation and normalisation of route documents: valid routes, sections, and a quarantine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlens.functions.scalar import clean_text, condition_class, full_match, one_of, py_round

# Accepted intervals, limits and enumerations.
MAX_SECTIONS, MAX_LIMITATIONS, MAX_REJECTED = 400, 12, 50
QUALITIES = ("gut", "maessig", "unbrauchbar")
SECTION_NUMBERS = (
    # name in the document, our name, low, high, required, missing counts as 0
    ("station_von_m", "station_from_m", 0.0, 100_000.0, True, False),
    ("station_bis_m", "station_to_m", 0.0, 100_000.0, True, False),
    ("schadanteil_pct", "share_pct", 0.0, 100.0, True, False),
    ("bezugsflaeche_m2", "area_m2", 0.1, 2000.0, False, False),
    ("lat", "lat", -90.0, 90.0, False, False),
    ("lon", "lon", -180.0, 180.0, False, False),
    ("laengsrisse_m", "longitudinal_m", 0.0, 100_000.0, True, True),
    ("querrisse_m", "transverse_m", 0.0, 100_000.0, True, True),
    ("netzrisse_m2", "net_m2", 0.0, float("inf"), True, True),
    ("flickstellen_m2", "patch_m2", 0.0, float("inf"), True, True),
    ("schaden_m2", "damage_m2", 0.0, float("inf"), True, True),
    ("gps_genauigkeit_m", "accuracy_m", 0.0, 10_000.0, False, False),
)
ROUTE_TEXTS = (
    ("strecke_id", "route_id", 40, "OHNE_ID"),
    ("name", "name", 80, "Unbenannte Strecke"),
    ("ort", "place", 60, ""),
    ("aufnahme", "captured", 40, ""),
    ("geraet", "device", 80, ""),
    ("methode", "method", 120, ""),
    ("quelle", "source", 160, ""),
)


@dataclass(frozen=True)
class Origins:
    """What a document must name as its schema, and which links of it are kept."""

    schema_tag: str
    image: str
    report: str
    map: str


#: Fields that sections and documents may have.  One cast to a structure takes them out of an object together.
SECTION_FIELDS = ("nr", *[name for name, *_ in SECTION_NUMBERS], "foto", "hinweis", "bild", "foto_bild", "bildqualitaet")
ROUTE_FIELDS = ("schema", "fahrbahnbreite_m", "abschnittslaenge_m", *[name for name, *_ in ROUTE_TEXTS], "bericht", "karte")
SECTION_TYPE = f"struct<{', '.join(f'{name}: variant' for name in SECTION_FIELDS)}>"
ROUTE_TYPE = f"struct<{', '.join(f'{name}: variant' for name in ROUTE_FIELDS)}, simuliert: boolean, abschnitte: array<variant>, grenzen: array<variant>, nicht_ausgewertet: array<variant>>"


def _kind(v: Column) -> Column:
    """Type of a variant field: null if it is missing, VOID if it is an explicit null."""
    return F.schema_of_variant(v)


def _is_number(kind: Column) -> Column:
    """Booleans and texts are no numbers."""
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _read(values: Column) -> Column:
    """An array of variants as an array of (k, n, s): type, the number if it is one, the text if it is one.

    One loop over an array is one short piece of code.  Written out for each field, the code of all checks together
    is more than the JVM compiles, and would be interpreted.
    """
    pairs = F.transform(values, lambda v: F.struct(v.alias("v"), _kind(v).alias("k")))
    number = lambda e: F.when(_is_number(e["k"]), F.try_variant_get(e["v"], "$", "double"))
    text = lambda e: F.when(e["k"] == "STRING", F.try_variant_get(e["v"], "$", "string"))
    return F.transform(pairs, lambda e: F.struct(e["k"].alias("k"), number(e).alias("n"), text(e).alias("s")))


def _taken_apart(rows: DataFrame, fields: tuple[str, ...], source: str) -> DataFrame:
    """Each field of the structure ``source`` as columns ``k_``, ``n_`` and ``s_``: its type, number and text."""
    rows = rows.withColumn("_read", _read(F.array(*[F.col(f"{source}.{name}") for name in fields])))
    return rows.withColumns({f"{mark}_{name}": F.get("_read", F.lit(i))[mark] for i, name in enumerate(fields) for mark in "kns"}).drop("_read")


def _text_of(name: str) -> tuple[Column, Column]:
    """A field's text, and whether it holds something else."""
    kind = F.col(f"k_{name}")
    return F.col(f"s_{name}"), F.coalesce(kind.isNotNull() & ~kind.isin("STRING", "VOID"), F.lit(False))


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _first(errors: list[Column]) -> Column:
    """The first error that holds."""
    return F.coalesce(*errors)


def _value(kind: Column, n: Column, zero: Column) -> Column:
    return F.when(zero & kind.isNull(), 0.0).otherwise(n)  # a missing field is 0, an explicit null an error


def _error(name: Column, kind: Column, n: Column, low: Column, high: Column, required: Column, zero: Column) -> Column:
    value = _value(kind, n, zero)
    wrong = F.coalesce((kind.isNotNull() & ~_is_number(kind) & (kind != "VOID")) | F.isnan(n), F.lit(False))
    return (
        F.when(wrong, F.concat(F.lit("type:"), name))
        .when(value.isNull() & required, F.concat(F.lit("missing:"), name))
        .when((value < low) | (value > high), F.concat(F.lit("range:"), name))
    )


def _check(name: str, low: float, high: float, required: bool, zero: bool, high_column: Column | None = None) -> tuple[Column, Column]:
    kind, n = F.col(f"k_{name}"), F.col(f"n_{name}")
    top = high_column if high_column is not None else F.lit(high)
    return _value(kind, n, F.lit(zero)), _error(F.lit(name), kind, n, F.lit(low), top, F.lit(required), F.lit(zero))


def _first_error(checks: list[tuple]) -> Column:
    """The first error of numbers (name, low, high, required, zero), in one loop over them, for the reason given at ``_read``."""
    keys = ("name", "k", "n", "low", "high", "required", "zero")
    one = lambda name, *rest: F.struct(*[c.alias(k) for k, c in zip(keys, (F.lit(name), F.col(f"k_{name}"), F.col(f"n_{name}"), *map(F.lit, rest)), strict=True)])
    errors = F.transform(F.array(*[one(*c) for c in checks]), lambda e: _error(*[e[k] for k in keys]))
    return F.get(F.filter(errors, lambda x: x.isNotNull()), F.lit(0))


def parse_routes(raw: DataFrame) -> DataFrame:
    """JSON texts (doc, json) as variants; what is no JSON has a null document."""
    return raw.select("doc", F.try_parse_json("json").alias("d"))


def check_sections(parsed: DataFrame, origins: Origins) -> DataFrame:
    """One row a section with its fields, its first error, and the route's width; ordered by pos."""
    items = F.try_variant_get("d", "$.abschnitte", f"array<{SECTION_TYPE}>")
    width = F.get(_read(F.array(_at(F.col("d"), "fahrbahnbreite_m"))), F.lit(0))["n"]
    rows = parsed.select("doc", width.alias("width"), items.alias("items")).select("doc", "width", F.posexplode("items").alias("pos", "a"))
    rows = rows.withColumn("object", F.col("a").isNotNull()).withColumn("v_nr", F.col("a.nr"))
    rows = _taken_apart(rows, SECTION_FIELDS, "a").drop("a")
    rows = rows.withColumn("nr", F.when(F.col("k_nr").isNull(), F.col("pos") + 1).otherwise(F.when(F.col("k_nr") == "BIGINT", F.try_variant_get("v_nr", "$", "int"))))
    nr = F.col("nr")
    early = [(name, ours, *rest) for name, ours, *rest in SECTION_NUMBERS if ours not in ("net_m2", "patch_m2", "damage_m2")]
    numbers = {ours: _value(F.col(f"k_{name}"), F.col(f"n_{name}"), F.lit(zero)) for name, ours, _, _, _, zero in early}
    errors: list[Column] = [F.when(~F.col("object"), F.lit("type:section")), F.when(nr.isNull() | (nr < 1) | (nr > 9999), F.lit("range:nr"))]
    area_limit = F.col("limit")
    errors.append(_first_error([(name, *rest) for name, _, *rest in early]))
    rows = rows.withColumns(numbers).withColumn("error", _first(errors))
    span = F.col("width") * (F.col("station_to_m") - F.col("station_from_m"))
    rows = rows.withColumn("limit", F.greatest(span, F.coalesce("area_m2", F.lit(0.0))) * 1.25)
    late: dict[str, Column] = {}
    late_errors: list[Column] = [F.col("error"), F.when(F.col("station_to_m") <= F.col("station_from_m"), F.lit("order:station"))]
    for name, ours, low, high, required, zero in SECTION_NUMBERS:
        if ours not in ("net_m2", "patch_m2", "damage_m2"):
            continue
        found = F.col(f"k_{name}")
        value, error = _check(name, low, high, required, zero, area_limit)
        if ours == "damage_m2":
            value = F.when(found.isNull(), F.col("share_pct") / 100 * F.coalesce("area_m2", span)).otherwise(value)
            error = F.when(found.isNotNull(), error).when(value > area_limit, F.lit(f"range:{name}"))
        late[ours] = value
        late_errors.append(error)
    texts: dict[str, Column] = {}
    for name, ours, length in (("foto", "photo", 60), ("hinweis", "note", 160)):
        value, wrong = _text_of(name)
        texts[ours] = clean_text(value, length)
        late_errors.append(F.when(wrong, F.lit(f"type:{name}")))
    links = {ours: _text_of(name)[0] for name, ours in (("bild", "image"), ("foto_bild", "photo_image"))}
    quality = F.when(F.col("k_bildqualitaet").isNull(), F.lit("gut")).otherwise(one_of(F.coalesce(_text_of("bildqualitaet")[0], F.lit("-")), QUALITIES, "maessig", "gut"))
    rows = rows.withColumns(late | texts | {"quality": quality}).withColumn("error", _first(late_errors))
    rows = rows.withColumns({k: F.when(full_match(v, origins.image), v) for k, v in links.items()})
    rows = rows.withColumns({
        "area_m2": F.coalesce(F.nullif(F.col("area_m2"), F.lit(0.0)), py_round(span, 2)), "lon": F.when(F.col("lat").isNotNull(), F.col("lon")), "condition": condition_class(F.col("share_pct")),
    })
    twice = F.count("*").over(Window.partitionBy("doc", "nr")) > 1
    rows = rows.withColumn("error", F.coalesce("error", F.when(twice, F.lit("duplicate:nr"))))
    return rows.drop("object", "limit", "width", "v_nr", *[f"{mark}_{name}" for name in SECTION_FIELDS for mark in "kns"])


def check_routes(parsed: DataFrame, sections: DataFrame, origins: Origins) -> DataFrame:
    """One row a document: its own fields, the number of its sections, and its first error, its sections' included."""
    rows = parsed.select("doc", _kind(F.col("d")).alias("kind"), F.try_variant_get("d", "$", ROUTE_TYPE).alias("a"))
    rows = _taken_apart(rows, ROUTE_FIELDS, "a")
    width, width_error = _check("fahrbahnbreite_m", 2.0, 20.0, True, False)
    step, step_error = _check("abschnittslaenge_m", 1.0, 50.0, True, False)
    step_kind = F.col("k_abschnittslaenge_m")
    step, step_error = F.when(step_kind.isNull(), F.lit(5.0)).otherwise(step), F.when(step_kind.isNotNull(), step_error)
    items = F.col("a.abschnitte")
    errors = [
        F.when(F.col("kind").isNull() | ~F.col("kind").startswith("OBJECT"), F.lit("type:document")),
        F.when(F.coalesce(_text_of("schema")[0], F.lit("")) != origins.schema_tag, F.lit("schema")),
        width_error, step_error,
        F.when(items.isNull() | (F.size(items) < 1), F.lit("missing:abschnitte")), F.when(F.size(items) > MAX_SECTIONS, F.lit("range:abschnitte")),
    ]
    texts, text_errors = {}, []
    for name, ours, length, default in ROUTE_TEXTS:
        value, wrong = _text_of(name)
        texts[ours] = clean_text(value, length, default)
        text_errors.append(F.when(wrong, F.lit(f"type:{name}")))
    limits = F.slice(F.coalesce(F.col("a.grenzen"), F.array().cast("array<variant>")), 1, MAX_LIMITATIONS)
    limits = F.filter(F.transform(_read(limits), lambda e: clean_text(e["s"], 200)), lambda t: t != "")
    bad = F.slice(F.coalesce(F.col("a.nicht_ausgewertet"), F.array().cast("array<variant>")), 1, MAX_REJECTED)
    bad = F.filter(bad, lambda v: F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False)))
    text = lambda v, name, length: clean_text(F.when(_kind(_at(v, name)) == "STRING", F.try_variant_get(v, f"$.{name}", "string")), length)
    rejected = F.transform(bad, lambda v: F.struct(text(v, "foto", 60).alias("photo"), text(v, "grund", 200).alias("reason")))
    simulated = F.coalesce("a.simuliert", F.lit(False))
    links = {ours: _text_of(name)[0] for name, ours in (("bericht", "report"), ("karte", "map"))}
    rows = rows.select(
        "doc", _first(errors).alias("own_error"), _first(text_errors).alias("text_error"), *[c.alias(k) for k, c in texts.items()], simulated.alias("simulated"), width.alias("width_m"), step.alias("step_m"),
        limits.alias("limitations"), rejected.alias("rejected_photos"), *[F.when(full_match(v, getattr(origins, k)), v).alias(k) for k, v in links.items()],
    )
    first = sections.groupBy("doc").agg(F.count("*").alias("n_sections"), F.min(F.when(F.col("error").isNotNull(), F.struct("pos", "error")))["error"].alias("section_error"))
    rows = rows.join(first, "doc", "left").withColumn("error", F.coalesce("own_error", "section_error", "text_error"))
    return rows.drop("own_error", "text_error", "section_error")


def validated(raw: DataFrame, origins: Origins) -> DataFrame:
    """Texts (doc, json) to one row a document with its fields, ``n_sections`` and ``error``, null if the document is valid.

    Whoever wants verdicts and counts only reads the texts once with this; ``validate_routes`` gives the sections too.
    """
    parsed = parse_routes(raw)
    return check_routes(parsed, check_sections(parsed, origins), origins)


def validate_routes(raw: DataFrame, origins: Origins) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (doc, json) to (routes, sections of valid routes, quarantine (doc, error)).

    All or nothing for each document, with the first error: missing, explicitly null and mistyped fields are
    told apart; classes are always computed, never read.
    """
    parsed = parse_routes(raw)
    sections = check_sections(parsed, origins)
    routes = check_routes(parsed, sections, origins)
    good = routes.where("error is null").drop("error", "n_sections")
    kept = sections.drop("error").join(good.select("doc", "route_id"), "doc")
    return good, kept, routes.where("error is not null").select("doc", "error")
