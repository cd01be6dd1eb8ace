"""Scalar functions, all as Column expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# German texts and thresholds that results must carry unchanged.
CLASS_LABELS = {1: "sehr gut", 2: "gut", 3: "mittel", 4: "schlecht", 5: "sehr schlecht"}
CLASS_STEPS = (10, 20, 30, 40)
DECIDED_BY = {"ki": "KI", "ki+regel": "KI, durch Regel verschärft", "regel": "Regel"}
INTENTS = (
    ("worst", ("schlimm", "schlecht", "wo ", "worst", "kaputt", "zuerst")),
    ("best", ("best", "gut", "am wenigsten")),
    ("accuracy", ("genau", "sicher", "grenze", "vertrau", "fehler")),
    ("decision", ("warum", "entscheid", "weiter")),
    ("cost", ("kost", "preis", "euro", "€")),
)
FAILURES = (  # of the output of a run, in this order
    ("no_lane", ("Kein Foto konnte ausgewertet werden", "Fahrbahn nicht gefunden")),
    ("no_calibration", ("Kalibrierung nicht möglich",)),
    ("memory", ("MemoryError",)),
    ("missing_package", ("ModuleNotFoundError",)),
)
KILLED = (-9, 137)
PROGRESS = r"^\s+· (\S+) … (.*)$"
PROGRESS_ENDS = ("%", "übersprungen")
EARTH_RADIUS_M = 6_371_000.0
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def py_round(x: Column, digits: int) -> Column:
    """Rounding of doubles on their exact binary value, ties to even."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit("")).cast("double")


def condition_class(share: Column) -> Column:
    """Class 1 to 5 of a damage share in percent: left-closed steps of ten."""
    out = F.lit(len(CLASS_STEPS) + 1)
    for k, step in reversed(list(enumerate(CLASS_STEPS, 1))):
        out = F.when(share < step, k).otherwise(out)
    return F.when(share.isNotNull(), out)


def class_label(condition: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_LABELS.items() for x in kv]), condition)


def decimal_comma(x: Column, digits: int = 1) -> Column:
    """31.7 as 31,7 without thousands separators."""
    return F.replace(F.replace(F.format_number(x, digits), F.lit(","), F.lit("")), F.lit("."), F.lit(","))


def decimal_comma_grouped(x: Column, digits: int = 1) -> Column:
    """1234.5 as 1.234,5."""
    return F.translate(F.format_number(x, digits), ",.", ".,")


def local_number(x: Column, digits: int = 1) -> Column:
    """As a browser writes it in Austria: decimal comma, no-break space between thousands, halves away from zero."""
    return F.translate(F.format_number(F.round(x, digits), digits), ",.", "\u00a0,")


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def padded(n: Column, width: int = 2) -> Column:
    return F.when(n.isNotNull(), F.format_string(f"%0{width}d", n.cast("long")))


def short_number(x: Column) -> Column:
    """Six significant digits without trailing zeros, as %g: 1234.57, 0.3, 1.23457e+07.

    Between 0.0001 and a million the digits come from the exact binary value, ties to even.
    """
    x = x.cast("double")
    size = F.abs(x)
    digits = F.lit(5) - F.floor(F.log10(size)).cast("int")
    plain = F.replace(F.call_function("format_number", x, digits), F.lit(","), F.lit(""))
    plain = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)
    power = F.regexp_replace(F.format_string("%.5e", x), r"\.?0*e", "e")
    return F.when(x == 0, "0").when(F.isnan(x), "nan").when((size >= 999_999.5) | (size < 0.000_099_999_95), power).otherwise(plain)


def map_link(lat: Column, lon: Column, prefix: str) -> Column:
    """A link with six decimals, empty without a position."""
    six = [F.replace(F.format_number(x, 6), F.lit(","), F.lit("")) for x in (lat, lon)]
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(F.lit(prefix), six[0], F.lit(","), six[1])).otherwise(F.lit(""))


def degrees_of(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as signed degrees; S and W are negative."""
    return (d + m / 60 + s / 3600) * F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1)


def dms_of(x: Column) -> Column:
    """Absolute degrees, minutes, and seconds with four decimals."""
    a = F.abs(x)
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    return F.struct(d.alias("d"), m.alias("m"), py_round((a - d - m / 60) * 3600, 4).alias("s"))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def clean_text(x: Column, length: int, default: str = "") -> Column:
    """Without control characters, trimmed of all white space, cut; null or empty gives the default."""
    plain = F.regexp_replace(F.regexp_replace(x, CONTROL, ""), r"(?U)^\s+|\s+$", "")
    return F.when(x.isNull() | (x == ""), F.lit(default)).otherwise(F.substring(plain, 1, length))


def number_error(x: Column, low: Column, high: Column, required: bool = True) -> Column:
    """missing, range or null (no error): finite and within the closed interval."""
    wrong = F.isnan(x) | (x < low) | (x > high)
    return F.when(x.isNull(), F.lit("missing" if required else None)).when(wrong, F.lit("range"))


def lenient_number(x: Column, default: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), default).otherwise(x)


def one_of(x: Column, allowed: tuple[str, ...], other: str, default: str) -> Column:
    return F.when(x.isNull(), F.lit(default)).when(x.isin(*allowed), x).otherwise(F.lit(other))


def full_match(x: Column, pattern: str) -> Column:
    """The whole string, trailing line ends included."""
    return F.coalesce(x.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def webhook_allowed(url: Column, host: str, prefix: str) -> Column:
    """https, the given host in any case, and a path below the prefix."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    ok = (F.lower(part("PROTOCOL")) == "https") & (F.lower(part("HOST")) == host) & part("PATH").startswith(prefix)
    return F.coalesce(ok, F.lit(False))


def html_escaped(x: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(raw), F.lit(name))
    return x


def intent(question: Column, has_decision: Column | None = None) -> Column:
    """The first group of words of which the question has one; decision only where there is one."""
    q, out = F.lower(question), F.lit("summary")
    for name, words in reversed(INTENTS):
        has = F.lit(False)
        for w in words:
            has = has | q.contains(w)
        if name == "decision" and has_decision is not None:
            has = has & has_decision
        out = F.when(has, F.lit(name)).otherwise(out)
    return out


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def failure_kind(text: Column, code: Column) -> Column:
    """What the output and exit code of a failed run say, the first test that holds."""
    out = F.lit("failed")
    for kind, words in reversed(FAILURES):
        holds = _has_any(text, words) | code.isin(*KILLED) if kind == "memory" else _has_any(text, words)
        out = F.when(holds, kind).otherwise(out)
    return out


def progress_of(line: Column) -> Column:
    """Photo and message of a progress line, and whether it ends a photo."""
    photo, message = F.regexp_extract(line, PROGRESS, 1), F.regexp_extract(line, PROGRESS, 2)
    return F.struct(photo.alias("photo"), message.alias("message"), ((photo != "") & _has_any(message, PROGRESS_ENDS)).alias("done"))


def capture_state(distance: Column) -> Column:
    """What to do at a distance from the last photo: go below 4 m, now up to 6.5 m, then too far."""
    return F.when(distance.isNull(), "no_fix").when(distance < 4, "go").when(distance <= 6.5, "now").otherwise("too_far")


def exif_time(x: Column) -> Column:
    """YYYY:MM:DD HH:MM:SS as ISO text; empty if it is no time."""
    t = F.try_to_timestamp(x, F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def clamped(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def due_date(captured: Column, today: Column) -> Column:
    return F.add_months(F.coalesce(captured, today), 12)
