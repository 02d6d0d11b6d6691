"""Text and measurement functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches must equal those of the audited tool chain.
TOKEN = r"[a-z0-9]+(?:[.:/-][a-z0-9]+)*"
VALUE_WITH_UNIT = r"(?i)\b\d+(?:\.\d+)?\s*(?:mm|cm|m|metres?|meters?|km|km/h)\b"
MEASUREMENT = r"(?i)(?<![\w.])(\d+(?:,\d{3})*(?:\.\d+)?)\s*(mm|cm|km/h|km|m|metres?|meters?)\b"
TOLERANCE = r"(?i)(?<![\w.])(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:±|\+\s*/\s*-|\+\s*-|plus\s+or\s+minus)\s*(\d+(?:\.\d+)?)\s*(mm|cm|km|m|metres?|meters?)\b"
NUMBER = r"[-+]?\d+(?:\.\d+)?"
COORDINATES = r"(?i)(?:N(?:orth)?\s*[:=]?\s*)?(?<![\d.])([+-]?\d{1,2}(?:\s*\.\s*\d+)?)\s*[,; ]+\s*(?:E(?:ast)?\s*[:=]?\s*)?(?<![\d.])([+-]?\d{1,3}(?:\s*\.\s*\d+)?)"
STANDARD = r"(?i)\bIRC\s*[:._-]?\s*(?:(SP)\s*[:._-]?\s*)?(\d{1,3})\b"
YEAR = r"\b(?:19|20)\d{2}\b"
OCR_PREFIX = r"(?i)(?<![A-Z0-9])[1IL]\s*R\s*C(?=\s*[:._-]?\s*(?:SP\b|\d))"
NUMBERED_HEADING = r"(?i)^(?:section\s+)?\d+(?:\.\d+){0,4}\s+[A-Za-z]"
DIMENSION_LINE = r"(?i)\d(?:[\d., ]*\d)?\s*(?:±|\+\s*/\s*-)?\s*(?:mm|cm|m|metres?|meters?|km)\b"
LOCATOR_LINE = r"(?i)\b(?:fig(?:ure)?|table)\s*\.?\s*\d+"
SIGN_SPEED = r"(?i)(?:speed\s*limit|maximum\s*speed|mandatory\s*speed)\D{0,8}(\d{2,3})\b"
#: Wording of a relation, in order of precedence.
COMPARATORS = (
    (">=", r"\bminimum\b|\bat\s+least\b|\bnot\s+less\s+than\b"),
    ("<=", r"\bmaximum\b|\bat\s+most\b|\bnot\s+more\s+than\b|\bshall\s+not\s+exceed\b"),
    (">", r"\bgreater\s+than\b|\bmore\s+than\b"),
    ("<", r"\bless\s+than\b|\bbelow\b"),
    ("=", r"\bshall\s+be\b|\bequal\s+to\b|\bstandard\b.{0,50}\b(?:is|shall\s+be)\b"),
)
ROAD_CLASSES = (("motorway", "Expressway"), ("motorway_link", "Expressway"), ("trunk", "National Highway"), ("trunk_link", "National Highway"), ("primary", "State Highway"), ("primary_link", "State Highway"), ("secondary", "Major District Road"), ("tertiary", "Other District Road"), ("residential", "Local Street"), ("living_street", "Local Street"), ("unclassified", "Rural Road"))
ROAD_REFERENCES = ((r"(?:^|;)NE?[-]?\d+", "Expressway", 0.92), (r"(?:^|;)NH[-]?\d+", "National Highway", 0.92), (r"(?:^|;)SH[-]?\d+", "State Highway", 0.90), (r"(?:^|;)MDR[-]?\d+", "Major District Road", 0.88), (r"(?:^|;)ODR[-]?\d+", "Other District Road", 0.88))
WEAK_PAGE = 80


def known(c: Column) -> Column:
    """Null, blank and ``unknown`` all mean "not known"."""
    return F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))


WHITE = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _replaced_if(signs: tuple[str, ...], pattern: str, by: str) -> Callable[[Column], Column]:
    """Replacement that runs only where a plain search finds one of ``signs``."""

    def body(x: Column) -> Column:
        return F.when(reduce(lambda a, b: a | b, (F.contains(x, F.lit(s)) for s in signs)), F.regexp_replace(x, pattern, by)).otherwise(x)

    return body


def normalize_text(c: Column) -> Column:
    """Control characters and runs of blanks become one blank, at most one empty line stays between paragraphs."""
    for control in "\x00\x08":
        c = F.replace(c, F.lit(control), F.lit(" "))
    for signs, pattern, by in ((("\t", "  "), r"[ \t]+", " "), (("\n ", "\n\t"), r"\n[ \t]+", "\n"), (("\n\n\n",), r"\n{3,}", "\n\n")):
        c = let(c, _replaced_if(signs, pattern, by))
    return F.btrim(c, F.lit(WHITE))


def match_form(c: Column) -> Column:
    """Case and white space do not count when quotes are looked for."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case alphanumeric runs, joined by single ``. : / -``; single letters are dropped."""
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) | t.between("0", "9"))


def token_text(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def numbers(c: Column) -> Column:
    """All signed numbers of a cell, in order."""
    found = F.transform(F.regexp_extract_all(c.cast("string"), F.lit(NUMBER), F.lit(0)), lambda t: t.cast("double"))
    return F.coalesce(found, F.array().cast("array<double>"))


def has_value_with_unit(c: Column) -> Column:
    return c.rlike(VALUE_WITH_UNIT)


def unit_form(c: Column) -> Column:
    """Spellings of the metre are one unit."""
    c = F.lower(c)
    return F.when(c.isin("metre", "metres", "meter", "meters"), "m").otherwise(c)


def to_metres(value: Column, unit: Column) -> Column:
    """Null for units that are no lengths."""
    u = unit_form(unit)
    return F.when(u == "mm", value / 1000.0).when(u == "cm", value / 100.0).when(u == "m", value).when(u == "km", value * 1000.0)


def measurements(c: Column) -> Column:
    """``array<struct<raw, unit, value_m>>`` of all numbers with a unit; ``value_m`` is null for speeds."""
    values = F.regexp_extract_all(c, F.lit(MEASUREMENT), F.lit(1))
    units = F.regexp_extract_all(c, F.lit(MEASUREMENT), F.lit(2))

    def row(x: Column) -> Column:
        raw = F.regexp_replace(x["v"], ",", "").cast("double")
        return F.struct(raw.alias("raw"), unit_form(x["u"]).alias("unit"), to_metres(raw, x["u"]).alias("value_m"))

    return F.transform(F.arrays_zip(values.alias("v"), units.alias("u")), lambda x: row(x))


def tolerance(c: Column) -> Column:
    """``struct<centre, spread, unit>`` of the first "centre plus or minus spread", or null."""
    centre, spread, unit = (F.regexp_extract(c, TOLERANCE, k) for k in (1, 2, 3))
    found = F.struct(F.regexp_replace(centre, ",", "").cast("double").alias("centre"), spread.cast("double").alias("spread"), unit_form(unit).alias("unit"))
    return F.when(c.rlike(TOLERANCE), found)


def comparator(c: Column) -> Column:
    """The relation that the wording states, or null."""
    text = match_form(c)
    return reduce(lambda a, x: F.when(text.rlike(x[1]), x[0]).otherwise(a), reversed(COMPARATORS), F.lit(None).cast("string"))


def clauses(c: Column) -> Column:
    """Sentences of a passage without line structure."""
    return F.split(flat(c), r"(?<=[.!?])\s+")


def coordinates(c: Column) -> Column:
    """``struct<lat, lon>`` from a label such as ``N: 17.6610 E: 78. 1068``; null if absent or out of range."""

    def part(k: int) -> Column:
        return F.regexp_replace(F.regexp_extract(c, COORDINATES, k), r"\s+", "").try_cast("double")

    lat, lon = part(1), part(2)
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def weak_page(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")) < WEAK_PAGE


def standard_identity(sample: Column, fallback: Column) -> Column:
    """``struct<standard_id, edition_year>`` from the first standard number; the year stands near it or is the first plausible one of the text."""
    at = F.regexp_instr(sample, F.lit(STANDARD))
    sp, number = F.regexp_extract(sample, STANDARD, 1), F.regexp_extract(sample, STANDARD, 2)
    near = F.regexp_extract(F.substring(sample, at, F.lit(80)), YEAR, 0).try_cast("int")
    years = F.transform(F.regexp_extract_all(F.substring(fallback, 1, 5000), F.lit(YEAR), F.lit(0)), lambda y: y.cast("int"))
    plausible = F.get(F.filter(years, lambda y: y.between(F.lit(1950), F.year(F.current_date()))), F.lit(0))
    name = F.concat(F.lit("IRC:"), F.when(sp != "", "SP:").otherwise(""), number.try_cast("int").cast("string"))
    return F.when(sample.rlike(STANDARD), F.struct(name.alias("standard_id"), F.coalesce(near, plausible).alias("edition_year")))


def repair_ocr(c: Column) -> Column:
    """Common misreadings of the standard prefix."""
    return F.regexp_replace(c, OCR_PREFIX, "IRC")


def section(c: Column) -> Column:
    """First numbered heading or ``#`` line of at most 160 characters."""
    lines = F.transform(F.split(c, r"\r?\n"), lambda x: F.struct(F.regexp_replace(x, r"^[ #\t]+|[ #\t]+$", "").alias("t"), F.ltrim(x).startswith("#").alias("h")))
    good = F.filter(lines, lambda x: (x["t"] != "") & (F.length(x["t"]) <= 160) & (x["h"] | x["t"].rlike(NUMBERED_HEADING)))
    return F.get(good, F.lit(0))["t"]


def speed_kmph(c: Column) -> Column:
    """Speed tag; miles are converted and rounded half to even to one place."""
    n = F.regexp_extract(c, r"\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when(F.lower(c).contains("mph"), F.bround(n * 1.609344, 1)).otherwise(n)


def sign_speed(c: Column) -> Column:
    """Posted speed named on a sign label, 10 to 180 km/h."""
    n = F.regexp_extract(c, SIGN_SPEED, 1).try_cast("double")
    return F.when(n.between(10, 180), n)


def lane_count(c: Column) -> Column:
    n = F.when(F.trim(c).rlike(r"^\d+$"), F.trim(c).try_cast("int"))
    return F.when(n.between(1, 30), n)


def road_class(ref: Column, highway: Column) -> Column:
    """``struct<road_class, confidence>`` from the road's reference, else from its highway tag."""
    ref = F.replace(F.upper(F.coalesce(ref, F.lit(""))), F.lit(" "), F.lit(""))

    def of(name: str, confidence: float) -> Column:
        return F.struct(F.lit(name).alias("road_class"), F.lit(confidence).alias("confidence"))

    by_tag = reduce(lambda a, x: F.when(highway == x[0], of(x[1], 0.60)).otherwise(a), ROAD_CLASSES, F.lit(None))
    return reduce(lambda a, x: F.when(ref.rlike(x[0]), of(x[1], x[2])).otherwise(a), reversed(ROAD_REFERENCES), by_tag)


def _digits_of(x: Column) -> Column:
    """A number of moderate size without an exponent and without trailing zeros."""
    return F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")


def fmt_g(x: Column) -> Column:
    """A number in six significant digits without trailing zeros, as C's ``%g``."""

    def shown(size: Column) -> Column:
        scale = F.pow(F.lit(10.0), F.lit(5) - size)
        small = F.concat(_digits_of(F.round(x * scale) / 100000), F.lit("e"), F.when(size < 0, "-").otherwise("+"), F.lpad(F.abs(size).cast("string"), 2, "0"))
        return F.when((size < -4) | (size >= 6), small).otherwise(_digits_of(F.round(x * scale) / scale))

    return F.when(x == 0, "0").otherwise(let(F.floor(F.log10(F.abs(x))).cast("int"), shown))


def fmt_3(x: Column) -> Column:
    """Three decimal places without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", x), r"0+$", ""), r"\.$", "")


def citation_label(standard_id: Column, source: Column, page: Column, sect: Column) -> Column:
    return F.concat_ws(", ", F.coalesce(F.nullif(standard_id, F.lit("")), source), F.concat(F.lit("p. "), page.cast("string")), sect)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
