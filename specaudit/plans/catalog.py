"""The metrics that can be audited, and their vocabularies.  Eight rows: small by definition."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Metric:
    key: str
    name: str
    description: str
    aliases: tuple[str, ...]
    preferred: tuple[str, ...]
    required: tuple[str, ...]
    low_m: float
    high_m: float
    comparator: str
    feature: str  # pattern of the words that a scanned passage must hold
    concepts: tuple[tuple[str, ...], ...]  # a clause must hold one of each group
    scope: tuple[str, ...]  # one of these must stand in the evidence

    @property
    def phrases(self) -> tuple[str, ...]:
        return (self.name, self.description, *self.aliases)


# Names, ranges, standards and words that results depend on.
_ROADS = ("IRC:73", "IRC:SP:73", "IRC:86", "IRC:SP:84", "IRC:SP:87", "IRC:SP:99")
_BARRIERS = ("IRC:119", "IRC:SP:84", "IRC:SP:99")
METRICS = {
    m.key: m
    for m in (
        Metric("min_lane_width", "minimum traffic lane width", "standard width of one traffic lane or carriageway lane", ("lane width", "width of traffic lane", "carriageway width per lane"), _ROADS, ("road_class", "setting", "lanes_total"), 2.0, 5.5, ">=", r"\b(?:lane|carriageway)\b", (("lane", "carriageway"), ("width",)), ("lane", "carriageway")),
        Metric("min_sign_height", "minimum traffic-sign mounting height", "vertical clearance from road or ground to the lower edge of a traffic sign", ("sign mounting height", "bottom edge height", "vertical clearance of sign"), ("IRC:67",), ("setting", "sign_mounting"), 0.3, 8.0, ">=", r"\b(?:sign|mounting|clearance)\b", (("sign",), ("height", "lower edge", "lowest edge", "above ground")), ("sign",)),
        Metric("traffic_sign_width", "traffic-sign face width", "specified width or diameter of the applicable traffic sign", ("sign size", "sign diameter", "sign plate width"), ("IRC:67",), ("sign_class", "design_speed_kmph"), 0.2, 4.0, "=", r"\b(?:sign|diameter|width)\b", (), ("sign",)),
        Metric("traffic_sign_height", "traffic-sign face height", "specified height or diameter of the applicable traffic sign face", ("sign size", "sign diameter", "sign plate height"), ("IRC:67",), ("sign_class", "design_speed_kmph"), 0.2, 4.0, "=", r"\b(?:sign|diameter|height)\b", (), ("sign",)),
        Metric("min_kerb_height", "kerb height", "specified height of the applicable raised, median, or barrier kerb", ("curb height", "raised kerb", "median kerb height"), ("IRC:86", "IRC:SP:84", "IRC:SP:99"), ("kerb_type",), 0.05, 0.6, "=", r"\b(?:kerb|curb)\b", (("kerb", "curb"), ("height", "raised")), ("kerb", "curb")),
        Metric("min_w_beam_barrier_height", "W-beam barrier mounting height", "height of the W-beam rail or top of barrier above the adjacent road level", ("W beam rail height", "metal beam crash barrier height", "semi-rigid barrier height"), _BARRIERS, (), 0.3, 1.5, "=", r"\bw[\s-]?beam\b", (("w beam", "w-beam"), ("height", "above ground")), ("w-beam", "w beam", "metal beam")),
        Metric("min_concrete_barrier_height", "concrete safety-barrier height", "height of a rigid concrete or New Jersey barrier above road level", ("rigid barrier height", "New Jersey barrier height", "concrete crash barrier height"), _BARRIERS, (), 0.3, 2.0, ">=", r"\b(?:concrete|new\s+jersey|rigid)\b", (("concrete barrier", "rigid barrier"), ("height",)), ("concrete", "new jersey", "rigid barrier")),
        Metric("min_radius_curvature", "minimum horizontal-curve radius", "minimum radius of a horizontal circular curve from an applicable direct IRC table or the best available radius-evaluation speed and terrain", ("minimum horizontal radius", "ruling minimum radius", "curve radius"), _ROADS, ("radius_speed_kmph", "terrain"), 10.0, 10000.0, ">=", r"\b(?:radius|radii|curve)\b", (("radius",), ("curve", "horizontal")), ("radius", "curve")),
    )
}
#: The metrics that observations are audited for, in report order.
AUDITED = ("min_lane_width", "min_sign_height", "min_kerb_height", "min_w_beam_barrier_height", "min_concrete_barrier_height", "min_radius_curvature")
#: Manuals that hold for one carriageway arrangement only.
MANUALS = (("IRC:SP:73", "undivided", 2), ("IRC:SP:84", "divided", 4), ("IRC:SP:87", "divided", 6))
#: Lanes of facilities other than the through road.
SPECIAL_FACILITIES = ("toll lane", "etc lane", "shoulder width", "service road", "access road", "parking lane", "acceleration lane", "deceleration lane", "climbing lane")
SCOPED = ("min_lane_width", "min_radius_curvature")


def metric(key: str) -> Metric:
    if key not in METRICS:
        raise KeyError(f"Unknown metric '{key}'. Valid metrics: {', '.join(sorted(METRICS))}")
    return METRICS[key]


def table(spark: SparkSession) -> DataFrame:
    """The catalogue as a DataFrame of eight rows."""
    names = [f.name for f in fields(Metric)]
    schema = "key string, name string, description string, aliases array<string>, preferred array<string>, required array<string>, low_m double, high_m double, comparator string, feature string, concepts array<array<string>>, scope array<string>"
    rows = [tuple([list(map(list, v)) if n == "concepts" else list(v) if isinstance(v, tuple) else v for n in names for v in [getattr(m, n)]]) for m in METRICS.values()]
    return spark.createDataFrame(rows, schema)
