"""Traffic-light (TLP) and annotated traffic-light (aTLP) colour expressions.

Everything here is a Column expression, so colouring runs inside the
aggregate's codegen stage.  The clinical rule table is data: it is built as
a small DataFrame and joined by variable name (broadcast: 25 fixed rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HIGHER_WORSE = "higher_worse"
LOWER_WORSE = "lower_worse"
TARGET_RANGE = "target_range"

# Uncertainty cut points (k1, k2) and percentile thresholds.
ATLP_K1 = 0.30
ATLP_K2 = 0.90
LOW_PERCENTILE = 33
HIGH_PERCENTILE = 66

# Measures where lower is worse for the percentile fallback.
DEFAULT_INVERT = ["gcs_motor", "gcs_verbal", "gcs_eyes", "urineoutput", "mbp_min"]

# Pure palette (red, green, blue) used for the plain TLP colour.
PURE_HEX = {"green": "#00ff00", "yellow": "#ffff00", "red": "#ff0000"}

# Clinical traffic-light rules, in their natural order.
# (variable, direction, green bound(s), red bound(s))
# higher_worse: value <= green is green, value >= red is red.
# lower_worse:  value >= green is green, value <= red is red.
# target_range: inside the green range is green, outside the red range is red.
CLINICAL_RULES = [
    ("admission_age", HIGHER_WORSE, 65.0, 80.0),
    ("apsiii", HIGHER_WORSE, 45.0, 70.0),
    ("apsiii_prob", HIGHER_WORSE, 0.20, 0.40),
    ("sepsis3", HIGHER_WORSE, 0.25, 0.75),
    ("heart_rate_max", HIGHER_WORSE, 100.0, 120.0),
    ("heart_rate_min", TARGET_RANGE, (50.0, 100.0), (40.0, 120.0)),
    ("mbp_min", LOWER_WORSE, 65.0, 55.0),
    ("mbp_max", TARGET_RANGE, (65.0, 120.0), (55.0, 140.0)),
    ("temperature_max", HIGHER_WORSE, 38.3, 39.5),
    ("temperature_min", TARGET_RANGE, (36.0, 38.0), (35.0, 39.0)),
    ("resp_rate_max", HIGHER_WORSE, 22.0, 30.0),
    ("resp_rate_min", TARGET_RANGE, (12.0, 22.0), (8.0, 30.0)),
    ("creatinine_max", HIGHER_WORSE, 1.3, 2.0),
    ("creatinine_min", HIGHER_WORSE, 1.3, 2.0),
    ("bun_max", HIGHER_WORSE, 25.0, 50.0),
    ("bun_min", HIGHER_WORSE, 25.0, 50.0),
    ("sodium_min", LOWER_WORSE, 135.0, 130.0),
    ("sodium_max", TARGET_RANGE, (135.0, 145.0), (130.0, 150.0)),
    ("glucose_max", HIGHER_WORSE, 180.0, 250.0),
    ("glucose_min", LOWER_WORSE, 70.0, 50.0),
    ("urineoutput", LOWER_WORSE, 1000.0, 500.0),
    ("gcs_eyes", LOWER_WORSE, 4.0, 2.0),
    ("gcs_verbal", LOWER_WORSE, 5.0, 3.0),
    ("gcs_motor", LOWER_WORSE, 6.0, 4.0),
    ("gcs_unable", HIGHER_WORSE, 0.10, 0.30),
]

# Severity-score family (percentile fallback with higher = worse).
SCORE_FEATURES = [
    "apsiii", "apsiii_prob", "hr_score", "mbp_score", "temp_score", "resp_rate_score", "hematocrit_score",
    "wbc_score", "creatinine_score", "uo_score", "bun_score", "sodium_score", "glucose_score", "gcs_score",
]

RULE_SCHEMA = "variable string, direction string, g1 double, g2 double, r1 double, r2 double"


def rules_frame(spark: SparkSession, rules=None) -> DataFrame:
    """Rule list -> DataFrame (variable, direction, g1, g2, r1, r2); g2/r2 only for ranges."""
    rows = []
    for var, direction, green, red in (rules if rules is not None else CLINICAL_RULES):
        if direction == TARGET_RANGE:
            rows.append((var, direction, float(green[0]), float(green[1]), float(red[0]), float(red[1])))
        else:
            rows.append((var, direction, float(green), None, float(red), None))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def percentile_color(value: Column, p_low: Column, p_high: Column, invert: Column) -> Column:
    """SC-03: percentile traffic light; ``invert`` swaps green and red; nulls are yellow."""
    normal = F.when(value <= p_low, "green").when(value >= p_high, "red").otherwise("yellow")
    inverted = F.when(value >= p_high, "green").when(value <= p_low, "red").otherwise("yellow")
    return (F.when(_missing(value) | _missing(p_low) | _missing(p_high), F.lit("yellow"))
            .when(invert, inverted).otherwise(normal))


def higher_worse_color(value: Column, green_max: Column, red_min: Column) -> Column:
    """SC-04."""
    return F.when(_missing(value), "yellow").when(value <= green_max, "green").when(value >= red_min, "red").otherwise("yellow")


def lower_worse_color(value: Column, green_min: Column, red_max: Column) -> Column:
    """SC-05."""
    return F.when(_missing(value), "yellow").when(value >= green_min, "green").when(value <= red_max, "red").otherwise("yellow")


def target_range_color(value: Column, g_lo: Column, g_hi: Column, r_lo: Column, r_hi: Column) -> Column:
    """SC-06."""
    return (F.when(_missing(value), "yellow").when((value >= g_lo) & (value <= g_hi), "green")
            .when((value < r_lo) | (value > r_hi), "red").otherwise("yellow"))


def rule_color(variable: Column, value: Column, p_low: Column, p_high: Column, invert: Column,
               direction: Column, g1: Column, g2: Column, r1: Column, r2: Column) -> Column:
    """SC-07: returns struct(color, polarity, basis).

    Clinical rule when the variable has one (columns joined from ``rules_frame``),
    else score variables use the plain percentile light, else the percentile light
    with the variable's inversion flag."""
    clinical = (F.when(direction == HIGHER_WORSE, higher_worse_color(value, g1, r1))
                .when(direction == LOWER_WORSE, lower_worse_color(value, g1, r1))
                .otherwise(target_range_color(value, g1, g2, r1, r2)))
    is_score = variable.isin(SCORE_FEATURES) | variable.endswith("_score")
    color = (F.when(direction.isNotNull(), clinical)
             .when(is_score, percentile_color(value, p_low, p_high, F.lit(False)))
             .otherwise(percentile_color(value, p_low, p_high, invert)))
    polarity = (F.when(direction.isNotNull(), direction).when(is_score, F.lit(HIGHER_WORSE))
                .when(invert, F.lit(LOWER_WORSE)).otherwise(F.lit(HIGHER_WORSE)))
    basis = (F.when(direction.isNotNull(), F.lit("clinical_threshold"))
             .when(is_score, F.lit("percentile_score_fallback")).otherwise(F.lit("percentile_fallback")))
    return F.struct(color.alias("color"), polarity.alias("polarity"), basis.alias("basis"))


def confidence(u: Column, k1: float = ATLP_K1, k2: float = ATLP_K2) -> Column:
    """SC-01: high (u <= k1), low (u >= k2), else medium."""
    return F.when(u <= k1, "high").when(u >= k2, "low").otherwise("medium")


def darkening(u: Column, k1: float = ATLP_K1, k2: float = ATLP_K2) -> Column:
    """SC-02: pure / mid / dark; missing uncertainty is dark."""
    return F.when(_missing(u), "dark").when(u <= k1, "pure").when(u < k2, "mid").otherwise("dark")


def clipped_uncertainty(u: Column) -> Column:
    """SC-08: clip to [0, 1]; null, NaN and ±inf become 1."""
    bad = _missing(u) | (F.abs(u) == F.lit(float("inf")))
    return F.when(bad, F.lit(1.0)).otherwise(F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)))


def _to_byte(s: Column) -> Column:
    # Python's round() is half-to-even: bround
    return F.bround(F.least(F.greatest(s, F.lit(0.0)), F.lit(255.0)), 0).cast("int")


def primary_saturation(u: Column) -> Column:
    """SC-08: 80 + 125(1-x) + 50(1-x)^2 for red/green."""
    y = 1 - clipped_uncertainty(u)
    return _to_byte(80 + 125 * y + 50 * y * y)


def yellow_saturation(u: Column) -> Column:
    """SC-08: 180 + 180(1-x) - 143(1-x)^2 + 38(1-x)^3 for yellow."""
    y = 1 - clipped_uncertainty(u)
    return _to_byte(180 + 180 * y - 143 * y * y + 38 * y * y * y)


def hex_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def atlp_hex(label: Column, u: Column) -> Column:
    """SC-09: continuous aTLP colour; unknown labels are yellow."""
    p = primary_saturation(u)
    y = yellow_saturation(u)
    zero = F.lit(0)
    return (F.when(label == "red", hex_rgb(p, zero, zero)).when(label == "green", hex_rgb(zero, p, zero))
            .otherwise(hex_rgb(y, y, zero)))


def tlp_hex(label: Column) -> Column:
    """SC-09: discrete pure palette; unknown labels are yellow."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PURE_HEX.items() for x in kv]), label),
                      F.lit(PURE_HEX["yellow"]))


def hex_channels(hex_col: Column) -> Column:
    """SC-10: '#rrggbb' -> struct(r, g, b) in [0, 1]; malformed input is pure yellow."""
    h = F.regexp_replace(hex_col, "^#+", "")
    ok = F.length(h) == 6

    def ch(i):
        return F.conv(F.substring(h, i, 2), 16, 10).cast("double") / 255.0
    return F.when(ok, F.struct(ch(1).alias("r"), ch(3).alias("g"), ch(5).alias("b"))).otherwise(
        F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("g"), F.lit(0.0).alias("b")))


def readable_text_color(hex_col: Column) -> Column:
    """SC-10: black on light backgrounds (luminance >= 0.45), else white."""
    c = hex_channels(hex_col)
    lum = 0.2126 * c["r"] + 0.7152 * c["g"] + 0.0722 * c["b"]
    return F.when(lum >= 0.45, "black").otherwise("white")


def uncertainty_heat_hex(u: Column) -> Column:
    """SC-11: green (0) -> yellow (0.5) -> red (1) heat colour of an uncertainty."""
    x = clipped_uncertainty(u)
    red = F.when(x <= 0.5, F.bround(255 * x / 0.5, 0)).otherwise(F.lit(255.0)).cast("int")
    green = F.when(x <= 0.5, F.lit(255.0)).otherwise(F.bround(255 * (1 - (x - 0.5) / 0.5), 0)).cast("int")
    return hex_rgb(red, green, F.lit(0))


def cell_label(x: Column) -> Column:
    """SC-21: integer values without decimals, |x| >= 100 rounded to units, else one decimal."""
    return (F.when(_missing(x), F.lit(""))
            .when(x == F.floor(x), F.floor(x).cast("bigint").cast("string"))
            .when(F.abs(x) >= 100, F.format_string("%.0f", x))
            .otherwise(F.format_string("%.1f", x)))
