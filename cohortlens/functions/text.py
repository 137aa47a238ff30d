"""Text functions: normalisation, number parsing/formatting, measurement
extraction from report text, response validation and display cleaning.

Everything is a Column expression (JVM regex engine, inside codegen) except
the full Unicode NFKD fold, which has no SQL built-in and runs as an Arrow
batch UDF.  Texts are always processed whole.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number pattern and the measurement extraction rules, in order.
# (fields filled by the first match, ordered patterns; matching is case-insensitive)
NUM = r"([-+]?\d+(?:[,.]\d+)?)"
RULES = [
    (("heart_rate_min", "heart_rate_max"), (
        rf"(?:frecuencia\s+cardiaca|fc|heart\s+rate|hr)\s*[:=]?\s*{NUM}\s*(?:lpm|bpm)?",
        rf"(?:fc|hr)\s+{NUM}\s*(?:lpm|bpm)?")),
    (("temperature_min", "temperature_max"), (
        rf"(?:temperatura|temp\.?|temperature)\s*[:=]?\s*{NUM}\s*(?:c|celsius|degrees|deg)?",)),
    (("resp_rate_min", "resp_rate_max"), (
        rf"(?:frecuencia\s+respiratoria|fr|respiratory\s+rate|rr)\s*[:=]?\s*{NUM}\s*(?:rpm|irpm)?",)),
    (("hematocrit_min", "hematocrit_max"), (rf"(?:hematocrito|hto|hct|hematocrit)\s*[:=]?\s*{NUM}\s*%?",)),
    (("wbc_min", "wbc_max"), (rf"(?:leucocitos|leucocytes|wbc|white\s+blood\s+cells)\s*[:=]?\s*{NUM}",)),
    (("creatinine_min", "creatinine_max"), (rf"(?:creatinina|creatinine)\s*[:=]?\s*{NUM}\s*(?:mg/dl|umol/l)?",)),
    (("bun_min", "bun_max"), (rf"(?:bun|urea|nitrogeno\s+ureico)\s*[:=]?\s*{NUM}\s*(?:mg/dl)?",)),
    (("sodium_min", "sodium_max"), (rf"(?:\bsodio\b|\bna\+?\b|\bsodium\b)\s*[:=]?\s*{NUM}\s*(?:mmol/l|meq/l)?",)),
    (("glucose_min", "glucose_max"), (rf"(?:glucosa|glycemia|glucose)\s*[:=]?\s*{NUM}\s*(?:mg/dl|mmol/l)?",)),
    (("urineoutput",), (rf"(?:diuresis|diuresi|urine\s+output|uo)\s*[:=]?\s*{NUM}\s*(?:ml|ml/24h)?",)),
    (("gcs_eyes",), (rf"(?:gcs\s+ojos|glasgow\s+ojos|ocular|eyes?)\s*[:=]?\s*{NUM}",)),
    (("gcs_verbal",), (rf"(?:gcs\s+verbal|glasgow\s+verbal|verbal)\s*[:=]?\s*{NUM}",)),
    (("gcs_motor",), (rf"(?:gcs\s+motor|glasgow\s+motor|motor)\s*[:=]?\s*{NUM}",)),
    (("apsiii",), (rf"(?:apsiii|aps\s*iii)\s*[:=]?\s*{NUM}",)),
]
BLOOD_PRESSURE = rf"(?:ta|pa|presion\s+arterial|blood\s+pressure)\s*[:=]?\s*{NUM}\s*/\s*{NUM}"
MEAN_PRESSURE = rf"(?:pam|presion\s+arterial\s+media|mean\s+arterial\s+pressure|map)\s*[:=]?\s*{NUM}"
AGE = rf"(?:edad|age)\s*[:=]?\s*{NUM}"
SEPSIS = r"\b(sepsis|sepsia|septicemia)\b"
GENDER = r"(?:sexo|genero|gender)\s*[:=]?\s*(masculino|femenino|hombre|mujer|male|female|m|f)\b"
# Gender words -> code (male = 1, female = 0, other = 2).
GENDER_MALE = ["masculino", "hombre", "male", "m"]
GENDER_FEMALE = ["femenino", "mujer", "female", "f"]
# Fields whose absence is reported by the extraction audit.
CORE_FIELDS = ["heart_rate_max", "mbp_min", "temperature_max", "resp_rate_max", "hematocrit_max", "wbc_max",
               "creatinine_max", "bun_max", "sodium_min", "glucose_max", "urineoutput", "gcs_eyes", "gcs_verbal", "gcs_motor"]

# Validation of generated explanations.
REQUIRED_HEADERS = ["RIESGO:", "LECTURA CLINICA:", "CONDUCTA RECOMENDADA:", "VIGILAR / COMPLETAR:"]
ALLOWED_NON_ASCII = "áéíóúÁÉÍÓÚñÑüÜçÇàèòÀÈÒ¿¡ºª"
LANGUAGE_MARKERS = ["PACIENTE", "RIESGO", "CLINICA", "VALORAR", "VIGILAR", "REVISAR", "MORTALIDAD", "FENOTIPO"]
FALLBACK_RESPONSE = (
    "RIESGO:\n"
    "No se ha podido generar una lectura clinica fiable automaticamente.\n\n"
    "LECTURA CLINICA:\n"
    "La respuesta del modelo de lenguaje no ha superado la validacion de idioma "
    "o formato, por lo que debe descartarse.\n\n"
    "CONDUCTA RECOMENDADA:\n"
    "- Hacer ahora: revisar manualmente la probabilidad, el grupo de riesgo y el fenotipo.\n"
    "- Valorar segun clinica: completar datos criticos del paciente.\n"
    "- No indicado de rutina: usar una respuesta generativa no validada.\n\n"
    "VIGILAR / COMPLETAR:\n"
    "Validar el caso con criterio clinico."
)
# Display cleaning of explanation text.
DEFAULT_DISPLAY_TEXT = "Sin explicación clínica disponible."
DISPLAY_MAX_LINES = 8
RISK_KEYS = ["low", "medium", "high"]
CONTEXT_MARKER = "CONTEXTO DEL CASO"


# ------------------------------------------------------------- normalise ----

FOLDED_AT_ONCE = 64  # texts of a batch held as Python strings


@F.arrow_udf(T.StringType())
def ascii_fold(s: pa.Array) -> pa.Array:
    """NFKD decomposition, then drop every non-ASCII code point (Arrow batches).  ASCII texts stay in their buffers; of the
    others a few at a time are Python strings, so a worker holds a batch and its result, not their copies."""
    parts = []
    for low in range(0, len(s), FOLDED_AT_ONCE):
        some = s.slice(low, FOLDED_AT_ONCE)
        if pc.all(pc.string_is_ascii(some)).as_py() is not False:
            parts.append(some)
        else:
            parts.append(pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii")
                                   for t in some.to_pylist()], s.type))
    return pa.concat_arrays(parts) if parts else s


def normalise_text(text: Column) -> Column:
    """TX-01: NBSP -> space, NFKD accent strip to ASCII, runs of blanks/tabs -> one space."""
    return F.regexp_replace(ascii_fold(F.regexp_replace(text, "\u00a0", " ")), "[ \t]+", " ")


def parse_number(raw: Column) -> Column:
    """TX-02: trim, comma -> point, invalid -> null."""
    return F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), ",", ".").try_cast("double")


@F.pandas_udf(T.StringType())
def _format_g6(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if pd.isna(x) else (str(int(x)) if float(x).is_integer()
                                                   else f"{float(x):.6g}".replace(".", ",")))


def format_number(x: Column) -> Column:
    """TX-03: integers without decimals, otherwise '%.6g' (6 significant digits, rounded
    on the exact binary value) with a decimal comma.  Java's formatter rounds the shortest
    decimal form half-up, which differs on ties, so this small helper runs in Arrow batches."""
    return _format_g6(x.cast("double"))


def first_number(text: Column, patterns, flags: str = "(?i)") -> Column:
    """TX-04: value of the first pattern (in order) that matches, case-insensitive."""
    return F.coalesce(*[parse_number(F.nullif(F.regexp_extract(text, flags + p, 1), F.lit(""))) for p in patterns])


def gender_code(word: Column) -> Column:
    w = F.lower(F.regexp_replace(word, r"^\s+|\s+$", ""))
    return F.when(w.isin(GENDER_MALE), 1).when(w.isin(GENDER_FEMALE), 0).otherwise(2)


def extract_measurements(text: Column, normalise: bool = True) -> dict[str, Column]:
    """TX-05..07: every rule's first match fans out to its fields; blood pressure s/d gives
    (s + 2d)/3, an explicit mean pressure overrides it; age kept within 0..120; sepsis
    keyword flag; gender code.

    After the ASCII fold the text is pure ASCII, so it is lower-cased once and the
    (lower-case) patterns match case-sensitively: the same matches as case-insensitive
    matching, without per-character case folding in every one of the ~40 scans."""
    if normalise:
        t, flags = F.lower(normalise_text(text)), ""
    else:
        t, flags = text, "(?i)"
    out: dict[str, Column] = {}
    for fields, patterns in RULES:
        v = first_number(t, patterns, flags)
        for f in fields:
            out[f] = v
    s = parse_number(F.nullif(F.regexp_extract(t, flags + BLOOD_PRESSURE, 1), F.lit("")))
    d = parse_number(F.nullif(F.regexp_extract(t, flags + BLOOD_PRESSURE, 2), F.lit("")))
    mbp = F.coalesce(first_number(t, [MEAN_PRESSURE], flags), (s + 2 * d) / 3)
    out["mbp_min"] = mbp
    out["mbp_max"] = mbp
    age = first_number(t, [AGE], flags)
    out["admission_age"] = F.when((age >= 0) & (age <= 120), age)
    out["sepsis3"] = F.when(t.rlike(flags + SEPSIS), F.lit(1.0))
    g = F.nullif(F.regexp_extract(t, flags + GENDER, 1), F.lit(""))
    out["gender"] = F.when(g.isNotNull(), gender_code(g).cast("double"))
    return out


def pattern_keywords(pattern: str) -> list[str] | None:
    """Literal lower-case words one of which must occur for ``pattern`` to match: the
    leading literal of every alternative of the pattern's first group (None if some
    alternative has no literal prefix).  Used as a cheap byte-level prefilter."""
    if not pattern.startswith("(?:"):
        return None
    depth, end = 0, None
    for i, ch in enumerate(pattern):
        if ch == "(" and (i == 0 or pattern[i - 1] != "\\"):
            depth += 1
        elif ch == ")" and pattern[i - 1] != "\\":
            depth -= 1
            if depth == 0:
                end = i
                break
    if end is None:
        return None
    words = []
    for alt in pattern[3:end].split("|"):
        alt = alt[2:] if alt.startswith("\\b") else alt
        lit = ""
        for j, ch in enumerate(alt):
            if not ch.isalpha():
                break
            if j + 1 < len(alt) and alt[j + 1] in "?*":
                break
            lit += ch
        if not lit:
            return None
        words.append(lit)
    return words


def _guarded_extract(t: Column, low: Column, pattern: str, flags: str, group: int = 1) -> Column:
    kws = pattern_keywords(pattern)
    ex = F.regexp_extract(t, flags + pattern, group)
    if not kws:
        return ex
    cond = F.lit(False)
    for k in sorted(set(kws)):
        cond = cond | low.contains(k)
    return F.when(cond, ex).otherwise(F.lit(""))


def extract_frame(df, text: str, keep: list[str], normalise: bool = True):
    """TX-05..07 as staged projections (same results as ``extract_measurements``):
    (1) fold + lower-case the text once, (2) run every pattern once into a raw match
    column, (3) parse and combine.  Each stage references the previous one's columns
    more than once, so Catalyst keeps the regex work in its own projection instead of
    re-evaluating it inside conditional branches."""
    if normalise:
        t, flags = F.lower(normalise_text(F.col(text))), ""
    else:
        t, flags = F.col(text), "(?i)"
    s0 = df.select(*keep, t.alias("__t"))
    s0 = s0.withColumn("__l", F.col("__t") if normalise else F.lower("__t"))
    pats = [p for _, ps in RULES for p in ps] + [MEAN_PRESSURE, AGE]
    tc, lc = F.col("__t"), F.col("__l")
    s1 = s0.select(*keep, *[_guarded_extract(tc, lc, p, flags).alias(f"__m{i}") for i, p in enumerate(pats)],
                   _guarded_extract(tc, lc, BLOOD_PRESSURE, flags, 1).alias("__bs"),
                   _guarded_extract(tc, lc, BLOOD_PRESSURE, flags, 2).alias("__bd"),
                   (lc.contains("seps") & tc.rlike(flags + SEPSIS)).alias("__sep"),
                   _guarded_extract(tc, lc, GENDER, flags).alias("__g"))

    def num(c):
        m = F.col(c)
        return F.when(m != "", F.translate(m, ",", ".").try_cast("double"))
    s2 = s1.select(*keep, *[num(f"__m{i}").alias(f"__v{i}") for i in range(len(pats))], num("__bs").alias("__s"),
                   num("__bd").alias("__d"), "__sep", F.when(F.col("__g") != "", gender_code(F.col("__g")).cast("double")).alias("gender"))
    out, i = [], 0
    for fields, ps in RULES:
        v = F.coalesce(*[F.col(f"__v{i + j}") for j in range(len(ps))]) if len(ps) > 1 else F.col(f"__v{i}")
        i += len(ps)
        out += [v.alias(f) for f in fields]
    mbp = F.coalesce(F.col(f"__v{i}"), (F.col("__s") + 2 * F.col("__d")) / 3)
    age = F.col(f"__v{i + 1}")
    out += [mbp.alias("mbp_min"), mbp.alias("mbp_max"), F.when((age >= 0) & (age <= 120), age).alias("admission_age"),
            F.when(F.col("__sep"), F.lit(1.0)).alias("sepsis3"), F.col("gender")]
    return s2.select(*keep, *out)


def extraction_audit(values: dict[str, Column], text: Column) -> dict[str, Column]:
    """TX-08: sorted extracted field names, their count, sorted missing core fields, text length."""
    names = sorted(values)
    found = F.array_sort(F.filter(F.array(*[F.when(values[n].isNotNull(), F.lit(n)) for n in names]),
                                  lambda x: x.isNotNull()))
    core = F.array(*[F.lit(c) for c in sorted(CORE_FIELDS)])
    return {"extracted_fields": found, "extracted_field_count": F.size(found),
            "missing_core_fields": F.array_sort(F.array_except(core, found)), "text_characters": F.length(text)}


# ------------------------------------------------------------- validation ---

def validation_fold(text: Column) -> Column:
    """Upper case with the two accented header words folded."""
    return F.replace(F.replace(F.upper(text), F.lit("CLÍNICA"), F.lit("CLINICA")), F.lit("SEGÚN"), F.lit("SEGUN"))


def has_required_headers(text: Column) -> Column:
    """TX-11."""
    u = validation_fold(text)
    cond = F.lit(True)
    for h in REQUIRED_HEADERS:
        cond = cond & F.contains(u, F.lit(h))
    return cond


def suspicious_ratio(text: Column) -> Column:
    """TX-12: non-ASCII characters outside the allow-list / non-whitespace characters."""
    checked = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    bad = F.length(F.regexp_replace(text, rf"(?U)[\x00-\x7F{ALLOWED_NON_ASCII}]|\s", ""))
    return F.when(text.isNull() | (F.length(text) == 0) | (checked == 0), F.lit(1.0)).otherwise(bad / checked)


def marker_count(text: Column) -> Column:
    u = validation_fold(text)
    return sum(F.when(F.contains(u, F.lit(m)), 1).otherwise(0) for m in LANGUAGE_MARKERS)


def looks_spanish(text: Column) -> Column:
    """TX-13: at least 3 of the 8 clinical markers."""
    return marker_count(text) >= 3


def strip_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_valid_response(text: Column) -> Column:
    """TX-14: length >= 40 after trimming, headers, ratio <= 0.03, language markers."""
    c = strip_blank(text)
    return F.coalesce((F.length(c) >= 40) & has_required_headers(c) & (suspicious_ratio(c) <= 0.03) & looks_spanish(c),
                      F.lit(False))


def accepted_response(text: Column) -> Column:
    """TX-14: the text when valid, else the fixed fallback response."""
    return F.when(is_valid_response(text), text).otherwise(F.lit(FALLBACK_RESPONSE))


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def display_lines(text: Column) -> Column:
    """TX-15: drop bold marks, a leading 'Aquí tienes...' line and everything from
    'Frases preferidas:'; split into trimmed non-empty lines, keep 8, HTML-escape,
    drop a leading list marker."""
    t = F.when(text.isNull() | (text == ""), F.lit(DEFAULT_DISPLAY_TEXT)).otherwise(text)
    t = F.regexp_replace(t, r"\*\*", "")
    t = F.regexp_replace(t, r"(?i)Aquí tienes.*?\n", "")
    t = F.regexp_replace(t, r"(?i)Frases preferidas:[\s\S]*$", "")
    t = strip_blank(t)
    lines = F.filter(F.transform(F.split(t, r"\n+"), strip_blank), lambda x: x != "")
    return F.transform(F.slice(lines, 1, DISPLAY_MAX_LINES), lambda x: F.regexp_replace(escape_html(x), r"^[-*]\s*", ""))


def normalize_risk(risk: Column) -> Column:
    """TX-16: known risk key (lower case) or 'medium'."""
    k = F.lower(F.coalesce(risk.cast("string"), F.lit("")))
    return F.when(k.isin(RISK_KEYS), k).otherwise(F.lit("medium"))


def case_context_json(prompt: Column) -> Column:
    """SC-20: the JSON text that follows the first '{' after the context marker (null if absent)."""
    pos = F.instr(prompt, CONTEXT_MARKER)
    section = F.substring(prompt, pos + len(CONTEXT_MARKER), 1 << 30)
    j = F.instr(section, "{")
    return F.when((pos > 0) & (j > 0), strip_blank(F.substring(section, j, 1 << 30)))


def name_ok(name: Column) -> Column:
    """TX-10 name rule: letters (with Spanish accents), spaces and hyphens only."""
    return F.coalesce(name.rlike(r"^[a-zA-ZáéíóúÁÉÍÓÚñÑ\s\-]+$"), F.lit(False))
