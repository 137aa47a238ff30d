"""Registered text queries.

Measurement extraction runs on report text generated from cohort columns
(one SQL expression valid in both Spark SQL and DuckDB, so both engines see
byte-identical reports) and on the whole ``documents`` texts.  Validation and
display cleaning run on the whole ``conversations`` texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..sources.tables import cohort, table, with_cohort
from .registry import query

REPORT_EXPR = """concat_ws(chr(10),
 'Informe clinico del paciente',
 CASE WHEN quantity_max IS NOT NULL THEN 'FC: ' || CAST(CAST(floor(quantity_max) AS INT) AS STRING) || ' lpm' END,
 CASE WHEN quantity_min IS NOT NULL THEN 'Temp ' || replace(printf('%.1f', 35 + quantity_min / 10), '.', ',') END,
 CASE WHEN quantity_max IS NOT NULL THEN 'TA ' || CAST(CAST(floor(80 + quantity_max) AS INT) AS STRING) || '/'
      || CAST(CAST(floor(40 + quantity_min) AS INT) AS STRING) END,
 CASE WHEN discount_max >= 0.09 THEN 'PAM: ' || CAST(CAST(floor(60 + quantity_min) AS INT) AS STRING) END,
 CASE WHEN tax_max IS NOT NULL THEN 'Creatinina: ' || replace(printf('%.2f', tax_max * 10), '.', ',') || ' mg/dl' END,
 CASE WHEN quantity_min IS NOT NULL THEN 'Edad: ' || CAST(CAST(floor(quantity_min * 3) AS INT) AS STRING) END,
 CASE WHEN has_return = 1 THEN 'Sospecha de sepsis' ELSE 'Sin foco claro' END,
 'Sexo: ' || CASE WHEN cat_priority IN ('1-URGENT', '2-HIGH') THEN 'M' ELSE 'F' END,
 CASE WHEN price_min IS NOT NULL THEN 'Sodio ' || CAST(CAST(floor(125 + quantity_max / 2) AS INT) AS STRING) || ' mmol/l' END,
 CASE WHEN price_max IS NOT NULL THEN 'Glucosa: ' || CAST(CAST(floor(price_max / 500) AS INT) AS STRING) END,
 'Diuresis ' || CAST(CAST(floor(totalprice / 100) AS INT) AS STRING) || ' ml')"""


def reports(spark, sf_dir):
    return cohort(spark, sf_dir).select("row_id", F.expr(REPORT_EXPR).alias("text"))


NORM_SQL_EXPR = ("regexp_replace(regexp_replace(strip_accents(replace(text, chr(160), ' ')), '[^\\x00-\\x7F]', '', 'g'), "
                 "'[ \\t]+', ' ', 'g')")
REPORTS_CTE = with_cohort(f", reports AS (SELECT row_id, {REPORT_EXPR} AS text FROM cohort)\n", clustered=False)


def _sql_num(expr):
    return f"TRY_CAST(replace(trim(nullif({expr}, '')), ',', '.') AS DOUBLE)"


def _sql_first(patterns, col="text"):
    parts = [_sql_num(f"regexp_extract({col}, '(?i)' || '{p}', 1)") for p in patterns]
    return parts[0] if len(parts) == 1 else f"coalesce({', '.join(parts)})"


def _sql_fields():
    cols = {}
    for fields, patterns in TX.RULES:
        for f in fields:
            cols[f] = _sql_first(patterns)
    s = _sql_num(f"regexp_extract(text, '(?i)' || '{TX.BLOOD_PRESSURE}', 1)")
    d = _sql_num(f"regexp_extract(text, '(?i)' || '{TX.BLOOD_PRESSURE}', 2)")
    mbp = f"coalesce({_sql_first([TX.MEAN_PRESSURE])}, ({s} + 2 * {d}) / 3)"
    cols["mbp_min"] = mbp
    cols["mbp_max"] = mbp
    age = _sql_first([TX.AGE])
    cols["admission_age"] = f"CASE WHEN {age} BETWEEN 0 AND 120 THEN {age} END"
    cols["sepsis3"] = f"CASE WHEN regexp_matches(text, '(?i)' || '{TX.SEPSIS}') THEN 1.0::DOUBLE END"
    g = f"lower(nullif(regexp_extract(text, '(?i)' || '{TX.GENDER}', 1), ''))"
    male = ", ".join(f"'{w}'" for w in TX.GENDER_MALE)
    female = ", ".join(f"'{w}'" for w in TX.GENDER_FEMALE)
    cols["gender"] = (f"CASE WHEN {g} IN ({male}) THEN 1.0::DOUBLE WHEN {g} IN ({female}) THEN 0.0::DOUBLE "
                     f"WHEN {g} IS NOT NULL THEN 2.0::DOUBLE END")
    return cols


FIELDS_SQL = _sql_fields()
EXTRACT_SQL = REPORTS_CTE + "SELECT row_id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in FIELDS_SQL.items()) + " FROM reports"


def extracted(spark, sf_dir):
    return TX.extract_frame(reports(spark, sf_dir), "text", ["row_id", "text"])


@query("tx05_extract_measurements", EXTRACT_SQL)
def tx05_extract_measurements(spark, sf_dir):
    """14 rules + blood pressure + age/sepsis/gender from generated report text."""
    return extracted(spark, sf_dir).drop("text")


DOCS_EXTRACT_SQL = (f"WITH reports AS (SELECT doc_id, lower({NORM_SQL_EXPR}) AS text FROM documents)\n"
                    "SELECT doc_id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in FIELDS_SQL.items()) + " FROM reports")


@query("tx05_extract_documents", DOCS_EXTRACT_SQL)
def tx05_extract_documents(spark, sf_dir):
    """The same extraction over every whole document text."""
    return TX.extract_frame(table(spark, sf_dir, "documents"), "text", ["doc_id"])


@query("tx06_blood_pressure", REPORTS_CTE + f"SELECT row_id, round({FIELDS_SQL['mbp_min']}, 6) AS mbp FROM reports")
def tx06_blood_pressure(spark, sf_dir):
    return extracted(spark, sf_dir).select("row_id", F.col("mbp_min").alias("mbp"))


@query("tx07_age_sepsis_gender", REPORTS_CTE + "SELECT row_id, " + ", ".join(
    f"{FIELDS_SQL[k]} AS {k}" for k in ("admission_age", "sepsis3", "gender")) + " FROM reports")
def tx07_age_sepsis_gender(spark, sf_dir):
    return extracted(spark, sf_dir).select("row_id", "admission_age", "sepsis3", "gender")


@query("tx04_first_match", REPORTS_CTE + f"SELECT row_id, {_sql_first(TX.RULES[0][1])} AS heart_rate FROM reports")
def tx04_first_match(spark, sf_dir):
    return reports(spark, sf_dir).select("row_id", TX.first_number(F.col("text"), TX.RULES[0][1]).alias("heart_rate"))


_names = sorted(FIELDS_SQL)
AUDIT_SQL = REPORTS_CTE + f"""
, f AS (SELECT row_id, length(text) AS text_characters, list_filter([{", ".join(
    f"CASE WHEN ({FIELDS_SQL[n]}) IS NOT NULL THEN '{n}' END" for n in _names)}], lambda x: x IS NOT NULL) AS found FROM reports)
SELECT row_id, array_to_string(list_sort(found), ',') AS extracted_fields, CAST(len(found) AS INTEGER) AS extracted_field_count,
       array_to_string(list_sort(list_filter([{", ".join(f"'{c}'" for c in sorted(TX.CORE_FIELDS))}],
                                             lambda x: NOT list_contains(found, x))), ',') AS missing_core_fields,
       CAST(text_characters AS INTEGER) AS text_characters
FROM f
"""


@query("tx08_extraction_audit", AUDIT_SQL)
def tx08_extraction_audit(spark, sf_dir):
    e = extracted(spark, sf_dir)
    vals = {k: F.col(k) for k in e.columns if k not in ("row_id", "text")}
    a = TX.extraction_audit(vals, F.col("text"))
    return e.select("row_id", F.array_join(a["extracted_fields"], ",").alias("extracted_fields"),
                    a["extracted_field_count"].alias("extracted_field_count"),
                    F.array_join(a["missing_core_fields"], ",").alias("missing_core_fields"),
                    a["text_characters"].alias("text_characters"))


PARSE_SQL = with_cohort("""
SELECT row_id, TRY_CAST(replace(trim(s), ',', '.') AS DOUBLE) AS parsed FROM
  (SELECT row_id, CASE WHEN quantity_max IS NULL THEN 'n/a' ELSE ' ' || replace(CAST(tax_max AS VARCHAR), '.', ',') || ' ' END AS s
   FROM cohort)
""", clustered=False)


@query("tx02_parse_number", PARSE_SQL)
def tx02_parse_number(spark, sf_dir):
    c = cohort(spark, sf_dir)
    s = F.when(F.col("quantity_max").isNull(), F.lit("n/a")).otherwise(
        F.concat(F.lit(" "), F.regexp_replace(F.col("tax_max").cast("string"), r"\.", ","), F.lit(" ")))
    return c.select("row_id", TX.parse_number(s).alias("parsed"))


FORMAT_SQL = with_cohort("""
SELECT row_id, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE replace(printf('%.6g', v), '.', ',') END AS formatted
FROM (SELECT row_id, totalprice / 7 AS v FROM cohort)
""", clustered=False)


@query("tx03_format_number", FORMAT_SQL)
def tx03_format_number(spark, sf_dir):
    """'%g'-style 6 significant digits with decimal comma on order value / 7."""
    c = cohort(spark, sf_dir)
    return c.select("row_id", TX.format_number(F.col("totalprice") / 7).alias("formatted"))


def conv(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


_FOLD = "replace(replace(upper(text), 'CLÍNICA', 'CLINICA'), 'SEGÚN', 'SEGUN')"
VALID_SQL = f"""
SELECT conv_id, turn,
       {" AND ".join(f"contains({_FOLD}, '{h}')" for h in TX.REQUIRED_HEADERS)} AS has_headers,
       CAST(({" + ".join(f"CASE WHEN contains({_FOLD}, '{m}') THEN 1 ELSE 0 END" for m in TX.LANGUAGE_MARKERS)}) AS INTEGER) AS markers,
       ({" + ".join(f"CASE WHEN contains({_FOLD}, '{m}') THEN 1 ELSE 0 END" for m in TX.LANGUAGE_MARKERS)}) >= 3 AS looks_spanish
FROM conversations
"""


@query("tx11_tx13_header_and_marker_checks", VALID_SQL)
def tx11_tx13_header_and_marker_checks(spark, sf_dir):
    t = F.col("text")
    return conv(spark, sf_dir).select("conv_id", "turn", TX.has_required_headers(t).alias("has_headers"),
                                      TX.marker_count(t).cast("int").alias("markers"), TX.looks_spanish(t).alias("looks_spanish"))


RATIO_SQL = f"""
SELECT conv_id, turn, round(CASE WHEN text IS NULL OR length(text) = 0 OR length(regexp_replace(text, '\\s', '', 'g')) = 0 THEN 1.0
  ELSE length(regexp_replace(text, '[\\x00-\\x7F{TX.ALLOWED_NON_ASCII}]|\\s', '', 'g')) / length(regexp_replace(text, '\\s', '', 'g'))
  END, 6) AS suspicious_ratio
FROM conversations
"""


@query("tx12_suspicious_ratio", RATIO_SQL)
def tx12_suspicious_ratio(spark, sf_dir):
    return conv(spark, sf_dir).select("conv_id", "turn", TX.suspicious_ratio(F.col("text")).alias("suspicious_ratio"))


def _sql_lit(text):
    return "(" + " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n")) + ")"


_CLEAN = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_CFOLD = f"replace(replace(upper({_CLEAN}), 'CLÍNICA', 'CLINICA'), 'SEGÚN', 'SEGUN')"
_CHECKED = f"length(regexp_replace({_CLEAN}, '\\s', '', 'g'))"
_BAD = f"length(regexp_replace({_CLEAN}, '[\\x00-\\x7F{TX.ALLOWED_NON_ASCII}]|\\s', '', 'g'))"
_VALID = (f"coalesce(length({_CLEAN}) >= 40 AND " + " AND ".join(f"contains({_CFOLD}, '{h}')" for h in TX.REQUIRED_HEADERS)
          + f" AND (CASE WHEN length({_CLEAN}) = 0 OR {_CHECKED} = 0 THEN 1.0 ELSE {_BAD} / {_CHECKED} END) <= 0.03 AND ("
          + " + ".join(f"CASE WHEN contains({_CFOLD}, '{m}') THEN 1 ELSE 0 END" for m in TX.LANGUAGE_MARKERS) + ") >= 3, false)")
ACCEPT_SQL = (f"SELECT conv_id, turn, {_VALID} AS is_valid, CASE WHEN {_VALID} THEN text ELSE {_sql_lit(TX.FALLBACK_RESPONSE)} END "
              "AS accepted_text FROM conversations")


@query("tx14_response_acceptance", ACCEPT_SQL)
def tx14_response_acceptance(spark, sf_dir):
    """Accepted text or the fixed fallback, for every whole conversation turn."""
    t = F.col("text")
    return conv(spark, sf_dir).select("conv_id", "turn", TX.is_valid_response(t).alias("is_valid"),
                                      TX.accepted_response(t).alias("accepted_text"))


CLEAN_SQL = f"""
WITH t0 AS (SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN '{TX.DEFAULT_DISPLAY_TEXT}' ELSE text END AS t
            FROM conversations),
t1 AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\*\\*', '', 'g'),
            '(?i)Aquí tienes.*?\\n', '', 'g'), '(?i)Frases preferidas:[\\s\\S]*$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM t0),
t2 AS (SELECT conv_id, turn, list_slice(list_filter(list_transform(string_split_regex(t, '\\n+'),
            lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), 1, 8) AS l FROM t1)
SELECT conv_id, turn, array_to_string(list_transform(l, lambda x: regexp_replace(
         replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '^[-*]\\s*', '')), chr(10)) AS display_text,
       CAST(len(l) AS INTEGER) AS n_lines
FROM t2
"""


@query("tx15_display_lines", CLEAN_SQL)
def tx15_display_lines(spark, sf_dir):
    lines = TX.display_lines(F.col("text"))
    return conv(spark, sf_dir).select("conv_id", "turn", F.array_join(lines, "\n").alias("display_text"),
                                      F.size(lines).cast("int").alias("n_lines"))


RISK_SQL = """
SELECT event_id, CASE WHEN lower(coalesce(r, '')) IN ('low', 'medium', 'high') THEN lower(r) ELSE 'medium' END AS risk
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'LOW' WHEN 'view' THEN 'High' ELSE event_type END AS r FROM events)
"""


@query("tx16_normalize_risk", RISK_SQL)
def tx16_normalize_risk(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = F.when(F.col("event_type") == "click", "LOW").when(F.col("event_type") == "view", "High").otherwise(F.col("event_type"))
    return e.select("event_id", TX.normalize_risk(r).alias("risk"))


NORM_SQL = f"SELECT doc_id, {NORM_SQL_EXPR} AS text FROM documents"


@query("tx01_normalise_text", NORM_SQL)
def tx01_normalise_text(spark, sf_dir):
    """Full NFKD fold of every whole document.  The oracle folds with DuckDB's accent
    stripping, which equals NFKD + ASCII filter on these Latin-script texts."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.normalise_text(F.col("text")).alias("text"))


FORM_SQL = with_cohort(f"""
, reports AS (SELECT row_id, {REPORT_EXPR} AS text, quantity_min, cat_region, cat_priority FROM cohort)
, x AS (SELECT row_id, {FIELDS_SQL['admission_age']} AS age, {FIELDS_SQL['gender']} AS gender, quantity_min,
               cat_region, cat_priority FROM reports)
SELECT row_id,
       CASE WHEN quantity_min IS NOT NULL THEN quantity_min + 50 ELSE age END AS admission_age,
       CASE WHEN cat_priority = '3-MEDIUM' THEN 2.0::DOUBLE WHEN cat_priority LIKE '1%' THEN 1.0::DOUBLE
            WHEN cat_priority LIKE '2%' THEN 0.0::DOUBLE ELSE gender END AS gender,
       CASE WHEN regexp_matches(cat_region, '^[0-9]+$') THEN cat_region END AS ethnicity,
       coalesce(age, quantity_min + 50) AS legacy_admission_age
FROM x
""", clustered=False)


@query("tx09_form_overlay", FORM_SQL)
def tx09_form_overlay(spark, sf_dir):
    """Form values overlay the extracted record: age and gender replace, ethnicity only
    when numeric; the legacy rule fills only blanks."""
    c = cohort(spark, sf_dir)
    r = c.select("row_id", F.expr(REPORT_EXPR).alias("text"), "quantity_min", "cat_region", "cat_priority")
    vals = TX.extract_measurements(F.col("text"))
    form_age = F.col("quantity_min") + 50
    form_gender = F.when(F.col("cat_priority").startswith("1"), "hombre").when(
        F.col("cat_priority").startswith("2"), "mujer").when(F.col("cat_priority") == "3-MEDIUM", "otro")
    return r.select(
        "row_id",
        F.when(form_age.isNotNull(), form_age.cast("double")).otherwise(vals["admission_age"]).alias("admission_age"),
        F.when(form_gender.isNotNull(), TX.gender_code(form_gender).cast("double")).otherwise(vals["gender"]).alias("gender"),
        F.when(F.col("cat_region").rlike("^[0-9]+$"), F.col("cat_region")).alias("ethnicity"),
        F.coalesce(vals["admission_age"], form_age.cast("double")).alias("legacy_admission_age"))


VALIDATE_SQL = """
, forms AS (SELECT c_custkey AS form_id,
                   CASE WHEN c_acctbal < 0 THEN c_name ELSE regexp_replace(c_name, '#.*', '') END AS nombre,
                   lower(c_mktsegment) AS apellido, c_nationkey * 6 AS edad, c_acctbal / 40 AS altura,
                   abs(c_acctbal) / 30 AS peso, CASE WHEN c_nationkey % 7 = 0 THEN '' ELSE 'x' END AS genero,
                   CAST(c_nationkey AS VARCHAR) AS etnia FROM customer)
SELECT form_id,
       coalesce(regexp_full_match(nombre, '[a-zA-ZáéíóúÁÉÍÓÚñÑ\\s\\-]+'), false) AS name_ok,
       coalesce(regexp_full_match(apellido, '[a-zA-ZáéíóúÁÉÍÓÚñÑ\\s\\-]+'), false) AS surname_ok,
       edad BETWEEN 18 AND 130 AS age_ok, altura BETWEEN 50 AND 250 AS height_ok, peso BETWEEN 30 AND 300 AS weight_ok,
       coalesce(genero, '') <> '' AS gender_ok, coalesce(etnia, '') <> '' AS ethnicity_ok
FROM forms
"""


@query("tx10_form_validation", "WITH x AS (SELECT 1)" + VALIDATE_SQL)
def tx10_form_validation(spark, sf_dir):
    """Form rule checks on customer-derived form rows (every rule evaluated, not first failure)."""
    c = table(spark, sf_dir, "customer")
    nombre = F.when(F.col("c_acctbal") < 0, F.col("c_name")).otherwise(F.regexp_replace("c_name", "#.*", ""))
    edad, altura, peso = F.col("c_nationkey") * 6, F.col("c_acctbal") / 40, F.abs("c_acctbal") / 30
    genero = F.when(F.col("c_nationkey") % 7 == 0, F.lit("")).otherwise(F.lit("x"))
    etnia = F.col("c_nationkey").cast("string")
    return c.select(F.col("c_custkey").alias("form_id"), TX.name_ok(nombre).alias("name_ok"),
                    TX.name_ok(F.lower("c_mktsegment")).alias("surname_ok"),
                    edad.between(18, 130).alias("age_ok"), altura.between(50, 250).alias("height_ok"),
                    peso.between(30, 300).alias("weight_ok"), (F.coalesce(genero, F.lit("")) != "").alias("gender_ok"),
                    (F.coalesce(etnia, F.lit("")) != "").alias("ethnicity_ok"))


@query("tx13_language_markers", f"SELECT conv_id, turn, markers, looks_spanish FROM ({VALID_SQL}) t")
def tx13_language_markers(spark, sf_dir):
    """At least 3 of the 8 clinical markers, on every whole conversation turn."""
    t = F.col("text")
    return conv(spark, sf_dir).select("conv_id", "turn", TX.marker_count(t).cast("int").alias("markers"),
                                      TX.looks_spanish(t).alias("looks_spanish"))
