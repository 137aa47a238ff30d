"""Registered ingest, schema, context, history and streaming queries.

File-based operators write data that Spark derives from the driver tables
into a fresh folder under the shared checkpoint directory and read it back;
their oracle is the same data computed directly from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import classify as CF
from ..operators import context as CX
from ..operators import quality as Q
from ..operators import schema as SC
from ..sources import ingest as IO
from ..sources.tables import cohort, segment_cluster, table, with_cohort
from .registry import query

ROUND_COLS = ["row_id", "cat_priority", "totalprice", "acctbal", "quantity_max"]
ROUND_SQL = with_cohort(f"SELECT {', '.join(ROUND_COLS)} FROM cohort", clustered=False)


def _roundtrip(spark, sf_dir, sep, decimal, extra=None):
    df = cohort(spark, sf_dir).select(*ROUND_COLS)
    if extra:
        df = df.withColumn(extra, F.col("row_id"))
    path = IO.write_delimited(df, IO.scratch_path(spark, "ingest"), sep=sep, decimal=decimal, files=4)
    return spark, path


@query("src01_sniffed_csv_roundtrip", ROUND_SQL)
def src01_sniffed_csv_roundtrip(spark, sf_dir):
    """';' + decimal-comma CSV written from the cohort, read back with sniffing and typing."""
    _, path = _roundtrip(spark, sf_dir, ";", ",")
    return IO.load_delimited(spark, path)


@query("src02_fallback_loader", ROUND_SQL)
def src02_fallback_loader(spark, sf_dir):
    """',' CSV with an 'H1' id column: ';' read gives one column -> re-read with ',', ids dropped."""
    _, path = _roundtrip(spark, sf_dir, ",", ".", extra="H1")
    return IO.load_with_fallback(spark, path)


def _blank_header_file(spark, sf_dir):
    c = cohort(spark, sf_dir).select("row_id", "totalprice")
    header = spark.range(1).select(F.lit(-1).cast("bigint").alias("k"), F.lit(";row_id;totalprice").alias("value"))
    lines = c.select(F.col("row_id").alias("k"), F.concat_ws(";", F.col("row_id").cast("string"), F.col("row_id").cast("string"),
                                                              F.regexp_replace(F.col("totalprice").cast("string"), r"\.", ",")).alias("value"))
    path = IO.scratch_path(spark, "ingest")
    header.unionByName(lines).orderBy("k").coalesce(1).select("value").write.text(path)
    return path


@query("src03_blank_header", with_cohort("SELECT row_id AS \"Unnamed: 0\", row_id, totalprice FROM cohort", clustered=False))
def src03_blank_header(spark, sf_dir):
    """A file whose first header cell is blank: that column is renamed 'Unnamed: 0'."""
    return IO.load_delimited(spark, _blank_header_file(spark, sf_dir), blank_header="rename")


ROWID_SQL = with_cohort("SELECT row_id, CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS rid FROM cohort", clustered=False)


@query("src04_row_id", ROWID_SQL)
def src04_row_id(spark, sf_dir):
    """File-order row ids 0..n-1 on a multi-file read, for files of unequal size written in key order."""
    path = IO.scratch_path(spark, "ordered")
    ordered = cohort(spark, sf_dir).select("row_id", F.repeat(F.lit("x"), (F.col("row_id") % 7).cast("int")).alias("pad"))
    ordered.repartitionByRange(5, "row_id").sortWithinPartitions("row_id").write.option("header", True).csv(path)
    return IO.with_row_id(spark.read.option("header", True).csv(path), "rid").select(F.col("row_id").cast("bigint"), "rid")


@query("src05_cardinality_guard", with_cohort(
    "SELECT subject_id, CAST(count(*) AS BIGINT) AS n_rows FROM cohort GROUP BY subject_id HAVING count(*) <> 1", clustered=False))
def src05_cardinality_guard(spark, sf_dir):
    """One-row-per-input rule applied by key: customers that do not have exactly one order."""
    c = cohort(spark, sf_dir)
    return c.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows <> 1")


@query("src06_json_roundtrip", ROUND_SQL)
def src06_json_roundtrip(spark, sf_dir):
    df = cohort(spark, sf_dir).select(*ROUND_COLS)
    path = IO.write_json(df, IO.scratch_path(spark, "json"))
    return IO.read_json_documents(spark, path, df.schema.simpleString()[len("struct<"):-1].replace(":", " "), multiline=False)


@query("src07_parquet_sink", ROUND_SQL)
def src07_parquet_sink(spark, sf_dir):
    df = cohort(spark, sf_dir).select(*ROUND_COLS)
    path = IO.write_table(df, IO.scratch_path(spark, "sink"), partition_by=["cat_priority"])
    return spark.read.parquet(path).select(*ROUND_COLS)


@query("src08_artifact_roundtrip")
def src08_artifact_roundtrip(spark, sf_dir):
    """Fitted preprocessing saved to the shared folder, reloaded, applied (rows-only)."""
    from ..operators.features import Preprocessor
    df = cohort(spark, sf_dir)
    p = Preprocessor.fit(df, ["totalprice", "quantity_max"], ["cat_priority"])
    path = IO.scratch_path(spark, "artifacts")
    p.save(spark, path)
    return Preprocessor.load(spark, path).transform(df, ["row_id"], as_array=None)


def _template_sql():
    from .text_queries import FIELDS_SQL, REPORTS_CTE
    cols = ["heart_rate_max", "admission_age", "gender"]
    body = REPORTS_CTE + ", ex AS (SELECT row_id, " + ", ".join(f"{FIELDS_SQL[c]} AS {c}" for c in cols) + " FROM reports)\n"
    body += ", t AS (SELECT * FROM ex WHERE row_id = (SELECT min(row_id) FROM ex WHERE heart_rate_max IS NOT NULL))\n"

    def shown(value):
        return (f"CASE WHEN {value} = floor({value}) THEN CAST(CAST({value} AS BIGINT) AS VARCHAR) "
                f"ELSE replace(printf('%.6g', {value}), '.', ',') END")
    return body + "SELECT ex.row_id, " + ", ".join(
        f"coalesce({shown('ex.' + c)}, (SELECT {shown(c)} FROM t)) AS {c}" for c in cols) + " FROM ex"


@query("src09_template_fill", _template_sql())
def src09_template_fill(spark, sf_dir):
    """Extracted values overwrite a one-row template (the first complete report)."""
    from .text_queries import extracted
    cols = ["heart_rate_max", "admission_age", "gender"]
    ex = extracted(spark, sf_dir).select("row_id", *cols)
    first = ex.where("heart_rate_max IS NOT NULL").agg(F.min("row_id")).first()[0]
    template = ex.where(F.col("row_id") == first).drop("row_id")
    return IO.fill_from_template(ex, template, cols)


@query("src10_text_scan", "SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents")
def src10_text_scan(spark, sf_dir):
    """Documents written as one text file each and scanned back whole: one row per file."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = IO.write_texts(d, "doc_id", "text", IO.scratch_path(spark, "texts"))
    whole = F.expr("substring(value, 1, length(value) - 1)")  # the sink ends each file with a line break
    doc_id = F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("bigint").alias("doc_id")
    return IO.read_texts(spark, path).select(doc_id, F.length(whole).alias("n_chars"), F.md5(whole).alias("digest"))


@query("src11_run_metadata")
def src11_run_metadata(spark, sf_dir):
    c = cohort(spark, sf_dir)
    info = {"n_rows": c.count(), "columns": c.columns, "chosen": {"method": "kmeans", "n_clusters": 5}}
    return IO.run_metadata(spark, "profile-run", info)


@query("src12_required_columns", with_cohort("SELECT row_id, cluster FROM cohort"))
def src12_required_columns(spark, sf_dir):
    from ..sources.tables import clustered_cohort
    out = IO.required_columns(clustered_cohort(spark, sf_dir), ["row_id", "cluster"], ["row_id", "cluster", "severity_rank"])
    return out


# ------------------------------------------------------------------ schema --

# Stand-in presets over the stand-in cohort's columns.
STANDIN_PRESETS = {
    "scores_only": ["cat_priority", "totalprice", "acctbal"],
    "raw_signals_only": ["cat_priority", "quantity_min", "quantity_max", "price_min", "price_max"],
    "clinical_core": ["cat_priority", "totalprice", "quantity_max", "discount_max", "tax_max"],
}


@query("prj01_feature_preset", with_cohort(
    "SELECT row_id, target, cat_priority, totalprice, quantity_max, discount_max, tax_max FROM cohort", clustered=False))
def prj01_feature_preset(spark, sf_dir):
    return SC.apply_preset(cohort(spark, sf_dir), "clinical_core", keep=["row_id", "target"], presets=STANDIN_PRESETS)


@query("prj01_feature_preset_all", with_cohort("SELECT * EXCLUDE (leakage_last_ship) FROM cohort", clustered=False))
def prj01_feature_preset_all(spark, sf_dir):
    return SC.apply_preset(cohort(spark, sf_dir), "all", post_outcome=["leakage_last_ship"])


@query("prj04_ensure_columns", with_cohort(
    "SELECT row_id, NULL::DOUBLE AS apsiii, totalprice, NULL::VARCHAR AS gender FROM cohort", clustered=False))
def prj04_ensure_columns(spark, sf_dir):
    return SC.ensure_columns(cohort(spark, sf_dir).select("row_id", "totalprice"), ["row_id", "apsiii", "totalprice", "gender"],
                             {"apsiii": "double", "gender": "string"})


COERCE_EXPR = ("CASE WHEN quantity_max IS NULL THEN 'NA' WHEN discount_max = 0 THEN 'nan' WHEN tax_max = 0 THEN '' "
               "WHEN discount_max = 0.1 THEN 'abc' "
               "ELSE ' ' || replace(CAST(acctbal AS STRING), '.', ',') || ' ' END")
COERCE_SQL = with_cohort(f"""
SELECT row_id, TRY_CAST(replace(nullif(nullif(nullif(nullif(trim(s), ''), 'nan'), 'None'), 'NA'), ',', '.') AS DOUBLE) AS value
FROM (SELECT row_id, {COERCE_EXPR.replace('AS STRING', 'AS VARCHAR')} AS s FROM cohort)
""", clustered=False)


@query("prj05_numeric_coercion", COERCE_SQL)
def prj05_numeric_coercion(spark, sf_dir):
    c = cohort(spark, sf_dir).select("row_id", F.expr(COERCE_EXPR).alias("s"))
    return c.select("row_id", IO.coerce_numeric(F.col("s")).alias("value"))


@query("pre01_decimal_separator", COERCE_SQL)
def pre01_decimal_separator(spark, sf_dir):
    """PRE-01: decimal-comma strings to numbers (PRJ-05 over string columns)."""
    return prj05_numeric_coercion(spark, sf_dir)


_PRE = ["row_id", "subject_id", "cat_priority", "cat_segment", "cat_region", "totalprice", "acctbal", "quantity_min",
        "quantity_max", "price_min", "price_max", "discount_max", "tax_max", "has_return", "constant_col",
        "leakage_last_ship", "target"]
_POST = [c for c in _PRE if c not in ("leakage_last_ship", "constant_col")] + ["cluster"]
VARMAP_SQL = "SELECT coalesce(a.v, b.v) AS variable, a.v IS NOT NULL AS in_pre, b.v IS NOT NULL AS in_post, " \
    "CASE WHEN coalesce(a.v, b.v) IN ('cat_priority', 'cat_segment', 'cat_region') THEN 'categorical' " \
    "WHEN coalesce(a.v, b.v) IN ('quantity_min', 'quantity_max') THEN 'ordinal' ELSE 'numeric' END AS kind " \
    f"FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in _PRE)}) a(v) " \
    f"FULL JOIN (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in _POST)}) b(v) ON a.v = b.v"


@query("prj08_variable_map", VARMAP_SQL)
def prj08_variable_map(spark, sf_dir):
    """Columns of the raw cohort vs the processed one (constant/leakage dropped, cluster added)."""
    from ..sources.tables import clustered_cohort
    pre = cohort(spark, sf_dir)
    post = clustered_cohort(spark, sf_dir).drop("leakage_last_ship", "constant_col")
    return SC.variable_map(pre, post, ["cat_priority", "cat_segment", "cat_region"], ["quantity_min", "quantity_max"])


def _contexts(spark, sf_dir):
    """Requests: some carry row_id, some only subject_id, some no id at all."""
    c = cohort(spark, sf_dir).select("row_id", "subject_id", "acctbal")
    return c.select(F.concat(F.lit("req-"), F.col("row_id").cast("string")).alias("request_id"),
                    F.when(F.col("acctbal") > 5000, F.col("row_id")).alias("row_id"),
                    F.when(F.col("acctbal") <= 5000, F.col("subject_id")).when(F.col("acctbal") > 8000, F.col("subject_id"))
                    .alias("subject_id"))


MATCH_SQL = with_cohort("""
, ctx AS (SELECT 'req-' || row_id AS request_id, CASE WHEN acctbal > 5000 THEN row_id END AS row_id,
                 CASE WHEN acctbal <= 5000 THEN subject_id WHEN acctbal > 8000 THEN subject_id END AS subject_id
          FROM cohort)
, m AS (SELECT ctx.request_id, d.row_id, d.subject_id, d.totalprice,
               row_number() OVER (PARTITION BY ctx.request_id ORDER BY d.row_id) AS r
        FROM ctx JOIN cohort d ON (ctx.row_id IS NOT NULL OR ctx.subject_id IS NOT NULL)
             AND (ctx.row_id IS NULL OR CAST(ctx.row_id AS VARCHAR) = CAST(d.row_id AS VARCHAR))
             AND (ctx.subject_id IS NULL OR CAST(ctx.subject_id AS VARCHAR) = CAST(d.subject_id AS VARCHAR)))
SELECT request_id, row_id, subject_id, totalprice FROM m WHERE r <= 3
""", clustered=False)


@query("prj12_id_match", MATCH_SQL)
def prj12_id_match(spark, sf_dir):
    db = cohort(spark, sf_dir).select("row_id", "subject_id", "totalprice")
    return SC.match_by_ids(_contexts(spark, sf_dir), db, ["row_id", "subject_id"], 3)


IDS_SQL = with_cohort("""
SELECT row_id, k AS id_name, v AS id_value FROM (
  SELECT row_id, 'row_id' AS k, CAST(row_id AS VARCHAR) AS v FROM cohort
  UNION ALL SELECT row_id, 'subject_id', CASE WHEN acctbal > 0 THEN CAST(subject_id AS VARCHAR) END FROM cohort)
WHERE v IS NOT NULL
""", clustered=False)


@query("prj14_identifiers", IDS_SQL)
def prj14_identifiers(spark, sf_dir):
    c = cohort(spark, sf_dir).select("row_id", F.when(F.col("acctbal") > 0, F.col("subject_id")).alias("subject_id"))
    m = SC.identifiers(c, ["row_id", "subject_id"])
    return c.select("row_id", F.explode(m).alias("id_name", "id_value"))


SNAP_COLS = ["totalprice", "quantity_max", "discount_max"]
SNAP_SQL = with_cohort(" UNION ALL ".join(
    f"SELECT row_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM cohort WHERE {c} IS NOT NULL" for c in SNAP_COLS),
    clustered=False)


@query("prj15_feature_snapshot", SNAP_SQL)
def prj15_feature_snapshot(spark, sf_dir):
    c = cohort(spark, sf_dir)
    return c.select("row_id", F.explode(SC.feature_snapshot(SNAP_COLS)).alias("feature", "value"))


# ----------------------------------------------------------------- context --

def _contexts_frame(spark, sf_dir):
    from .classify_queries import explanation_rows
    e = explanation_rows(spark, sf_dir)
    e = e.withColumn("prompt_json", CX.case_context(e, ["row_id", "subject_id"], []))
    return e


@query("sc19_case_context")
def sc19_case_context(spark, sf_dir):
    """Case context JSON per scored row (rows-only)."""
    return _contexts_frame(spark, sf_dir).select("row_id", "prompt_json")


@query("sc23_prompt_text")
def sc23_prompt_text(spark, sf_dir):
    """Prompt text per case: header, knowledge section, context (rows-only)."""
    e = _contexts_frame(spark, sf_dir)
    return e.select("row_id", CX.prompt_text(F.lit("CASO CLINICO"), F.lit("(base de conocimiento)"), F.col("prompt_json")).alias("prompt"))


def _augmented_sql():
    from .text_queries import AUDIT_SQL

    def lit(text):
        return "'" + text.replace("'", "''") + "'"
    head = "CASO CLINICO\n\n" + CX.KNOWLEDGE_HEADING + "\n(base de conocimiento)\n\n" + CX.CONTEXT_HEADING + "\n"
    return f"""
WITH a AS (SELECT * FROM ({AUDIT_SQL}) t),
m AS (SELECT request_id, CAST(to_json(list({{'row_id': row_id, 'subject_id': subject_id}} ORDER BY row_id)) AS VARCHAR) AS found
      FROM ({MATCH_SQL}) t GROUP BY request_id)
SELECT 'req-' || a.row_id AS request_id,
       {lit(head)} || '{{"row_id":' || a.row_id || '}}' || {lit(chr(10))}
       || {lit(chr(10) * 2 + CX.FORM_HEADING)} || '{{"nombre":"req-' || a.row_id || '"}}' || {lit(chr(10))}
       || CASE WHEN extracted_field_count = 0 THEN '' ELSE {lit(CX.EXTRACTION_HEADING)} || '{{"extracted_fields":"' || extracted_fields
            || '","extracted_field_count":' || extracted_field_count || ',"missing_core_fields":"' || missing_core_fields || '"}}' || {lit(chr(10))} END
       || {lit(CX.FORM_REMINDER)} || {lit(chr(10) * 2 + CX.MATCHED_HEADING)}
       || CASE WHEN found IS NULL THEN {lit(CX.MATCHED_NONE)} ELSE {lit(CX.MATCHED_NOTE)} || found END
       || {lit(chr(10) + CX.OUTPUT_CONTRACT + chr(10))} AS prompt
FROM a LEFT JOIN m ON m.request_id = 'req-' || a.row_id
"""


@query("sc23_augmented_prompt", _augmented_sql())
def sc23_augmented_prompt(spark, sf_dir):
    """Prompt per request with its form, the extraction summary of its report and its matched history rows."""
    from .text_queries import tx08_extraction_audit
    history = cohort(spark, sf_dir).select("row_id", "subject_id")
    matched = CX.matched_rows(SC.match_by_ids(_contexts(spark, sf_dir), history, ["row_id", "subject_id"], 3), ["row_id", "subject_id"])
    r = tx08_extraction_audit(spark, sf_dir).withColumn("request_id", F.concat(F.lit("req-"), F.col("row_id").cast("string")))
    r = r.join(matched, "request_id", "left")
    base = CX.prompt_text(F.lit("CASO CLINICO"), F.lit("(base de conocimiento)"), F.to_json(F.struct("row_id")))
    summary = F.when(F.col("extracted_field_count") > 0, F.to_json(F.struct("extracted_fields", "extracted_field_count", "missing_core_fields")))
    form = F.to_json(F.struct(F.col("request_id").alias("nombre")))
    return r.select("request_id", CX.with_history(CX.with_form(base, form, summary), F.col("matched_json")).alias("prompt"))


@query("sc19_run_contexts")
def sc19_run_contexts(spark, sf_dir):
    """Every cohort row's context from both stored runs: the classifier's answer, its cluster with all votes, the profile."""
    from ..operators import runs
    from .classify_queries import risk_run
    from .model_queries import run_bundle
    out = runs.case_contexts(cohort(spark, sf_dir), risk_run(spark, sf_dir), run_bundle(spark, sf_dir), ["row_id", "subject_id"],
                             ["totalprice", "acctbal", "quantity_max"])
    return out.select("row_id", "predicted_probability", "cluster", "neighbors_used", "prompt_json")


SC20_SQL = with_cohort("""
SELECT row_id, CAST(row_id AS VARCHAR) AS ctx_row_id, round(1.0 / (1.0 + exp(-(totalprice / 100000.0 - 1.5))), 2) AS ctx_probability,
       'cluster_' || cluster AS ctx_cluster_label
FROM cohort
""")


@query("sc20_extract_case_context", SC20_SQL)
def sc20_extract_case_context(spark, sf_dir):
    """Round trip: prompt text -> JSON after the marker -> fields."""
    e = _contexts_frame(spark, sf_dir)
    p = e.select("row_id", CX.prompt_text(F.lit("CASO"), F.lit("kb"), F.col("prompt_json")).alias("prompt"))
    j = TX.case_context_json(F.col("prompt"))
    return p.select("row_id", F.get_json_object(j, "$.patient_identifiers.row_id").alias("ctx_row_id"),
                    F.get_json_object(j, "$.model_outputs.predicted_probability").cast("double").alias("ctx_probability"),
                    F.get_json_object(j, "$.cluster_assignment.cluster_label").alias("ctx_cluster_label"))


TS_SQL = """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0
       THEN '.' || strftime(ts, '%f') ELSE '' END || '+00:00' AS created_at, strftime(ts, '%d/%m/%y %H:%M') AS display
FROM events
"""


@query("sc24_timestamps", TS_SQL)
def sc24_timestamps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", CX.iso_utc(F.col("ts")).alias("created_at"), CX.display_date(F.col("ts")).alias("display"))


LATEST_SQL = """
SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type,
       arg_max(value, ts) AS value, arg_max(props, ts) AS props
FROM events GROUP BY user_id
"""


@query("jn10_history_upsert", LATEST_SQL)
def jn10_history_upsert(spark, sf_dir):
    """Events as versions keyed by user: the newest version per user wins."""
    e = table(spark, sf_dir, "events")
    return CX.latest_versions(e, "user_id", "ts")


@query("wn10_newest_first", LATEST_SQL)
def wn10_newest_first(spark, sf_dir):
    return CX.newest_first(CX.latest_versions(table(spark, sf_dir, "events"), "user_id", "ts"), "ts")


@query("jn08_history_lookup", f"SELECT * FROM ({LATEST_SQL}) l WHERE user_id = (SELECT max(user_id) FROM events)")
def jn08_history_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    top = e.agg(F.max("user_id")).first()[0]
    return CX.lookup(CX.latest_versions(e, "user_id", "ts"), top, "user_id")


def _plan_values():
    rows = ", ".join(f"('{r}', {o}, '{s}', '{a}')" for r, o, s, a in CX.ACTION_PLAN)
    return f"(VALUES {rows}) AS plan(risk, step_order, step, action)"


ACTIONS_SQL = with_cohort(f"""
, s AS (SELECT row_id, CASE WHEN round(1.0 / (1.0 + exp(-(totalprice / 100000.0 - 1.5))), 2) < 0.2 THEN 'low'
               WHEN round(1.0 / (1.0 + exp(-(totalprice / 100000.0 - 1.5))), 2) < 0.6 THEN 'medium' ELSE 'high' END AS risk
        FROM cohort)
SELECT row_id, s.risk, step_order, step, action FROM s JOIN {_plan_values()} USING (risk)
""", clustered=False)


@query("jn11_action_plan", ACTIONS_SQL)
def jn11_action_plan(spark, sf_dir):
    from .classify_queries import scored
    s = scored(spark, sf_dir).select("row_id", TX.normalize_risk(F.col("predicted_risk_group")).alias("risk"))
    return CX.expand_actions(s, "risk").select("row_id", "risk", "step_order", "step", "action")


@query("wn08_nulls_last_ordering", with_cohort("""
SELECT cluster, CAST(CASE WHEN cluster <> -1 THEN row_number() OVER (PARTITION BY cluster <> -1
       ORDER BY avg(target) DESC NULLS LAST, cluster) END AS INTEGER) AS severity_rank, CAST(count(*) AS BIGINT) AS n_patients
FROM cohort GROUP BY cluster""", noise=True))
def wn08_nulls_last_ordering(spark, sf_dir):
    """Summary ordered by severity with noise (null rank) last, then size."""
    from .profile_queries import summary
    s = summary(spark, sf_dir, noise=True)
    return s.select("cluster", "severity_rank", "n_patients").orderBy(F.asc_nulls_last("severity_rank"), F.desc("n_patients"))


AG11_SQL = with_cohort("\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS missing_rate FROM cohort" for c in _PRE),
    clustered=False)


@query("ag11_schema_profile_nulls", f"SELECT * FROM ({AG11_SQL}) t ORDER BY n_missing DESC, variable LIMIT 15")
def ag11_schema_profile_nulls(spark, sf_dir):
    """Top-15 null counts of the schema profile (the type counts are the first element)."""
    _types, top = Q.schema_profile(cohort(spark, sf_dir), 15)
    return top


@query("ag11_schema_type_counts")
def ag11_schema_type_counts(spark, sf_dir):
    types, _top = Q.schema_profile(cohort(spark, sf_dir), 15)
    return types


ML20_SQL = with_cohort("""
, raw AS (SELECT 'raw' AS source, acctbal AS x FROM cohort)
, post AS (SELECT 'processed' AS source, CASE WHEN acctbal < 0 THEN NULL ELSE acctbal END AS x FROM cohort)
, u AS (SELECT * FROM raw UNION ALL SELECT * FROM post)
, e AS (SELECT source, min(x) AS lo, max(x) AS hi FROM u GROUP BY source)
, b AS (SELECT u.source, lo, CASE WHEN hi > lo THEN (hi - lo) / 10 ELSE 1.0 END AS w, x FROM u JOIN e USING (source) WHERE x IS NOT NULL)
SELECT source, 'acctbal' AS variable, CAST(least(floor((x - lo) / w), 9) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n
FROM b GROUP BY ALL
""", clustered=False)


@query("ml20_raw_vs_processed", ML20_SQL)
def ml20_raw_vs_processed(spark, sf_dir):
    """Before/after comparison: histograms of a measure before and after PRE-07, tagged."""
    raw = cohort(spark, sf_dir)
    post = Q.negatives_to_null(raw, ["acctbal"])
    h = Q.union_tagged({"raw": Q.histogram(raw, ["acctbal"], 10), "processed": Q.histogram(post, ["acctbal"], 10)})
    return h.select("source", "variable", "bin", "n")


# --------------------------------------------------------------- streaming --

@query("st02_history_stream", LATEST_SQL)
def st02_history_stream(spark, sf_dir):
    """Events replayed through a file stream into the append-only version log; the
    latest view equals the batch upsert."""
    from ..streaming.scoring import stream_latest_events
    e = table(spark, sf_dir, "events")
    src = IO.scratch_path(spark, "stream-src")
    e.repartition(4).write.parquet(src)
    out = IO.scratch_path(spark, "stream-out")
    return stream_latest_events(spark, src, out, out + "/_checkpoint", e.schema.simpleString()[len("struct<"):-1].replace(":", " "))


@query("st01_scoring_stream")
def st01_scoring_stream(spark, sf_dir):
    """Orders of the latest year arrive as ';' decimal-comma CSV files; each micro-batch is
    aligned, scored by the fitted GBT and assigned by kNN vote (rows-only)."""
    from ..operators.features import Preprocessor, Reducer
    from ..streaming.scoring import ScoringModels, run_scoring_stream
    from .classify_queries import TREES
    c = cohort(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.year("o_orderdate").alias("yr"))
    last = orders.agg(F.max("yr")).first()[0]
    c = c.join(orders, "row_id")
    hist = c.where(F.col("yr") < last)
    nums = ["totalprice", "acctbal", "quantity_min", "quantity_max", "price_max", "discount_max", "tax_max"]
    pre = Preprocessor.fit(hist, nums, ["cat_priority", "cat_region"])  # the latest year is new to the model
    sizes = hist.agg(F.sum(1 - F.col("target")).alias("n0"), F.sum("target").alias("n1")).first()
    train = CF.with_class_weight(pre.transform(hist, ["row_id", "target"]), "target", sizes["n0"] / sizes["n1"])
    model = CF.fit_gbt(CF.to_features(train), "target", weight="weight", max_iter=TREES)
    cpre = Preprocessor.fit(hist, nums, ["cat_priority"])
    x = cpre.transform(hist, ["row_id"])
    red = Reducer.fit(x, "features", len(cpre.feature_names), hist.count(), 15)
    ref = red.transform(x, "features", ["row_id"], "embedding").join(
        hist.select("row_id", segment_cluster().alias("cluster")), "row_id").withColumnRenamed("row_id", "ref_id")
    from ..session import cut_lineage
    ref = cut_lineage(ref)
    models = ScoringModels(pre, model, cpre, red, ref, 15)
    inp = IO.scratch_path(spark, "stream-in")
    new = c.where(F.col("yr") == last).select("row_id", *nums, "cat_priority", "cat_region")
    IO.write_delimited(new, inp, ";", ",", files=4)
    out = IO.scratch_path(spark, "stream-out")
    run_scoring_stream(spark, inp, out, out + "/_checkpoint", models, "row_id", nums, ["cat_priority", "cat_region"])
    return spark.read.parquet(out + "/scored")



@query("prj06_numeric_columns", "SELECT * FROM (VALUES (0, 'totalprice'), (1, 'acctbal'), (2, 'quantity_max')) t(position, variable)")
def prj06_numeric_columns(spark, sf_dir):
    """Suggested review list intersected with the table's columns ('heart_rate_max' is absent)."""
    c = cohort(spark, sf_dir)
    cols = Q.numeric_columns(c, ["totalprice", "heart_rate_max", "acctbal", "quantity_max"])
    return spark.createDataFrame(list(enumerate(cols)), "position int, variable string")


@query("prj06_numeric_columns_all", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{c}')" for i, c in enumerate(["row_id", "subject_id", "totalprice", "acctbal", "quantity_min", "quantity_max",
                                           "price_min", "price_max", "discount_max", "tax_max", "has_return", "constant_col",
                                           "target"])) + ") t(position, variable)")
def prj06_numeric_columns_all(spark, sf_dir):
    """Without a suggested list: every numeric column of the schema."""
    return spark.createDataFrame(list(enumerate(Q.numeric_columns(cohort(spark, sf_dir)))), "position int, variable string")


JN03_SQL = """
SELECT e.vec_id AS row_id, e.label, a.cluster
FROM embeddings e LEFT JOIN (SELECT vec_id, label AS cluster FROM embeddings WHERE embedding[1] > 0) a USING (vec_id)
"""


@query("jn03_embeddings_assignments", JN03_SQL)
def jn03_embeddings_assignments(spark, sf_dir):
    """Embedding rows left-joined with an assignment table that covers only part of them."""
    e = table(spark, sf_dir, "embeddings")
    assign = e.where(F.col("embedding")[0] > 0).select(F.col("vec_id").alias("row_id"), F.col("label").alias("cluster"))
    return e.select(F.col("vec_id").alias("row_id"), "label").join(assign, "row_id", "left")


JN06_SQL = with_cohort("""
, s AS (SELECT cluster, 'cluster_' || cluster AS cluster_label, count(*) AS n_patients FROM cohort GROUP BY cluster)
, dup AS (SELECT * FROM s UNION ALL SELECT cluster, cluster_label, 0 FROM s)
, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_label ORDER BY n_patients DESC) AS r FROM dup) WHERE r = 1)
SELECT c.row_id, 'cluster_' || c.cluster AS cluster_label, CAST(f.n_patients AS BIGINT) AS n_patients
FROM cohort c LEFT JOIN first f ON f.cluster_label = 'cluster_' || c.cluster
""")


@query("jn06_first_match_lookup", JN06_SQL)
def jn06_first_match_lookup(spark, sf_dir):
    """Rows look up their cluster's profile by label; the profile table repeats labels and the
    first row per label wins (here: the larger count), broadcast (one row per label)."""
    from pyspark.sql import Window as W
    from ..sources.tables import clustered_cohort
    c = clustered_cohort(spark, sf_dir).withColumn("cluster_label", F.concat(F.lit("cluster_"), F.col("cluster").cast("string")))
    s = c.groupBy("cluster", "cluster_label").agg(F.count(F.lit(1)).alias("n_patients"))
    dup = s.unionByName(s.withColumn("n_patients", F.lit(0).cast("bigint")))
    first = dup.withColumn("__r", F.row_number().over(W.partitionBy("cluster_label").orderBy(F.desc("n_patients")))) \
        .where("__r = 1").select("cluster_label", "n_patients")
    return c.select("row_id", "cluster_label").join(F.broadcast(first), "cluster_label", "left")




@query("src05_file_cardinality_guard", with_cohort(
    "SELECT CAST(count(*) AS BIGINT) AS n_rows FROM cohort GROUP BY cat_priority HAVING count(*) <> 1", clustered=False))
def src05_file_cardinality_guard(spark, sf_dir):
    """Per input file: orders written one file per priority, read back; every file that does
    not hold exactly one record is reported."""
    c = cohort(spark, sf_dir).select("row_id", "cat_priority", "totalprice")
    path = IO.scratch_path(spark, "guard")
    c.repartition("cat_priority").write.partitionBy("cat_priority").parquet(path)
    return IO.cardinality_violations(spark.read.parquet(path)).select("n_rows")
