"""Queries over whole tables for the engine's own operators, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions import casts, text
from quernstone.operators import catalog, chunking, entities, filters, intent, lookup, retrieval, staging
from quernstone.session import table
from quernstone.sources import tables as table_sinks
from quernstone.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- aggregation, joins, order -----------------------------------------------------------------------------------------
@query("SELECT record_type, count(*) AS record_count FROM records GROUP BY record_type")
def records_by_type(t):
    return t("records").groupBy("record_type").agg(F.count("*").alias("record_count"))


@query(r"""
SELECT p.id AS patient_key, sum(CAST(r.total_amount AS DECIMAL(18,2))) AS total_billed
FROM records r JOIN patients p ON r.patient_id = p.id
WHERE r.record_type = 'bill' AND regexp_matches(r.total_amount, '^[0-9]+(\.[0-9]+)?$') GROUP BY p.id""")
def total_by_patient(t):
    bills = t("records").where((F.col("record_type") == "bill") & F.col("total_amount").rlike(r"^[0-9]+(\.[0-9]+)?$"))
    patients = t("patients").select(F.col("id").alias("patient_key"))
    joined = bills.join(patients, F.col("patient_id") == F.col("patient_key"))
    return joined.groupBy("patient_key").agg(F.sum(F.col("total_amount").try_cast("decimal(18,2)")).alias("total_billed"))


@query(r"""
SELECT CAST(date_trunc('month', TRY_CAST(record_date AS DATE)) AS DATE) AS month, count(DISTINCT patient_id) AS unique_patients
FROM records WHERE regexp_matches(record_date, '^\d{4}-\d{2}-\d{2}$') AND record_date LIKE '2023-%' GROUP BY 1""")
def unique_patients_by_month(t):
    dated = t("records").where(F.col("record_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("record_date").like("2023-%"))
    return dated.groupBy(F.trunc(casts.safe_date(F.col("record_date")), "month").alias("month")).agg(F.countDistinct("patient_id").alias("unique_patients"))


@query("""
SELECT icd9_code, icd9_description, count(*) AS occurrences FROM records WHERE icd9_code IS NOT NULL
GROUP BY icd9_code, icd9_description ORDER BY occurrences DESC, icd9_code, icd9_description NULLS LAST LIMIT 10""")
def top_codes(t):
    counted = t("records").where("icd9_code is not null").groupBy("icd9_code", "icd9_description").agg(F.count("*").alias("occurrences"))
    return counted.orderBy(F.desc("occurrences"), "icd9_code", F.asc_nulls_last("icd9_description")).limit(10)


@query("""
SELECT p.insurance_id, count(*) AS total_claims, CAST(sum(CASE WHEN r.total_amount = '0' OR r.total_amount IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS zero_amount_claims,
round(100.0 * sum(CASE WHEN r.total_amount = '0' OR r.total_amount IS NULL THEN 1 ELSE 0 END) / nullif(count(*), 0), 2)::DOUBLE AS zero_amount_rate_pct
FROM records r JOIN patients p ON r.patient_id = p.id WHERE r.record_type = 'bill' GROUP BY p.insurance_id""")
def zero_rate_by_payer(t):
    joined = t("records").where("record_type = 'bill'").join(t("patients").select(F.col("id").alias("pk"), "insurance_id"), F.col("patient_id") == F.col("pk"))
    zero = F.count_if((F.col("total_amount") == "0") | F.col("total_amount").isNull())
    return joined.groupBy("insurance_id").agg(F.count("*").alias("total_claims"), zero.alias("zero_amount_claims"), F.round(100.0 * zero / F.nullif(F.count("*"), F.lit(0)), 2).alias("zero_amount_rate_pct"))


@query("""
SELECT v.name AS provider_name, v.npi, v.specialty, count(DISTINCT r.patient_id) AS unique_patients
FROM records r JOIN providers v ON r.provider_id = v.id GROUP BY v.name, v.npi, v.specialty""")
def providers_unique_patients(t):
    providers = t("providers").select(F.col("id").alias("pk"), F.col("name").alias("provider_name"), "npi", "specialty")
    joined = t("records").join(providers, F.col("provider_id") == F.col("pk"))
    return joined.groupBy("provider_name", "npi", "specialty").agg(F.countDistinct("patient_id").alias("unique_patients"))


@query(r"""
SELECT CAST(date_trunc('month', TRY_CAST(record_date AS DATE)) AS DATE) AS month, record_type,
CAST((2 * CAST(sum(CAST(total_amount AS DECIMAL(18,2))) * 100 AS HUGEINT) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS avg_amount, count(*) AS claim_count
FROM records WHERE regexp_matches(record_date, '^\d{4}-\d{2}-\d{2}$') AND regexp_matches(total_amount, '^[0-9]+(\.[0-9]+)?$') GROUP BY 1, 2""")
def avg_by_month_type(t):
    kept = t("records").where(F.col("record_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("total_amount").rlike(r"^[0-9]+(\.[0-9]+)?$"))
    month = F.trunc(casts.safe_date(F.col("record_date")), "month").alias("month")
    return kept.groupBy(month, "record_type").agg(F.round(F.avg(F.col("total_amount").try_cast("decimal(18,2)")), 2).cast("double").alias("avg_amount"), F.count("*").alias("claim_count"))


@query("""
SELECT count(*) AS total_emergency, CAST(coalesce(sum(CASE WHEN deathtime IS NOT NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS in_hospital_deaths,
round(100.0 * sum(CASE WHEN deathtime IS NOT NULL THEN 1 ELSE 0 END) / nullif(count(*), 0), 2)::DOUBLE AS mortality_rate_pct
FROM admissions WHERE admission_type = 'EMERGENCY'""")
def global_rate(t):
    died = F.count_if(F.col("deathtime").isNotNull())
    return t("admissions").where("admission_type = 'EMERGENCY'").agg(F.count("*").alias("total_emergency"), died.alias("in_hospital_deaths"), F.round(100.0 * died / F.nullif(F.count("*"), F.lit(0)), 2).alias("mortality_rate_pct"))


@query("""
SELECT r.id, r.patient_id, p.name AS patient_name, v.name AS provider_name, v.npi AS provider_npi, r.record_type, r.record_date
FROM records r JOIN patients p ON r.patient_id = p.id LEFT JOIN providers v ON r.provider_id = v.id
QUALIFY row_number() OVER (PARTITION BY r.patient_id ORDER BY r.record_date DESC NULLS FIRST, r.id DESC) <= 30""")
def patient_records_topn(t):
    latest = F.row_number().over(W.partitionBy("patient_id").orderBy(F.desc_nulls_first("record_date"), F.desc("id")))
    chosen = t("records").select("id", "patient_id", "provider_id", "record_type", "record_date").withColumn("nth", latest).where("nth <= 30").drop("nth")
    full = lookup.patient_records(chosen, t("patients"), t("providers"))
    return full.select("id", "patient_id", "patient_name", "provider_name", "provider_npi", "record_type", "record_date")


@query(r"""
SELECT id, hadm_id, row_number() OVER (PARTITION BY hadm_id ORDER BY CASE WHEN regexp_matches(seq_num, '^\d+$') THEN TRY_CAST(seq_num AS INTEGER) END ASC NULLS LAST, id) AS place
FROM records WHERE hadm_id IS NOT NULL""")
def ordered_by_seq(t):
    number = F.when(F.col("seq_num").rlike(r"^\d+$"), F.col("seq_num").try_cast("int"))
    return t("records").where("hadm_id is not null").select("id", "hadm_id", F.row_number().over(W.partitionBy("hadm_id").orderBy(F.asc_nulls_last(number), "id")).cast("long").alias("place"))


@query("""
SELECT id, patient_id FROM records WHERE record_type IN ('bill', 'lab_result') AND diagnosis IS NOT NULL AND (provider_id IS NULL OR medication IS NULL) AND source_file LIKE 'tma42%'""")
def predicate_mix(t):
    kept = F.col("record_type").isin("bill", "lab_result") & F.col("diagnosis").isNotNull() & (F.col("provider_id").isNull() | F.col("medication").isNull()) & F.col("source_file").like("tma42%")
    return t("records").where(kept).select("id", "patient_id")


@query("SELECT p.id, p.name FROM patients p WHERE EXISTS (SELECT 1 FROM admissions a WHERE a.patient_id = p.id) AND NOT EXISTS (SELECT 1 FROM records r WHERE r.patient_id = p.id)")
def admitted_without_records(t):
    patients = t("patients").select("id", "name")
    admitted = patients.join(t("admissions").select(F.col("patient_id").alias("id")), "id", "left_semi")
    return admitted.join(t("records").select(F.col("patient_id").alias("id")), "id", "left_anti")


@query("""
SELECT 'patients' AS table_name, count(*) AS n FROM patients UNION ALL SELECT 'providers', count(*) FROM providers
UNION ALL SELECT 'records', count(*) FROM records UNION ALL SELECT 'admissions', count(*) FROM admissions""")
def table_counts(t):
    counts = [t(n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n in ("patients", "providers", "records", "admissions")]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_counts(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.count("*").alias("n"))


@query("SELECT coalesce(max(id), 0) + 1 AS next_id FROM patients")
def next_patient_id(t):
    return staging.next_id(t("patients"), "id")


# --- casts and text ----------------------------------------------------------------------------------------------------
_SQL_NUMERIC = r"""
CASE WHEN starts_with(trim(v), '-') OR regexp_matches(trim(v), '^\(.*\)$') THEN -1 ELSE 1 END * TRY_CAST(nullif(regexp_replace(trim(v), '[^0-9.]', '', 'g'), '') AS DECIMAL(38,6))"""


@query(f"SELECT id, CAST({_SQL_NUMERIC} AS DOUBLE) AS amount FROM (SELECT id, total_amount AS v FROM records)")
def safe_numeric(t):
    return t("records").select("id", casts.safe_numeric(F.col("total_amount")).cast("double").alias("amount"))


_SQL_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_SQL_MONTH = "(January|February|March|April|May|June|July|August|September|October|November|December)"


def _sql_parsed(value: str, *forms: tuple[str, str]) -> str:
    """The first form whose shape fits, strictly; null where none does or the day isn't in the calendar."""
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({value}, '^{shape}$') THEN TRY_STRPTIME({value}, '{form}') END" for shape, form in forms) + ", NULL)"


_ISO_DAY = (r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d")


@query(f"SELECT id, CAST({_sql_parsed('v', _ISO_DAY)} AS DATE) AS as_date FROM (SELECT id, {_SQL_STRIP.format('record_date')} AS v FROM records)")
def safe_dates(t):
    return t("records").select("id", casts.safe_date(F.col("record_date")).alias("as_date"))


_ISO_TIME = (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}", "%Y-%m-%d %H:%M:%S")


@query(f"SELECT id, {_sql_parsed('v', _ISO_TIME)} AS admitted_at FROM (SELECT id, {_SQL_STRIP.format('admittime')} AS v FROM admissions)")
def safe_timestamps(t):
    return t("admissions").select("id", casts.safe_timestamp(F.col("admittime")).cast("timestamp_ntz").alias("admitted_at"))


@query("""
SELECT id, CASE WHEN lower(trim(total_amount)) IN ('', 'nan', 'none', 'n/a', 'na', '-', '--', 'null', 'undefined') THEN NULL ELSE trim(total_amount) END AS amount FROM records""")
def null_tokens(t):
    return t("records").select("id", text.null_if_token(F.col("total_amount")).alias("amount"))


_SQL_SAFE = "regexp_replace(regexp_replace(lower(trim(h)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_SQL_SAFE = f"CASE WHEN regexp_matches({_SQL_SAFE}, '^[0-9]') THEN 'c' || {_SQL_SAFE} ELSE {_SQL_SAFE} END"


@query(f"SELECT file_id, md5(array_to_string(list_sort(list_distinct(list_transform(headers, lambda h: {_SQL_SAFE}))), '|')) AS signature FROM stream_files")
def file_signatures(t):
    return catalog.signatures(t("stream_files")).select("file_id", "signature")


@query("""
SELECT id, md5('dob=' || coalesce(dob, '') || '|gender=' || coalesce(gender, '') || '|name=' || coalesce(name, '') || '|phone=' || coalesce(phone, '')) AS row_hash FROM patients""")
def row_hashes(t):
    return t("patients").select("id", text.row_hash(["name", "dob", "gender", "phone"]).alias("row_hash"))


@query("""
SELECT id, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(name), '[.,]', ' ', 'g'), '\\s+'), lambda x: x <> ''))) AS tokens,
array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(name), '[.,]', ' ', 'g'), '\\s+'), lambda x: x <> ''))), ' ') AS canonical
FROM providers""".replace("\\\\", "\\"))
def name_forms(t):
    return t("providers").select("id", text.name_tokens(F.col("name")).alias("tokens"), text.canonical_name(F.col("name")).alias("canonical"))


@query()
def normalised_names(t):
    return t("patients").select("id", text.normalise_name(F.col("name")).alias("name"))


@query("SELECT doc_id, regexp_replace(text, '<[^>]+>', ' ', 'g') AS text FROM documents")
def tags_stripped(t):
    return t("documents").select("doc_id", text.strip_tags(F.col("text")).alias("text"))


@query("""
SELECT id, CASE WHEN contains(n, 'bill') OR contains(n, 'invoice') THEN 'bill' WHEN contains(n, 'provider') OR contains(n, 'npi') OR contains(n, 'doctor') THEN 'provider_info'
WHEN contains(n, 'prescription') OR contains(n, 'rx') THEN 'prescription' WHEN contains(n, 'lab') THEN 'lab_result' WHEN contains(n, 'record') THEN 'record' ELSE 'other' END AS doc_type
FROM (SELECT id, lower(source_file) AS n FROM records)""")
def type_from_name(t):
    return t("records").select("id", text.mapped_substring(F.col("source_file"), list(lookup.NAME_TYPES), F.lit("other")).alias("doc_type"))


_ANY_DAY = (_ISO_DAY, (r"\d{1,2}/\d{1,2}/\d{4}", "%m/%d/%Y"), (r"\d{1,2}-\d{1,2}-\d{4}", "%m-%d-%Y"), (rf"\d{{1,2}} {_SQL_MONTH} \d{{4}}", "%d %B %Y"), (rf"{_SQL_MONTH} \d{{1,2}}, \d{{4}}", "%B %d, %Y"))


@query(f"SELECT id, coalesce(CAST(CAST({_sql_parsed('v', *_ANY_DAY)} AS DATE) AS VARCHAR), dob) AS as_date FROM (SELECT id, dob, {_SQL_STRIP.format('dob')} AS v FROM patients)")
def any_dates(t):
    return t("patients").select("id", casts.any_date(F.col("dob")).alias("as_date"))


@query("SELECT doc_id, md5(coalesce(source_file, '')) AS document_key, md5(coalesce(source_file, '') || '::chunk::' || (doc_id % 7)) AS chunk_key FROM documents")
def document_keys(t):
    path = F.coalesce("source_file", F.lit(""))
    return t("documents").select("doc_id", text.document_id(path).alias("document_key"), text.part_id(path, "chunk", F.col("doc_id") % 7).alias("chunk_key"))


@query(f"""
SELECT id, '[Source: ' || source_file || '] ' || concat_ws(' | ', {", ".join(f"CASE WHEN {_SQL_STRIP.format(f'coalesce({c}, {chr(39) * 2})')} <> '' THEN '{c}: ' || {c} END" for c in ("record_type", "record_date", "diagnosis", "total_amount"))}) AS line FROM records""")
def row_texts(t):
    return t("records").select("id", text.row_text(F.col("source_file"), ["record_type", "record_date", "diagnosis", "total_amount"]).alias("line"))


@query("SELECT doc_id, replace(trim(lower(title)), ' ', '_') AS slug FROM documents WHERE title IS NOT NULL")
def label_slugs(t):
    return t("documents").where("title is not null").select("doc_id", text.label_slug(F.col("title")).alias("slug"))


# --- catalog -----------------------------------------------------------------------------------------------------------
@query("""
SELECT column_signature, list_filter(safe_columns, lambda c: NOT (contains(c, 'ssn') OR contains(c, 'social_security') OR contains(c, 'social_sec') OR contains(c, 'password') OR contains(c, 'passwd'))) AS stored
FROM source_catalog""")
def denylist_projection(t):
    return t("source_catalog").select("column_signature", catalog.stored_columns(F.col("safe_columns")).alias("stored"))


@query("""
SELECT a.column_signature, coalesce(a.aliased_to, a.column_signature) AS target, coalesce(b.staging_table, a.staging_table) AS staging_table,
(a.aliased_to IS NOT NULL AND b.aliased_to IS NOT NULL) AS chained FROM source_catalog a LEFT JOIN source_catalog b ON a.aliased_to = b.column_signature""")
def alias_resolution(t):
    return catalog.resolve_aliases(t("source_catalog"))


@query("""
WITH s AS (SELECT column_signature AS sig, list_distinct(safe_columns) AS cols, first_ingested_at AS seen FROM source_catalog),
p AS (SELECT a.sig AS column_signature, b.sig AS candidate, b.seen, len(list_intersect(a.cols, b.cols))::DOUBLE / len(list_distinct(list_concat(a.cols, b.cols))) AS similarity
FROM s a JOIN s b ON a.sig <> b.sig)
SELECT column_signature, candidate, similarity FROM p WHERE similarity >= 0.7 QUALIFY row_number() OVER (PARTITION BY column_signature ORDER BY seen, candidate) = 1""")
def schema_drift(t):
    return catalog.drift_candidates(t("source_catalog"))


@query("""
SELECT o_orderkey AS order_id, TRY_CAST(o_totalprice AS DECIMAL(38,6))::DOUBLE AS amount, CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS priority FROM orders""")
def typed_view(t):
    raw = t("orders").select(*[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_orderpriority")], F.format_string("%.2f", "o_totalprice").alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    staged = raw.withColumn("_deleted_at", F.lit(None).cast("timestamp"))
    view = catalog.typed_view(staged, {"o_orderkey": ("order_id", "numeric", None), "o_totalprice": ("amount", "numeric", None), "o_orderdate": ("order_date", "date", "YYYY-MM-DD"), "o_orderpriority": ("priority", "text", None)})
    return view.select(F.col("order_id").cast("long").alias("order_id"), F.col("amount").cast("double").alias("amount"), "order_date", "priority")


@query("""
WITH v AS (SELECT coalesce(view_name, 'v_' || substr(column_signature, 1, 8)) AS view_name, safe_columns FROM source_catalog),
w AS (SELECT view_name, list_distinct(list_concat(string_split(regexp_replace(view_name, '^v_', ''), '_'), list_filter(flatten(list_transform(safe_columns, lambda c: string_split(c, '_'))), lambda p: length(p) > 2))) AS vocab FROM v)
SELECT view_name, len(list_intersect(vocab, ['total', 'amount', 'billed', 'service', 'date', 'payer']))::DOUBLE / len(vocab) AS score FROM w
ORDER BY score DESC, view_name LIMIT 5""")
def schema_links(t):
    views = t("source_catalog").select(F.coalesce("view_name", F.concat(F.lit("v_"), F.substring("column_signature", 1, 8))).alias("view_name"), F.col("safe_columns").alias("columns"))
    return catalog.link_score(views, ["total", "amount", "billed", "service", "date", "payer"])


_SQL_DENIED = "(contains(c, 'ssn') OR contains(c, 'social_security') OR contains(c, 'social_sec') OR contains(c, 'password') OR contains(c, 'passwd'))"


@query(f"""
WITH f AS (SELECT file_id, list_distinct(list_filter(list_transform(headers, lambda h: {_SQL_SAFE}), lambda c: c <> '' AND NOT {_SQL_DENIED})) AS cols, column_signature FROM stream_files),
c AS (SELECT s.column_signature, coalesce(b.stored_columns, s.stored_columns) AS stored FROM source_catalog s LEFT JOIN source_catalog b ON s.aliased_to = b.column_signature)
SELECT file_id, list_sort(list_filter(cols, lambda x: NOT list_contains(stored, x))) AS added FROM f JOIN c USING (column_signature)""")
def columns_to_add(t):
    return catalog.new_columns(t("source_catalog"), t("stream_files"))


@query("""
SELECT substr(column_signature, 1, 8) AS signature, human_label, load_mode, query_exposed, rows_total, substr(aliased_to, 1, 8) AS aliased_to, len(safe_columns)::INTEGER AS n_columns, first_ingested_at FROM source_catalog""")
def catalog_listing(t):
    return catalog.listing(t("source_catalog"))


@query("""
WITH f AS (SELECT column_signature, max(delivered_at) AS at FROM stream_files GROUP BY 1)
SELECT file_id, s.column_signature, coalesce(c.aliased_to, c.column_signature) AS target, coalesce(b.staging_table, c.staging_table) AS staging_table, CASE WHEN c.aliased_to IS NULL THEN 'known' ELSE 'aliased' END AS outcome
FROM stream_files s JOIN source_catalog c USING (column_signature) LEFT JOIN source_catalog b ON c.aliased_to = b.column_signature""")
def stream_registration(t):
    return catalog.register(t("source_catalog"), t("stream_files"))[1]


# --- staging -----------------------------------------------------------------------------------------------------------
def _loads(t) -> tuple[DataFrame, DataFrame]:
    """Staged rows as they are, by feed, and as incoming each feed's latest file; every staged row is on one side or the other."""
    files = t("stream_files").select("file_id", "feed_code", F.row_number().over(W.partitionBy("feed_code").orderBy(F.desc("delivered_at"), F.desc("file_id"))).alias("age"))
    rows = t("stg_rows").join(files, "file_id").select(F.col("feed_code").alias("_source_file"), "_row_hash", F.col("_id").alias("row_idx"), "_deleted_at", "age")
    return rows.where("age > 1").drop("age"), rows.where("age = 1").drop("age", "_deleted_at")


_SQL_LOADS = """
WITH f AS (SELECT file_id, feed_code, row_number() OVER (PARTITION BY feed_code ORDER BY delivered_at DESC, file_id DESC) AS age FROM stream_files),
e AS (SELECT feed_code AS _source_file, _row_hash, _id AS row_idx, _deleted_at IS NOT NULL AS deleted, age FROM stg_rows JOIN f USING (file_id)),
staged AS (SELECT * FROM e WHERE age > 1), incoming AS (SELECT * FROM e WHERE age = 1),
firsts AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY _source_file, _row_hash ORDER BY row_idx) = 1)"""


@query(_SQL_LOADS + " SELECT _source_file, _row_hash, row_idx FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE s._source_file = f._source_file AND s._row_hash = f._row_hash)")
def append_dedup(t):
    return staging.append_load(*_loads(t)).select("_source_file", "_row_hash", "row_idx")


@query(_SQL_LOADS + " SELECT _source_file, _row_hash, row_idx FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE NOT s.deleted AND s._source_file = f._source_file AND s._row_hash = f._row_hash)")
def snapshot_load(t):
    return staging.snapshot_load(*_loads(t)).select("_source_file", "_row_hash", "row_idx")


@query(_SQL_LOADS + """, inc AS (SELECT DISTINCT _source_file, _row_hash FROM incoming), live AS (SELECT DISTINCT _source_file, _row_hash FROM staged WHERE NOT deleted),
n AS (SELECT _source_file, count(*) AS n_new FROM inc GROUP BY 1), m AS (SELECT _source_file, count(*) AS n_live FROM (SELECT * FROM live UNION SELECT * FROM inc) GROUP BY 1)
SELECT l._source_file, l._row_hash FROM live l JOIN n USING (_source_file) JOIN m USING (_source_file)
WHERE n_new >= 10 AND n_new >= n_live * 0.1 AND NOT EXISTS (SELECT 1 FROM inc i WHERE i._source_file = l._source_file AND i._row_hash = l._row_hash)""")
def snapshot_reconcile(t):
    return staging.reconcile(*_loads(t), min_fraction=0.1)


_SQL_RECONCILE = _SQL_LOADS + """, inc AS (SELECT DISTINCT _source_file, _row_hash FROM incoming), live AS (SELECT DISTINCT _source_file, _row_hash FROM staged WHERE NOT deleted),
n AS (SELECT _source_file, count(*) AS n_new FROM inc GROUP BY 1), m AS (SELECT _source_file, count(*) AS n_live FROM live GROUP BY 1)
SELECT l._source_file, l._row_hash FROM live l JOIN n USING (_source_file) JOIN m USING (_source_file)
WHERE n_new >= 10 AND n_new >= n_live * 0.90 AND NOT EXISTS (SELECT 1 FROM inc i WHERE i._source_file = l._source_file AND i._row_hash = l._row_hash)"""


@query(_SQL_RECONCILE.replace("FROM e WHERE age > 1", "FROM e WHERE age = 2"))
def snapshot_reconcile_default(t):
    """At the default fraction, counted before the load: each feed's latest file against the one before it alone."""
    files = t("stream_files").select("file_id", "feed_code", F.row_number().over(W.partitionBy("feed_code").orderBy(F.desc("delivered_at"), F.desc("file_id"))).alias("age"))
    rows = t("stg_rows").join(files, "file_id").select(F.col("feed_code").alias("_source_file"), "_row_hash", "_deleted_at", "age")
    return staging.reconcile(rows.where("age = 2"), rows.where("age = 1"), guard="pre_insert")


@query(_SQL_LOADS + " SELECT _source_file, count(*) AS rows_total, count(*) FILTER (NOT deleted) AS rows_live FROM staged GROUP BY 1")
def stream_counters(t):
    return staging.stream_counters(_loads(t)[0])


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_wins_upsert(t):
    events = t("events").select("user_id", "event_id", "event_type", "value", "ts")
    ordered = events.withColumn("seq", F.struct("ts", "event_id"))
    return staging.upsert(ordered.where("event_id % 2 = 0"), ordered.where("event_id % 2 = 1"), "user_id", "seq").select("user_id", "event_id", "event_type", "value")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def migrate_new_rows(t):
    there = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return staging.insert_new(there, t("customer").select("c_custkey", "c_name"), "c_custkey")


@query("SELECT id, source_file FROM records WHERE source_file IS NULL OR source_file <> (SELECT min(source_file) FROM records)")
def file_deleted(t):
    first = t("records").agg(F.min("source_file")).first()[0]
    return entities.without_file(t("records").select("id", "source_file"), first)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM eval_items)")
def documents_deleted(t):
    return retrieval.without_ids(t("documents").select("doc_id"), t("eval_items").select(F.col("item_id").alias("doc_id")))


@query("SELECT doc_id, source FROM documents WHERE source IS NULL OR source NOT IN ('intake-share.harbor.example', 'ward-scans.quarry.example')")
def purge_documents(t):
    return staging.purge(t("documents").select("doc_id", "source"), "source", ("intake-share.harbor.example", "ward-scans.quarry.example"))


# --- entities ----------------------------------------------------------------------------------------------------------
_SQL_TOKENS = r"list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(name), '[.,]', ' ', 'g'), '\s+'), lambda x: x <> '')))"


@query(f"""
WITH n AS (SELECT id, {_SQL_TOKENS} AS t FROM patients WHERE name IS NOT NULL), q AS (SELECT id AS query_id, t AS qt FROM n WHERE id % 100 = 0)
SELECT query_id, id FROM q JOIN n ON len(list_intersect(q.qt, n.t)) = least(len(q.qt), len(n.t)) AND least(len(q.qt), len(n.t)) >= 2""")
def name_subset_match(t):
    named = t("patients").select("id", "name").where("name is not null")
    return entities.subset_matches(named.where("id % 100 = 0"), named)


@query()
def name_fuzzy_match(t):
    return entities.all_closest(t("patients").select("id", "name"))


@query("""
WITH p AS (SELECT insurance_id, id, coalesce(phone, '') AS phone0, phone, address, gender FROM patients WHERE insurance_id IS NOT NULL),
f AS (SELECT insurance_id, arg_min(struct_pack(phone := phone, address := address, gender := gender), id) AS a,
arg_min(phone, id) FILTER (phone IS NOT NULL AND phone NOT IN ('', 'Unknown')) AS lp, arg_min(address, id) FILTER (address IS NOT NULL AND address NOT IN ('', 'Unknown')) AS la,
arg_min(gender, id) FILTER (gender IS NOT NULL AND gender NOT IN ('', 'Unknown')) AS lg FROM p GROUP BY insurance_id)
SELECT insurance_id, CASE WHEN a.phone IS NOT NULL AND a.phone <> '' THEN a.phone ELSE coalesce(lp, a.phone) END AS phone,
CASE WHEN a.address IS NOT NULL AND a.address <> '' THEN a.address ELSE coalesce(la, a.address) END AS address,
CASE WHEN a.gender IS NOT NULL AND a.gender <> '' THEN a.gender ELSE coalesce(lg, a.gender) END AS gender FROM f""")
def patient_merge(t):
    return entities.merge_fields(t("patients").where("insurance_id is not null"), "insurance_id", "id", ["phone", "address", "gender"])


@query(r"""
WITH e AS (SELECT insurance_id, id, generate_subscripts(l, 1) AS i, trim(unnest(l)) AS f FROM (SELECT insurance_id, id, regexp_split_to_array(source_files, '\s*[,;]\s*') AS l FROM patients
WHERE insurance_id IS NOT NULL AND source_files IS NOT NULL)),
d AS (SELECT insurance_id, f, min(id * 1000 + i) AS pos FROM e WHERE f <> '' GROUP BY insurance_id, f)
SELECT insurance_id, string_agg(f, ',' ORDER BY pos) AS source_files FROM d GROUP BY insurance_id""")
def file_union(t):
    return entities.file_union(t("patients").where("insurance_id is not null"), "insurance_id", "id", "source_files")


@query("""
WITH known AS (SELECT subject_id, min(id) AS match_id FROM patients WHERE coalesce(subject_id, '') <> '' GROUP BY subject_id)
SELECT a.id, k.match_id FROM admissions a JOIN known k USING (subject_id)""")
def find_or_create(t):
    existing = t("patients").select("id", "subject_id")
    incoming = t("admissions").select("id", "subject_id")
    matched, _ = entities.by_keys(existing, incoming, ["subject_id"])
    return matched.select("id", "match_id")


@query("""
WITH known AS (SELECT subject_id, min(id) AS k FROM patients WHERE coalesce(subject_id, '') <> '' GROUP BY 1),
ordered AS (SELECT a.id AS row_id, a.subject_id, k FROM admissions a LEFT JOIN known USING (subject_id) WHERE coalesce(a.subject_id, '') <> ''),
fresh AS (SELECT subject_id, min(row_id) AS first FROM ordered WHERE k IS NULL GROUP BY 1)
SELECT row_id, k AS known_id, CASE WHEN k IS NULL THEN first END AS first_row FROM ordered LEFT JOIN fresh USING (subject_id)""")
def subjects_found_or_created(t):
    """Every admission's patient: the known one, else a new one, named by the first admission that brought it."""
    existing = t("patients").select("id", "subject_id")
    incoming = t("admissions").select(F.col("id").alias("row_id"), "subject_id")
    _, ids = entities.find_or_create(existing, incoming, ["subject_id"], [], name=None)
    found = ids.join(existing.select("id", F.lit(True).alias("old")), "id", "left")
    first = found.where("old is null").groupBy("id").agg(F.min("row_id").alias("first_row"))
    return found.join(first, "id", "left").select("row_id", F.when(F.col("old"), F.col("id")).alias("known_id"), "first_row")


# --- documents ---------------------------------------------------------------------------------------------------------
@query(r"""
WITH RECURSIVE w AS (
  SELECT doc_id, text, length(text) AS n, 0 AS pos, 0 AS chunk_no, CAST(NULL AS BIGINT) AS stop FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, text, n, CASE WHEN stop IS NULL THEN 0 WHEN stop - 200 > pos THEN stop - 200 ELSE stop END AS pos2, chunk_no + 1,
    (SELECT CASE WHEN n <= a + 1000 THEN n
      WHEN contains(h, chr(10) || chr(10)) THEN a + 500 + length(h) - instr(reverse(h), chr(10) || chr(10)) + 1
      WHEN contains(h, chr(10)) THEN a + 500 + length(h) - instr(reverse(h), chr(10)) + 1
      WHEN contains(h, ' ') THEN a + 500 + length(h) - instr(reverse(h), ' ') + 1 ELSE a + 1000 END
     FROM (SELECT x.a, substring(text, CAST(x.a + 501 AS BIGINT), 500) AS h FROM (SELECT CASE WHEN stop IS NULL THEN 0 WHEN stop - 200 > pos THEN stop - 200 ELSE stop END AS a) x))
  FROM w WHERE stop IS NULL OR stop < n)
SELECT doc_id, count(*) AS n_chunks FROM w WHERE chunk_no > 0 AND trim(substring(text, pos + 1, CAST(stop - pos AS BIGINT)), ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY doc_id""")
def chunk_counts(t):
    return chunking.chunk_documents(t("documents")).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


@query()
def chunk_documents(t):
    chunks = chunking.chunk_documents(t("documents"))
    titled = chunks.join(t("documents").select("doc_id", "source_file"), "doc_id")
    return titled.select("doc_id", "chunk_no", "n_chunks", "n_words", chunking.header(F.coalesce("source_file", F.lit("untitled")), F.col("chunk_no"), F.col("n_chunks"), F.col("text")).alias("content"))


@query(r"""
WITH l AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda b: trim(b) <> ''), lambda b: length(b)) AS ls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(ls) >= 8 AND list_sum(ls) <= len(ls) * 200 AND len(list_filter(ls, lambda x: x <= 120)) * 10 >= len(ls) * 7 AS is_table FROM l""")
def table_pages(t):
    lengths = F.transform(F.filter(F.split("text", "\n"), lambda b: F.trim(b) != ""), F.length)
    return t("documents").where("text is not null").select("doc_id", F.coalesce(chunking.is_table(lengths), F.lit(False)).alias("is_table"))


@query("""
WITH p AS (SELECT user_id AS doc_id, event_id AS page_no, event_id % 5 = 0 AS is_table, event_type AS text FROM events),
r AS (SELECT *, sum(is_table::INT) OVER (PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS run FROM p)
SELECT doc_id, min(page_no) AS first_page, is_table AS "table", string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text FROM r GROUP BY doc_id, run, is_table""")
def prose_runs(t):
    pages = t("events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("page_no"), (F.col("event_id") % 5 == 0).alias("table"), F.col("event_type").alias("text"))
    return chunking.prose_runs(pages)


@query("SELECT doc_id, substring(text, 1, 300) || '…' AS preview FROM documents")
def document_previews(t):
    return retrieval.preview(t("documents"))


# --- retrieval ---------------------------------------------------------------------------------------------------------
def _asked(t) -> DataFrame:
    return t("eval_items").select(F.col("item_id").alias("query_id"), F.col("item_text").alias("text"))


_SQL_BM25 = r"""
WITH tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}\x{85}]+'), lambda x: x <> '')) AS term FROM documents),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL), len AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY doc_id),
c AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM len)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), c),
w AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS qn FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(item_text), '[\s\p{Z}\x{85}]+'), lambda x: x <> '')) AS term FROM eval_items) GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN w USING (term) JOIN post USING (term) JOIN len USING (doc_id), c GROUP BY query_id, doc_id),
b AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM s WHERE score > 0)"""


def _lexical(t, k: int) -> DataFrame:
    return retrieval.bm25_top(t("documents").select("doc_id", "text"), _asked(t), k)


@query(_SQL_BM25 + " SELECT query_id, doc_id, round(score, 4) AS score, rank FROM b WHERE rank < 20")
def bm25_topk(t):
    return _lexical(t, 20).select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


_SQL_NEAREST = """
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
a AS (SELECT q.vec_id AS query_id, v.vec_id, greatest(0, list_cosine_similarity(q.e, v.e)) AS similarity FROM v q JOIN v ON q.vec_id % 100 = 0),
d AS (SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) - 1 AS rank FROM a)"""


def _semantic(t, k: int) -> DataFrame:
    vectors = t("embeddings")
    return retrieval.nearest(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


@query(f"WITH {_SQL_NEAREST} SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM d WHERE rank < 20")
def vector_topk(t):
    return _semantic(t, 20).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {_SQL_NEAREST}, x AS (SELECT query_id, vec_id AS doc_id, rank FROM d WHERE rank < 30),
y AS (SELECT x.query_id, e.vec_id AS doc_id, row_number() OVER (PARTITION BY x.query_id ORDER BY e.label, e.vec_id) - 1 AS rank FROM (SELECT DISTINCT query_id FROM x) x CROSS JOIN embeddings e QUALIFY rank < 30),
f AS (SELECT query_id, doc_id, coalesce(1.0 / (60 + x.rank + 1), 0)::DOUBLE + coalesce(1.0 / (60 + y.rank + 1), 0)::DOUBLE AS score, x.rank AS r1, y.rank AS r2 FROM x FULL JOIN y USING (query_id, doc_id))
SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, r1 NULLS LAST, r2 NULLS LAST, doc_id) - 1 AS rank FROM f QUALIFY rank < 10""")
def rrf_fusion(t):
    first = _semantic(t, 30).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    by_label = t("embeddings").select(F.col("vec_id").alias("doc_id"), "label").orderBy("label", "doc_id").limit(30)
    listed = by_label.withColumn("rank", F.row_number().over(W.orderBy("label", "doc_id")) - 1)
    second = first.select("query_id").distinct().crossJoin(F.broadcast(listed.select("doc_id", "rank")))  # 30 rows
    return retrieval.fuse(first, second, 10).select("query_id", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_SQL_BM25.replace("WITH tok", f"WITH {_SQL_NEAREST}, tok", 1) + """, l AS (SELECT query_id, doc_id, score, rank FROM b WHERE rank < 30 AND query_id % 100 = 0),
x AS (SELECT query_id, vec_id AS doc_id, similarity AS score, rank FROM d WHERE rank < 30),
both_ AS (SELECT DISTINCT query_id FROM l INTERSECT SELECT DISTINCT query_id FROM x),
f AS (SELECT query_id, doc_id, coalesce(1.0 / (60 + x.rank + 1), 0)::DOUBLE + coalesce(1.0 / (60 + l.rank + 1), 0)::DOUBLE AS score, x.rank AS r1, l.rank AS r2
FROM (SELECT * FROM x WHERE query_id IN (FROM both_)) x FULL JOIN (SELECT * FROM l WHERE query_id IN (FROM both_)) l USING (query_id, doc_id)),
g AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, r1 NULLS LAST, r2 NULLS LAST, doc_id) - 1 AS rank FROM f QUALIFY rank < 10)
SELECT query_id, doc_id, round(score, 4) AS score, rank FROM (SELECT * FROM g UNION ALL SELECT * FROM l WHERE rank < 10 AND query_id NOT IN (FROM both_) UNION ALL SELECT * FROM x WHERE rank < 10 AND query_id NOT IN (FROM both_))""")
def hybrid_search(t):
    """Lexical search for items, semantic search for vectors with the same numbers, fused; the queries are those divisible by 100."""
    lexical = retrieval.bm25_top(t("documents").select("doc_id", "text"), _asked(t).where("query_id % 100 = 0"), 30).select("query_id", "doc_id", "score", "rank")
    semantic = _semantic(t, 30).select("query_id", F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"), "rank")
    return retrieval.hybrid(lexical, semantic, 10).select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_SQL_BM25 + """, s2 AS (SELECT query_id, doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE round(score, 4) END AS score FROM b WHERE rank < 10),
k AS (SELECT *, score IS NULL OR score >= 150 AS kept, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, doc_id) AS best FROM s2)
SELECT query_id, doc_id, score FROM k QUALIFY kept OR (NOT max(kept) OVER (PARTITION BY query_id) AND best = 1)""")
def threshold_fallback(t):
    scored = _lexical(t, 10).select("query_id", "doc_id", F.when(F.col("doc_id") % 7 != 0, F.round("score", 4)).alias("score"))
    return retrieval.above_threshold(scored, 150.0)


@query("""
SELECT doc_id FROM documents WHERE (coalesce(lang, '') = 'en' AND coalesce(doc_type, '') <> 'other') OR coalesce(source, '') = 'intake-share.harbor.example'""")
def metadata_where(t):
    documents = t("documents").select("doc_id", filters.stringify(["lang", "doc_type", "source"]).alias("metadata"))
    tree = {"$or": [{"$and": [{"lang": {"$eq": "en"}}, {"doc_type": {"$ne": "other"}}]}, {"source": "intake-share.harbor.example"}]}
    return retrieval.filtered(documents, tree, keep_empty=True).select("doc_id")


# --- lookups and questions ---------------------------------------------------------------------------------------------
@query()
def record_texts(t):
    full = lookup.patient_records(t("records"), t("patients"), t("providers"))
    return full.select("id", lookup.record_text().alias("content"))


@query("""
SELECT id, CASE WHEN payer IS NOT NULL AND payer <> '' THEN payer END AS payer, CASE WHEN ward IS NOT NULL AND ward <> '' THEN ward END AS ward, n FROM (
SELECT id, json_extract_string(details_json, '$.payer') AS payer, json_extract_string(details_json, '$.ward') AS ward,
(CASE WHEN coalesce(diagnosis, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(treatment, '') <> '' THEN 1 ELSE 0 END
 + CASE WHEN coalesce(json_extract_string(details_json, '$.payer'), '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(json_extract_string(details_json, '$.ward'), '') <> '' THEN 1 ELSE 0 END)::INTEGER AS n FROM records)""")
def details_merge(t):
    merged = t("records").select("id", lookup.merge_details(["diagnosis", "treatment"]).alias("m"))
    return merged.select("id", F.try_element_at("m", F.lit("payer")).alias("payer"), F.try_element_at("m", F.lit("ward")).alias("ward"), F.size("m").alias("n"))


@query("""
SELECT r.id, r.icd9_code, d.title FROM records r LEFT JOIN (SELECT icd9_code, min(icd9_description) AS title FROM records WHERE icd9_description IS NOT NULL GROUP BY icd9_code) d
ON trim(r.icd9_code) = d.icd9_code WHERE r.icd9_code IS NOT NULL""")
def code_titles(t):
    records = t("records").where("icd9_code is not null")
    titles = records.where("icd9_description is not null").groupBy("icd9_code").agg(F.min("icd9_description").alias("title")).select(F.col("icd9_code").alias("code"), "title")
    return records.join(titles, F.trim("icd9_code") == F.col("code"), "left").select("id", "icd9_code", "title")


@query("""
SELECT 'admission' AS kind, hadm_id, id, 0::BIGINT AS place FROM admissions UNION ALL
SELECT 'record', hadm_id, id, row_number() OVER (PARTITION BY hadm_id ORDER BY id) FROM records WHERE hadm_id IS NOT NULL""")
def admission_first(t):
    admissions = t("admissions").select(F.lit("admission").alias("kind"), "hadm_id", "id", F.lit(0).cast("long").alias("place"))
    place = F.row_number().over(W.partitionBy("hadm_id").orderBy("id")).cast("long")
    return admissions.unionAll(t("records").where("hadm_id is not null").select(F.lit("record").alias("kind"), "hadm_id", "id", place.alias("place")))


def _questions(t) -> DataFrame:
    q = (
        F.when(F.col("id") % 6 == 0, F.concat(F.lit("total amount due by insurance for patient "), F.coalesce("patient_id", F.lit("P001"))))
        .when(F.col("id") % 6 == 1, F.concat(F.lit("show the bill on "), F.coalesce("dob", F.lit("2024-01-05")), F.lit(" for "), "name"))
        .when(F.col("id") % 6 == 2, F.concat(F.lit("admission type for hadm id "), F.col("id").cast("string")))
        .when(F.col("id") % 6 == 3, F.concat(F.lit("NPI of doctor "), "name"))
        .when(F.col("id") % 6 == 4, F.concat(F.lit("lab results of subject id "), F.coalesce("subject_id", F.lit("10006"))))
        .otherwise(F.concat("name", F.lit("'s phone number")))
    )
    return t("patients").where("name is not null").select("id", q.alias("question"))


_SQL_QUESTIONS = """
WITH q AS (SELECT id, CASE id % 6 WHEN 0 THEN 'total amount due by insurance for patient ' || coalesce(patient_id, 'P001') WHEN 1 THEN 'show the bill on ' || coalesce(dob, '2024-01-05') || ' for ' || name
WHEN 2 THEN 'admission type for hadm id ' || id WHEN 3 THEN 'NPI of doctor ' || name WHEN 4 THEN 'lab results of subject id ' || coalesce(subject_id, '10006') ELSE name || '''s phone number' END AS question
FROM patients WHERE name IS NOT NULL)"""


@query(_SQL_QUESTIONS + r"""
SELECT id, CASE WHEN regexp_matches(lower(question), 'provider|doctor|dr\.|physician|npi|specialist') OR regexp_matches(question, '\b\d{10}\b') THEN 'provider' ELSE 'patient' END AS query_type,
nullif(coalesce(nullif(regexp_extract(lower(question), '\bhadm[\s_]?id\D{0,5}(\d{1,8})\b', 1), ''), nullif(regexp_extract(lower(question), '\badmission(?:\s+id)?\D{0,5}(\d{3,8})\b', 1), ''), ''), '') AS hadm_id,
CASE WHEN contains(l, 'npi') THEN 'NPI number' WHEN contains(l, 'dob') OR contains(l, 'date of birth') OR contains(l, 'birth date') OR contains(l, 'birthday') THEN 'date of birth'
WHEN contains(l, 'total') OR contains(l, 'how much') OR contains(l, 'amount due') OR contains(l, 'balance') THEN 'total amount' WHEN contains(l, 'claim') THEN 'claim number'
WHEN contains(l, 'patient account number') OR contains(l, 'patient acct no') OR contains(l, 'account number') OR contains(l, 'acct no') OR contains(l, 'acct number') OR contains(l, 'patient id') OR contains(l, 'mrn')
OR contains(l, 'chart number') OR contains(l, 'member id') THEN 'patient id' WHEN contains(l, 'address') OR contains(l, 'location') THEN 'address' WHEN contains(l, 'phone') OR contains(l, 'contact number') THEN 'phone'
WHEN contains(l, 'insurance') THEN 'insurance' WHEN contains(l, 'gender') OR contains(l, 'sex') THEN 'gender' WHEN contains(l, 'death time') OR contains(l, 'deathtime') OR contains(l, 'date of death')
OR contains(l, 'time of death') OR contains(l, 'died') OR contains(l, 'expired') OR contains(l, 'expiry date') OR contains(l, 'passed away') THEN 'death time' WHEN contains(l, 'admission type') THEN 'admission type'
WHEN contains(l, 'discharge time') OR contains(l, 'dischtime') OR contains(l, 'discharge date') THEN 'discharge time' WHEN contains(l, 'admit time') OR contains(l, 'admittime') OR contains(l, 'admission date')
OR contains(l, 'admission time') THEN 'admit time' END AS specific_field FROM (SELECT *, lower(question) AS l FROM q)""")
def intent_features(t):
    return intent.parse(_questions(t)).select("id", "query_type", "hadm_id", "specific_field")


@query()
def route_decision(t):
    routed = intent.route(intent.parse(_questions(t)))
    return routed.select("id", "route", "patient_name", "provider_name", "patient_id", "subject_id", "date", "doc_type")


@query("""
SELECT event_type AS route, count(*) AS n_queries, count(*) FILTER (value < 5) AS n_errors, round(avg(round(value * 10, 1)), 1) AS avg_latency_ms FROM events GROUP BY event_type""")
def audit_rollup(t):
    log = t("events").select(F.col("event_type").alias("route"), F.when(F.col("value") < 5, "failed").alias("error"), F.round(F.col("value") * 10, 1).alias("latency_ms"))
    return table_sinks.audit_rollup(log)


@query("SELECT vec_id, CASE WHEN label >= 15 THEN 'high' WHEN label >= 10 THEN 'medium' ELSE 'low' END AS band FROM embeddings")
def relevance_bands(t):
    return t("embeddings").select("vec_id", lookup.band(F.col("label") / 20).alias("band"))


# --- event time --------------------------------------------------------------------------------------------------------
@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(t):
    counted = ingest.windowed_counts(t("events"), "ts", "event_type")
    return counted.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS nth FROM e)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, nth""")
def event_sessions(t):
    found = ingest.sessions(t("events"), "ts", "user_id")
    return found.select(F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "user_id", "n")
