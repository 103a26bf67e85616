"""Queries of the text problems: p2, p4, p6, p7, p8, p9 and p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import leakage, names, packing, pii, spam, split, survivor
from quernstone.operators import timestamps
from quernstone.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "records"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_records(table(spark, sf_dir, "records")).where("n_chunks > 1 and chunk_index = '0'").select("record_id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_records(table(spark, sf_dir, "records"))


def _with_dob(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Adds ``born``: the birth date as YYYY-MM-DD."""
    asked = rows.select(
        F.lit("").alias("src_table"), F.col("id").alias("row_id"), F.lit("dob").alias("field_name"), F.col("dob").alias("value"),
        F.col("source_files").alias("source"), F.lit(False).alias("instant"), F.lit(True).alias("old"),
    )
    read = timestamps.not_yet_normal(asked, table(spark, sf_dir, "facilities")).select(F.col("row_id").alias("id"), F.col("norm_value"))
    iso = F.when(F.col("dob").rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp("dob", F.lit("yyyy-MM-dd")).cast("date").cast("string"))
    return rows.join(read, "id", "left").withColumn("born", F.coalesce(iso, "norm_value"))


def _text_id(column: str):
    plain = F.upper(F.regexp_replace(column, "[^A-Za-z0-9]", ""))
    return F.when(plain != "", plain)


def p6_rows(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, list[str], list[str]]]:
    """The rows of each table with their evidence, strong and weak."""
    patients = _with_dob(spark, sf_dir, table(spark, sf_dir, "patients"))
    providers = _with_dob(spark, sf_dir, table(spark, sf_dir, "providers"))
    weak = [F.col("born").alias("dob"), survivor.usable_phone(F.col("phone")).alias("phone"), names.address_key(F.col("address")).alias("address")]
    return {
        "patients": (
            patients.where("id != 1").select("id", "name", survivor.known_id(F.col("patient_id")).alias("chart"), _text_id("insurance_id").alias("insurance"), _text_id("subject_id").alias("subject"), *weak),
            ["chart", "insurance", "subject"],
            ["dob", "phone", "address"],
        ),
        "providers": (providers.select("id", "name", _text_id("npi").alias("npi"), _text_id("license_number").alias("license"), *weak), ["npi", "license"], ["dob", "phone", "address"]),
    }


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [names.variants(*rows).select(F.lit(name).alias("src_table"), "id_a", "id_b") for name, rows in p6_rows(spark, sf_dir).items()]
    return found[0].unionByName(found[1])


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [names.memberships(*rows).select(F.lit(name).alias("src_table"), "id", "entity") for name, rows in p6_rows(spark, sf_dir).items()]
    return found[0].unionByName(found[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.survivors(table(spark, sf_dir, "patients"))


def p7_voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.survivors(table(spark, sf_dir, "patients"), recency="none")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaked(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.removal_spans(_leaked(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_redacted, p4_found, p4_pieces, p6_found, p6_entities, p7_found, p7_voted, p8_packed, p9_found, p9_spans, p10_found)}

ORACLES: dict[str, str] = {
    "p4_found": "SELECT id AS record_id FROM records WHERE length(trim(raw_text, ' ' || chr(9) || chr(10) || chr(13))) > 1000",
}
