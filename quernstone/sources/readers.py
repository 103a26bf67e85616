"""Readers of document and table files, dispatched by suffix; what isn't installed is pluggable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import strip, strip_tags

#: Suffixes by kind of file.
SUFFIXES = {
    "table": (".csv", ".xlsx", ".xls"),
    "json": (".json",),
    "html": (".html", ".htm"),
    "text": (".txt", ".md", ".xml"),
    "document": (".pdf", ".docx", ".doc"),
}
#: Metadata keys of JSON documents and the object keys they are read from, in order. Fixed values.
METADATA_KEYS = {
    "patient_name": ("patient_name", "patient", "name", "full_name", "member_name"),
    "patient_id": ("patient_id", "id", "mrn", "patient_number", "member_id", "patient acct no", "subject_id"),
    "date": ("date", "bill_date", "service_date", "date_of_service", "visit_date", "service date", "claim date", "start date of service"),
    "doc_type": ("doc_type", "document_type", "type", "record_type"),
    "provider_name": ("provider_name", "provider", "physician", "doctor", "physician_name", "rendering provider", "appointment / servicing provider"),
    "provider_npi": ("provider_npi", "npi", "npi_number"),
    "provider_dob": ("provider_dob", "dob", "date_of_birth"),
    "total_amount": ("total_amount", "total", "amount", "bill_amount", "billed charge", "total payment", "balance", "amount_due"),
}


def kind_of(path: Column) -> Column:
    """table, json, html, text or document by the lower-cased suffix; null where it isn't supported."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    chain = None
    for kind, endings in SUFFIXES.items():
        chain = F.when(suffix.isin(*endings), kind) if chain is None else chain.when(suffix.isin(*endings), kind)
    return chain


def visible(path: Column, root: str) -> Column:
    """Files below root that lie in no folder whose name begins with an underscore."""
    return ~F.regexp_replace(path, "^.*?" + root.rstrip("/").replace(".", r"\."), "").rlike("/_[^/]*/")


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, kind, size of supported files, folders searched to any depth; the bytes aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return listed.select("path", kind_of(F.col("path")).alias("kind"), F.col("length").alias("size")).where(F.col("kind").isNotNull() & visible(F.col("path"), root))


def csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text, rows without any value dropped; header names trimmed."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.strip() for c in df.columns]).na.drop("all")


def excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheets as one string map per row; needs an Excel reader of pandas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                sheet = pd.read_excel(io.BytesIO(content), dtype=str).dropna(how="all")
                yield pd.DataFrame({"path": name, "row_idx": range(len(sheet)), "cells": [{str(k).strip(): v for k, v in r.items() if isinstance(v, str)} for r in sheet.to_dict("records")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row_idx long, cells map<string,string>")


def text_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, text: tabs to spaces in plain text, tags to spaces in HTML; blank files are left out."""
    read = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    is_html = kind_of(F.col("path")) == "html"
    plain = F.when(is_html, strip_tags(F.col("text"))).otherwise(F.translate("text", "\t", " "))
    return read.select("path", plain.alias("text")).where(strip(F.col("text")) != "")


def binary_documents(spark: SparkSession, path: str, extract: Callable[[str, bytes], str]) -> DataFrame:
    """path, text of PDF and word-processor files through a given extractor; one that fails gives null."""

    @F.pandas_udf("string")
    def run(names: pd.Series, contents: pd.Series) -> pd.Series:
        def one(name: str, content: bytes) -> str | None:
            try:
                return extract(name, content)
            except Exception:  # noqa: BLE001 - a broken file must not end the job
                return None

        return pd.Series([one(n, c) for n, c in zip(names, contents)])

    read = spark.read.format("binaryFile").load(path)
    return read.select("path", run("path", "content").alias("text"))


def json_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, text (as in the file), metadata (string map by METADATA_KEYS, from the first object of a list)."""
    read = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return read.withColumn("metadata", json_metadata(F.col("text")))


def json_metadata(text: Column) -> Column:
    """String map of METADATA_KEYS found in a JSON object (keys in any case); null for what is no object."""
    first = F.coalesce(F.get_json_object(text, "$[0]"), text)
    entries = F.from_json(first, "map<string,string>")
    lowered = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(entries), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    pick = lambda names: F.coalesce(*[F.try_element_at(lowered, F.lit(n)) for n in names])
    found = F.create_map(*[x for k, names in METADATA_KEYS.items() for x in (F.lit(k), pick(names))])
    return F.map_filter(found, lambda _, v: v.isNotNull())


def lookup_table(spark: SparkSession, path: str, code: str = "icd9_code") -> DataFrame:
    """code, title: the short title, else the long one; codes trimmed, the first of equal ones kept."""
    read = csv(spark, path)
    named = read.toDF(*[c.lower() for c in read.columns])
    title = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("short_title", "long_title") if c in named.columns])
    placed = named.select(F.trim(code).alias("code"), title.alias("title"), F.monotonically_increasing_id().alias("at"))
    return placed.where("code != '' and title is not null").groupBy("code").agg(F.min_by("title", "at").alias("title"))


def read(spark: SparkSession, path: str, extract: Callable[[str, bytes], str] | None = None) -> dict[str, DataFrame]:
    """Everything below a path by its kind: tables as one DataFrame per file, texts, JSON documents and extracted ones together.

    A missing path is an error; unsupported files are passed over; documents need ``extract``.
    """
    found = files(spark, path).select("path", "kind").orderBy("path").collect()
    by_kind: dict[str, list[str]] = {}
    for r in found:
        by_kind.setdefault(r["kind"], []).append(r["path"])
    out = {p: (csv if p.lower().endswith(".csv") else excel)(spark, p) for p in by_kind.pop("table", [])}
    texts = by_kind.get("text", []) + by_kind.get("html", [])
    if texts:
        out["text"] = text_documents(spark, texts)
    if "json" in by_kind:
        out["json"] = json_documents(spark, by_kind["json"])
    if "document" in by_kind and extract is not None:
        out["document"] = binary_documents(spark, by_kind["document"], extract)
    return out


def jdbc(spark: SparkSession, url: str, table: str, fetch: int = 500, **options: str) -> DataFrame:
    """A relational table read in batches of ``fetch`` rows; partition options split large ones."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch), **options).load()
