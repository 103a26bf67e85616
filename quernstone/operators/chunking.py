"""Sliding-window chunks of documents, contextual headers, and table-like pages as chunks of their own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.text import title_case, words

SIZE, OVERLAP = 1000, 200


def windows(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Windows of ``size``, cut after the last paragraph, line or word break of their second half."""
    if not text:
        return []
    out, at = [], 0
    while len(text) > size and at + size < len(text):
        half = at + size // 2
        breaks = ((text.rfind(mark, half, at + size), len(mark)) for mark in ("\n\n", "\n", " "))
        stop = next((p + n for p, n in breaks if p >= 0), at + size)
        out.append(text[at:stop])
        at = stop - overlap if stop - overlap > at else stop
    return [w for w in (p.strip() for p in [*out, text[at:]]) if w]


def chunk_column(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of chunks; short texts are trimmed in the JVM and never reach Python."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: windows(t, size, overlap))

    whole = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    short = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array(whole))
    return F.when(text.isNull(), F.array().cast("array<string>")).when(F.length(text) <= size, short).otherwise(split(F.when(F.length(text) > size, text)))


def chunk_documents(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_no (from 1), n_chunks, text, n_words."""
    cut = documents.select("doc_id", chunk_column(F.col("text"), size, overlap).alias("chunks"))
    placed = cut.select("doc_id", F.size("chunks").alias("n_chunks"), F.posexplode("chunks").alias("i", "text"))
    return placed.select("doc_id", (F.col("i") + 1).alias("chunk_no"), "n_chunks", "text", F.size(words(F.col("text"))).alias("n_words"))


def header(title: Column, number: Column, total: Column, text: Column) -> Column:
    """``<Title> [chunk i/N]:`` and the text; the title is a file's stem with spaces for ``_`` and ``-``."""
    stem = F.regexp_replace(F.regexp_replace(title, r"\.[^.]*$", ""), "[_-]", " ")
    return F.concat(title_case(stem), F.lit(" [chunk "), number.cast("string"), F.lit("/"), total.cast("string"), F.lit("]:\n"), text)


def is_table(lengths: Column) -> Column:
    """At least 8 blocks, 200 characters each on average at most, 70 % of them at most 120."""
    n = F.size(lengths)
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    short = F.size(F.filter(lengths, lambda x: x <= 120))
    return (n >= 8) & (total <= n * 200) & (short * 10 >= n * 7)


def prose_runs(pages: DataFrame) -> DataFrame:
    """pages: doc_id, page_no, table (boolean), text -> one row per table page or run of prose pages between them.

    doc_id, first_page, table, text (pages of a run joined by an empty line).
    """
    before = F.sum(F.col("table").cast("int")).over(W.partitionBy("doc_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, W.currentRow))
    runs = pages.withColumn("run", before)
    joined = runs.groupBy("doc_id", "run", "table").agg(F.min("page_no").alias("first_page"), F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("parts"))
    return joined.select("doc_id", "first_page", "table", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"))
