"""Text primitives as native column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cell texts that mean "no value", compared in lower case after trimming.
NULL_TOKENS = ("", "nan", "none", "n/a", "na", "-", "--", "null", "undefined")


def strip(col: Column) -> Column:
    """Trim Unicode white space at both ends (Spark's trim only removes spaces)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def words(col: Column) -> Column:
    """Split on Unicode white space; empty text gives an empty array."""
    return F.filter(F.split(col, r"(?U)\s+"), lambda w: w != "")


def null_if_token(col: Column) -> Column:
    """The trimmed text, or null where it only says that there is none."""
    trimmed = strip(col)
    return F.when(~F.lower(trimmed).isin(*NULL_TOKENS), trimmed)


def safe_identifier(col: Column) -> Column:
    """Header -> identifier: lower case, runs of other characters to one underscore, none at the ends.

    A leading digit gets the prefix ``c``. A header without any letter or digit gives null.
    """
    slug = F.regexp_replace(F.regexp_replace(F.lower(strip(col)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(slug.rlike("^[0-9]"), F.concat(F.lit("c"), slug)).when(slug != "", slug)


def column_signature(headers: Column) -> Column:
    """md5 over the sorted distinct safe names of an array of raw headers."""
    safe = F.array_sort(F.array_distinct(F.transform(headers, safe_identifier)))
    return F.md5(F.array_join(safe, "|"))


def row_hash(columns: list[str]) -> Column:
    """md5 over ``name=value`` of the columns in sorted order; null counts as empty."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(columns)]
    return F.md5(F.concat_ws("|", *parts))


def title_case(col: Column) -> Column:
    """Capitalise after any non-letter (``O'Brien``, ``Mary-Jane``); initcap only does so after spaces."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def normalise_name(col: Column) -> Column:
    return F.regexp_replace(title_case(strip(col)), r"(?U)\s+", " ")


def name_tokens(col: Column) -> Column:
    """Sorted distinct lower-case tokens; full stops and commas count as spaces."""
    return F.array_sort(F.array_distinct(words(F.regexp_replace(F.lower(col), "[.,]", " "))))


def canonical_name(col: Column) -> Column:
    return F.array_join(name_tokens(col), " ")


def strip_tags(col: Column) -> Column:
    """Tags to one space; entities and script bodies stay as they are."""
    return F.regexp_replace(col, "<[^>]+>", " ")


def mapped_substring(col: Column, mapping: list[tuple[str, str]], default: Column | None = None) -> Column:
    """First mapping key, in order, that the lower-cased text contains."""
    lowered = F.lower(col)
    start = F.when(lowered.contains(mapping[0][0]), mapping[0][1])
    chain = reduce(lambda acc, kv: acc.when(lowered.contains(kv[0]), kv[1]), mapping[1:], start)
    return chain.otherwise(default) if default is not None else chain


def view_name(label: Column) -> Column:
    return F.concat(F.lit("v_"), F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def document_id(path: Column) -> Column:
    return F.md5(path)


def part_id(path: Column, kind: str, number: Column) -> Column:
    """Id of a chunk or row of a document: md5 of path, kind and number."""
    return F.md5(F.concat_ws("::", path, F.lit(kind), number.cast("string")))


def row_text(source: Column, columns: list[str]) -> Column:
    """``[Source: f] name: value | name: value``; null and blank values are left out."""
    pairs = [F.when(strip(F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))) != "", F.concat(F.lit(f"{c}: "), F.col(quoted(c)).cast("string"))) for c in columns]
    return F.concat(F.lit("[Source: "), source, F.lit("] "), F.concat_ws(" | ", *pairs))


def quoted(name: str) -> str:
    """A column or table name that is read as it is, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def label_slug(label: Column) -> Column:
    """Lower case, trimmed, blanks to underscores."""
    return F.regexp_replace(strip(F.lower(label)), " ", "_")


def safe_name(header: str) -> str | None:
    """:func:`safe_identifier` of one header on the driver."""
    slug = re.sub("[^a-z0-9]+", "_", header.strip().lower()).strip("_")
    return None if not slug else f"c{slug}" if slug[0].isdigit() else slug
