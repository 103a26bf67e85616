"""Metadata filter trees compiled to predicates, and filters built from parsed questions."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def where_tree(tree: dict[str, Any] | None, metadata: str = "metadata") -> Column:
    """A tree of ``$and``, ``$or``, ``$eq``, ``$ne`` or bare values over a string map column.

    Values compare as strings, a missing key as "". Of several operators on one key the first counts; an unknown
    operator lets every row pass; no tree or an empty one too.
    """
    if not tree:
        return F.lit(True)
    key, value = next(iter(tree.items()))
    if key == "$and":
        return reduce(lambda a, b: a & b, [where_tree(t, metadata) for t in value], F.lit(True))
    if key == "$or":
        return reduce(lambda a, b: a | b, [where_tree(t, metadata) for t in value], F.lit(False))
    field = F.coalesce(F.try_element_at(F.col(metadata), F.lit(key)), F.lit(""))
    if not isinstance(value, dict):
        return field == F.lit(str(value))
    op, wanted = next(iter(value.items()))
    if op == "$eq":
        return field == F.lit(str(wanted))
    if op == "$ne":
        return field != F.lit(str(wanted))
    return F.lit(True)


def intent_filter(intent: dict[str, str | None]) -> dict[str, Any] | None:
    """Filter tree of a parsed question: no condition gives None, one a bare entry, more an ``$and``."""
    full_name = lambda name: name if name and len(name.split()) >= 2 else None
    wanted = [
        ("doc_type", intent.get("doc_type")),
        ("patient_id", intent.get("patient_id")),
        ("patient_id", intent.get("subject_id")),
        ("patient_name", full_name(intent.get("patient_name"))),
        ("date", intent.get("date")),
        ("provider_npi", intent.get("provider_npi")),
        ("provider_name", full_name(intent.get("provider_name"))),
    ]
    terms = [{k: {"$eq": v}} for k, v in wanted if v]
    return None if not terms else terms[0] if len(terms) == 1 else {"$and": terms}


def stringify(columns: list[str]) -> Column:
    """A string map of columns; null becomes ""."""
    entries = [x for c in columns for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return F.create_map(*entries)
