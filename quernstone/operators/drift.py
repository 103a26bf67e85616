"""Schemas that drift between the files of a feed: report every change, read all files into one consistent table.

Rows are read as path-value pairs with raw types; types are counted per file and path (combined before the shuffle),
and a file's schema is compared with that of the file before it in its feed. Columns that left and columns that came
are matched as renames by, in this order: the same core name (without ``fld_``, ``_v2`` and underscores), the same canonical
column in the catalog's mappings, the same consonants, and - for text columns only - overlapping values, estimated
from theta sketches of the cells of columns that are then still alone. Only schemas, one short row per file and column,
meet in a window or group; of rows staged twice, which are few, the one with the highest ``_id`` counts.

Odd input: blank cells and null words are empty; a column without any non-empty value has no type and is never
``retyped``; headers without letters or digits are ignored; headers that sanitise alike are one column; rows staged
twice (same file and row_no) count once; equal delivery times are ordered by file_id; files without rows still have
their columns; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.casts import safe_numeric
from quernstone.functions.text import NULL_TOKENS, safe_identifier
from quernstone.operators import timestamps
from quernstone.session import checkpointed

#: Least overlap (Jaccard) of the cells of two text columns that makes one a rename of the other.
VALUE_OVERLAP = 0.25
#: Log of a sketch's size: estimates are exact up to some thousand distinct values, within a few per cent beyond.
SKETCH = 12

_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_DATE = rf"(?:\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{1,2}}([-/.])\d{{1,2}}\1(?:\d{{4}}|\d{{2}})|\d{{1,2}}[- ]?{_MONTH}[- ,]*\d{{2,4}}|{_MONTH}\.? \d{{1,2}},? \d{{4}})"
_CLOCK = r"(?:t|,? )\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?[ap]m)?(?: ?(?:z|utc|gmt|[a-z]{3,4}|[+-]\d{2}:?\d{2}))?"
_NUMBER = r"[-+(]{0,2}\s*[$€£]?\s*-?(?:\d{1,3}(?:[,' ]\d{3})+|\d+)?(?:[.,]\d+|\d)\s*[%)]?"
TYPES = ("date", "numeric", "text", "timestamptz")


def raw_type(value: Column) -> Column:
    """Type of a trimmed lower-case text: text, numeric, date or timestamptz; null where it means no value."""
    return (
        F.when(value.isNull() | value.isin(*NULL_TOKENS), F.lit(None))
        .when(value.rlike(f"^{_NUMBER}$"), "numeric")
        .when(value.rlike(f"^{_DATE}$"), "date")
        .when(value.rlike(f"^{_DATE}{_CLOCK}$"), "timestamptz")
        .otherwise("text")
    )


def core_name(name: Column) -> Column:
    """Without the marks that renaming adds: prefix fld_, suffix _v and a number."""
    return F.regexp_replace(name, r"^(?:fld|col|field)_|_v\d+$", "")


def skeleton(name: Column) -> Column:
    """First letter and consonants of the core name in their order, without underscores between words."""
    core = core_name(name)
    return F.concat(F.substring(core, 1, 1), F.regexp_replace(F.substring(core, 2, 1000), "[aeiou_]", ""))


def staged_once(rows: DataFrame) -> DataFrame:
    """Rows without those staged twice (same file and row_no): the highest _id counts. Cells aren't shuffled for it."""
    plain = rows.select("file_id", "row_no", "_id", "cells")
    key = ["file_id", "row_no"]
    # few as a rule; read back with statistics, so that they are broadcast only if they are
    twice = checkpointed(plain.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1 and file_id is not null and row_no is not null").select(*key))
    order = W.partitionBy(*key).orderBy(F.desc_nulls_last("_id"), F.xxhash64("cells"))
    picked = plain.join(twice, key, "left_semi").withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    return plain.join(twice, key, "left_anti").unionByName(picked)


def path_values(files: DataFrame, rows: DataFrame) -> DataFrame:
    """file_id, row_no, column_name, value (as staged), raw_type: one row per cell. ``rows``: ``staged_once``."""
    headers = files.select("file_id", F.transform("headers", safe_identifier).alias("names"))
    cells = rows.join(headers, "file_id").select("file_id", "row_no", F.explode(F.arrays_zip("names", "cells")).alias("cell"))
    named = cells.select("file_id", "row_no", F.col("cell.names").alias("column_name"), F.col("cell.cells").alias("value")).where("column_name is not null")
    return named.withColumn("raw_type", raw_type(F.lower(F.trim("value"))))


def file_schemas(files: DataFrame, rows: DataFrame) -> DataFrame:
    """file_id, column_name, n_values, n_typed, column_type (most frequent; ties to the first in alphabet)."""
    stats = (
        path_values(files, rows)
        .where("raw_type is not null")
        .groupBy("file_id", "column_name")
        .agg(F.count("*").alias("n_values"), *[F.count_if(F.col("raw_type") == t).alias(t) for t in TYPES])
    )
    most = F.greatest(*TYPES)
    kind = F.coalesce(*[F.when(F.col(t) == most, t) for t in TYPES])
    columns = files.select("file_id", F.explode(F.array_distinct(F.transform("headers", safe_identifier))).alias("column_name")).where("column_name is not null")
    return columns.join(stats.select("file_id", "column_name", "n_values", most.alias("n_typed"), kind.alias("column_type")), ["file_id", "column_name"], "left")


def _squashed(name: Column) -> Column:
    return F.regexp_replace(core_name(name), "_", "")


def with_canonical(columns: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds squashed and skeleton (forms of column_name) and canonical: what most mapping entries of the catalog say.

    A name is looked up as it is; only where the catalog doesn't have it, by its skeleton (``dose`` and ``dos`` share one).
    """
    entries = catalog.select(F.explode("column_mapping").alias("name", "entry")).where("entry.canonical is not null").select("name", F.col("entry.canonical").alias("canonical"))

    def lookup(form: Column, key: str, out: str) -> DataFrame:
        counted = entries.select(form.alias(key), "canonical").groupBy(key, "canonical").count()
        return counted.groupBy(key).agg(F.max_by("canonical", F.struct("count", "canonical")).alias(out))

    named = columns.withColumn("squashed", _squashed(F.col("column_name"))).withColumn("skeleton", skeleton(F.col("column_name")))
    known = named.join(lookup(_squashed(F.col("name")), "squashed", "as_named"), "squashed", "left").join(lookup(skeleton(F.col("name")), "skeleton", "as_shortened"), "skeleton", "left")
    return known.withColumn("canonical", F.coalesce("as_named", "as_shortened")).drop("as_named", "as_shortened")


_COLUMN = "struct<column_name:string,column_type:string,squashed:string,canonical:string,skeleton:string>"
_PAIRS = "array<struct<old:string,new:string,old_type:string,new_type:string>>"


def match_columns(before: list[dict], later: list[dict]) -> list[tuple[dict | None, dict | None]]:
    """Columns of two files side by side: equal names, then one partner per key, in the order of names; the rest alone."""
    gone = {c["column_name"]: c for c in sorted(before, key=lambda c: c["column_name"])}
    came = {c["column_name"]: c for c in sorted(later, key=lambda c: c["column_name"])}
    pairs: list[tuple[dict | None, dict | None]] = [(gone.pop(n), came.pop(n)) for n in sorted(gone.keys() & came.keys())]
    for key in ("squashed", "canonical", "skeleton"):
        waiting: dict[str, list[dict]] = {}
        for c in came.values():
            if c[key]:
                waiting.setdefault(c[key], []).append(c)
        for name, c in list(gone.items()):
            if c[key] and waiting.get(c[key]):
                partner = waiting[c[key]].pop(0)
                del gone[name], came[partner["column_name"]]
                pairs.append((c, partner))
    return pairs + [(c, None) for c in gone.values()] + [(None, c) for c in came.values()]


def compare_files(files: DataFrame, rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """file_id, feed_code, prev_id, old, new, old_type, new_type: the columns of each file beside those of the file before it.

    The columns of one file are few; they are matched as one row per file. Only what then stands alone is compared by value.
    """
    schemas = checkpointed(with_canonical(file_schemas(files, rows), catalog))
    listed = schemas.groupBy("file_id").agg(F.collect_list(F.struct("column_name", "column_type", "squashed", "canonical", "skeleton").cast(_COLUMN)).alias("columns"))
    order = W.partitionBy("feed_code").orderBy("delivered_at", "file_id")
    placed = files.select("file_id", "feed_code", "delivered_at").join(listed, "file_id", "left").withColumn("columns", F.coalesce("columns", F.array().cast(f"array<{_COLUMN}>")))
    beside = placed.select("file_id", "feed_code", F.lag("file_id").over(order).alias("prev_id"), "columns", F.lag("columns").over(order).alias("before")).where("prev_id is not null")

    @F.pandas_udf(_PAIRS)
    def match(before: pd.Series, later: pd.Series) -> pd.Series:
        get = lambda c, k: c[k] if c is not None else None
        both = [match_columns(list(a), list(b)) for a, b in zip(before, later)]
        return pd.Series([[{"old": get(a, "column_name"), "new": get(b, "column_name"), "old_type": get(a, "column_type"), "new_type": get(b, "column_type")} for a, b in ps] for ps in both])

    compared = checkpointed(beside.select("file_id", "feed_code", "prev_id", F.inline(match("before", "columns"))))
    by_value = checkpointed(_value_matches(compared, files, rows))
    matched = by_value.select("file_id", "old", "new").withColumn("sides", F.array(F.struct(F.lit("old").alias("side"), F.col("old").alias("name")), F.struct(F.lit("new").alias("side"), F.col("new").alias("name"))))
    taken = matched.select("file_id", F.inline("sides"))
    named = compared.withColumn("side", F.when(F.col("new").isNull(), "old").when(F.col("old").isNull(), "new")).withColumn("name", F.coalesce("new", "old"))
    rest = named.join(taken, ["file_id", "side", "name"], "left_anti").select(*compared.columns)
    return rest.unionByName(by_value.select(*compared.columns))


def _value_matches(compared: DataFrame, files: DataFrame, rows: DataFrame) -> DataFrame:
    """Lone text columns of one file pair whose cells overlap; each takes the partner with the largest overlap."""
    lone_old = compared.where("new is null and old_type = 'text'").select("file_id", "feed_code", "prev_id", "old", "old_type")
    lone_new = compared.where("old is null and new_type = 'text'").select("file_id", "new", "new_type")
    # only where both kinds stand alone is there anything to compare
    gone, came = lone_old.join(lone_new.select("file_id"), "file_id", "left_semi"), lone_new.join(lone_old.select("file_id"), "file_id", "left_semi")
    lone = checkpointed(gone.select(F.col("prev_id").alias("file_id"), F.col("old").alias("column_name")).unionByName(came.select("file_id", F.col("new").alias("column_name"))).distinct())
    own = rows.join(lone.select("file_id").distinct(), "file_id", "left_semi")
    cells = path_values(files, own).where("raw_type is not null").join(lone, ["file_id", "column_name"], "left_semi")
    sketches = cells.groupBy("file_id", "column_name").agg(F.theta_sketch_agg(F.lower(F.trim("value")), SKETCH).alias("sketch"))
    pairs = gone.join(came, "file_id").join(sketches.select(F.col("file_id").alias("prev_id"), F.col("column_name").alias("old"), F.col("sketch").alias("a")), ["prev_id", "old"])
    both = pairs.join(sketches.select("file_id", F.col("column_name").alias("new"), F.col("sketch").alias("b")), ["file_id", "new"])
    overlap = F.theta_sketch_estimate(F.theta_intersection("a", "b")) / F.theta_sketch_estimate(F.theta_union("a", "b"))
    scored = both.withColumn("overlap", overlap).where(F.col("overlap") >= VALUE_OVERLAP)
    best = lambda side, other: F.row_number().over(W.partitionBy("file_id", side).orderBy(F.desc("overlap"), other))
    return scored.withColumn("x", best("old", "new")).withColumn("y", best("new", "old")).where("x = 1 and y = 1").select("file_id", "feed_code", "prev_id", "old", "new", "old_type", "new_type")


def schema_changes(files: DataFrame, rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """file_id, change_kind (added, removed, renamed, retyped), column_name (of the later file; for removed of the earlier)."""
    compared = compare_files(files, staged_once(rows), catalog)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("old").isNull(), F.lit("added")),
            F.when(F.col("new").isNull(), F.lit("removed")),
            F.when(F.col("old") != F.col("new"), F.lit("renamed")),
            F.when(F.col("old_type") != F.col("new_type"), F.lit("retyped")),
        )
    )
    return compared.select("file_id", F.explode(kinds).alias("change_kind"), F.coalesce("new", "old").alias("column_name"))


_NAMED = "file_id long, column_name string, name string"


def feed_columns(files: DataFrame, rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """file_id, column_name, name: the column of its feed's one table that each column of a file goes to.

    Matches of ``compare_files`` are carried from file to file. A column that comes without a match goes where its name
    went before, else its squashed name, canonical column or skeleton; two columns of one file never go to the same one.
    A column is named by the catalog's canonical of most of its files, else by its most frequent core name; the second of
    a name gets ``_2``. The schemas of one feed, a short row per file and column, are worked on as a group.
    """
    pairs = compare_files(files, rows, catalog).where("new is not null").select("file_id", F.col("new").alias("column_name"), "old")
    columns = files.select("feed_code", "delivered_at", "file_id", F.explode(F.array_distinct(F.transform("headers", safe_identifier))).alias("column_name")).where("column_name is not null")
    known = with_canonical(columns.join(pairs, ["file_id", "column_name"], "left"), catalog).withColumn("core", core_name(F.col("column_name")))

    def name(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["delivered_at", "file_id", "column_name"], na_position="first")
        pdf = pdf.astype(object).where(pdf.notna(), None)
        seen: dict[tuple, list[int]] = {}  # form of a name -> columns that had it, the last one last
        spoken: list[tuple[Counter, Counter]] = []
        before: dict[str, int] = {}
        out = []
        for _, own in pdf.groupby(["delivered_at", "file_id"], sort=False, dropna=False):
            file = own.to_dict("records")
            now = {c["column_name"]: before[c["old"]] for c in file if c["old"] in before}
            for key in ("column_name", "squashed", "canonical", "skeleton"):
                for c in file:
                    if c["column_name"] not in now and c[key]:
                        open_ = [k for k in seen.get((key, c[key]), ()) if k not in now.values()]
                        if open_:
                            now[c["column_name"]] = open_[-1]
            for c in file:
                if c["column_name"] not in now:
                    now[c["column_name"]] = len(spoken)
                    spoken.append((Counter(), Counter()))
                k = now[c["column_name"]]
                out.append((c["file_id"], c["column_name"], k))
                if c["canonical"]:
                    spoken[k][0][c["canonical"]] += 1
                spoken[k][1][c["core"]] += 1
                for key in ("column_name", "squashed", "canonical", "skeleton"):
                    if c[key]:
                        had = seen.setdefault((key, c[key]), [])
                        if k in had:
                            had.remove(k)
                        had.append(k)
            before = now
        names: list[str] = []
        for canonical, core in spoken:
            first = min((canonical or core).items(), key=lambda x: (-x[1], x[0]))[0]
            n, given = 1, first
            while given in names:
                n += 1
                given = f"{first}_{n}"
            names.append(given)
        return pd.DataFrame([(i, c, names[k]) for i, c, k in out], columns=["file_id", "column_name", "name"])

    return known.groupBy("feed_code").applyInPandas(name, _NAMED)


def number(value: Column, kind: Column) -> Column:
    """Decimal of a text whose ``kind`` (``raw_type``) is numeric, else null; a comma, apostrophe or blank before three digits parts
    thousands, another comma is the decimal point. Negative with a minus in front of the digits or in brackets."""
    plain = F.regexp_replace(F.regexp_replace(value, r"(?<=\d)[,' ](?=\d{3}(?!\d))", ""), ",", ".")
    sign = F.when(value.contains("-") | value.rlike(r"\(.*\)"), "-").otherwise("")
    return safe_numeric(F.when(kind == "numeric", F.concat(sign, F.regexp_replace(plain, "[^0-9.]", ""))))


def consistent_rows(files: DataFrame, rows: DataFrame, catalog: DataFrame, facilities: DataFrame) -> DataFrame:
    """Every cell of every file in its feed's one consistent table, cast to its column's type, with failed casts.

    feed_code, file_id, row_no, column_name (``feed_columns``), column_type (the most frequent type of the column in its
    feed), value (trimmed, null words to null), as_numeric, as_date, as_timestamp (the one of the column's type, where the
    cast succeeds), cast_failed (a value, but no cast). ``feed_table`` gives the columns side by side.

    Dates and instants are read as by ``timestamps``, in the date order and zone of the facility that the feed's code names
    (where it names none in UTC, and in the order that all dates of the feed with a part above 12 share); a date in a column of instants is its midnight there. Each distinct text of a feed is converted once.
    """
    once = staged_once(rows)
    named = checkpointed(feed_columns(files, once, catalog))
    values = path_values(files, once).join(named, ["file_id", "column_name"]).join(files.select("file_id", "feed_code"), "file_id").withColumn("column_name", F.col("name"))
    counted = values.where("raw_type is not null").groupBy("feed_code", "column_name").agg(*[F.count_if(F.col("raw_type") == t).alias(t) for t in TYPES])
    most = F.greatest(*TYPES)
    kinds = counted.select("feed_code", "column_name", F.coalesce(*[F.when(F.col(t) == most, t) for t in TYPES]).alias("column_type"))
    value = F.when(F.col("raw_type").isNotNull(), F.trim("value"))
    cells = values.join(kinds, ["feed_code", "column_name"], "left").select("feed_code", "file_id", "row_no", "column_name", "column_type", value.alias("value"), "raw_type")
    instant = F.col("column_type") == "timestamptz"
    dated = F.when(instant & (F.col("raw_type") == "date"), F.concat("value", F.lit(" 00:00"))).when(F.col("column_type").isin("date", "timestamptz"), F.col("value"))
    # instants, and birth dates, whose two-digit years lie before 2000
    flags = F.when(instant, 1).otherwise(0) + F.when(F.col("column_name").rlike("dob|birth"), 2).otherwise(0)
    cells = checkpointed(cells.withColumn("dated", dated).withColumn("flags", flags.cast("long")))
    codes = facilities.select(F.upper("facility_code").alias("facility"), "date_order", "time_zone").dropDuplicates(["facility"])
    part = lambda n: F.regexp_extract("dated", r"^(\d{1,2})([-/.])(\d{1,2})\2\d", n).try_cast("int")
    first, second = F.count_if((part(1) > 12) & (part(3) <= 12)), F.count_if((part(3) > 12) & (part(1) <= 12))
    orders = cells.where("dated is not null").groupBy("feed_code").agg(F.when((first > 0) & (second == 0), "DMY").when((second > 0) & (first == 0), "MDY").alias("own_order"))
    asked = cells.where("dated is not null").select("feed_code", "dated", "flags").distinct().withColumn("facility", F.upper("feed_code")).join(codes, "facility", "left").join(orders, "feed_code", "left")
    read = timestamps.normalise(
        asked.select(
            F.col("feed_code").alias("src_table"), F.col("flags").alias("row_id"), F.col("dated").alias("field_name"), F.col("dated").alias("value"), F.coalesce("date_order", "own_order", F.lit("")).alias("date_order"), F.coalesce("time_zone", F.lit("UTC")).alias("time_zone"),
            (F.col("flags") % 2 == 1).alias("instant"), (F.col("flags") >= 2).alias("old"),
        )
    )
    typed = cells.join(read.select(F.col("src_table").alias("feed_code"), F.col("row_id").alias("flags"), F.col("field_name").alias("dated"), "norm_value"), ["feed_code", "flags", "dated"], "left")
    of = lambda kind, cast: F.when(F.col("column_type") == kind, cast)
    typed = typed.select(
        "feed_code",
        "file_id",
        "row_no",
        "column_name",
        "column_type",
        "value",
        of("numeric", number(F.col("value"), F.col("raw_type"))).alias("as_numeric"),
        of("date", F.col("norm_value").try_cast("date")).alias("as_date"),
        of("timestamptz", F.col("norm_value").try_cast("timestamp")).alias("as_timestamp"),
    )
    cast = F.coalesce(F.col("as_numeric").isNotNull() | F.col("as_date").isNotNull() | F.col("as_timestamp").isNotNull(), F.lit(False))
    return typed.withColumn("cast_failed", F.col("value").isNotNull() & (F.col("column_type") != "text") & ~cast)


def feed_table(cells: DataFrame, feed_code: str) -> DataFrame:
    """One feed's cells of ``consistent_rows`` as a table: file_id, row_no, its columns in their types, and failed_casts
    (names). Of headers that are one column the greatest value counts."""
    own = cells.where(F.col("feed_code") == feed_code)
    columns = sorted((r[0], r[1] or "text") for r in own.select("column_name", "column_type").distinct().collect())
    source = {"text": "value", "numeric": "as_numeric", "date": "as_date", "timestamptz": "as_timestamp"}
    wide = [F.max(F.when(F.col("column_name") == name, F.col(source[kind]))).alias(name) for name, kind in columns]
    return own.groupBy("file_id", "row_no").agg(*wide, F.array_sort(F.collect_set(F.when(F.col("cast_failed"), F.col("column_name")))).alias("failed_casts"))
