"""Casts that give null instead of an error, and date-format translation."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import strip

#: Tokens of the declared date formats and their Spark patterns (single letters accept both widths).
FORMAT_TOKENS = (
    ("YYYY", "yyyy"),
    ("HH24", "H"),
    ("HH12", "h"),
    ("MI", "m"),
    ("SS", "s"),
    ("Mon", "MMM"),
    ("Month", "MMMM"),
    ("MM", "M"),
    ("DD", "d"),
    ("AM", "a"),
)


def spark_format(declared: str) -> str:
    """``YYYY-MM-DD HH24:MI`` -> ``yyyy-M-d H:m``; text that is no token is kept, letters quoted."""
    tokens = sorted(FORMAT_TOKENS, key=lambda t: -len(t[0]))
    out, i = [], 0
    while i < len(declared):
        for name, pattern in tokens:
            if declared.startswith(name, i):
                out.append(pattern)
                i += len(name)
                break
        else:
            out.append(f"'{declared[i]}'" if declared[i].isalpha() else declared[i])
            i += 1
    return "".join(out)


def safe_numeric(col: Column, scale: int = 6) -> Column:
    """Digits and points of the text as a decimal, null where they form no number.

    Negative where the trimmed text starts with ``-`` or is in brackets. ``1e5`` gives 15 and ``$-5`` gives 5:
    the sign is only looked for in front.
    """
    trimmed = strip(col)
    negative = trimmed.startswith("-") | trimmed.rlike(r"^\(.*\)$")
    digits = F.regexp_replace(trimmed, r"[^0-9.]", "")
    number = F.when(digits != "", digits).try_cast(f"decimal(38,{scale})")
    return F.when(negative, -number).otherwise(number)


def safe_date(col: Column, declared: str = "YYYY-MM-DD") -> Column:
    trimmed = strip(col)
    return F.try_to_timestamp(F.when(trimmed != "", trimmed), F.lit(spark_format(declared))).cast("date")


def safe_timestamp(col: Column, declared: str = "YYYY-MM-DD HH24:MI:SS") -> Column:
    trimmed = strip(col)
    return F.try_to_timestamp(F.when(trimmed != "", trimmed), F.lit(spark_format(declared)))


def any_date(col: Column, formats: tuple[str, ...] = ("yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "d MMMM yyyy", "MMMM d, yyyy")) -> Column:
    """ISO text of the first format that fits (month first); otherwise the text itself."""
    trimmed = strip(col)
    parsed = F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)).cast("date") for f in formats])
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), col)


def typed(col: Column, kind: str, declared: str | None = None) -> Column:
    """The cast of a column mapping entry: text, numeric, date or timestamptz."""
    if kind == "numeric":
        return safe_numeric(col)
    if kind == "date":
        return safe_date(col, declared or "YYYY-MM-DD")
    if kind == "timestamptz":
        return safe_timestamp(col, declared or "YYYY-MM-DD HH24:MI:SS")
    return col


#: SQL bodies of the casts for ad-hoc statements; Spark inlines them, so they stay in generated code.
_STRIPPED = r"regexp_replace(v, '(?U)^\\s+|\\s+$', '')"
_DIGITS = r"nullif(regexp_replace(v, '[^0-9.]', ''), '')"
_NUMBER = f"TRY_CAST({_DIGITS} AS DECIMAL(38,6))"
_PATTERN = "f"
# two-digit months first: what month names become must stay
for _token, _spark in sorted(FORMAT_TOKENS, key=lambda t: (t[0] != "MM", -len(t[0]))):
    _PATTERN = f"replace({_PATTERN}, '{_token}', '{_spark}')"
SQL_FUNCTIONS = {
    "safe_numeric": ("v STRING", "DECIMAL(38,6)", rf"CASE WHEN startswith({_STRIPPED}, '-') OR {_STRIPPED} RLIKE '^\\(.*\\)$' THEN -({_NUMBER}) ELSE {_NUMBER} END"),
    "safe_date": ("v STRING", "DATE", f"CAST(try_to_timestamp(nullif({_STRIPPED}, ''), 'yyyy-M-d') AS DATE)"),
    "safe_timestamptz": ("v STRING", "TIMESTAMP", f"try_to_timestamp(nullif({_STRIPPED}, ''), 'yyyy-M-d H:m:s')"),
}


def register(spark: SparkSession) -> None:
    """The casts as functions of ad-hoc SQL: ``safe_numeric(text)``, ``safe_date(text)``, ``safe_timestamptz(text)``, and
    with a declared format ``safe_date_as(text, 'MM/DD/YYYY')`` and ``safe_timestamptz_as``."""
    declared = {
        "safe_date_as": ("v STRING, f STRING", "DATE", f"CAST(try_to_timestamp(nullif({_STRIPPED}, ''), {_PATTERN}) AS DATE)"),
        "safe_timestamptz_as": ("v STRING, f STRING", "TIMESTAMP", f"try_to_timestamp(nullif({_STRIPPED}, ''), {_PATTERN})"),
    }
    for name, (arguments, kind, body) in {**SQL_FUNCTIONS, **declared}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
