"""One surviving record per group of duplicates, field by field, by iterative truth discovery.

Claims are (group, field, value, source, time). Estimating what is true and how reliable a source is take turns: a
value is supported by the sum of the weights of the sources that claim it, a source's reliability is the share of its
claims that won, and its weight the log odds of that share. The turns end when the elected values are those of a turn
before: mostly the last one, else the turns go round in a circle. There are finitely many elections, so they do end.

``recency`` settles how claims of one group and field compete. ``strict``: only the latest usable claims stand for
election, the weighted vote decides between them. ``none``: all usable claims stand. Ties end with the smallest value.

Nothing here is grouped in memory: votes are sums per value, combined before the shuffle, so a group or source with a
third of all claims is spread. Null, blank, incomplete and unusable values are no claims; a field without any gives no
row; equal rows count as separate claims; a claim without source has the source ``""``; ids that mean "not known"
identify nobody.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.session import checkpointed

#: Chart numbers that identify nobody, in upper case.
UNKNOWN_IDS = ("", "TEMP", "UNK", "UNKNOWN", "PENDING", "N/A", "NA", "NONE", "NULL", "NAN", "TBD", "-", "--", "?", "0")
_BLANKS = " \t\r\n"


def known_id(col: Column) -> Column:
    """The trimmed id, or null where it means "not known" (also runs of one digit such as 0000 or P999999999)."""
    trimmed = F.btrim(col, F.lit(_BLANKS))
    return F.when(~F.upper(trimmed).isin(*UNKNOWN_IDS) & ~trimmed.rlike(r"^[A-Za-z]{0,3}-?(\d)\1{3,}$"), trimmed)


def usable_phone(col: Column) -> Column:
    """Ten digits, or null: letters, missing digits and placeholders make a number unusable."""
    plain = F.btrim(col, F.lit(_BLANKS))
    digits = F.regexp_replace(F.regexp_replace(plain, r"[^0-9]", ""), r"^1(?=\d{10}$)", "")
    fits = plain.rlike(r"^[+]?[0-9 ().\-/]+$") & digits.rlike(r"^[2-9]\d{9}$") & ~digits.rlike(r"^(\d)\1{9}$")
    return F.when(fits, digits)


def complete_address(col: Column) -> Column:
    """The trimmed address if it has number, street, town, state and postal code, else null."""
    plain = F.btrim(col, F.lit(_BLANKS))
    return F.when(plain.rlike(r"(?i)^\d+[a-z]?\s+[^\d\s,][^,]*\s+[^,\s]+.*[,\s]\s*\S.*,?\s+[a-z]{2}\s+\d{5}(?:-\d{4})?$") & plain.rlike(r"^\d+\S*(?:[\s,]+\S+){5,}$"), plain)


def discover(claims: DataFrame, recency: str = "strict") -> DataFrame:
    """claims: group_id, field_name, value, source, claimed_at -> group_id, field_name, kept_value, support."""
    if recency not in ("strict", "none"):
        raise ValueError("recency must be strict or none")
    named = claims.where("value is not null").withColumn("source", F.coalesce("source", F.lit("")))
    counted = checkpointed(
        named.groupBy("group_id", "field_name", "value", "source").agg(F.count("*").alias("n"), F.max("claimed_at").alias("claimed_at"))
    )
    latest = counted.groupBy("group_id", "field_name").agg(F.max("claimed_at").alias("latest"))
    standing = F.col("claimed_at").eqNullSafe(F.col("latest")) if recency == "strict" else F.lit(True)
    votes = checkpointed(counted.join(latest, ["group_id", "field_name"]).withColumn("stands", standing).drop("latest", "claimed_at"))
    weights = votes.select("source").distinct().withColumn("weight", F.lit(1.0))
    seen = set()
    while True:
        won = checkpointed(_elect(votes, weights))
        key = F.xxhash64("group_id", "field_name", "kept_value")
        sign = tuple(won.agg(F.count("*"), F.bit_xor(key), F.sum(F.pmod(key, F.lit(1 << 31)))).first())
        if sign in seen:
            return won
        seen.add(sign)
        share = (
            votes.join(won.select("group_id", "field_name", "kept_value"), ["group_id", "field_name"])
            .groupBy("source")
            .agg((F.sum(F.when(F.col("value") == F.col("kept_value"), F.col("n")).otherwise(0)) + 4).alias("right"), (F.sum("n") + 5).alias("claims"))
            .select("source", (F.col("right") / F.col("claims")).alias("share"))
        )
        # log odds, kept positive so that no source votes against its own claims
        weights = share.select("source", F.greatest(F.log(F.col("share") / (1 - F.col("share"))), F.lit(0.05)).alias("weight"))


def _elect(votes: DataFrame, weights: DataFrame) -> DataFrame:
    supported = votes.join(weights, "source").groupBy("group_id", "field_name", "value").agg(F.sum(F.col("n") * F.col("weight")).alias("support"), F.max("stands").alias("stands"))
    # the largest support; of equals the smallest value
    best = F.min_by(F.struct("value", "support"), F.struct((-F.round("support", 9)).alias("s"), "value"))
    return supported.where("stands").groupBy("group_id", "field_name").agg(best.alias("b")).select("group_id", "field_name", F.col("b.value").alias("kept_value"), F.col("b.support").alias("support"))


def duplicate_groups(patients: DataFrame) -> DataFrame:
    """Rows of chart numbers with two rows or more, with group_id: the smallest id of the group."""
    known = patients.withColumn("chart", known_id(F.col("patient_id"))).where("chart is not null")
    groups = known.groupBy("chart").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return known.join(groups, "chart")


def patient_claims(grouped: DataFrame) -> DataFrame:
    """Claims for phone and address; the source is the facility that starts the first file name."""
    source = F.upper(F.regexp_extract("source_files", r"^[^A-Za-z0-9]*([A-Za-z0-9]+)", 1))
    fields = F.array(
        F.struct(F.lit("phone").alias("field_name"), usable_phone(F.col("phone")).alias("value")),
        F.struct(F.lit("address").alias("field_name"), complete_address(F.col("address")).alias("value")),
    )
    flat = grouped.select("group_id", source.alias("source"), F.col("updated_at").alias("claimed_at"), F.explode(fields).alias("f"))
    return flat.select("group_id", "f.field_name", "f.value", "source", "claimed_at")


def file_lists(grouped: DataFrame) -> DataFrame:
    """The distinct file names of each group, sorted by code point, joined by commas."""
    names = grouped.select("group_id", F.explode(F.split("source_files", r"[\s,;|]+")).alias("name")).where("name != ''").distinct()
    joined = names.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("kept_value"))
    return joined.select("group_id", F.lit("source_files").alias("field_name"), "kept_value")


def survivors(patients: DataFrame, recency: str = "strict") -> DataFrame:
    """group_id, field_name, kept_value for phone, address and source_files."""
    grouped = duplicate_groups(patients.select("id", "patient_id", "phone", "address", "source_files", "updated_at"))
    chosen = discover(patient_claims(grouped), recency).select("group_id", "field_name", "kept_value")
    return chosen.unionByName(file_lists(grouped))
