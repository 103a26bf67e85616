"""Stream catalog: signatures, denylist, drift candidates, aliases, overlays, typed views."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.casts import typed
from quernstone.functions.text import column_signature, label_slug, quoted, safe_identifier, safe_name

#: A column whose safe name contains one of these is never stored.
DENYLIST = ("ssn", "social_security", "social_sec", "password", "passwd")
DRIFT_SIMILARITY = 0.70


def signatures(files: DataFrame) -> DataFrame:
    """file_id, signature, safe_columns (sorted, distinct)."""
    safe = F.array_sort(F.array_distinct(F.array_compact(F.transform("headers", safe_identifier))))
    return files.select("file_id", column_signature(F.col("headers")).alias("signature"), safe.alias("safe_columns"))


def denied(name: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether a safe column name contains a denied token (anywhere: ``businessname`` is denied too)."""
    return F.exists(F.array(*[F.lit(t) for t in (*DENYLIST, *extra)]), lambda t: name.contains(t))


def stored_columns(columns: Column, extra: tuple[str, ...] = ()) -> Column:
    return F.filter(columns, lambda c: ~denied(c, extra))


def select_stored(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Raw headers renamed to safe ones (the last of equal names wins), denied columns dropped; none left is an error."""
    names = {raw: safe_name(raw) for raw in df.columns}
    if None in names.values():
        raise ValueError("a header has no letter or digit")
    last = {safe: raw for raw, safe in names.items()}
    kept = {s: r for s, r in last.items() if not any(t in s for t in (*DENYLIST, *extra))}
    if not kept:
        raise ValueError("no column is left after the denylist")
    return df.select(*[F.col(quoted(raw)).alias(safe) for safe, raw in kept.items()])


def drift_candidates(catalog: DataFrame, similarity: float = DRIFT_SIMILARITY) -> DataFrame:
    """column_signature, candidate, similarity: the earliest other stream whose column sets overlap by Jaccard.

    Sets that overlap by at least t share one of their first n - ceil(t n) + 1 columns in any fixed order; with the
    rarest columns first, few pairs meet (a prefix-filter join, no pair of the result is lost).
    """
    sets = catalog.select("column_signature", "first_ingested_at", F.array_distinct("safe_columns").alias("columns")).where(F.size("columns") > 0)
    exploded = sets.select("column_signature", F.size("columns").alias("n"), F.explode("columns").alias("c"))
    counts = exploded.groupBy("c").agg(F.count("*").alias("df"))
    place = F.row_number().over(W.partitionBy("column_signature").orderBy("df", "c"))
    prefix = exploded.join(counts, "c").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity) + 1)
    side = lambda s: prefix.select(F.col("column_signature").alias(s), "c", F.col("n").alias(f"n_{s}"))
    fits = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity) & (F.col("a") != F.col("b"))
    pairs = side("a").join(side("b"), "c").where(fits).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("column_signature").alias("a"), F.col("columns").alias("ca")), "a").join(
        sets.select(F.col("column_signature").alias("b"), F.col("columns").alias("cb"), F.col("first_ingested_at").alias("at")), "b"
    )
    score = F.size(F.array_intersect("ca", "cb")) / F.size(F.array_union("ca", "cb"))
    hits = both.withColumn("similarity", score).where(F.col("similarity") >= similarity)
    return hits.groupBy(F.col("a").alias("column_signature")).agg(F.min_by(F.struct(F.col("b").alias("candidate"), "similarity"), F.struct("at", "b")).alias("x")).select("column_signature", "x.candidate", "x.similarity")


def resolve_aliases(catalog: DataFrame) -> DataFrame:
    """column_signature, target, staging_table, chained: one hop; an alias that points to an alias is flagged, not followed."""
    target = catalog.select(F.col("column_signature").alias("target"), F.col("staging_table").alias("target_table"), F.col("aliased_to").alias("next"))
    joined = catalog.select("column_signature", "aliased_to", "staging_table").join(target, F.col("aliased_to") == F.col("target"), "left")
    return joined.select(
        "column_signature",
        F.coalesce("aliased_to", "column_signature").alias("target"),
        F.coalesce("target_table", "staging_table").alias("staging_table"),
        (F.col("aliased_to").isNotNull() & F.col("next").isNotNull()).alias("chained"),
    )


def overlay(catalog: DataFrame, config: DataFrame) -> DataFrame:
    """Catalog with the non-null values of a declared configuration, by column_signature."""
    shared = [c for c in config.columns if c != "column_signature" and c in catalog.columns]
    renamed = config.select("column_signature", *[F.col(c).alias(f"_new_{c}") for c in shared])
    joined = catalog.join(renamed, "column_signature", "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in shared else F.col(c) for c in catalog.columns])


def read_overlay(path: str) -> list[dict]:
    """Declared streams of a configuration file: JSON, or YAML where a reader for it is installed; a missing file declares none."""
    try:
        with open(path, encoding="utf-8") as config:
            text = config.read()
    except FileNotFoundError:
        return []
    if path.endswith(".json"):
        found = json.loads(text or "{}")
    else:
        import yaml

        found = yaml.safe_load(text) or {}
    return [s for s in (found.get("sources") or found.get("streams") or []) if isinstance(s, dict)]


def overlay_errors(catalog: DataFrame, declared: list[dict]) -> list[str]:
    """What is wrong with declared streams: a signature must have 32 characters and be in the catalog."""
    wanted = [str(s.get("column_signature") or "") for s in declared]
    known = {r[0] for r in catalog.where(F.col("column_signature").isin(wanted)).select("column_signature").collect()} if wanted else set()
    return [f"{s!r}: {'not 32 characters' if len(s) != 32 else 'not in the catalog'}" for s in wanted if len(s) != 32 or s not in known]


def new_columns(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, added: safe columns of a file that its stream's staging table doesn't have yet, denied ones left out."""
    safe = signatures(files).withColumnRenamed("signature", "column_signature")
    target = resolve_aliases(catalog).select("column_signature", "target")
    stored = catalog.select(F.col("column_signature").alias("target"), "stored_columns")
    joined = safe.join(target, "column_signature").join(stored, "target")
    return joined.select("file_id", F.array_except(stored_columns(F.col("safe_columns")), F.coalesce("stored_columns", F.array().cast("array<string>"))).alias("added"))


def register(catalog: DataFrame, files: DataFrame, declared: DataFrame | None = None, similarity: float = DRIFT_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Streams of arriving files (file_id, headers, delivered_at): the catalog as it is afterwards, and file_id, column_signature,
    target, staging_table, outcome (``known``, ``aliased``, ``new``).

    A known signature takes over declared values and columns new to its table; an alias leads to its target, whose table
    gets them; a new one is added with a staging table of its own, beside the stream it may have drifted from.
    """
    seen = signatures(files).withColumnRenamed("signature", "column_signature").join(files.select("file_id", "headers", "delivered_at"), "file_id")
    first = seen.groupBy("column_signature").agg(F.min_by(F.struct("headers", "safe_columns"), F.struct("delivered_at", "file_id")).alias("f"), F.min("delivered_at").alias("first_ingested_at"), F.max("delivered_at").alias("last_ingested_at"))
    fresh = first.join(catalog.select("column_signature"), "column_signature", "left_anti").select(
        "column_signature",
        F.concat(F.lit("stg_"), F.substring("column_signature", 1, 12)).alias("staging_table"),
        F.col("f.headers").alias("representative_headers"),
        F.col("f.safe_columns").alias("safe_columns"),
        stored_columns(F.col("f.safe_columns")).alias("stored_columns"),
        F.lit("append").alias("load_mode"),
        F.lit(False).alias("query_exposed"),
        "first_ingested_at",
        "last_ingested_at",
    )
    both = catalog.unionByName(fresh, allowMissingColumns=True)
    near = drift_candidates(both, similarity).join(fresh.select("column_signature"), "column_signature", "left_semi").select("column_signature", "candidate")
    drifted = both.join(near, "column_signature", "left").withColumn("candidate_drift_of", F.coalesce("candidate_drift_of", "candidate")).drop("candidate")
    latest = first.select("column_signature", F.col("last_ingested_at").alias("_at"))
    merged = drifted.join(latest, "column_signature", "left").withColumn("last_ingested_at", F.greatest("last_ingested_at", "_at")).drop("_at")
    added = new_columns(merged, files).where(F.size("added") > 0).join(seen.select("file_id", "column_signature"), "file_id").join(resolve_aliases(merged).select("column_signature", "target"), "column_signature")
    more = added.select("target", F.explode("added").alias("c")).groupBy("target").agg(F.array_sort(F.collect_set("c")).alias("_more"))
    synced = merged.join(more, merged["column_signature"] == more["target"], "left").withColumn("stored_columns", F.when(F.col("_more").isNotNull(), F.array_union("stored_columns", "_more")).otherwise(F.col("stored_columns"))).drop("_more", "target")
    after = overlay(synced, declared) if declared is not None else synced
    after = after.select(*catalog.columns)
    known = catalog.select("column_signature", F.when(F.col("aliased_to").isNotNull(), "aliased").otherwise("known").alias("outcome"))
    placed = seen.select("file_id", "column_signature").join(resolve_aliases(after).drop("chained"), "column_signature").join(known, "column_signature", "left")
    return after, placed.withColumn("outcome", F.coalesce("outcome", F.lit("new")))


def listing(catalog: DataFrame) -> DataFrame:
    """The streams in the order of their first file, with what an operator asks for."""
    shown = catalog.select(F.substring("column_signature", 1, 8).alias("signature"), "human_label", "load_mode", "query_exposed", "rows_total", F.substring("aliased_to", 1, 8).alias("aliased_to"), F.size("safe_columns").alias("n_columns"), "first_ingested_at", "column_signature")
    return shown.orderBy("first_ingested_at", "column_signature").drop("column_signature")


def labelled(catalog: DataFrame, prefix: str, label: str) -> DataFrame:
    """The catalog with a stream's label, as a slug."""
    hit = F.col("column_signature") == by_prefix(catalog, prefix)
    return catalog.withColumn("human_label", F.when(hit, label_slug(F.lit(label))).otherwise(F.col("human_label")))


def aliased(catalog: DataFrame, prefix: str, target: str) -> DataFrame:
    """The catalog with one stream led into another's table, whose columns grow by those it lacks.

    A stream can't be an alias of itself, nor of an alias.
    """
    own, into = by_prefix(catalog, prefix), by_prefix(catalog, target)
    rows = {r["column_signature"]: r for r in catalog.where(F.col("column_signature").isin(own, into)).select("column_signature", "aliased_to", "stored_columns").collect()}
    if own == into or rows[into]["aliased_to"]:
        raise ValueError("an alias must lead to another stream that is none itself")
    more = F.array(*[F.lit(c) for c in rows[own]["stored_columns"] or []]).cast("array<string>")
    column = F.col("column_signature")
    return catalog.withColumn("aliased_to", F.when(column == own, F.lit(into)).otherwise(F.col("aliased_to"))).withColumn("stored_columns", F.when(column == into, F.array_union("stored_columns", more)).otherwise(F.col("stored_columns")))


def by_prefix(catalog: DataFrame, prefix: str) -> str:
    """The one signature that begins with the prefix; none and several are errors."""
    found = [r[0] for r in catalog.where(F.col("column_signature").startswith(prefix)).select("column_signature").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"no stream begins with {prefix!r}" if not found else f"{prefix!r} is ambiguous")
    return found[0]


def typed_view(staged: DataFrame, mapping: dict[str, tuple[str, str, str | None]], deleted: str = "_deleted_at") -> DataFrame:
    """mapping: safe column -> (canonical name, type, format). Live rows only, each column cast without errors.

    A mapped column that isn't there is an error that tells a denied one from an unknown one.
    """
    for name in mapping:
        if name not in staged.columns:
            raise ValueError(f"{name} is denied" if any(t in name for t in DENYLIST) else f"{name} not found")
    live = staged.where(F.col(deleted).isNull()) if deleted in staged.columns else staged
    return live.select(*[typed(F.col(quoted(safe)), kind, fmt).alias(canonical) for safe, (canonical, kind, fmt) in mapping.items()])


def expose(view: DataFrame, name: str) -> str:
    """Register a typed view for SQL; :func:`unexpose` drops it."""
    view.createOrReplaceTempView(name)
    return name


def unexpose(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def visible_columns(spark: SparkSession) -> DataFrame:
    """view_name, columns of the session's views whose name begins with ``v_``; system columns (a leading ``_``) are hidden."""
    found = [(t.name, [c.name for c in spark.catalog.listColumns(t.name) if not c.name.startswith("_")]) for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith("v_")]
    return spark.createDataFrame(found, "view_name string, columns array<string>")


def schema_prompt(spark: SparkSession, question_tokens: list[str], top: int = 5, examples: list[tuple[str, str]] = ()) -> str:
    """The views that fit a question best, a line each with their columns, and worked examples, for a model that writes SQL."""
    views = visible_columns(spark)
    best = link_score(views, question_tokens, top).join(views, "view_name").orderBy(F.desc_nulls_last("score"), "view_name").collect()
    lines = [f"{r['view_name']}({', '.join(r['columns'])})" for r in best]
    return "\n".join(["Views:", *lines, *(f"Question: {q}\nSQL: {sql}" for q, sql in examples)])


def link_score(views: DataFrame, question_tokens: list[str], top: int = 5) -> DataFrame:
    """views: view_name, columns -> the best by shared tokens over vocabulary size; the first ``top`` even at no overlap.

    The vocabulary is the view's name without ``v_`` and all column-name parts longer than two letters.
    """
    stem = F.split(F.regexp_replace("view_name", "^v_", ""), "_")
    parts = F.filter(F.flatten(F.transform("columns", lambda c: F.split(c, "_"))), lambda p: F.length(p) > 2)
    vocabulary = F.array_union(stem, parts)
    shared = F.size(F.array_intersect(vocabulary, F.array(*[F.lit(t) for t in question_tokens]).cast("array<string>")))
    scored = views.select("view_name", (shared / F.nullif(F.size(vocabulary), F.lit(0))).alias("score"))
    return scored.orderBy(F.desc_nulls_last("score"), "view_name").limit(top)
