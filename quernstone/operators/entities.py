"""Resolution of people by identifiers and names, and merging of what their rows say."""

from __future__ import annotations

import difflib
import math
import re
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.text import canonical_name, name_tokens
from quernstone.operators import nearnames
from quernstone.session import checkpointed

SIMILARITY = 0.82
BLOCK = 5000
#: Names of a tile's side at most, and at least where there are fewer tiles than tasks.
TILE, LEAST_TILE = 1 << 16, 1 << 11
_UNKNOWN = ("", "Unknown")


def token_subset(a: Column, b: Column) -> Column:
    """Whether the smaller of two token sets has at least two tokens and lies within the other."""
    smaller = F.least(F.size(a), F.size(b))
    return (smaller >= 2) & (F.size(F.array_intersect(a, b)) == smaller)


def name_score(a: str | None, b: str | None) -> float:
    """1.0 for a token subset of two or more, else the sequence ratio of the sorted tokens; an empty name scores 0."""
    ta, tb = ({t for t in re.sub("[.,]", " ", (n or "").lower()).split()} for n in (a, b))
    if not ta or not tb:
        return 0.0
    small, large = sorted((ta, tb), key=len)
    if len(small) >= 2 and small <= large:
        return 1.0
    return difflib.SequenceMatcher(None, " ".join(sorted(ta)), " ".join(sorted(tb))).ratio()


def subset_matches(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, id: names that match a query by token subset. Only names that share a token with a query meet."""
    q = queries.select(F.col("id").alias("query_id"), name_tokens(F.col("name")).alias("qt"))
    n = names.select("id", name_tokens(F.col("name")).alias("nt"))
    # a match shares all tokens of the smaller set, hence any of them: the rarest of the query would do, the smaller set is unknown
    shared = q.select("query_id", "qt", F.explode("qt").alias("t")).join(n.select("id", "nt", F.explode("nt").alias("t")), "t")
    return shared.where(token_subset(F.col("qt"), F.col("nt"))).select("query_id", "id").distinct()


def fuzzy_matches(queries: DataFrame, names: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """query_id, id, score: a stated query set against all names, in blocks of queries shipped with the tasks.

    Cheap upper bounds of the ratio come first, so that most pairs are never aligned.
    """
    return _searched(queries, names, similarity, block, None)


def closest(queries: DataFrame, names: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """query_id, id, score: of :func:`fuzzy_matches` the best with another id than the query's own, the smallest id of equals.

    Each task keeps two ids a query, as one can be its own, and aligns nothing that can't reach the second.
    """
    return best_match(_searched(queries, names, similarity, block, 2).where("query_id != id"))


def all_closest(names: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """query_id, id, score: what :func:`closest` gives where every name is asked.

    Equal texts and token subsets are joined; a text that has another id by them can't be closer to any. The others are
    compared with all texts in tiles, a task each.
    """
    keyed = names.where("id is not null and name is not null").select(F.col("id").cast("long").alias("id"), "name").mapInPandas(nearnames.as_texts, "id long, text string")
    own = checkpointed(_two_least(keyed))
    tokens = own.select("text", "ids", F.split("text", " ").alias("t"))
    # a subset is found by a pair of its tokens, the longest two as they are rare; pairs are in the order of the text
    pair = F.array_join(F.array_sort(F.slice(F.reverse(F.array_sort(F.transform("t", lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))))["x"], 1, 2)), " ")
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.concat_ws(" ", x, y))))
    small = tokens.where("size(t) > 1").select(pair.alias("pair"), F.col("text").alias("s"), F.col("ids").alias("s_ids"), F.col("t").alias("st"))
    large = tokens.where("size(t) > 1").select(F.explode(pairs).alias("pair"), F.col("text").alias("l"), F.col("ids").alias("l_ids"), F.col("t").alias("lt"))
    within = small.join(large, "pair").where("s != l and size(array_except(st, lt)) = 0")
    sides = [own.select("text", F.explode("ids").alias("id")), *(within.select(F.col(a).alias("text"), F.explode(f"{b}_ids").alias("id")) for a, b in ("sl", "ls"))]
    full = checkpointed(_two_least(sides[0].unionByName(sides[1]).unionByName(sides[2])))
    other = F.when(F.col("ids")[0] != F.col("id"), F.col("ids")[0]).otherwise(F.col("ids")[1])
    same = keyed.join(full.where("size(ids) > 1"), "text").select(F.col("id").alias("query_id"), other.alias("id"), F.lit(1.0).alias("score"))
    near = _tiles(full.where("size(ids) = 1"), own, similarity)
    return best_match(same.unionByName(keyed.withColumnRenamed("id", "query_id").join(near, "text").select("query_id", "id", "score")))


def _two_least(rows: DataFrame) -> DataFrame:
    """text, ids: the two smallest."""
    ranked = rows.withColumn("nth", F.dense_rank().over(W.partitionBy("text").orderBy("id"))).where("nth <= 2")
    return ranked.groupBy("text").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def _tiles(asked: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """text, id, score of asked texts, by tile: the best text with another id, by the ratio alone."""
    size = own.count()
    n = max(1, math.ceil(size / TILE), min(math.ceil(size / LEAST_TILE), math.ceil(math.sqrt(2 * own.sparkSession.sparkContext.defaultParallelism))))
    part, each = F.pmod(F.xxhash64("text"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ids = F.col("ids")[0].alias("first"), F.element_at("ids", -1).alias("second")
    sides = [df.select(F.lit(i == 0).alias("asked"), "text", *ids, part.alias("part"), each.alias("each")).withColumn("tile", F.expr(f"{a} * {n} + {b}")).drop("part", "each") for i, (df, a, b) in enumerate(((asked, "part", "each"), (own, "each", "part")))]
    # as many partitions as stated, or small tiles would be put into one task
    spread = sides[0].unionByName(sides[1]).repartition(2 * n * n, "tile")
    return spread.groupBy("tile").applyInPandas(lambda pdf: nearnames.tile(pdf, similarity), "text string, id long, score double")


def _searched(queries: DataFrame, names: DataFrame, similarity: float, block: int, best: int | None) -> DataFrame:
    asked = queries.select("id", "name").where("name is not null").orderBy("id")
    spark = names.sparkSession
    # few files would be few tasks
    spread = names.select("id", "name").where("name is not null").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "name")
    result = None
    rows = [(r[0], r[1]) for r in asked.toLocalIterator()]
    for at in range(0, max(1, len(rows)), block):
        run = partial(nearnames.search, rows=rows[at : at + block], similarity=similarity, best=best)
        found = spread.mapInPandas(run, "query_id long, id long, score double")
        result = found if result is None else result.unionByName(found)
    return result


def best_match(matches: DataFrame) -> DataFrame:
    """The highest score per query, the smallest id of equals."""
    return matches.groupBy("query_id").agg(F.min_by(F.struct("id", "score"), F.struct((-F.col("score")).alias("s"), "id")).alias("m")).select("query_id", "m.id", "m.score")


def resolve(rows: DataFrame, subject_id: str | None = None, patient_id: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Primary keys by any of the given identifiers or among the ids of name matches."""
    hit = F.lit(False)
    if subject_id is not None:
        hit = hit | (F.col("subject_id") == subject_id)
    if patient_id is not None:
        hit = hit | (F.col("patient_id") == patient_id)
    found = rows.where(hit).select("id")
    return found if ids is None else found.union(ids.select("id")).distinct()


def merge_fields(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row per key: the first row as it is, its empty fields filled from the first later row that has more than a placeholder."""
    first = F.min_by(F.struct(*fields), order).alias("first")
    usable = lambda c: F.col(c).isNotNull() & ~F.col(c).isin(*_UNKNOWN)
    later = [F.min_by(c, F.when(usable(c), F.col(order))).alias(f"_{c}") for c in fields]
    grouped = rows.groupBy(key).agg(first, *later)
    keep = lambda c: F.when(F.col(f"first.{c}").isNotNull() & (F.col(f"first.{c}") != ""), F.col(f"first.{c}")).otherwise(F.coalesce(f"_{c}", f"first.{c}"))
    return grouped.select(key, *[keep(c).alias(c) for c in fields])


def file_union(rows: DataFrame, key: str, order: str, files: str) -> DataFrame:
    """Distinct file names of each key in the order of first sight, joined by commas."""
    each = rows.select(key, order, F.posexplode(F.split(files, r"\s*[,;]\s*")).alias("i", "f")).where("trim(f) != ''")
    first = each.groupBy(key, F.trim("f").alias("f")).agg(F.min(F.struct(order, "i")).alias("at"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "f"))), lambda x: x["f"]), ",").alias(files))


def by_keys(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(incoming with the id of the row that its first known key matches, rows without a match), key by key.

    Keys are tried in their order; an empty or null key never matches; of several rows the smallest id counts.
    """
    left, matched = incoming, None
    for key in keys:
        known = existing.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min("id").alias("match_id"))
        hit = left.join(known, key).select(*incoming.columns, "match_id")
        left = left.join(known.select(key), key, "left_anti").select(*incoming.columns)
        matched = hit if matched is None else matched.unionByName(hit)
    return matched, left


def find_or_create(existing: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str], order: str = "row_id", name: str | None = "name", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(the table afterwards, order and id of every incoming row): by keys, else by the name that fits best, else inserted.

    ``existing``: id, keys, name, fields. ``incoming``: the same without id, and ``order``, unique. New rows that share
    a key or, without one, their normalised name are one row, the first of them; ids go on from the largest. Null fields
    of an existing row take the first value that comes for them; others stay. Rows without key and name get no id.
    """
    matched, left = by_keys(existing, incoming, keys)
    matched = matched.select(order, "match_id") if matched is not None else incoming.limit(0).select(order, F.lit(0).cast("long").alias("match_id"))
    if name is not None:
        asked = left.select(F.col(order).alias("id"), F.col(name).alias("name"))
        close = best_match(fuzzy_matches(asked, existing.select("id", F.col(name).alias("name")), similarity)).select(F.col("query_id").alias(order), F.col("id").alias("match_id"))
        matched = matched.unionByName(close)
    filled = fill_nulls(existing, incoming.join(matched, order), fields, order)
    open_rows = incoming.join(matched.select(order), order, "left_anti")
    known = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{c}:"), F.col(c)))
    person = F.coalesce(*[known(k) for k in keys], *([F.nullif(F.concat(F.lit("name:"), canonical_name(F.col(name))), F.lit("name:"))] if name is not None else [F.lit(None)]))
    grouped = open_rows.withColumn("_person", person).where("_person is not null")
    columns = [c for c in existing.columns if c != "id"]
    first = grouped.groupBy("_person").agg(F.min(order).alias("_first"), F.min_by(F.struct(*columns), order).alias("_row"))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # new people in the order in which they came; sorted over all tasks, so numbers may leave gaps; one row of ``top``
    sorted_ = checkpointed(first.sort("_first").withColumn("nth", F.monotonically_increasing_id() + 1))
    placed = sorted_.crossJoin(F.broadcast(top)).withColumn("id", (F.col("top") + F.col("nth")).cast("long"))
    created = placed.select("id", *[F.col(f"_row.{c}").alias(c) for c in columns])
    ids = matched.select(order, F.col("match_id").alias("id")).unionByName(grouped.join(placed.select("_person", "id"), "_person").select(order, "id"))
    return filled.select("id", *columns).unionByName(created), ids


def fill_nulls(existing: DataFrame, matched: DataFrame, fields: list[str], order: str = "row_id") -> DataFrame:
    """Existing rows whose null fields take the first value of their matches, by ``order``."""
    if not fields:
        return existing
    news = matched.groupBy(F.col("match_id").alias("id")).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in fields])
    joined = existing.join(news, "id", "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in fields else F.col(c) for c in existing.columns])


def without_file(rows: DataFrame, source_file: str, column: str = "source_file") -> DataFrame:
    """Rows that don't come from a file, so that it can be read again; null stays."""
    return rows.where(~F.coalesce(F.col(column) == source_file, F.lit(False)))
