"""What changed between consecutive full snapshots, by subtraction of invertible Bloom lookup tables.

Every complete file is summarised per hash bucket in a table of cells; a row enters three cells, chosen by key hash and
value digest together, with both and a check. (Chosen by the key alone, the two versions of a changed row would share
all their cells and never peel.) The table of a file minus that of its predecessor keeps only rows that differ. Those are
peeled cell by cell; a bucket that does not peel to nothing is built again with four times the cells, and after
``MAX_ROUNDS`` it is compared row by row instead. Recovered hashes are verified by joining them to the rows they
came from, key hash and digest, and classified by sign.

Shuffled are hashes, not rows: a row is its file, key hash, digest and place, once to find the row that counts for its
key and once to bring the buckets of a feed's files together. There cells are filled, subtracted and peeled without
another shuffle. Only for the few recovered hashes the keys themselves are read. Buckets hold about
``ROWS_PER_BUCKET`` rows, so a feed with a third of all rows is spread over many tasks.

Odd input: null cells count as empty, header texts that sanitise alike are one column (the last cell counts), rows
staged twice count once, of several rows with one key the one with the highest row_no counts, a file without rows or
headers is incomplete unless it declares none, extra columns are ignored, a feed with one file gives no row.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.text import safe_identifier
from quernstone.session import checkpointed

ROWS_PER_BUCKET = 1024
CELLS = 384
MAX_ROUNDS = 4
#: Recovered rows up to which their places are broadcast (five numbers each).
MOST_BROADCAST = 500_000
_SEED = 42
_BLANKS = " \t\r\n\f\u000b "
_SALT_CHECK, _SALT_CELL = 97, (11, 23, 37)


def _trim(col: Column) -> Column:
    return F.trim(col, F.lit(_BLANKS))


def complete_files(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Files with at least as many distinct row_no as they declare."""
    staged = rows.groupBy("file_id").agg(F.countDistinct("row_no").alias("n_rows"))
    return files.join(staged, "file_id", "left").na.fill(0, ["n_rows"]).where(F.col("n_rows") >= F.coalesce("row_count", F.lit(0)))


def layouts(files: DataFrame) -> DataFrame:
    """file_id, columns (name and cell position of all but the key, sorted, the last of equal names), key_at (positions of the key)."""
    placed = files.select("file_id", "natural_key", F.posexplode("headers").alias("i", "header")).withColumn("name", safe_identifier(F.col("header")))
    kept = placed.where("name is not null").groupBy("file_id", "name").agg(F.max(F.col("i") + 1).alias("at"))
    columns = kept.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("name", "at"))).alias("columns"))
    keyed = files.select("file_id", "natural_key").join(columns, "file_id", "left")
    place = lambda k: F.try_element_at(F.transform(F.filter("columns", lambda c: c["name"] == k), lambda c: c["at"]), F.lit(1))
    at = F.transform(F.coalesce("natural_key", F.array().cast("array<string>")), lambda k: F.coalesce(place(k), F.lit(0)))
    rest = F.filter("columns", lambda c: ~F.array_contains("key_at", c["at"]))
    return keyed.select("file_id", "columns", at.alias("key_at")).select("file_id", rest.alias("columns"), "key_at")


def _cell(at: Column) -> Column:
    return F.when(at > 0, _trim(F.try_element_at(F.col("cells"), F.greatest(at, F.lit(1)))))


def _row_key() -> Column:
    return F.array_join(F.transform("key_at", lambda at: F.upper(F.coalesce(_cell(at), F.lit("")))), "|")


def keyed_rows(places: DataFrame, rows: DataFrame) -> DataFrame:
    """file_id, key_hash, digest, row_no, _id: one row per file and natural key. ``places``: ``layouts`` of the files.

    Names and positions are worked out once per file. Key columns are no part of the digest: a key in other case is the
    same key. Empty values are left out, as null equals empty.
    """
    joined = rows.select("file_id", "row_no", "_id", "cells").join(places, "file_id")
    named = F.transform(F.coalesce("columns", F.array().cast("array<struct<name:string,at:int>>")), lambda c: F.concat(c["name"], F.lit("="), F.nullif(_cell(c["at"]), F.lit(""))))
    keyed = joined.select("file_id", "row_no", "_id", F.xxhash64(_row_key()).alias("key_hash"), F.xxhash64(F.array_join(named, "\u0001")).alias("digest"))
    one = keyed.groupBy("file_id", "key_hash").agg(F.max(F.struct("row_no", "_id", "digest")).alias("top"))
    return one.select("file_id", "key_hash", "top.digest", "top.row_no", "top._id")


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def subtracted(rows: DataFrame, pairs: DataFrame, cells: int) -> DataFrame:
    """Cells of each later file minus those of its predecessor, where anything is left; laid out by feed and bucket.

    rows: feed_code, file_id, bucket, key_hash, digest. pairs: file_id, prev_id and, where only some are wanted, bucket. A
    row counts for the pair in which its file is the later one, and against the one in which it is the earlier.
    """
    third = cells // 3
    some = ["bucket"] if "bucket" in pairs.columns else []
    later = pairs.select("file_id", F.col("file_id").alias("pair"), F.lit(1).alias("sign"), *some)
    earlier = pairs.select(F.col("prev_id").alias("file_id"), F.col("file_id").alias("pair"), F.lit(-1).alias("sign"), *some)
    # a given number of tasks: peeling costs CPU, not bytes, and would else be merged into few
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = rows.repartition(tasks, "feed_code", "bucket").join(later.unionByName(earlier), ["file_id", *some])
    places = F.array(*[(F.pmod(F.xxhash64("key_hash", "digest", _long(s)), _long(third)) + i * third).cast("int") for i, s in enumerate(_SALT_CELL)])
    return (
        signed.select("feed_code", "bucket", "pair", "sign", "key_hash", "digest", F.xxhash64("key_hash", "digest", _long(_SALT_CHECK)).alias("check"), F.explode(places).alias("cell"))
        .groupBy("feed_code", "bucket", "pair", "cell")
        .agg(F.sum("sign").alias("n"), F.bit_xor("key_hash").alias("key_hash"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check"))
        .where("n != 0 or key_hash != 0 or digest != 0 or check != 0")
    )


def _chain(*values: int) -> int:
    """Spark's xxhash64 over longs: each value is hashed with the last hash as the seed."""
    seed = _SEED
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", v & 0xFFFFFFFFFFFFFFFF), seed & 0xFFFFFFFFFFFFFFFF)
    return seed


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def peel(n: dict[int, int], keys: dict[int, int], digests: dict[int, int], checks: dict[int, int], cells: int) -> tuple[list[tuple[int, int, int]], bool]:
    """(key hash, digest, sign) of all rows in a subtracted table, and whether it peeled to nothing."""
    third = cells // 3
    found, ready = [], list(n)
    while ready:
        c = ready.pop()
        sign = n.get(c, 0)
        if sign not in (1, -1) or _chain(keys[c], digests[c], _SALT_CHECK) != checks[c] & 0xFFFFFFFFFFFFFFFF:
            continue
        key, digest, check = keys[c], digests[c], checks[c]
        found.append((key, digest, sign))
        for i, s in enumerate(_SALT_CELL):
            p = _signed(_chain(key, digest, s)) % third + i * third
            n[p] = n.get(p, 0) - sign
            keys[p], digests[p], checks[p] = keys.get(p, 0) ^ key, digests.get(p, 0) ^ digest, checks.get(p, 0) ^ check
            ready.append(p)
    return found, not any(n.values()) and not any(keys.values()) and not any(checks.values())


_PEELED = "pair long, bucket long, key_hash long, digest long, sign int, failed boolean"


def peel_buckets(cells_left: DataFrame, cells: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["cell"].tolist()
        found, whole = peel(*[dict(zip(at, map(int, pdf[c]))) for c in ("n", "key_hash", "digest", "check")], cells)
        pair, bucket = pdf["pair"].iloc[0], pdf["bucket"].iloc[0]
        if not whole:
            return pd.DataFrame({"pair": [pair], "bucket": [bucket], "key_hash": [0], "digest": [0], "sign": np.array([0], "int32"), "failed": [True]})
        keys, digests, signs = zip(*found) if found else ((), (), ())
        return pd.DataFrame({"pair": pair, "bucket": bucket, "key_hash": np.array(keys, "int64"), "digest": np.array(digests, "int64"), "sign": np.array(signs, "int32"), "failed": False})

    return cells_left.groupBy("feed_code", "bucket", "pair").applyInPandas(run, _PEELED)


def consecutive(files: DataFrame) -> DataFrame:
    """file_id and the file before it in its feed; equal delivery times are ordered by file_id."""
    order = W.partitionBy("feed_code").orderBy("delivered_at", "file_id")
    return files.select("file_id", "feed_code", F.lag("file_id").over(order).alias("prev_id"))


def snapshot_changes(files: DataFrame, rows: DataFrame, catalog: DataFrame, cells: int = CELLS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """file_id, row_key, change_kind (added, removed, changed) for every complete file of a snapshot feed."""
    streams = catalog.where(F.col("load_mode") == "snapshot").select("column_signature", "natural_key").dropDuplicates(["column_signature"])
    snapshots = files.select("file_id", "feed_code", "column_signature", "headers", "row_count", "delivered_at").join(streams, "column_signature")
    staged = rows.join(snapshots.select("file_id"), "file_id", "left_semi")
    complete = checkpointed(complete_files(snapshots, staged))
    pairs = checkpointed(consecutive(complete))
    n_rows = F.greatest(F.ceil(F.max("n_rows") / rows_per_bucket), F.lit(1)).cast("long").alias("n_buckets")
    buckets = complete.select("file_id", "feed_code").join(complete.groupBy("feed_code").agg(n_rows), "feed_code")
    places = layouts(complete)
    keyed = checkpointed(
        keyed_rows(places, staged).join(buckets, "file_id").withColumn("bucket", F.pmod(F.xxhash64("key_hash", _long(_SEED)), F.col("n_buckets"))).drop("n_buckets")
    )
    wanted = pairs.where("prev_id is not null").select("file_id", "prev_id")
    peeled, todo, size = None, keyed, cells
    for _ in range(MAX_ROUNDS):
        got = checkpointed(peel_buckets(subtracted(todo, wanted, size), size))
        done = got.where(~F.col("failed"))
        peeled = done if peeled is None else peeled.unionByName(done)
        failed = got.where("failed").select(F.col("pair").alias("file_id"), "bucket")
        if failed.isEmpty():
            break
        wanted = failed.join(pairs.select("file_id", "prev_id"), "file_id")
        either = wanted.select("file_id", "bucket").unionByName(wanted.select(F.col("prev_id").alias("file_id"), "bucket")).distinct()
        todo, size = keyed.join(either, ["file_id", "bucket"], "left_semi"), size * 4
    else:
        peeled = peeled.unionByName(_row_by_row(todo, wanted))
    sides = peeled.where("sign != 0").select("pair", "key_hash", "digest", "sign")
    owner = sides.join(pairs.select(F.col("file_id").alias("pair"), "prev_id"), "pair").withColumn("file_id", F.when(F.col("sign") > 0, F.col("pair")).otherwise(F.col("prev_id")))
    # verified by the row they came from, key hash and digest; its key is read at its place
    verified = checkpointed(owner.join(keyed.select("file_id", "key_hash", "digest", "row_no", "_id"), ["file_id", "key_hash", "digest"]).select("pair", "sign", "file_id", "row_no", "_id"))
    spots = verified.withColumnsRenamed({"file_id": "f", "row_no": "r", "_id": "i"})
    at = (F.col("file_id") == F.col("f")) & F.col("row_no").eqNullSafe(F.col("r")) & F.col("_id").eqNullSafe(F.col("i"))
    # known to be small only by its count: broadcast up to a bound, else joined
    few = F.broadcast(spots) if verified.count() <= MOST_BROADCAST else spots
    found = staged.select("file_id", "row_no", "_id", "cells").join(few, at).join(places, "file_id").select("pair", "sign", _row_key().alias("row_key"))
    kind = F.when(F.min("sign") > 0, "added").when(F.max("sign") < 0, "removed").otherwise("changed")
    return found.groupBy(F.col("pair").alias("file_id"), "row_key").agg(kind.alias("change_kind"))


def _row_by_row(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The exact way for buckets that no table of the largest size held."""
    later = rows.join(wanted.select("file_id", "bucket"), ["file_id", "bucket"]).select(F.col("file_id").alias("pair"), "bucket", "key_hash", "digest")
    before = rows.join(wanted.select(F.col("file_id").alias("pair"), F.col("prev_id").alias("file_id"), "bucket"), ["file_id", "bucket"]).select("pair", "bucket", "key_hash", "digest")
    on = ["pair", "bucket", "key_hash", "digest"]
    plus = later.join(before, on, "left_anti").withColumn("sign", F.lit(1))
    minus = before.join(later, on, "left_anti").withColumn("sign", F.lit(-1))
    return plus.unionByName(minus).withColumn("failed", F.lit(False))
