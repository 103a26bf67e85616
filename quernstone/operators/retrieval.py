"""Lexical and vector search, rank fusion, reranking, thresholds.

All operators take a batch of queries; a single query is a batch of one. Ties are broken by explicit keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.text import words
from quernstone.operators.filters import where_tree

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
FETCH_FACTOR, FETCH_LIMIT = 3, 60
VECTOR_BLOCK = 4096


def postings(documents: DataFrame) -> DataFrame:
    """term, doc_id, tf over lower-cased white-space tokens."""
    return documents.select("doc_id", F.explode(words(F.lower("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def bm25(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score > 0. queries: query_id, text; a repeated query word counts repeatedly.

    Corpus statistics cover all documents. Terms in more than half of the documents get a quarter of the mean idf of
    the vocabulary. Only postings of query words are joined; scores are summed per query and document.
    """
    posted = postings(documents)
    lengths = posted.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    corpus = documents.agg(F.count("*").alias("n")).crossJoin(lengths.agg(F.sum("dl").alias("total")))
    corpus = corpus.select("n", (F.col("total") / F.col("n")).alias("avgdl"))
    # one row of corpus statistics, known to be small
    terms = posted.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus))
    raw = terms.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf").alias("mean"))
    asked = queries.select("query_id", F.explode(words(F.lower("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    weighted = raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, F.col("mean") * EPSILON).otherwise(F.col("idf")).alias("idf"))
    hits = asked.join(weighted, "term").join(posted, "term").join(lengths, "doc_id").crossJoin(F.broadcast(corpus))
    part = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score")).where("score > 0")


def term_weights(documents: DataFrame, wanted: DataFrame) -> tuple[DataFrame, float]:
    """(term, idf) of wanted terms by statistics of all documents, and the mean length of a document.

    A document gives each of its terms once; they are counted per task before the shuffle, so what is shuffled grows with
    the vocabulary and not with the postings.
    """
    tokens = words(F.lower("text"))
    lengths = documents.agg(F.count("*").alias("n"), F.sum(F.when(F.col("text").isNotNull(), F.size(tokens))).alias("total")).first()
    size = lengths["n"]
    terms = documents.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = terms.withColumn("idf", F.log(F.lit(size) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf")).first()[0] or 0.0
    kept = raw.join(wanted, "term", "left_semi").select("term", F.when(F.col("idf") < 0, mean * EPSILON).otherwise(F.col("idf")).alias("idf"))
    return kept, (lengths["total"] or 0) / max(size, 1)


def bm25_top(documents: DataFrame, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """query_id, doc_id, score, rank: the k best of each stated query, queries taken in blocks.

    The scores of :func:`bm25`, without a row per query word and posting: the weights of a block's words travel with the
    tasks (terms x queries), each batch of documents is scored as a product, and only its k best per query are shuffled.
    """
    asked = queries.where("text is not null").select("query_id", F.explode(words(F.lower("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    weights, avgdl = term_weights(documents, asked.select("term").distinct())
    rows = [tuple(r) for r in asked.join(weights, "term").select("query_id", "term", F.col("qn") * F.col("idf")).orderBy("query_id", "term").toLocalIterator()]
    ids = sorted({r[0] for r in rows})
    result = None
    for at in range(0, max(1, len(ids)), block):
        chosen = {q: i for i, q in enumerate(ids[at : at + block])}
        own = [r for r in rows if r[0] in chosen]
        place = {t: i for i, t in enumerate(sorted({r[1] for r in own}))}
        matrix = np.zeros((len(place), len(chosen)))
        for q, t, w in own:
            matrix[place[t], chosen[q]] = w

        def run(batches: Iterator[pd.DataFrame], order: np.ndarray = np.array(list(chosen), "int64"), place: dict = place, matrix: np.ndarray = matrix) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in range(0, len(pdf), 256):
                    part = pdf.iloc[start : start + 256]
                    docs, hits, shares = [], [], []
                    for doc_id, text in zip(part["doc_id"], part["text"]):
                        tokens = text.lower().split() if isinstance(text, str) else []
                        counts: dict[int, int] = {}
                        for t in tokens:
                            if (p := place.get(t)) is not None:
                                counts[p] = counts.get(p, 0) + 1
                        if counts:
                            tf = np.fromiter(counts.values(), "float64")
                            docs.append(doc_id)
                            hits.append(np.fromiter(counts, "int64"))
                            shares.append(tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(tokens) / avgdl)))
                    if not docs or not len(order):
                        continue
                    starts = np.concatenate(([0], np.cumsum([len(h) for h in hits])[:-1]))
                    score = np.add.reduceat(matrix[np.concatenate(hits)] * np.concatenate(shares)[:, None], starts, axis=0).T
                    ident = np.array(docs)
                    best = np.lexsort((np.broadcast_to(ident, score.shape), -np.round(score, 9)), axis=1)[:, :k]
                    q = np.repeat(np.arange(len(order)), best.shape[1])
                    found = pd.DataFrame({"query_id": order[q], "doc_id": ident[best.ravel()], "score": score[q, best.ravel()]})
                    yield found[found["score"] > 0]

        scored = documents.select("doc_id", "text").mapInPandas(run, "query_id long, doc_id long, score double")
        result = scored if result is None else result.unionByName(scored)
    return top(result.withColumn("_rounded", F.round("score", 9)), k, "_rounded").drop("_rounded")


def top(scored: DataFrame, k: int, score: str = "score", tie: str = "doc_id", by: str = "query_id") -> DataFrame:
    """The k best of each query with rank from 0 (Spark keeps k rows per partition before the shuffle)."""
    order = W.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def relative(scored: DataFrame) -> DataFrame:
    """Scores over the best of their query; a best score of 0 or less counts as 1."""
    best = F.max("score").over(W.partitionBy("query_id"))
    return scored.withColumn("relevance", F.col("score") / F.when(best > 0, best).otherwise(1.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, not below 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(0.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, vec_id, similarity, rank: exact search of stated queries against all vectors, in blocks of queries.

    The filter applies before the search. Each batch of vectors gives its k best per query, so only those are shuffled.
    """
    pool = vectors if where is None else vectors.where(where)
    rows = [(r[0], r[1]) for r in queries.select("query_id", "embedding").where("embedding is not null").orderBy("query_id").toLocalIterator()]
    result = None
    for at in range(0, max(1, len(rows)), block):
        ids = np.array([r[0] for r in rows[at : at + block]], "int64")
        asked = np.array([r[1] for r in rows[at : at + block]], "float64").reshape(len(ids), -1)
        norms = np.linalg.norm(asked, axis=1, keepdims=True)
        asked = np.divide(asked, norms, out=np.zeros_like(asked), where=norms > 0)

        def run(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, asked: np.ndarray = asked) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf[pdf["embedding"].notna()]
                if not len(pdf) or not len(ids):
                    continue
                matrix = np.stack(pdf["embedding"].to_numpy()).astype("float64")
                length = np.linalg.norm(matrix, axis=1, keepdims=True)
                similarity = np.maximum(0.0, asked @ np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0).T)
                vec = pdf["vec_id"].to_numpy()
                order = np.lexsort((np.broadcast_to(vec, similarity.shape), -np.round(similarity, 9)), axis=1)[:, :k]
                q = np.repeat(np.arange(len(ids)), order.shape[1])
                yield pd.DataFrame({"query_id": ids[q], "vec_id": vec[order.ravel()], "similarity": similarity[q, order.ravel()]})

        part = pool.select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, similarity double")
        result = part if result is None else result.unionByName(part)
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id")
    return result.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def fuse(first: DataFrame, second: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, doc_id, rank from 0); ties keep the first list's order.

    query_id, doc_id, score, rank.
    """
    joined = first.select("query_id", "doc_id", F.col("rank").alias("r1")).join(second.select("query_id", "doc_id", F.col("rank").alias("r2")), ["query_id", "doc_id"], "full")
    part = lambda r: F.coalesce(1.0 / (constant + F.col(r) + 1), F.lit(0.0))
    scored = joined.withColumn("score", part("r1") + part("r2"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("query_id", "doc_id", "score", "rank")


def hybrid(lexical: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """Fused lists; a query that only one list answers keeps that list's first k and its scores."""
    both = lexical.select("query_id").distinct().join(semantic.select("query_id").distinct(), "query_id")
    fused = fuse(semantic.join(both, "query_id", "left_semi"), lexical.join(both, "query_id", "left_semi"), k)
    alone = lambda df: df.join(both, "query_id", "left_anti").where(F.col("rank") < k).select("query_id", "doc_id", "score", "rank")
    return fused.unionByName(alone(lexical)).unionByName(alone(semantic))


def fetch_size(k: int) -> int:
    return min(k * FETCH_FACTOR, FETCH_LIMIT)


def above_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    """Rows at or above the threshold, rows without a score, or the best row of a query if none is left; 0 or less keeps all."""
    if threshold <= 0:
        return scored
    partition = W.partitionBy("query_id")
    kept = F.col("score").isNull() | (F.col("score") >= threshold)
    best = F.row_number().over(partition.orderBy(F.desc_nulls_last("score"), "doc_id"))
    return scored.withColumn("_kept", kept).withColumn("_any", F.max("_kept").over(partition)).withColumn("_best", best).where("_kept or (not _any and _best = 1)").drop("_kept", "_any", "_best")


def rerank(hits: DataFrame, k: int, model: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """hits: query_id, doc_id, rank, query, content. With a model its scores decide; without one the first k stay in their order."""
    if model is None:
        return hits.where(F.col("rank") < k)
    score = F.pandas_udf(model, "double")
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return hits.withColumn("rerank_score", score("query", "content")).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def filtered(documents: DataFrame, tree: dict | None, keep_empty: bool = False) -> DataFrame:
    """Documents that pass a metadata filter. Unless ``keep_empty``, a filter that leaves nothing is dropped."""
    found = documents.where(where_tree(tree))
    return found if keep_empty or tree is None or not found.isEmpty() else documents


def embedded(texts: DataFrame, model: Callable[[pd.Series], pd.Series], column: str = "text") -> DataFrame:
    """Adds ``embedding``: the model's vectors, Arrow batch by batch; null and blank texts get none."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        some = [isinstance(t, str) and t.strip() != "" for t in batch]
        found = iter(model(batch[some]) if any(some) else ())
        return pd.Series([next(found) if s else None for s in some], dtype=object)

    return texts.withColumn("embedding", run(column))


def without_ids(documents: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose id isn't among those to delete."""
    return documents.join(gone.select(key).distinct(), key, "left_anti")


def preview(documents: DataFrame, length: int = 300) -> DataFrame:
    """doc_id and the first characters of each text with an ellipsis."""
    return documents.select("doc_id", F.concat(F.substring("text", 1, length), F.lit("…")).alias("preview"))
