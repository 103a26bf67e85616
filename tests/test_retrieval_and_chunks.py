import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.operators import chunking, filters, retrieval

DOCS = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "cats and dogs"), (4, ""), (5, None), (6, "the the the")]


def bm25_plain(docs, query):
    bags = {i: Counter((t or "").lower().split()) for i, t in docs}
    n = len(bags)
    avg = sum(sum(b.values()) for b in bags.values()) / n
    df = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    score = {i: sum(idf.get(w, 0) * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * sum(b.values()) / avg)) for w in query.lower().split()) for i, b in bags.items()}
    return {i: v for i, v in score.items() if v > 0}


def test_bm25(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cat cat the"), (2, "zebra"), (3, None)], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(docs, asked).collect()}
    want = {(1, i): v for i, v in bm25_plain(DOCS, "cat cat the").items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    best = {(r.query_id, r.doc_id): (r.rank, r.score) for r in retrieval.bm25_top(docs, asked, 2).collect()}
    ranked_plain = sorted(want, key=lambda k: (-want[k], k))[:2]
    assert {k: v[0] for k, v in best.items()} == {k: i for i, k in enumerate(ranked_plain)} and all(best[k][1] == pytest.approx(want[k], abs=1e-8) for k in best)
    assert retrieval.bm25_top(docs.limit(0), asked, 2).collect() == []


def test_nearest(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [2.0, 0.0])], "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    got = [(r.vec_id, round(r.similarity, 4)) for r in retrieval.nearest(vectors, asked, 3).orderBy("rank").collect()]
    assert got == [(1, 1.0), (6, 1.0), (3, 0.7071)]
    assert [r.vec_id for r in retrieval.nearest(vectors, asked, 2, F.col("vec_id") != 1).orderBy("rank").collect()] == [6, 3]
    assert retrieval.nearest(vectors.limit(0), asked, 2).collect() == []


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, rank int, score double")


def test_fusion_and_hybrid(spark):
    a, b = ranked(spark, [(1, 10, 0, 0.9), (1, 11, 1, 0.8), (2, 10, 0, 0.5)]), ranked(spark, [(1, 11, 0, 9.0), (1, 12, 1, 8.0), (3, 7, 0, 2.0)])
    fused = [(r.doc_id, round(r.score, 6)) for r in retrieval.fuse(a, b, 2).where("query_id = 1").orderBy("rank").collect()]
    assert fused == [(11, round(1 / 62 + 1 / 61, 6)), (10, round(1 / 61, 6))]
    alone = {r.query_id: (r.doc_id, r.score) for r in retrieval.hybrid(b, a, 2).where("query_id > 1").collect()}
    assert alone == {2: (10, 0.5), 3: (7, 2.0)}


def test_threshold(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1), (1, 3, None), (2, 4, 0.1), (2, 5, 0.2)], "query_id long, doc_id long, score double")
    assert sorted(r.doc_id for r in retrieval.above_threshold(rows, 0.5).collect()) == [1, 3, 5]
    assert retrieval.above_threshold(rows, 0).count() == 5


def test_where_tree(spark):
    df = spark.createDataFrame([(1, {"a": "1"}), (2, {"a": "2", "b": "x"}), (3, {})], "i int, metadata map<string,string>")
    keep = lambda tree: [r.i for r in df.where(filters.where_tree(tree)).orderBy("i").collect()]
    assert keep({"a": 1}) == [1] and keep({"b": {"$ne": "x"}}) == [1, 3] and keep({"b": {"$eq": ""}}) == [1, 3]
    assert keep({"$or": [{"a": "1"}, {"b": "x"}]}) == [1, 2] and keep(None) == [1, 2, 3] and keep({"a": {"$gt": 0}}) == [1, 2, 3]
    assert filters.intent_filter({}) is None and filters.intent_filter({"date": "d", "patient_name": "Solo"}) == {"date": {"$eq": "d"}}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=600))
def test_windows_cover_the_text(text):
    parts = chunking.windows(text, 100, 20)
    assert all(0 < len(p) <= 100 and p == p.strip() for p in parts)
    at = 0
    for p in parts:
        found = text.find(p)
        assert found >= 0
        at = max(at, found + len(p))
    assert sum(c not in " \n" for c in "".join(parts)) >= sum(c not in " \n" for c in text)


def test_windows_prefer_paragraphs_and_short_texts_stay_whole(spark):
    text = "a" * 60 + "\n\n" + "b" * 30 + " " + "c" * 60
    assert chunking.windows(text, 100, 20)[0] == "a" * 60
    df = spark.createDataFrame([(1, "  short "), (2, None), (3, " "), (4, "w " * 900)], "doc_id long, text string")
    got = [(r.doc_id, r.chunk_no, r.n_chunks, r.n_words) for r in chunking.chunk_documents(df).orderBy("doc_id", "chunk_no").collect()]
    assert got[0] == (1, 1, 1, 1) and {r[0] for r in got} == {1, 4} and [r for r in got if r[0] == 4] == [(4, 1, 2, 500), (4, 2, 2, 500)]


def test_table_heuristic(spark):
    cases = [([10] * 7, False), ([10] * 8, True), ([200] * 8, False), ([120] * 6 + [400] * 2, True), ([120] * 5 + [300] * 3, False)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "l array<int>")
    assert [r[0] for r in df.select(chunking.is_table(F.col("l"))).collect()] == [w for _, w in cases]
