import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import packing, split


def brute_best(values, low, high):
    return max(range(low, high + 1), key=lambda i: (values[i], i))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=80), st.data())
def test_range_maximum_against_brute_force(values, data):
    import numpy as np

    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low, len(values) - 1))
    assert split.RangeMax(np.array(values)).best(low, high) == brute_best(values, low, high)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n,é", max_size=400), st.integers(5, 60), st.data())
def test_pieces_cover_overlap_and_fit(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    got = split.pieces(text, size, overlap)
    inner = text.strip(split.BLANKS)
    assert bool(got) == bool(inner)
    if not got:
        return
    assert "".join(text[got[0][0] : got[-1][1]]) == inner
    assert all(0 < b - a <= size for a, b in got)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d


def test_cuts_at_the_strongest_boundary():
    text = "x" * 700 + ". " + "y" * 100 + "\n\n" + "z" * 100 + " " + "w" * 400
    (a, b), (c, _) = split.pieces(text)
    assert text[a:b].rstrip() == "x" * 700 + ". " + "y" * 100 and abs((b - c) - 200) <= 50
    # the rightmost of equals; no break at all
    assert split.pieces("ab " * 500, 100, 0)[0] == (0, 99)
    assert split.pieces("x" * 250, 100, 20) == [(0, 100), (80, 180), (160, 250)]


def test_clusters_stay_whole():
    text = "é" * 300
    assert all(not text[a:].startswith("́") for a, _ in split.pieces(text, 101, 0))
    with pytest.raises(ValueError):
        split.pieces("x", 10, 10)


def test_split_records(spark):
    rows = [(1, None, "z"), (2, "  \n", "z"), (3, " short ", "z"), (4, "w" * 999 + " " + "v" * 999, "z"), (4, "w" * 999 + " " + "v" * 999, "z"), (5, "y" * 1000, "z")]
    df = spark.createDataFrame(rows, "id long, raw_text string, text string")
    got = [(r.record_id, r.chunk_index, r.n_chunks) for r in split.split_records(df).collect()]
    assert sorted(got) == [(3, "0", 1), *[(4, i, 3) for i in ("0", "0", "1", "1", "2", "2")], (5, "0", 1)] and all(r.text for r in split.split_records(df).collect())
    assert split.split_records(df.limit(0)).collect() == []


def test_local_search_never_gets_worse():
    rnd = random.Random(3)
    for n, top in ((0, 9), (1, 9), (200, 60), (400, 100), (300, 35)):
        sizes = [rnd.randint(1, top) for _ in range(n)]
        first = packing.first_fit(sizes, 100)
        after = packing.pack(sizes, 100)
        assert sorted(i for b in after for i in b) == list(range(n))
        assert all(sum(sizes[i] for i in b) <= 100 for b in after)
        square = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)  # noqa: B023, E731
        assert len(after) <= len(first) and square(after) >= square(first)
        assert len(after) >= -(-sum(sizes) // 100)


def test_exchanges_beat_best_fit_where_sizes_are_hard():
    """Sizes of a third to a half: best fit alone leaves space that exchanges fill; the search ends where none is left."""
    rnd = random.Random(11)
    sizes = [rnd.randint(300, 1000) for _ in range(1500)]
    first, after = packing.first_fit(sizes, 2048), packing.pack(sizes, 2048)
    assert len(after) < len(first) and sorted(i for b in after for i in b) == list(range(len(sizes)))
    square = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
    assert square(packing.improve([list(b) for b in after], sizes, 2048)) == square(after)
    # many items of one size, all in bins too full to give one away, hide no partner further on
    bins = packing.improve([[0], *([k, k + 1] for k in range(1, 201, 2)), [201], [202, 203]], [90, *[49, 50] * 100, 10, 20, 20], 100)
    assert any(sorted(b) == [0, 201] for b in bins)


def test_exchange_empties_a_bin():
    # two half-full bins beside one that an exchange fills up
    bins = packing.improve([[0, 1], [2, 3], [4]], [5, 3, 6, 2, 2], 10)
    assert len(bins) == 2


def test_packed_documents(spark):
    texts = [(i, "word " * n) for i, n in enumerate([1, 5, 30, 100, 7, 7, 250, 64])] + [(90, None), (91, ""), (1, "word " * 5)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = packing.pack_documents(df, capacity=64).toPandas()
    counts = {r.doc_id: 0 for r in got.itertuples()}
    for r in got.itertuples():
        counts[r.doc_id] += r.n_tokens
    want = {}
    enc = packing.tokenizer(packing.TOKENIZER)
    for i, t in texts:
        if t:
            want[i] = want.get(i, 0) + len(enc.encode_ordinary(t))
    assert counts == want
    filled = got.groupby("sequence_id").n_tokens.sum()
    assert filled.max() <= 64 and got.groupby("sequence_id").position.apply(lambda p: sorted(p) == list(range(len(p)))).all()
    assert set(got[got.piece > 0].doc_id) <= {3, 6, 7}
    assert packing.pack_documents(df.limit(0)).count() == 0
    assert packing.padding(packing.pack_documents(df, capacity=64), 64).first().unused < 0.35
