"""Search of stated names: all matches and best ones against every pair compared, and what it aligns."""

from __future__ import annotations

import difflib
import random

import pandas as pd
import pytest

from quernstone.operators import entities, nearnames

ODD = ["Anna Maria Lopez", "Lopez, Anna", "J. Smith", "John Smith", "Smith", "smith", "Jon Smyth", "", " ", None, ".", "Zoë Müller-Lüdenscheidt", "李 小龍", "O'Brien Pat", "obrien pat", "aaaaaaaaaa", "aaaaabaaaa", "a" * 70 + " b", "ab" * 120, "ab" * 118 + "ba", "\x1cfoo\x1cbar", "foo bar", " ".join(f"w{i}" for i in range(80))]


def names(n: int, seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    out = list(ODD)
    while len(out) < n:
        text = list(rng.choice(ODD) or "")
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "e", " ", "n", "."])
        out.append("".join(text))
    return list(enumerate(out, 1))


def batches(rows: list, size: int = 37):
    return iter([pd.DataFrame(rows[k : k + size], columns=["id", "name"]) for k in range(0, len(rows), size)])


def best_of(matches) -> dict[int, tuple[float, int]]:
    out: dict[int, tuple[float, int]] = {}
    for q, i, score in matches:
        if q != i:
            out[q] = min(out.get(q, (0.0, 0)), (-score, i))
    return out


@pytest.mark.parametrize("similarity", [0.6, 0.82, 0.95])
def test_search_finds_what_every_pair_gives(similarity):
    rows = names(240, 3)
    asked = [r for r in rows if r[0] % 3 == 0 and r[1] is not None]
    want = {(q, i, s) for q, a in asked for i, b in rows if (s := entities.name_score(a, b)) >= similarity}
    got = [tuple(r) for df in nearnames.search(batches(rows), asked, similarity, None) for r in df.itertuples(index=False)]
    assert len(got) == len(set(got)) and set(got) == want
    for tasks in (1, 3):
        parts = [df for k in range(tasks) for df in nearnames.search(batches(rows[k::tasks]), asked, similarity, 2)]
        assert best_of(tuple(r) for df in parts for r in df.itertuples(index=False)) == best_of(want)


def test_few_pairs_are_aligned(monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(4, 8)))
    rows = [(i, f"{word()} {word()}") for i in range(2000)]
    rows += [(2000 + i, name + rng.choice(["s", "e", " x"])) for i, name in rows[:100]]
    aligned = []
    whole = difflib.SequenceMatcher
    monkeypatch.setattr(difflib, "SequenceMatcher", lambda *a, **k: aligned.append(1) or whole(*a, **k))
    got = best_of(tuple(r) for df in nearnames.search(batches(rows, 700), rows[:100], 0.82, 2) for r in df.itertuples(index=False))
    assert all(got[i][1] == 2000 + i for i in range(100))
    assert len(aligned) < len(rows)  # of 210,000 pairs


def test_closest_works_in_many_tasks_whatever_the_files(spark):
    rows = names(240, 4)
    df = spark.createDataFrame(rows, "id long, name string").coalesce(1)
    asked = df.where("id % 3 = 0")
    assert entities.fuzzy_matches(asked, df).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    want = best_of((q, i, s) for q, a in rows if q % 3 == 0 and a is not None for i, b in rows if (s := entities.name_score(a, b)) >= 0.82)
    for block in (5000, 11):
        assert {r.query_id: (-r.score, r.id) for r in entities.closest(asked, df, block=block).collect()} == want
    assert entities.closest(asked.limit(0), df).collect() == []


def test_every_name_is_asked(spark, tmp_path, monkeypatch):
    from quernstone.plans import reference

    # an id with two names and one with the same name twice, besides unique ones
    rows = [*names(240, 5), (7, "Jon Smyth"), (8, "Zoë Müllr-Lüdenscheidt"), (2, "Lopez, Anna")]
    want = best_of((q, i, s) for q, a in rows if a is not None for i, b in rows if (s := entities.name_score(a, b)) >= 0.82)
    spark.createDataFrame(rows, "id long, name string").write.parquet(f"{tmp_path}/patients.parquet")
    got = lambda: {r.query_id: (-r.score, r.id) for r in reference.QUERIES["name_fuzzy_match"](spark, str(tmp_path)).collect()}
    assert len(want) > 150 and got() == want
    monkeypatch.setattr(entities, "TILE", 50)
    assert got() == want
    assert entities.all_closest(spark.createDataFrame([], "id long, name string")).collect() == []


@pytest.mark.parametrize("rows, columns", [(128, 4096), (3, 5)])
@pytest.mark.parametrize("similarity", [0.6, 0.82, 0.95])
def test_nearest_finds_the_best_of_every_pair(rows, columns, similarity, monkeypatch):
    monkeypatch.setattr(nearnames, "ROWS", rows)
    monkeypatch.setattr(nearnames, "COLUMNS", columns)
    texts = sorted({" ".join(sorted(nearnames.tokens(name))) for _, name in names(240, 6)} - {""})
    ids = pd.DataFrame({"first": range(len(texts)), "second": [i + i % 3 for i in range(len(texts))]}).to_numpy()
    ids[5::7] = 4  # an id with several texts
    asked = texts[::2]
    pairs = [(t, int(i), difflib.SequenceMatcher(None, t, u).ratio()) for k, t in enumerate(asked) for u, both in zip(texts, ids) for i in both if i != ids[2 * k, 0]]
    want = best_of(p for p in pairs if p[2] >= similarity)
    got = list(nearnames.nearest(asked, ids[::2, 0], texts, ids, similarity))
    assert len(want) > 20 and {t: (-s, i) for t, i, s in got} == want and len(got) == len(want)
