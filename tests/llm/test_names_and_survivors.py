import datetime as dt
import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import names, survivor

WORD = st.text(alphabet="abcd", min_size=1, max_size=7)


@settings(max_examples=200, deadline=None)
@given(WORD, WORD, WORD)
def test_distance_is_a_metric(a, b, c):
    d = names.distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)


@settings(max_examples=200, deadline=None)
@given(WORD, WORD)
def test_within_one_is_the_distance(a, b):
    assert names.within_one(a, b) == (names.distance(a, b) <= 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcdé*ß ", min_size=1, max_size=9), min_size=2, max_size=8))
def test_bag_distance_is_a_metric_below_the_edit_distance(texts):
    d = names.bag_distances(names.bags(texts), names.bags(texts))
    assert (d == d.T).all() and (np.diag(d) == 0).all()
    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):
        assert d[i, j] <= names.distance(a, b) and all(d[i, j] <= d[i, k] + d[k, j] for k in range(len(texts)))


def spoilt(rnd, n=220):
    base = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(4, 9))) for _ in range(n)]
    base += ["x" * 70 + t for t in base[:30]]  # names far longer than any usual one, equal but at the end
    return sorted({*base, *(t[:2] + t[3:] for t in base[:80]), *(t[1] + t[0] + t[2:] for t in base[40:120]), *(t[:-1] + "f" for t in base[n:])})


def test_neighbours_against_all_pairs(spark):
    """Whatever the pivots and however often cells are divided: exactly the pairs within the radius."""
    forms = spoilt(random.Random(8))
    df = spark.createDataFrame([(t, 1 + (i % 5), "p") for i, t in enumerate(forms)], "form string, n long, part string")
    want = {(a, b) for a, b in itertools.combinations(forms, 2) if names.distance(a, b) <= 1} | {(t, t) for t in forms}
    for per_pivot, most in ((10_000, 10_000), (20, 10_000), (10, 40)):
        got = [(r.a, r.b) for r in names.neighbours(df, per_pivot=per_pivot, most=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert names.neighbours(df.limit(0)).collect() == []


def test_every_near_pair_meets_at_home():
    forms = spoilt(random.Random(5))
    pivots = names.bags(forms[::9])
    text, cell, home = names.cells_of(forms, pivots, 1)
    at = [{c: h for t, c, h in zip(text, cell, home) if t == i} for i in range(len(forms))]
    for i, j in itertools.combinations(range(len(forms)), 2):
        if names.distance(forms[i], forms[j]) <= 1:
            assert any(at[i][c] or at[j][c] for c in at[i].keys() & at[j].keys())


def test_names():
    assert names.parts("Dr. O'Koroquist, Tariq W., MD")[0] == ["okoroquist", "tariq"]
    for a, b in (("Jackie Walezek", "Walezek Jacqueline"), ("TAMESTEAD, H.", "Henrietta Tamestead"), ("Søren Lamstone", "SOREN LAMSTONE"), ("Mount Ulincombe CC", "Mount Ulincombe Children's Clinic"), ("Ray DelaOllinden", "Raymond de la Ollinden")):
        assert names.same_name(a, b) >= 2, (a, b)
    for a, b in (("Maria Holm", "Peter Holm"), ("", "Peter Holm"), (None, None), ("Heron Heart Institute", "Heron Dental Partners")):
        assert names.same_name(a, b) <= 1, (a, b)


def rows(spark, data):
    return spark.createDataFrame(data, "id long, name string, ident string, dob string, phone string, extra string")


def variants(df):
    return sorted(tuple(r) for r in names.variants(df, ["ident"], ["dob", "phone"]).collect())


def test_variants(spark):
    data = [
        (1, "Philippa Brenaberg", "I1", "1998-12-16", None, None),
        (2, "brenaberg, pippa", "I1", None, None, None),
        (3, "Philippa Brenabreg", None, "1998-12-16", None, None),
        (4, "Philippa Brenaberg", "I2", "1998-12-16", None, None),  # a namesake with an identifier of its own
        (5, "Peter Brenaberg", None, "1998-12-16", "2125550100", None),  # a twin
        (6, "Philippa Brenaberg", "I1", "1998-12-16", None, None),
        (7, None, "I1", None, None, None),
        (8, " ", None, None, None, None),
    ]
    got = variants(rows(spark, data))
    assert {(1, 2), (1, 3), (2, 3), (2, 6), (3, 6)} <= set(got) and (1, 6) not in got
    assert not any(5 in p or 7 in p for p in got)


def test_forms_and_the_cells_find_spelling_errors(spark):
    assert set(names.forms("Hadostrom, Terrence")) == {"hadostrom tt", "terrence hh"} and names.forms("Heron Valley Clinic") == ["heron **"]
    assert "hadostrom tt" in names.forms("T. Hadostrom") and "linnik **" in names.forms("Linnik OA") and len(names.forms("Harimere")) == 26
    assert names.forms(None) == names.forms(" .,") == []
    long = "Wolfeschlegelsteinhausenbergerdorff" * 3
    data = [(1, "Terrence Hadostrom", "I1", None, None, None), (2, "Terrence Hadostorm", "I1", None, None, None), (3, f"Peter {long}a", "I2", None, None, None), (4, f"Peter {long}zzzzz", None, None, "2125550100", None), (5, f"Peter {long}b", "I2", None, "2125550100", None)]
    assert variants(rows(spark, data)) == [(1, 2), (3, 5)]
    got = {r.id: r.entity for r in names.memberships(rows(spark, data), ["ident"], ["dob", "phone"]).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 5: 3}


def test_empty_names(spark):
    assert variants(rows(spark, [])) == []


def test_long_chains_become_one_entity(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "id_a long, id_b long")
    got = {r.id: r.entity for r in names.entities(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 100
    assert names.entities(links.limit(0)).collect() == []


def claims(spark, data):
    return spark.createDataFrame([(g, f, v, s, dt.datetime(2024, 1, d)) for g, f, v, s, d in data], "group_id long, field_name string, value string, source string, claimed_at timestamp")


def truth(df, **k):
    return {(r.group_id, r.field_name): r.kept_value for r in survivor.discover(df, **k).collect()}


def test_recency_then_votes(spark):
    data = [(1, "phone", "a", "X", 3), (1, "phone", "b", "Y", 9), (1, "phone", "a", "Z", 4), (2, "phone", None, "X", 3), (3, "phone", "c", None, 1)]
    assert truth(claims(spark, data)) == {(1, "phone"): "b", (3, "phone"): "c"}
    assert truth(claims(spark, data), recency="none") == {(1, "phone"): "a", (3, "phone"): "c"}
    assert truth(claims(spark, [])) == {}


def test_unreliable_sources_lose_ties(spark):
    data = [(g, "phone", f"t{g}", s, 1) for g in range(20) for s in ("A", "B", "C")] + [(g, "phone", f"w{g}", "BAD", 1) for g in range(20)]
    data += [(99, "phone", "right", "A", 1), (99, "phone", "a wrong one", "BAD", 1)]
    assert truth(claims(spark, data))[(99, "phone")] == "right"


def test_votes_against_planted_reliability(spark):
    """Few reliable sources against many careless ones that copy an error: weighted votes are right more often than counts."""
    rnd = random.Random(2)
    good, bad = {"A": 0.95, "B": 0.95, "C": 0.9}, {"X": 0.35, "Y": 0.35, "Z": 0.35, "V": 0.3}
    data, majority = [], 0
    for g in range(400):
        said = {s: "true" if rnd.random() < r else rnd.choice(["wrong", "wrong", "a", "b"]) for s, r in {**good, **bad}.items()}
        data += [(g, "phone", v, s, 1) for s, v in said.items()]
        counts = {v: list(said.values()).count(v) for v in set(said.values())}
        majority += max(sorted(counts), key=lambda v: counts[v]) == "true"
    got = truth(claims(spark, data), recency="none")
    right = sum(v == "true" for v in got.values())
    assert right >= 395 and right > majority + 10, (right, majority)


def test_usable_values(spark):
    phones = {"(614) 555-6308": "6145556308", "+1 614 555 6308": "6145556308", "614.S55.6308": None, "555-6308": None, "999-999-9999": None, "614 555 63": None, "none": None, "": None}
    df = spark.createDataFrame([(k,) for k in phones], "p string")
    assert [r[0] for r in df.select(survivor.usable_phone(df.p)).collect()] == list(phones.values())
    addresses = {" 7766 Kiln Rd, Apt 3, Dunmere, NY 13904 ": True, "8332 Marl Pit Ln Brindle Falls, OR 97835": True, "Dunmere, NY 13904": False, "4927 Yarrow Ct, Dunmere": False, "6353 Kiln Way": False, "unknown": False, "": False}
    df = spark.createDataFrame([(k,) for k in addresses], "a string")
    assert [r[0] for r in df.select(survivor.complete_address(df.a)).collect()] == [k.strip() if v else None for k, v in addresses.items()]
    ids = {"P000012": "P000012", "TEMP": None, " unk ": None, "0": None, "P999999999": None, "": None, "000000": None}
    df = spark.createDataFrame([(k,) for k in ids], "i string")
    assert [r[0] for r in df.select(survivor.known_id(df.i)).collect()] == list(ids.values())


def test_survivors(spark):
    d = lambda n: dt.datetime(2024, 1, n)
    data = [
        (7, "P1", "614 555 6308", None, "b.csv, a.csv", d(1), 1), (5, "P1", "614-555-0000", "1 Kiln Rd, Dunmere, NY 13904", "a.csv;C.csv", d(2), 1), (9, "P1", "555", None, None, d(9), 1),
        (1, "TEMP", "614 555 6308", None, "z", d(1), 1), (2, "TEMP", None, None, None, d(1), 1), (3, None, None, None, None, None, 1), (4, "P2", "614 555 6308", None, None, d(1), 1),
        (10, "P3", None, None, None, None, 1), (11, "P3", "", " ", "", None, 1),
    ]
    df = spark.createDataFrame(data, "id long, patient_id string, phone string, address string, source_files string, updated_at timestamp, value int")
    got = sorted(tuple(r) for r in survivor.survivors(df).collect())
    assert got == [(5, "address", "1 Kiln Rd, Dunmere, NY 13904"), (5, "phone", "6145550000"), (5, "source_files", "C.csv,a.csv,b.csv")]
