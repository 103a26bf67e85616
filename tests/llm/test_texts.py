import random

import numpy as np
import pytest

from quernstone.llm import fmindex, leakage, pii, spam


def found(text):
    return [(k, text[a:b]) for k, a, b in pii.find(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Contact edward_d+clinic@family-net.example for the portal.", [("EMAIL", "edward_d+clinic@family-net.example")]),
        ("cc renee dot holley at postbox dot test, second copy", [("EMAIL", "renee dot holley at postbox dot test")]),
        ("Receipt to califell.p(at)inbox(dot)example on request", [("EMAIL", "califell.p(at)inbox(dot)example")]),
        ("Order 9 units @ $40 each. Sent @ 4:15 from the ward.", []),
        ("Call back on 555-7831. Score sheet 555-16 filed.", [("PHONE", "555-7831")]),
        ("Mobile +44 20 7946 0577 after five.", [("PHONE", "+44 20 7946 0577")]),
        ("Cell is 224-555-3384 ext. 238; fine.", [("PHONE", "224-555-3384 ext. 238")]),
        ("Reach the family under five two five five five five one seven five one only.", [("PHONE", "five two five five five five one seven five one")]),
        ("Left a message at 841‑555‑5805, no answer.", [("PHONE", "841‑555‑5805")]),
        ("SSN#974-07-2004 was keyed. Order no. 974072004 is open.", [("ID", "974-07-2004")]),
        ("mrn=08944846 and NDC 00912-4421-2, Claim 2011-0091-79, lot 23-606-28", [("ID", "08944846")]),
        ("Holds passport no. X51435216. DL B046-7214-9976 expired. eligibility for member HPX53809402", [("ID", "X51435216"), ("ID", "B046-7214-9976"), ("ID", "HPX53809402")]),
        ("Moved to 3348 Ember Lane\nDunmere, NY 13975 last spring.", [("ADDRESS", "3348 Ember Lane\nDunmere, NY 13975")]),
        ("addr PO Box 748, Quarry Mills, OH 44912", [("ADDRESS", "PO Box 748, Quarry Mills, OH 44912")]),
        ("Resides 141 Ember Close, Hobbleford, QX10 1FS.", [("ADDRESS", "141 Ember Close, Hobbleford, QX10 1FS")]),
        ("Requests older than 11 days close on Tuesday.\nIn 2020", []),
        ("Interview with QUININQUIST, TIMOTHY took place by video.", [("NAME", "QUININQUIST, TIMOTHY")]),
        ("José Uladen, MD, signed the order. Isadora  Maroworth's results were mailed.", [("NAME", "José Uladen"), ("NAME", "Isadora  Maroworth")]),
        ("told jacqueline istridge to fast before labs", [("NAME", "jacqueline istridge")]),
        ("I saw Mr O'Korinlow again. The Harimere household shares one policy.", [("NAME", "O'Korinlow"), ("NAME", "Harimere")]),
        ("Name on the card: LAMISTROM, GORAN K\nPlan: rest.", [("NAME", "LAMISTROM, GORAN K")]),
        ("Parkinson disease, Bell palsy and Babinski sign; Foley catheter; Nurse call button replaced; seen at Heron Landing Day Surgery.", []),
        ("", []),
    ],
)
def test_finds(text, want):
    assert found(text) == want


#: Texts with people, numbers and places that occur in no test table: what stands in them.
ELSEWHERE = (
    ("Alice Johnson visited the clinic.", "Alice Johnson"),
    ("The chart of John Smith was reviewed by Sarah Williams yesterday.", "Sarah Williams"),
    ("I met Mary O'Neill in the ward.", "Mary O'Neill"),
    ("Wei Zhang is a 54-year-old man.", "Wei Zhang"),
    ("Results were sent to Deepak Sharma.", "Deepak Sharma"),
    ("Mr. Okonkwo denies pain.", "Okonkwo"),
    ("Fatima Al-Sayed reports nausea.", "Fatima Al-Sayed"),
    ("Hiroshi Tanaka underwent surgery.", "Hiroshi Tanaka"),
    ("Seen by Dr. Priyanka Chopra-Jonas today.", "Priyanka Chopra-Jonas"),
    ("Guarantor: Lars Lindqvist", "Lars Lindqvist"),
    ("Dictated by: Ngozi Adichie, MD", "Ngozi Adichie"),
    ("Her husband Giovanni asked for a copy.", "Giovanni"),
    ("We called Kofi Annan about the scan.", "Kofi Annan"),
    ("Björn Borg has mild asthma.", "Björn Borg"),
    ("Consent was given and Rosa Parks signed the form.", "Rosa Parks"),
    ("The wound is dry. Chidi Anagonye will return on Monday.", "Chidi Anagonye"),
    ("Dear Ms. Huang, your labs are back.", "Huang"),
    ("Referred by Olena Shevchenko for imaging.", "Olena Shevchenko"),
    ("My neighbour is a friend of hers, Anders.", "Anders"),
    ("MRN 1234567 is on the chart.", "1234567"),
    ("MRN: 12345678901", "12345678901"),
    ("Passport AB1234567 was shown.", "AB1234567"),
    ("Driver licence D1234567 expired.", "D1234567"),
    ("SSN 123-45-6789 on file", "123-45-6789"),
    ("social security number 123 45 6789", "123 45 6789"),
    ("Member ID: W123456789", "W123456789"),
    ("Medical record number 00456789.", "00456789"),
    ("She lives at 10 Broadway, New York, NY 10004.", "10 Broadway, New York, NY 10004"),
    ("221B Baker Street, London NW1 6XE", "221B Baker Street, London NW1 6XE"),
    ("Mail to 1600 Pennsylvania Ave NW, Washington, DC 20500 please", "1600 Pennsylvania Ave NW, Washington, DC 20500"),
    ("moved to 742 Evergreen Terrace, Springfield, IL 62704 in May", "742 Evergreen Terrace, Springfield, IL 62704"),
    ("P.O. Box 99, Fargo, ND 58102", "P.O. Box 99, Fargo, ND 58102"),
    ("Call six one four, eight eight eight, one two one two.", "six one four, eight eight eight, one two one two"),
    ("Her number is (415) 555-2671.", "(415) 555-2671"),
    ("Reach me at +49 30 901820.", "+49 30 901820"),
    ("tel:+14155552671", "+14155552671"),
    ("Fax 4155552671 is out of paper", "4155552671"),
    ("Write to o'brien@example.com today.", "o'brien@example.com"),
    ("jane.doe [at] mail [dot] example [dot] org", "jane.doe [at] mail [dot] example [dot] org"),
    ("mailto:first.last@sub.example.co.uk?subject=x", "first.last@sub.example.co.uk"),
)
NOBODY = (
    "Patient has Crohn Disease and Atrial Fibrillation was noted.", "Take Vitamin D with Calcium Carbonate daily.", "Order no. 12345678, claim 123456789, lot 123-45-678 and invoice 2024-11-0042 are open.",
    "Blood pressure 120/80 on 2024-01-02 at 10:30, pulse 72.", "In May the Family Clinic was moved to Harbor Community Hospital.", "Dose was 500 mg in 10 ml, 3 times a day for 7-10 days.", "The Medical Center is closed and Day Surgery will open.",
    "See page 12 of 140 in the manual.", "He was asked to fast and told not to drive.", "ICD-10 code E11.9 and CPT 99213 were billed at $1,234.56.", "Platelets 150 - 400, sodium 135.", "Next visit in two to three weeks, or one week if worse.",
)


def test_people_numbers_and_places_from_elsewhere():
    """Recall and precision outside the vocabulary of the test tables."""
    hits = [want in {t[a:b] for _, a, b in pii.find(t)} for t, want in ELSEWHERE]
    assert sum(hits) / len(hits) >= 0.95, [t for (t, _), h in zip(ELSEWHERE, hits) if not h]
    wrong = [(t, found(t)) for t in NOBODY if found(t)]
    assert not wrong


def test_many_finds_in_a_long_text():
    text = "Call 614-555-0101 or mail x@y.example; " * 20_000
    assert len(pii.find(text)) == 40_000


def test_redaction_keeps_the_rest(spark):
    text = "Spoke with Søren Garadale about 555. Mail soren@inbox.example.\n"
    rows = [(1, text * 300, "x"), (2, None, "x"), (3, "", "x"), (4, "nothing", "x"), (4, "nothing", "x")]
    df = spark.createDataFrame(rows, "id long, raw_text string, text string")
    got = {r.record_id: (r.text, r.n_replaced) for r in pii.redacted(df).collect()}
    assert got[1] == ("Spoke with [NAME] about 555. Mail [EMAIL].\n" * 300, 600) and got[2][0] is None and got[3] == ("", 0) and got[4] == ("nothing", 0)
    assert sorted(tuple(r) for r in pii.personal_data(df).collect()) == [(1, "EMAIL", "soren@inbox.example"), (1, "NAME", "Søren Garadale")]
    assert pii.personal_data(df.limit(0)).collect() == []


def test_fm_index_against_brute_force():
    rng = np.random.default_rng(4)
    for n in (1, 2, 17, 400):
        text = rng.integers(1, 5, n)
        index = fmindex.FMIndex(text, 4)
        phrases = rng.integers(1, 5, (60, 3))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(n - 2) if (text[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


ITEM = (
    "A retired lamp keeper of 57 reports a humming noise in the left knee after climbing spiral stairs for nine days in a row. "
    "Her brother once lost his sense of direction near a quarry. The copper value is twice the upper bound. Which vitamin is most likely missing?\nA) iron\nB) none of these"
)
LEAD = "For each question select the option that is most nearly correct; there is no penalty for a wrong guess. "


def leaks(spark, docs, items=None):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(items or [(1, LEAD + ITEM), (2, LEAD + "What colour does litmus turn when the sample is left in the sun for seven hours without any cover at all?")], "item_id long, item_text string")
    return sorted(tuple(r) for r in leakage.leaked_passages(d, e).select("doc_id", "item_id").distinct().collect())


def test_leaks(spark):
    words = ITEM.split()
    filler = "Follow up in two weeks and keep the wound dry. " * 30
    altered = [w for k, w in enumerate(words[4:40]) if k % 9 != 5]
    docs = [
        (1, filler + " ".join(words[:25]) + " " + filler),
        (2, filler + ITEM.upper() + filler),
        (3, "> " + "\n> ".join(" ".join(words[i : i + 6]) for i in range(0, 42, 6))),
        (4, " ".join(words[:9]) + " " + filler),  # a short quotation
        (5, LEAD * 3),
        (6, "A) iron\nB) none of these " * 20),
        (7, " ".join(altered)),
        (8, None),
        (9, ""),
        (10, filler * 20),
    ]
    assert leaks(spark, docs) == [(1, 1), (2, 1), (3, 1), (7, 1)]
    assert leaks(spark, []) == []
    assert leaks(spark, docs, [(3, "too short")]) == []


def test_spans(spark):
    text = "Start here. " + ITEM.split("\n")[0] + " The end."
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    e = spark.createDataFrame([(1, ITEM)], "item_id long, item_text string")
    spans = leakage.removal_spans(leakage.leaked_passages(d, e)).first()["spans"]
    assert [text[a:b] for a, b in spans] == [ITEM.split("\n")[0].rstrip("?")]


def test_spoken_number_of_any_digits():
    assert found("Ring two one two, three four six, nine oh one two after noon.") == [("PHONE", "two one two, three four six, nine oh one two")]


def aligned(item, document):
    """(first, last) document word of each passage of one item that counts."""
    text = " ".join(document)
    items = leakage.Items.of([(1, [leakage.key_of(w) for w in item])])
    found = [p for _, cs in leakage.search_shard(items, [leakage.Lexicon(items.vocabulary).encode(text)]) for p in leakage.passages(text, cs)]
    return sorted((len(text[:a].split()), len(text[:b].split()) - 1) for *_, a, b in found)


def test_blocks_of_items_change_nothing(spark):
    """Whatever the blocks: text shared by items of different blocks is no leak, competing items share a document alike."""
    rnd = random.Random(3)
    some = ["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(300)]
    items = [(i, LEAD + " ".join(rnd.choices(some, k=45))) for i in range(14)]
    items[3], items[11] = (3, items[3][1] + " " + ITEM), (11, items[11][1] + " " + ITEM)  # shared by two items
    items[5] = (5, items[5][1] + " " + " ".join(items[9][1].split()[-11:]))  # too short to be shared: 5 and 9 compete for it
    words = [t.split()[len(LEAD.split()) :] for _, t in items]
    docs = [(i, "Keep the wound dry. " * i + " ".join(words[i][:30]) + " and more " + " ".join(words[(i + 4) % 14][-30:])) for i in range(14)] + [(50, ITEM), (51, ITEM)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, item_text string")
    got = {n: sorted(map(tuple, leakage.leaked_passages(d, e, item_block=n).collect())) for n in (1, 3, 5, 100)}
    assert len(got[100]) > 10 and got[1] == got[3] == got[5] == got[100]
    assert not any(doc in (50, 51) for doc, *_ in got[100])


def test_six_fragments_and_a_long_item(spark):
    item = [f"w{k}" for k in range(150)]
    text = " ".join(" ".join(item[k * 25 : k * 25 + 22] + [f"x{j}" for j in range(30)]) for k in range(6))
    long = [f"v{k}" for k in range(1500)]
    d = spark.createDataFrame([(1, text), (2, " ".join(long))], "doc_id long, text string")
    e = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long))], "item_id long, item_text string")
    spans = {r.doc_id: r.spans for r in leakage.removal_spans(leakage.leaked_passages(d, e)).collect()}
    assert [len(text[a:b].split()) for a, b in spans[1]] == [22] * 6
    assert [tuple(s) for s in spans[2]] == [(0, len(" ".join(long)))]


def test_every_copy_of_a_passage(spark):
    item, gap = [f"w{k}" for k in range(30)], [f"x{k}" for k in range(10)]
    for n in (3, 4, 9, 200):  # the last in several blocks
        assert aligned(item, (item + gap) * n) == [(k * 40, k * 40 + 29) for k in range(n)]
    d = spark.createDataFrame([(1, " ".join((item + gap) * 7))], "doc_id long, text string")
    e = spark.createDataFrame([(1, " ".join(item))], "item_id long, item_text string")
    assert len(leakage.removal_spans(leakage.leaked_passages(d, e)).first()["spans"]) == 7


def test_short_quotation_hides_no_passage():
    item = [f"w{k}" for k in range(60)]
    altered = [f"y{k}" if k in (35, 40, 45, 50) else f"w{k}" for k in range(31, 55)]
    gap = [f"x{k}" for k in range(30)]
    assert aligned(item, item[:15]) == []
    assert aligned(item, altered) == [(0, 23)]
    assert aligned(item, item[:15] + gap + altered) == [(45, 68)]
    assert aligned(item, altered + gap + item[:15]) == [(0, 23)]


PROSE = "The patient was seen on Monday and the wound is dry. She walks with a cane and has no pain at rest. We will see her again in two weeks if the dose of warfarin is well tolerated. A result of 4.5 mg was in the table. "


def test_spam(spark):
    docs = [(i, PROSE * (1 + i % 4) + f"Visit {i} is done.") for i in range(80)]
    docs += [(100, "cheap knee brace online, knee brace sale, buy knee brace near me, " * 20), (101, "\n".join(f"http://link-farm.example/page/{i}" for i in range(60))), (102, " ".join(f"tag:miracle_cure; sku:{i}_belt;" for i in range(40)))]
    docs += [(200 - k, "Result table\n" + "\n".join(f"warfarin dose\t{i + k}.4\tmg" for i in range(40 - k))) for k in range(6)]
    docs += [ (201, None), (202, ""), (203, "...!!!"), (204, PROSE * 8 + "cheap knee brace online, knee brace sale, " * 6)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, share string")
    assert sorted(r.doc_id for r in spam.spam_pages(df).collect()) == [100, 101, 102]
    assert spam.spam_pages(df.limit(0)).collect() == []
    # the model decides: without its limits nothing is flagged
    fitted = spam.fit(df)
    assert 0 < fitted.low < fitted.high < 10 and {r.doc_id: r.bits > fitted.high for r in spam.score_pages(df, fitted).where("doc_id in (0, 100, 101, 200)").collect()} == {0: False, 100: True, 101: True, 200: False}


def test_sample_is_bounded_and_counts_copies_once(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same page' ELSE concat('page ', id) END AS text")
    assert spam.sample_pages(docs, 10_000).count() == 2001
    assert 100 < spam.sample_pages(docs, 300).count() < 320


def test_histories_begin_anew_on_each_page():
    pages = spam.Pages(frozenset({"wound"}))
    (block,) = pages.blocks(["the wound", "wound", None, "", "is\n\nthe wound dry."])
    two, one = block.histories(block.classes())
    line = spam._NUMBER["<line>"]
    assert block.rows == [0, 1, 4]
    for start in block.starts:
        assert two[start] == one[start] == line
    assert two[block.starts[0] + 1] == line and one[block.starts[0] + 1] == spam._NUMBER["the"]
