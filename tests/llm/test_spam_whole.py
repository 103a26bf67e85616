"""The spam model is fitted on the whole corpus: words, trigrams and limits."""

from __future__ import annotations

from collections import Counter

import numpy as np

from quernstone.llm import spam

N = 24_000
ENDS = ["is dry.", "has healed, and she walks well.", "was seen on Monday at the clinic.", "is open; 4.5 mg of warfarin was given."]
RARE = [f"gauze{chr(97 + k)}" for k in range(26)]


def page(i: int) -> str:
    # words in three pages each: only who reads all pages knows them all
    rare = f" The {RARE[i % (N // 3)]} of the ward is new." if i % (N // 3) < len(RARE) else ""
    return f"Visit {i} is done. The wound of the patient {ENDS[i % len(ENDS)]} We will see her again in {i % 90} weeks.{rare}"


def test_fit_takes_every_page_once(spark):
    texts = [page(i) for i in range(N)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:500]])], "doc_id long, text string").repartition(4)
    fitted = spam.fit(df)
    assert {*RARE, "ward", "wound"} <= fitted.known
    corpus = spam.distinct_pages(df).collect()
    assert sorted(r.text for r in corpus) == sorted(texts)
    counts, parts = [Counter(), Counter()], {0: [], 1: []}
    for half in (0, 1):
        for block in spam.Pages(fitted.known).blocks([r.text for r in corpus if r.half == half]):
            classes = block.classes()
            two, one = block.histories(classes)
            assert block.trusted(classes).all()
            counts[half].update(((two * spam.N_CLASSES + one) * spam.N_CLASSES + classes).tolist())
            parts[half].append(block)
    assert fitted.counts == counts[0] + counts[1]
    bits, stretches = [], []
    for half in (0, 1):
        for block in parts[half]:
            p, _, words, b, _ = spam.score_block(block, spam.Model(counts[1 - half]))
            bits.append(p)
            stretches.append(b[words >= 3])
    low, middle, high = np.quantile(np.concatenate(bits), [spam.LOW, 0.5, spam.HIGH], method="inverted_cdf")
    step = 4 / spam.STEPS
    assert abs(fitted.high - max(1.5 * middle, middle + spam.MARGIN * (high - middle))) < step
    assert abs(fitted.low - max(0.0, min(middle / 2, middle - spam.MARGIN * (middle - low)))) < step
    assert abs(fitted.stretch - np.quantile(np.concatenate(stretches), spam.STRETCH_HIGH, method="inverted_cdf")) < step


def test_quantile_of_steps():
    values = np.random.default_rng(2).gamma(3, 1, 5000)
    steps = dict(Counter(np.floor(values * spam.STEPS).astype(int).tolist()))
    for share in (0.001, 0.5, 0.98, 0.999, 1.0):
        assert abs(spam.quantile(steps, share) - np.quantile(values, share, method="inverted_cdf")) <= 1 / spam.STEPS
