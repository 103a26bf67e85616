"""Keyword-stuffed pages, link lists and product tags, by an n-gram model of prose.

A page becomes a sequence of function words and word classes: function words stand for themselves; other words are
``k`` (known from prose), ``u`` (not), ``r`` (said once before in the same line or sentence), ``x`` (said there more often), in capitals where they begin with
one; numbers, amounts, links, tags and punctuation have classes of their own.

The model is fitted on all distinct pages: a text with many copies counts once, and every page is scored whole. Words are
known if they occur in at least ``LEAST_PAGES`` prose pages and there more often than elsewhere. A trigram model over the
classes is counted on all trusted pages (``Block.trusted``: known words or many numbers, few links, little repetition; so
tables, charges, code and reference lists are learnt as well as sentences). Limits come from all trusted pages too, each scored by the
model of the half (by a hash of the text) that it isn't in: perplexities farther from the median than ``MARGIN`` times the
quantiles ``LOW`` and ``HIGH`` are abnormal.

A page is flagged if its perplexity (mean bits per class) is abnormally high and most of its words stand in stretches
(lines, sentences, ``STRETCH`` tokens where those are long) above the stretch limit, or if it is abnormally low. Nothing
but the model decides: the rule for trusted pages only chooses what it is trained on.

The distinct pages are written once and read for words, for trigrams and for limits; one more pass scores the corpus.
Counts are combined before any shuffle. Shipped with the tasks are the model, bounded by the number of classes (under 250)
to the third power and in practice some ten thousand trigrams, and the known words, which grow as the vocabulary does.
Null, blank and punctuation-only texts are never flagged; equal pages get equal results; a corpus without trusted pages
has no flagged ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.lexer import Lexer
from quernstone.session import checkpointed

LEAST_PAGES = 3
STRETCH = 40
#: Steps of a bit in which bits are counted for quantiles.
STEPS = 4096
#: Quantiles of trusted pages, and how many times their distance from the median is still normal (at least half the median).
LOW, HIGH, MARGIN = 0.001, 0.999, 1.4
#: Quantile of trusted stretches that a stretch of an abnormal page lies above.
STRETCH_HIGH = 0.98
LEAST_SHARE = 0.5
#: Pages with fewer words are never abnormally low.
LEAST_WORDS = 20
#: A prose page has at least this share of function words, and links in at most every so many words.
FUNCTION_SHARE, LINK_SHARE = 0.2, 0.02
#: A trusted page has at most these shares of unknown words, of links and tags, and of words said before in their sentence.
TRUSTED_UNKNOWN, TRUSTED_LINKS, TRUSTED_REPEATED = 0.2, 0.1, 0.05
#: With at least this share of numbers it may have so many unknown words: tables and lists have words that prose lacks.
TRUSTED_NUMBERS, TRUSTED_UNKNOWN_BESIDE = 0.1, 0.5

#: Function words of English, Spanish and German.
FUNCTION_WORDS = frozenset(
    """a about after all also although an and any are as at be because been before being both but by can could do does
    each for from had has have he her his how i if in into is it its may me more most must my no not of on once one only
    or other our out over per she should since so some such than that the their them then there these they this those
    through to under until up us was we were what when where which while who will with within without would you your
    al como con cuando de del desde el en es esta este fue la las lo los más no o para pero por que se si sin su sus un una y
    ab als am auf aus bei bis das dem den der des die durch ein eine einem einen einer es für ich im ist mit nach nicht
    oder sich sie sind über um und vom von vor war wird wurde zu zum zur""".split()
)

_TOKEN = re.compile(
    r"(?P<link>(?:https?://|www\.)\S+|(?<![\w@])[\w-]+(?:\.[\w-]+)*\.(?:example|test|invalid|com|net|org|info|biz|shop|store)\b(?:/[\w/.-]*)?)"
    r"|(?P<tag>#\w+|\b\w+[:=][\w-]+(?:/\d+)?|\b[^\W\d]+_\w+|<[^>\n]*>?)"
    r"|(?P<money>[$€£]\s?\d[\d.,]*)"
    r"|(?P<number>\d[\d.,/^]*)"
    r"|(?P<word>[^\W\d_]+(?:['’][^\W\d_]+)*)"
    r"|(?P<line>\n)"
    r"|(?P<mark>[^\w\s])"
)
_MARKS = ".,;:!?()[]|-*%/\"'~"
_KINDS = ("line", "word", "link", "tag", "money", "number", "mark")
#: Classes by number: function words first, then words known (k), unknown (u) and repeated (r, x), in capitals too, marks and kinds.
CLASSES = (*sorted(FUNCTION_WORDS), *"kKuUrRxX", *_MARKS, "<link>", "<tag>", "<money>", "<n>", "<line>")
_NUMBER = {c: i for i, c in enumerate(CLASSES)}
_KIND_CLASS = {"link": "<link>", "tag": "<tag>", "money": "<money>", "number": "<n>", "line": "<line>"}
N_CLASSES = len(CLASSES)
_UNKNOWN = np.isin(CLASSES, ["u", "U"])
_REPEATS = np.isin(CLASSES, ["r", "R", "x", "X"])
_OFTEN = np.arange(len(CLASSES))
_OFTEN[[CLASSES.index("r"), CLASSES.index("R")]] = [CLASSES.index("x"), CLASSES.index("X")]
_FUNCTION = np.arange(N_CLASSES) < len(FUNCTION_WORDS)
# rows of the lexer's columns: class, class if repeated (-1: never), number of the lower-cased word (-1: no word), kind, end of a sentence


class Pages:
    """Pages as arrays of tokens and classes; ``known`` are the words of prose."""

    def __init__(self, known: frozenset[str] = frozenset()):
        self.known = known
        self.words: dict[str, int] = {}
        self.lexer = Lexer(_TOKEN, self._describe)

    def _describe(self, kind: str, token: str) -> tuple[int, int, int, int, int]:
        if kind == "word":
            low = token.lower()
            word = self.words.setdefault(low, len(self.words))
            if low in FUNCTION_WORDS:
                return _NUMBER[low], -1, word, 1, 0
            c, r = "k" if low in self.known else "u", "r" if len(low) > 2 else "k" if low in self.known else "u"
            if token[0].isupper():
                c, r = c.upper(), r.upper()
            return _NUMBER[c], _NUMBER[r], word, 1, 0
        if kind == "mark":
            return _NUMBER[token if token in _MARKS else "~"], -1, -1, _KINDS.index(kind), int(token in ".!?")
        return _NUMBER[_KIND_CLASS[kind]], -1, -1, _KINDS.index(kind), int(kind == "line")

    def blocks(self, texts: list) -> Iterator[Block]:
        """Blocks of about ``BLOCK`` tokens; texts without any token are left out, ``rows`` tells which are in."""
        parts, rows, n = [], [], 0
        for i, text in enumerate(texts):
            if isinstance(text, str) and text:
                if self.lexer.full():
                    if parts:
                        yield Block(self.lexer.columns(), parts, rows)
                        parts, rows, n = [], [], 0
                    self.lexer.reset()
                    self.words.clear()
                numbers = self.lexer.encode(text)
                if len(numbers):
                    parts.append(numbers)
                    rows.append(i)
                    n += len(numbers)
            if n >= BLOCK:
                yield Block(self.lexer.columns(), parts, rows)
                parts, rows, n = [], [], 0
        if parts:
            yield Block(self.lexer.columns(), parts, rows)


BLOCK = 300_000


class Block:
    """Some pages together: tokens of all pages in one array each, with the page of each token."""

    def __init__(self, columns: np.ndarray, parts: list[np.ndarray], rows: list[int]):
        numbers = np.concatenate(parts)
        self.rows, self.n = rows, len(rows)
        sizes = np.array([len(p) for p in parts])
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.page = np.repeat(np.arange(self.n), sizes)
        self.plain, self.repeated, self.word, self.kind, self.end = (columns[i][numbers] for i in range(5))
        self.is_word = self.word >= 0
        self.function = _FUNCTION[self.plain]
        self.n_words = self._count(self.is_word)
        content = np.flatnonzero(self.is_word & ~self.function)
        self.width = int(self.word.max()) + 1
        keys, counts = np.unique(self.page[content] * max(self.width, 1) + self.word[content], return_counts=True)
        self.content = content
        self.top = np.zeros(self.n, "int64")
        np.maximum.at(self.top, keys // max(self.width, 1), counts)

    def _count(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.page[mask], minlength=self.n)

    def words_of_pages(self) -> tuple[np.ndarray, np.ndarray]:
        """(page, word), each pair once."""
        width = int(self.word.max()) + 1
        keys = np.unique(self.page[self.is_word] * width + self.word[self.is_word])
        return keys // max(width, 1), keys % max(width, 1)

    def prose(self) -> np.ndarray:
        """Which pages are prose: function words, few links and tags, sentences that end, no content word over and over."""
        links = self._count((self.kind == 2) | (self.kind == 3))
        ends = self._count((self.end == 1) & (self.kind == 6))
        words = self.n_words
        return (words >= 8) & (self._count(self.function) >= FUNCTION_SHARE * words) & (links <= LINK_SHARE * words) & (ends >= words / 40) & ((self.top < 8) | (self.top < 0.08 * words))

    def classes(self) -> np.ndarray:
        """Class of each token; content words that stood in the same line or sentence before are repeated ones."""
        out = self.plain.copy()
        begins = np.zeros(len(out), bool)
        begins[self.starts] = True
        begins[1:] |= self.end[:-1] == 1
        at = self.content
        key = np.cumsum(begins)[at] * max(self.width, 1) + self.word[at]
        order = np.argsort(key, kind="stable")
        same = np.zeros((2, len(order)), bool)
        same[0, 1:] = key[order[1:]] == key[order[:-1]]
        same[1, 2:] = key[order[2:]] == key[order[:-2]]
        second, third = at[order[same[0]]], at[order[same[1]]]
        out[second] = self.repeated[second]
        out[third] = _OFTEN[self.repeated[third]]
        return out

    def trusted(self, classes: np.ndarray) -> np.ndarray:
        """Which pages the model learns from: nearly all words known, few links and tags, few words repeated in a sentence."""
        heavy = np.maximum(self._count((self.kind >= 1) & (self.kind <= 4)), 1)
        numbers = self._count(self.kind == 5)
        unknown, links, again = self._count(_UNKNOWN[self.plain]), self._count((self.kind == 2) | (self.kind == 3)), self._count(_REPEATS[classes])
        return (self.n_words >= 8) & (unknown <= np.where(numbers >= TRUSTED_NUMBERS * (heavy + numbers), TRUSTED_UNKNOWN_BESIDE, TRUSTED_UNKNOWN) * heavy) & (links <= TRUSTED_LINKS * heavy) & (again <= TRUSTED_REPEATED * heavy)

    def histories(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two classes before each token; a page begins after two line breaks."""
        line = _NUMBER["<line>"]
        one, two = np.concatenate(([line], classes[:-1])), np.concatenate(([line, line], classes[:-2]))[: len(classes)]
        one[self.starts] = line
        two[self.starts] = line
        second = self.starts + 1
        second = second[second < len(classes)]
        two[second[self.page[second] == self.page[second - 1]]] = line
        return two, one

    def stretches(self) -> np.ndarray:
        """Starts of stretches: lines and sentences, short ones joined with what follows, long ones in parts."""
        out: list[int] = []
        ends = (np.flatnonzero(self.end) + 1).tolist()
        bounds = [*self.starts.tolist()[1:], len(self.page)]
        k = 0
        for start, stop in zip(self.starts.tolist(), bounds):
            out.append(start)
            at = start
            while k < len(ends) and ends[k] < stop:
                end = ends[k]
                k += 1
                while end - at > STRETCH:
                    at += STRETCH
                    out.append(at)
                if end - at >= STRETCH // 4:
                    at = end
                    out.append(at)
            while k < len(ends) and ends[k] <= stop:
                k += 1
            while stop - at > STRETCH:
                at += STRETCH
                out.append(at)
        return np.array(out, "int64")


class Model:
    """Interpolated trigram model over classes (Witten-Bell weights), as one table of bits."""

    def __init__(self, counts: dict[int, int]):
        keys, n = np.array(list(counts), "int64").reshape(-1), np.array(list(counts.values()), "float64")
        # classes that prose never shows share one row
        parts = (keys // N_CLASSES**2, keys // N_CLASSES % N_CLASSES, keys % N_CLASSES)
        seen = np.unique(np.concatenate(parts)) if len(keys) else np.zeros(0, "int64")
        self.place = np.full(N_CLASSES, len(seen))
        self.place[seen] = np.arange(len(seen))
        size = self.size = len(seen) + 1
        tri = np.zeros((size, size, size))
        np.add.at(tri, tuple(self.place[p] for p in parts), n)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 1 / size) / (uni.sum() + 1)
        n1, t1 = bi.sum(axis=1, keepdims=True), np.count_nonzero(bi, axis=1, keepdims=True)
        p2 = np.where(n1 > 0, (bi + t1 * p1) / np.maximum(n1 + t1, 1), p1)
        n2, t2 = tri.sum(axis=2, keepdims=True), np.count_nonzero(tri, axis=2)[:, :, None]
        p3 = np.where(n2 > 0, (tri + t2 * p2[None]) / np.maximum(n2 + t2, 1), p2[None])
        self.bits = -np.log2(p3).astype("float32").ravel()

    def losses(self, two: np.ndarray, one: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Bits of each class after the two before it."""
        return self.bits[(self.place[two] * self.size + self.place[one]) * self.size + self.place[classes]]


def score_block(block: Block, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits per token of each page; per stretch: page, words (with links, tags, amounts), bits per token; trusted pages."""
    classes = block.classes()
    losses = model.losses(*block.histories(classes), classes).astype("float64")
    starts = block.stretches()
    sizes = np.diff(np.append(starts, len(classes)))
    heavy = (block.kind >= 1) & (block.kind <= 4)
    words = np.add.reduceat(heavy.astype("float64"), starts)
    bits = np.add.reduceat(losses, starts) / sizes
    page = np.add.reduceat(losses, block.starts) / np.diff(np.append(block.starts, len(classes)))
    return page, block.page[starts], words, bits, block.trusted(classes)


def distinct_pages(documents: DataFrame) -> DataFrame:
    """text, half (0 or 1): every text once, so that one with many copies doesn't count more than others."""
    return documents.where("text is not null").select("text").distinct().select("text", F.pmod(F.shiftright(F.xxhash64("text"), 40), F.lit(2)).cast("int").alias("half"))


def sample_pages(documents: DataFrame, pages: int) -> DataFrame:
    """About ``pages`` of :func:`distinct_pages`, for trials on a large corpus; no query is fitted on a sample."""
    n = documents.count()
    share = min(1.0, pages / n) if n else 1.0
    return distinct_pages(documents.where(F.pmod(F.xxhash64("text"), F.lit(1 << 31)) < int(share * (1 << 31))))


def known_words(corpus: DataFrame, least_pages: int = LEAST_PAGES) -> list[str]:
    """Words that occur in prose pages, at least ``least_pages`` and half of all their pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages = Pages()
        counts = np.zeros((2, 1 << 16), "int64")

        def out() -> pd.DataFrame:
            words = list(pages.words)
            n, prose = counts[:, : len(words)]
            some = np.flatnonzero(n)
            return pd.DataFrame({"key": np.array([words[i] for i in some], object), "n": n[some], "prose": prose[some]})

        for pdf in batches:
            for block in pages.blocks(pdf["text"].tolist()):
                if len(pages.words) > counts.shape[1]:
                    counts = np.concatenate((counts, np.zeros((2, len(pages.words)), "int64")), axis=1)
                page, word = block.words_of_pages()
                size = counts.shape[1]
                counts[0] += np.bincount(word, minlength=size)
                counts[1] += np.bincount(word[block.prose()[page]], minlength=size)
                if pages.lexer.full():
                    yield out()
                    counts[:] = 0
        yield out()

    counts = corpus.select("text").mapInPandas(run, "key string, n long, prose long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("prose").alias("prose"))
    return [r[0] for r in counts.where((F.col("prose") >= least_pages) & (2 * F.col("prose") >= F.col("n"))).select("key").collect()]


def prose_model(corpus: DataFrame, known: frozenset[str]) -> list[dict[int, int]]:
    """Counts of class trigrams over trusted pages of each half; their number is bounded by the number of classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages, total = Pages(known), Counter()
        for pdf in batches:
            halves = pdf["half"].to_numpy("int64")
            for block in pages.blocks(pdf["text"].tolist()):
                classes = block.classes()
                two, one = block.histories(classes)
                learnt = block.trusted(classes)[block.page]
                half = halves[block.rows][block.page]
                keys, n = np.unique((((half * N_CLASSES + two) * N_CLASSES + one) * N_CLASSES + classes)[learnt], return_counts=True)
                total.update(dict(zip(keys.tolist(), n.tolist())))
        yield pd.DataFrame({"key": np.array(list(total), "int64"), "n": np.array(list(total.values()), "int64")})

    counts = corpus.mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    halves: list[dict[int, int]] = [{}, {}]
    for key, n in counts.collect():
        halves[key // N_CLASSES**3][key % N_CLASSES**3] = n
    return halves


@dataclass
class Fitted:
    """What the pages give: known words, trigram counts, limits of pages (low, high) and of stretches."""

    known: frozenset[str]
    counts: dict[int, int]
    low: float = float("-inf")
    high: float = float("inf")
    stretch: float = float("inf")


def held_out_bits(corpus: DataFrame, known: frozenset[str], counts: list[dict[int, int]]) -> tuple[dict[int, int], dict[int, int]]:
    """How many trusted pages, and how many of their stretches, have so many steps of bits; half h by the model of ``counts[h]``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, models = Pages(known), [Model(c) for c in counts]
        total: Counter = Counter()
        for pdf in batches:
            for half, model in enumerate(models):
                for block in own.blocks(pdf.loc[pdf["half"] == half, "text"].tolist()):
                    page, of, words, bits, trusted = score_block(block, model)
                    for kind, values in enumerate((page[trusted], bits[trusted[of] & (words >= 3)])):
                        steps, n = np.unique(np.floor(values * STEPS).astype("int64"), return_counts=True)
                        total.update(dict(zip(zip([kind] * len(n), steps.tolist()), n.tolist())))
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["kind", "step", "n"])

    found: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for kind, step, n in corpus.mapInPandas(run, "kind int, step long, n long").groupBy("kind", "step").agg(F.sum("n")).collect():
        found[kind][step] = n
    return found


def quantile(steps: dict[int, int], share: float) -> float:
    """Bits that at least this share of the values doesn't exceed, to a step."""
    keys = np.array(sorted(steps))
    below = np.cumsum([steps[k] for k in keys.tolist()])
    return float(keys[np.searchsorted(below, share * below[-1])] + 0.5) / STEPS


def fit(documents: DataFrame) -> Fitted:
    corpus = checkpointed(distinct_pages(documents))
    known = frozenset(known_words(corpus))
    halves = prose_model(corpus, known)
    counts = dict(Counter(halves[0]) + Counter(halves[1]))
    fitted = Fitted(known, counts)
    # too few pages for two halves: each is scored by the model of all
    enough = min(corpus.where(f"half = {h}").limit(100).count() for h in (0, 1)) == 100
    of_pages, of_stretches = held_out_bits(corpus, known, halves[::-1] if enough else [counts, counts])
    if of_pages and of_stretches:
        low, middle, high = (quantile(of_pages, share) for share in (LOW, 0.5, HIGH))
        fitted.low = max(0.0, min(middle / 2, middle - MARGIN * (middle - low)))
        fitted.high = max(1.5 * middle, middle + MARGIN * (high - middle))
        fitted.stretch = quantile(of_stretches, STRETCH_HIGH)
    return fitted


def score_pages(documents: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, n_words, bits (cross-entropy of the page), share (words in stretches above their limit)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages, model = Pages(fitted.known), Model(fitted.counts)
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            for block in pages.blocks(pdf["text"].tolist()):
                page, of, words, bits, _ = score_block(block, model)
                total = np.bincount(of, words, minlength=block.n)
                over = np.bincount(of, words * (bits > fitted.stretch), minlength=block.n)
                yield pd.DataFrame({"doc_id": ids[block.rows], "n_words": total.astype("int32"), "bits": page, "share": over / np.maximum(total, 1)})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, n_words int, bits double, share double")


def spam_pages(documents: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id of pages whose perplexity is abnormal."""
    fitted = fit(documents)
    high = (F.col("bits") > fitted.high) & (F.col("share") > least_share) & (F.col("n_words") > 0)
    low = (F.col("bits") < fitted.low) & (F.col("n_words") >= LEAST_WORDS)
    return score_pages(documents, fitted).where(high | low).select("doc_id")
