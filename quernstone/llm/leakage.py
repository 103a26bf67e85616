"""Evaluation texts inside a training corpus.

The corpus is read in shards of at most ``SHARD_WORDS`` words, one after another in each task, without a shuffle. A
shard becomes one FM-index over the words that occur in evaluation items (all others are one symbol). Every run of
``SEED`` words of an item is searched backwards in it and located; where seeds of one item cluster in a document, an
exact check aligns item and document locally: a word that fits scores 1, a changed, missing or added one costs
``PENALTY``. A passage counts from ``LEAST_SCORE`` on, over at least ``LEAST_SPAN`` words of the item: an altered passage of
twenty words can lose a word at each end.

Words are compared in lower case without accents, punctuation inside numbers and words, quote marks or line-break
hyphens; words of more than three characters with the same letters are equal, so swapped letters are forgiven. No
evidence are answer options (lines from ``A)`` on) and runs of ``SHARED`` or more words that stand in several items, such
as instructions; these are counted over all items before any search. Where several items align with the same words of
a document, the best one counts and others only with what they have elsewhere.

Items are a stated query set. ``ITEM_BLOCK`` of them are broadcast and searched in one pass over the corpus; where there
are more, each block finds its clusters on its own, and a document's clusters of all blocks are settled together, so
that the result doesn't depend on the blocks. Items of more than ``SEGMENT`` words are aligned in overlapping segments.
Null and blank texts and items shorter than a seed match nothing; repeated documents give their rows once; repeated
items share all their text and so give none.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.fmindex import FMIndex
from quernstone.session import checkpointed

SEED = 4
SHARED = 12
PENALTY = 1.5
LEAST_SCORE = 9.0
LEAST_SPAN = 18
SHARD_WORDS = 300_000
#: Items that are broadcast together: at SEGMENT words each under 350 MB, of usual length some 50 MB.
ITEM_BLOCK = 200_000
#: Longest run of an item that is aligned at once, and how far the next one overlaps it.
SEGMENT, OVERLAP = 400, 60
#: Runs of SEED item words that are searched at a time.
SEED_BLOCK = 400_000
#: Item words that seeds within ``BAND`` diagonals of each other must cover before a cluster is aligned.
LEAST_COVER = 8
BAND = 12
#: Words around a cluster of seeds that the alignment looks at.
MARGIN = 40
#: Seeds farther apart than this in a document belong to different clusters.
REACH = 60
#: Words of a document that are aligned at a time.
BLOCK = 2000

_WORD = re.compile(r"[^\W_]+(?:(?:['’]|[-‐]\s*\n[>\s]*|(?<=\d)[.,](?=\d))[^\W_]+)*")
_BROKEN = re.compile(r"[-‐]\s*\n")
_OPTIONS = re.compile(r"\n\s*A[).]\s")


def normal(word: str) -> str:
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]", "", word.lower())


def words_of(text: str | None) -> list[str]:
    return [w for w in map(normal, _WORD.findall(text or "")) if w]


def stem(item: str | None) -> str:
    """The item without its answer options."""
    return _OPTIONS.split(item or "", maxsplit=1)[0]


@lru_cache(maxsize=1_000_000)
def key_of(raw: str) -> str:
    """What stands for a word in comparisons: its letters in order, so that swapped ones don't matter; digits as they are."""
    w = normal(raw)
    return "".join(sorted(w)) if len(w) > 3 and not w.isdigit() else w


class Lexicon:
    """Symbols of words: 1 any word that no item has, 2.. the items' words (by key)."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.chunks: dict[str, tuple[int, ...]] = {}

    def _symbols(self, chunk: str) -> tuple[int, ...]:
        return tuple(self.vocabulary.get(k, 1) for k in map(key_of, _WORD.findall(chunk)) if k)

    def encode(self, text: str) -> np.ndarray:
        """Symbols of all words of a text. Only a hyphen at a line's end joins words across white space."""
        if _BROKEN.search(text):
            return np.array(self._symbols(text), "int64")
        out: list[int] = []
        known = self.chunks
        for chunk in text.split():
            found = known.get(chunk)
            if found is None:
                found = self._symbols(chunk)
                if len(known) < 1_000_000:
                    known[chunk] = found
            out += found
        return np.array(out, "int64")


@dataclass
class Items:
    """A block of items: keys of their words, "" where masked, and the same as symbols (0 masked)."""

    ids: list[int]
    words: list[list[str]]
    vocabulary: dict[str, int]
    symbols: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[int, list[str]]]) -> Items:
        vocabulary: dict[str, int] = {}
        for _, words in rows:
            for w in words:
                if w:
                    vocabulary.setdefault(w, len(vocabulary) + 2)
        return cls([i for i, _ in rows], [w for _, w in rows], vocabulary, [np.array([vocabulary[w] if w else 0 for w in ws], "int64") for _, ws in rows])

    def seeds(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of SEED unmasked words, some at a time: symbols, item (place in ``ids``), first word."""
        at = 0
        while at < len(self.symbols):
            own, size = [], 0
            while at < len(self.symbols) and (not own or size < SEED_BLOCK):
                own.append(at)
                size += len(self.symbols[at])
                at += 1
            whole = np.concatenate([np.append(self.symbols[i], 0) for i in own])
            item = np.repeat(own, [len(self.symbols[i]) + 1 for i in own])
            word = np.concatenate([np.arange(len(self.symbols[i]) + 1) for i in own])
            if len(whole) >= SEED:
                runs = np.lib.stride_tricks.sliding_window_view(whole, SEED)
                kept = (runs > 0).all(axis=1)
                yield runs[kept], item[: len(runs)][kept], word[: len(runs)][kept]


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"uid": pdf["uid"], "item_id": pdf["item_id"], "words": [[k for k in map(key_of, _WORD.findall(stem(t))) if k] for t in pdf["item_text"]]})


def _masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for item_id, words, starts in zip(pdf["item_id"], pdf["words"], pdf["starts"]):
            words = list(words)
            if starts is not None and len(starts):
                for k in sorted(starts):
                    words[k : k + SHARED] = [""] * SHARED
            for at in range(0, max(1, len(words) - OVERLAP), SEGMENT - OVERLAP):
                out.append((item_id, words[at : at + SEGMENT]))
        yield pd.DataFrame(out, columns=["item_id", "words"])


def item_words(eval_items: DataFrame) -> DataFrame:
    """item_id, words: keys of each item's words, "" where a run of them stands in several items too; a row per segment."""
    texts = eval_items.where("item_text is not null").select(F.monotonically_increasing_id().alias("uid"), "item_id", "item_text")
    words = checkpointed(texts.mapInPandas(_item_words, "uid long, item_id long, words array<string>"))
    places = F.sequence(F.lit(0), F.size("words") - SHARED)
    runs = words.where(F.size("words") >= SHARED).select("uid", "words", F.explode(places).alias("k")).select("uid", "k", F.xxhash64(F.slice("words", F.col("k") + 1, SHARED)).alias("run"))
    shared = runs.groupBy("run").agg(F.min("uid").alias("a"), F.max("uid").alias("b")).where("a < b").select("run")
    starts = runs.join(shared, "run", "left_semi").groupBy("uid").agg(F.collect_set("k").alias("starts"))
    return words.join(starts, "uid", "left").mapInPandas(_masked, "item_id long, words array<string>")


def align(item: np.ndarray, window: np.ndarray, ends_from: int = 0) -> tuple[float, int, int, int, int]:
    """Best local alignment that ends at window word ``ends_from`` or later: score, first and last item word, first and last
    window word (inclusive)."""
    n, m = len(item), len(window)
    # multiples of a half: exact in single precision
    score = np.zeros((n + 1, m + 1), "float32")
    steps = np.arange(m + 1, dtype="float32") * PENALTY
    gain = np.where((item[:, None] == window) & (item[:, None] > 1), np.float32(1), np.float32(-PENALTY))
    for i in range(n):
        before, row = score[i], score[i + 1]
        np.maximum(before[:-1] + gain[i], before[1:] - np.float32(PENALTY), out=row[1:])
        np.maximum(row, 0, out=row)
        # words added in the document: a running maximum of (value + position * penalty)
        row += steps
        np.maximum.accumulate(row, out=row)
        row -= steps
    ends = score[:, ends_from + 1 :]
    i, j = np.unravel_index(int(ends.argmax()), ends.shape)
    j += ends_from + 1
    best, end_i, end_j = float(score[i, j]), int(i) - 1, int(j) - 1
    first_i, first_j = end_i, end_j
    while i > 0 and j > 0 and score[i, j] > 0:
        fits = window[j - 1] == item[i - 1] and item[i - 1] > 1
        if abs(score[i, j] - (score[i - 1, j - 1] + (1.0 if fits else -PENALTY))) < 1e-6:
            i, j = i - 1, j - 1
            if fits:
                first_i, first_j = int(i), int(j)
        elif abs(score[i, j] - (score[i - 1, j] - PENALTY)) < 1e-6:
            i -= 1
        else:
            j -= 1
    return best, first_i, end_i, first_j, end_j


def covered(cluster: np.ndarray, at: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Most item words that seeds in one band of diagonals cover, for each of ``n`` clusters: those of a passage lie close,
    chance hits apart. Given per seed: cluster, document word, item word."""
    band = (at - word) // BAND
    band = band - (int(band.min()) if len(band) else 0)
    width, longest = int(band.max(initial=0)) + 2, int(word.max(initial=0)) + SEED + 1
    both = np.concatenate((cluster * width + band, cluster * width + band + 1))
    words = np.concatenate((word, word))
    cells = np.unique((both[:, None] * longest + words[:, None] + np.arange(SEED)).ravel())
    bands, sizes = np.unique(cells // longest, return_counts=True)
    most = np.zeros(n, "int64")
    np.maximum.at(most, bands // width, sizes)
    return most


class Seeds:
    """Seeds of an item in a cluster, by document word, with the item words that those of each band cover (``covered``)."""

    def __init__(self, seeds: list[tuple[int, int]]):
        self.at: dict[int, list[int]] = defaultdict(list)
        self.words: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for d, k in seeds:
            self.at[d].append(k)
            for words in self._bands(d, k):
                for w in range(k, k + SEED):
                    words[w] += 1
        self.full = {id(words) for words in self.words.values() if len(words) >= LEAST_COVER}

    def _bands(self, d: int, k: int) -> tuple[dict[int, int], dict[int, int]]:
        b = (d - k) // BAND
        return self.words[b], self.words[b + 1]

    def drop(self, first: int, last: int) -> None:
        """Without the seeds that hold one of these document words."""
        for d in range(first - SEED + 1, last + 1):
            for k in self.at.pop(d, ()):
                for words in self._bands(d, k):
                    for w in range(k, k + SEED):
                        words[w] -= 1
                        if not words[w]:
                            del words[w]
                    if len(words) < LEAST_COVER:
                        self.full.discard(id(words))


class Window:
    """Best local alignments of an item with a stretch of a document from which words are taken one passage after another.

    Aligned in blocks of ``BLOCK`` words where alignments end, each read from as far before it as one can reach; so only
    blocks near the words taken are aligned again.
    """

    def __init__(self, item: np.ndarray, words: np.ndarray):
        self.item, self.words = item, words
        # a positive score has at most one fitting word per item word, and fewer other words than these pay for
        self.reach = len(item) + int(len(item) / PENALTY) + 1
        self.known: dict[int, tuple[float, int, int, int, int]] = {}

    def best(self) -> tuple[float, int, int, int, int]:
        for at in range(0, len(self.words), BLOCK):
            if at not in self.known:
                low = max(0, at - self.reach)
                score, i0, i1, d0, d1 = align(self.item, self.words[low : at + BLOCK], at - low)
                self.known[at] = score, i0, i1, low + d0, low + d1
        return min(self.known.values(), key=lambda a: (-a[0], a[2], a[4]))

    def take(self, first: int, last: int) -> None:
        self.words[first : last + 1] = 1
        for at in range(first // BLOCK * BLOCK, last + self.reach + 1, BLOCK):
            self.known.pop(at, None)


@dataclass
class Cluster:
    """Seeds of one item close together in a document, and how many item words they cover in a band."""

    item_id: int
    words: list[str]
    cover: int
    seeds: list[tuple[int, int]]


def passages(text: str, clusters: list[Cluster]) -> list[tuple[int, float, int, int, int]]:
    """(item_id, score, item words spanned, first and last code point) of the passages of a text that count.

    Clusters are aligned from the best covered one on; a passage takes its words, other items count with what they have
    elsewhere.
    """
    vocabulary: dict[str, int] = {}
    for words in {id(c.words): c.words for c in clusters}.values():
        for w in words:
            if w:
                vocabulary.setdefault(w, len(vocabulary) + 2)
    document = Lexicon(vocabulary).encode(text)
    free = np.ones(len(document), bool)
    found = []
    for c in sorted(clusters, key=lambda c: (-c.cover, c.item_id, c.seeds[0], c.words)):
        own = c.seeds
        if found:
            open_ = free[np.array([d for d, _ in own])[:, None] + np.arange(SEED)].all(axis=1)
            own = [p for p, o in zip(own, open_.tolist()) if o]
        if len(own) * SEED < LEAST_COVER:
            continue
        low, high = max(0, min(d for d, _ in own) - MARGIN), min(len(document), max(d for d, _ in own) + SEED + MARGIN)
        left = Seeds(own)
        item = np.array([vocabulary[w] if w else 0 for w in c.words], "int64")
        window = Window(item, np.where(free[low:high], document[low:high], 1))
        while left.full:
            score, i0, i1, d0, d1 = window.best()
            if score < LEAST_SCORE:
                break
            if i1 - i0 + 1 >= LEAST_SPAN:
                found.append((c.item_id, score, i1 - i0 + 1, low + d0, low + d1))
                free[low + d0 : low + d1 + 1] = False
            # words of a quotation too short to count stay free for other items
            window.take(d0, d1)
            left.drop(low + d0, low + d1)
    if not found:
        return []
    places = [m.span() for m in _WORD.finditer(text) if key_of(m.group())]
    return [(i, score, span, places[first][0], places[last][1]) for i, score, span, first, last in found]


def searchable(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What seeds can occur in: runs of item words of a seed's length or more, parted by one other symbol; and their positions."""
    item = np.concatenate(([False], text > 1, [False]))
    edges = np.flatnonzero(item[1:] != item[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= SEED
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    lengths = ends - starts + 1
    places = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    kept = text[np.minimum(places, len(text) - 1)].copy()
    kept[np.cumsum(lengths) - 1] = 1
    return kept, places


def search_shard(items: Items, documents: list[np.ndarray]) -> Iterator[tuple[int, list[Cluster]]]:
    """(document, its clusters) over one shard: one index, all seeds of the items."""
    if not documents:
        return
    gap = np.array([1])
    lengths = np.array([len(d) + 1 for d in documents])
    starts = np.cumsum(lengths) - lengths
    text, places = searchable(np.concatenate([x for d in documents for x in (d, gap)]))
    if not len(text):
        return
    index = FMIndex(text, int(text.max()))
    present = np.zeros(max(items.vocabulary.values(), default=1) + 2, bool)
    present[text] = True
    hits = []
    for runs, item, word in items.seeds():
        some = present[runs].all(axis=1)
        runs, item, word = runs[some], item[some], word[some]
        if not len(runs):
            continue
        distinct, which = np.unique(runs, axis=0, return_inverse=True)
        low, high = index.search(distinct)
        sizes = (high - low)[which.ravel()]
        first = low[which.ravel()]
        ranks = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        if not len(ranks):
            continue
        # equal runs of several items lead to the same ranks: each is located once
        once, back = np.unique(ranks, return_inverse=True)
        hits.append((places[index.locate(once)][back], np.repeat(item, sizes), np.repeat(word, sizes)))
    if not hits:
        return
    position, item, word = (np.concatenate(x) for x in zip(*hits))
    document = np.searchsorted(starts, position, side="right") - 1
    at = position - starts[document]
    order = np.lexsort((word, at, item, document))
    document, item, at, word = document[order], item[order], at[order], word[order]
    new = np.ones(len(at), bool)
    new[1:] = (document[1:] != document[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > REACH)
    cluster = np.cumsum(new) - 1
    # one seed alone covers too little
    many = np.bincount(cluster)[cluster] * SEED >= LEAST_COVER
    document, item, at, word, cluster = document[many], item[many], at[many], word[many], cluster[many]
    if not len(at):
        return
    _, cluster, sizes = np.unique(cluster, return_inverse=True, return_counts=True)
    cover = covered(cluster, at, word, len(sizes))
    edges = np.cumsum(sizes)
    found: dict[int, list[Cluster]] = defaultdict(list)
    for c in np.flatnonzero(cover >= LEAST_COVER).tolist():
        a, b = int(edges[c] - sizes[c]), int(edges[c])
        i = int(item[a])
        found[int(document[a])].append(Cluster(items.ids[i], items.words[i], int(cover[c]), list(zip(at[a:b].tolist(), word[a:b].tolist()))))
    yield from found.items()


def _shards(batches: Iterator[pd.DataFrame], lexicon: Lexicon, shard_words: int) -> Iterator[tuple[list[int], list[str], list[np.ndarray]]]:
    ids: list[int] = []
    texts: list[str] = []
    shard: list[np.ndarray] = []
    n = 0
    for pdf in batches:
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            symbols = lexicon.encode(text)
            if len(symbols) < SEED:
                continue
            ids.append(doc_id)
            texts.append(text)
            shard.append(symbols)
            n += len(symbols) + 1
            if n >= shard_words:
                yield ids, texts, shard
                ids, texts, shard, n = [], [], [], 0
    yield ids, texts, shard


_FOUND = "doc_id long, item_id long, score double, item_words int, start int, end int"
_CLUSTERS = "doc_id long, text string, clusters array<struct<item_id:long,words:array<string>,cover:int,at:array<int>,word:array<int>>>"
_COLUMNS = ["doc_id", "item_id", "score", "item_words", "start", "end"]


def _settled(rows: Iterator[tuple[int, str, list[Cluster]]]) -> pd.DataFrame:
    out = [(doc_id, *p) for doc_id, text, clusters in rows for p in passages(text, clusters)]
    return pd.DataFrame(out, columns=_COLUMNS).astype({"item_words": "int32", "start": "int32", "end": "int32"})


def _of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Passages of documents whose clusters come from several blocks of items."""
    for pdf in batches:
        own = ([Cluster(c["item_id"], list(c["words"]), c["cover"], list(zip(c["at"], c["word"]))) for part in parts for c in part] for parts in pdf["parts"])
        yield _settled(zip(pdf["doc_id"], pdf["text"], own))


def _blocks(items: DataFrame, size: int) -> Iterator[Items]:
    block: list[tuple[int, list[str]]] = []
    for r in items.where(F.size("words") >= SEED).toLocalIterator():
        block.append((r["item_id"], list(r["words"])))
        if len(block) == size:
            yield Items.of(block)
            block = []
    if block:
        yield Items.of(block)


def leaked_passages(documents: DataFrame, eval_items: DataFrame, shard_words: int = SHARD_WORDS, item_block: int = ITEM_BLOCK) -> DataFrame:
    """doc_id, item_id, score, item_words, start, end (code points of the text): every leaked passage, each once."""
    spark = documents.sparkSession
    shipped = [spark.sparkContext.broadcast(b) for b in _blocks(item_words(eval_items), item_block)]
    texts = documents.where("text is not null").select("doc_id", "text")
    if not shipped:
        return spark.createDataFrame([], _FOUND)

    def search(own: Broadcast, settle: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            items = own.value
            for ids, docs, shard in _shards(batches, Lexicon(items.vocabulary), shard_words):
                found = list(search_shard(items, shard))
                if settle:
                    yield _settled((ids[d], docs[d], clusters) for d, clusters in found)
                elif found:
                    flat = [[{"item_id": c.item_id, "words": c.words, "cover": c.cover, "at": [a for a, _ in c.seeds], "word": [w for _, w in c.seeds]} for c in cs] for _, cs in found]
                    yield pd.DataFrame({"doc_id": [ids[d] for d, _ in found], "text": [docs[d] for d, _ in found], "clusters": flat})

        return run

    if len(shipped) == 1:
        return texts.mapInPandas(search(shipped[0], True), _FOUND).distinct()
    clusters = reduce(DataFrame.unionByName, [texts.mapInPandas(search(b, False), _CLUSTERS) for b in shipped])
    together = clusters.groupBy("doc_id", "text").agg(F.collect_list("clusters").alias("parts"))
    return together.mapInPandas(_of_blocks, _FOUND).distinct()


def removal_spans(found: DataFrame) -> DataFrame:
    """doc_id, spans: the stretches of each document that leaked text covers, merged where they overlap or one character parts them."""
    grouped = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] + 1 >= s["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return grouped.select("doc_id", merged.alias("spans"))
