"""Documents into training sequences of a fixed capacity, with little padding.

Texts are measured with a public tokenizer. A document longer than the capacity is cut into full pieces and a rest;
every other one stays whole. Items are dealt by hash into groups of about ``GROUP_ITEMS``, and each group is packed
on its own, so that no task holds more than a group whatever the corpus holds: best fit decreasing first, then local
search. The search exchanges one item for one, two for one, or moves one, between bins that are not full, wherever
that increases the sum of squared fills; bins that run empty vanish. It ends when no such exchange is left: the sum is
whole and grows with each one.

Null and empty texts have no tokens and give no row. Equal texts are packed separately. A group holds documents, one
item each; full pieces of long ones are sequences of their own and no items. The number of groups follows from the count; results depend on document ids and texts only, not on the order of rows.
"""

from __future__ import annotations

import base64
import bisect
import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
GROUP_ITEMS = 4096
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern of the byte-level vocabularies. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encoder = tokenizer(path)
        return texts.map(lambda t: len(encoder.encode_ordinary(t)) if t else 0).astype("int32")

    return documents.select("doc_id", count("text").alias("n_tokens"))


def first_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: bins as lists of item positions."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free space, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            free, b = capacity - sizes[i], len(bins) - 1
        else:
            free, b = room.pop(at)
            bins[b].append(i)
            free -= sizes[i]
        bisect.insort(room, (free, b))
    return bins


class Open:
    """Bins that are not full, with their items by size: which bin of the least fill holds an item of a wanted size."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.items: list[dict[int, list[int]]] = [{} for _ in bins]  # bin -> size -> items
        self.heaps: dict[int, list[tuple[int, int]]] = {}  # size -> (fill, bin); entries of the past are dropped when met
        self.present: list[int] = []
        for b in range(len(bins)):
            if self.open(b):
                for i in bins[b]:
                    self.items[b].setdefault(sizes[i], []).append(i)
                self._offer(b)

    def open(self, b: int) -> bool:
        return 0 < self.fill[b] < self.capacity

    def _offer(self, b: int) -> None:
        for s in self.items[b]:
            if s not in self.heaps:
                self.heaps[s] = []
                bisect.insort(self.present, s)
            heapq.heappush(self.heaps[s], (self.fill[b], b))

    def least(self, size: int, but: int) -> tuple[int, int] | None:
        """(fill, bin) of the least filled open bin that holds an item of the size, other than ``but``."""
        heap, aside, found = self.heaps[size], None, None
        while heap:
            fill, b = heap[0]
            if fill != self.fill[b] or not self.open(b) or size not in self.items[b]:
                heapq.heappop(heap)
            elif b == but:
                aside = heapq.heappop(heap)
                while heap and heap[0] == aside:
                    heapq.heappop(heap)
            else:
                found = heap[0]
                break
        if aside is not None:
            heapq.heappush(heap, aside)
        return found

    def partner(self, low: int, high: int, into: int, floor: int) -> tuple[int, int] | None:
        """(item, bin): the largest item of low..high in another bin whose fill is below ``floor`` + its size."""
        for k in range(bisect.bisect_right(self.present, high) - 1, -1, -1):
            s = self.present[k]
            if s < low:
                return None
            held = self.least(s, into)
            if held is not None and held[0] < floor + s:
                return min(self.items[held[1]][s]), held[1]
        return None

    def shift(self, moves: list[tuple[int, int, int]]) -> None:
        """(item, from, to): all at once."""
        for i, source, target in moves:
            s = self.sizes[i]
            self.bins[source].remove(i)
            self.bins[target].append(i)
            self.items[source][s].remove(i)
            if not self.items[source][s]:
                del self.items[source][s]
            self.items[target].setdefault(s, []).append(i)
            self.fill[source] -= s
            self.fill[target] += s
        for b in {b for _, *both in moves for b in both}:
            if self.open(b):
                self._offer(b)


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search over bins that are not full, until none helps; each exchange strictly increases the sum of squared fills.

    For a bin with free space f, the best partner item is looked up by size: moving an item of size s from a bin with
    fill b into one with fill a changes the sum by 2s(a + s - b), an exchange of sizes s for t (s > t) works like
    moving s - t. Of equal items of a bin any one stands for all.
    """
    own = Open(bins, sizes, capacity)
    changed = True
    while changed:
        changed = False
        for a in sorted((b for b in range(len(bins)) if own.open(b)), key=lambda b: (-own.fill[b], b)):
            while own.open(a):
                free = capacity - own.fill[a]
                # move: an item of at most the free space
                if (found := own.partner(1, free, a, own.fill[a])) is not None:
                    own.shift([(found[0], found[1], a)])
                    changed = True
                    continue
                held = sorted(own.items[a])
                outs: dict[int, tuple[int, ...]] = {s: (own.items[a][s][0],) for s in held}
                for k, s in enumerate(held):
                    if len(own.items[a][s]) > 1:
                        outs.setdefault(2 * s, tuple(own.items[a][s][:2]))
                    for t in held[k + 1 :]:
                        outs.setdefault(s + t, (own.items[a][s][0], own.items[a][t][0]))
                best = None
                for t, out in outs.items():
                    got = own.partner(t + 1, t + free, a, own.fill[a] - t)
                    if got is not None and (best is None or sizes[got[0]] - t > best[0]):
                        best = (sizes[got[0]] - t, got, out)
                if best is None:
                    break
                _, (i, source), out = best
                own.shift([(i, source, a), *((o, a, source) for o in out)])
                changed = True
    return [b for b in bins if b]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    return improve(first_fit(sizes, capacity), sizes, capacity)


_PACKED = "doc_id long, piece int, n_tokens int, sequence_id long, position int, start int"


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, group_items: int = GROUP_ITEMS) -> DataFrame:
    """doc_id, piece (0 unless cut), n_tokens, sequence_id, position (in the sequence), start (token offset in it)."""
    n_groups = max(1, -(-documents.count() // group_items))
    measured = token_counts(documents, path).where("n_tokens > 0")
    dealt = measured.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(n_groups)))

    def run(key, pdf):
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable", ignore_index=True)
        ids, tokens = pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy()
        full, rest = tokens // capacity, tokens % capacity
        items = np.flatnonzero(rest)
        bins = [sorted(b) for b in pack(rest[items].tolist(), capacity)]
        order = items[np.array([i for b in bins for i in b], "int64")]
        lengths = np.array([len(b) for b in bins], "int64")
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        before = np.cumsum(rest[order]) - rest[order]
        # a full piece is a sequence of its own
        whole = np.repeat(np.arange(len(ids)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        sequence = np.concatenate((np.repeat(np.arange(len(bins)), lengths), len(bins) + np.arange(len(whole))))
        return pd.DataFrame(
            {
                "doc_id": ids[np.concatenate((order, whole))],
                "piece": np.concatenate((full[order], piece)).astype("int32"),
                "n_tokens": np.concatenate((rest[order], np.full(len(whole), capacity))).astype("int32"),
                "sequence_id": int(key[0]) * (1 << 32) + sequence,
                "position": np.concatenate((np.arange(len(order)) - first, np.zeros(len(whole), "int64"))).astype("int32"),
                "start": np.concatenate((before - before[first] if len(order) else before, np.zeros(len(whole), "int64"))).astype("int32"),
            }
        )

    return dealt.groupBy("grp").applyInPandas(run, _PACKED)


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_sequences, n_tokens, and the share of the capacity that stays unused."""
    total = packed.agg(F.countDistinct("sequence_id").alias("n_sequences"), F.sum("n_tokens").alias("n_tokens"))
    return total.withColumn("unused", 1 - F.col("n_tokens") / (F.col("n_sequences") * capacity))
