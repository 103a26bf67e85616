"""Search of a block of stated names in a stream of names, by token subset or sequence ratio.

Names are compared as their sorted distinct tokens. A pair whose smaller token set has at least two tokens and lies
within the other scores 1, any other the ratio of ``difflib.SequenceMatcher``. Subsets are found through an index of the stated tokens.
For the ratio, bounds that never lie below it come first: letters in common for all pairs at once, as one matrix
product, then the longest common subsequence in 64-bit words. Only what passes both is aligned.

With ``best`` only that many ids of each stated text are kept, and a pair must reach the last of them.

Where all names are stated, :func:`nearest` compares a tile of them: letters in common are counted in one word a text, and
of what a text leaves the pairs with the highest bounds are aligned first, until no other can be better.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Letters are counted in so many groups, up to so often; names and stated texts compared at once.
GROUPS, LEVELS = 32, 4
NAMES, TEXTS, PAIRS = 2048, 1024, 1 << 16
#: Stated texts and texts of a tile whose words are compared at once.
ROWS, COLUMNS = 128, 4096
#: Texts that fit in a word; longer ones are aligned if their letters allow it.
WORD = 64
_NEVER = 2.0
_GROUP = np.array([c - 97 if 97 <= c < 123 else 26 + c % (GROUPS - 26) for c in range(128)], "uint8")


def tokens(name: str | None) -> frozenset[str]:
    return frozenset(re.sub("[.,]", " ", (name or "").lower()).split())


class Letters:
    """Letter groups of texts: their counts, and their sequences where they fit in a word."""

    def __init__(self, texts: list[str], pad: int):
        self.sizes = np.array([len(t) for t in texts], "int64")
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "uint32")
        groups = np.where(points < 128, _GROUP[np.minimum(points, 127)], 26 + points % (GROUPS - 26))
        row = np.repeat(np.arange(len(texts)), self.sizes)
        self.counts = np.bincount(row * GROUPS + groups, minlength=len(texts) * GROUPS).reshape(-1, GROUPS)
        at = np.arange(len(points)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.sequence = np.full((len(texts), WORD), pad, "uint8")
        self.sequence[row[at < WORD], at[at < WORD]] = groups[at < WORD]

    def places(self) -> np.ndarray:
        """Per text and letter group a word with the places where it stands; the last group has none."""
        out = np.zeros((len(self.sizes), GROUPS + 2), "uint64")
        rows = np.arange(len(self.sizes))
        for k in range(min(WORD, int(self.sizes.max(initial=0)))):
            out[rows, self.sequence[:, k]] |= np.uint64(1 << k)
        return out


def common(asked: Letters | Asked, u: np.ndarray, j: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """No less than the ratio: that of the longest common subsequence of letter groups; 1 for texts longer than a word."""
    state = np.full(len(u), ~np.uint64(0))
    for k in range(min(WORD, int(asked.sizes[u].max(initial=0)))):
        m = state & places[j, asked.sequence[u, k]]
        state = (state + m) | (state - m)
    return np.where((sizes[j] <= WORD) & (asked.sizes[u] <= WORD), 2 * np.bitwise_count(~state) / (asked.sizes[u] + sizes[j]), 1.0)


class Asked:
    """Stated names, equal ones together."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float, best: int | None):
        found: dict[str, list[int]] = {}
        for i, name in rows:
            if t := tokens(name):
                found.setdefault(" ".join(sorted(t)), []).append(i)
        self.texts = sorted(found, key=lambda t: (len(t), t))
        self.ids = [found[t] for t in self.texts]
        self.number = {t: u for u, t in enumerate(self.texts)}
        self.tokens = [frozenset(t.split(" ")) for t in self.texts]
        self.having: dict[str, set[int]] = {}
        for u, t in enumerate(self.tokens):
            for token in t:
                self.having.setdefault(token, set()).add(u)
        self.rarest: dict[str, list[int]] = {}
        for u, t in enumerate(self.tokens):
            if len(t) > 1:
                self.rarest.setdefault(min(t, key=lambda x: (len(self.having[x]), x)), []).append(u)
        self.similarity, self.best = similarity, best
        self.least = np.full(len(self.texts), similarity)
        self.kept: list[list[tuple[float, int]]] = [[] for _ in self.texts]  # (-score, id)
        letters = Letters(self.texts, GROUPS + 1)
        self.sizes, self.sequence = letters.sizes, letters.sequence
        levels = letters.counts[:, :, None] >= np.arange(1, LEVELS + 1)
        self.feature = np.argwhere(levels.any(axis=0))
        self.over = np.maximum(letters.counts - LEVELS, 0).sum(axis=1)
        self.matrix = 2 * levels[:, self.feature[:, 0], self.feature[:, 1]].astype("float32")

    def within(self, t: frozenset[str], text: str) -> set[int]:
        """Stated texts that score 1 with these tokens."""
        out = {u for token in t if token in self.rarest for u in self.rarest[token] if self.tokens[u] <= t}
        if len(t) > 1:
            having = sorted((self.having.get(token, ()) for token in t), key=len)
            if having[0]:
                out |= having[0].intersection(*having[1:])
        if text in self.number:
            out.add(self.number[text])
        return out

    def keep(self, u: int, score: float, ids: list[int]) -> None:
        """Take in ids (ascending) with their score; the best of an id counts."""
        kept = self.kept[u]
        if len(kept) == self.best and (-score, ids[0]) >= kept[-1]:
            return
        first: dict[int, float] = {}
        for s, i in sorted([*kept, *((-score, i) for i in ids)]):
            first.setdefault(i, s)
        kept[:] = [(s, i) for i, s in first.items()][: self.best]
        if len(kept) == self.best:
            last = -kept[-1][0]
            # equal texts and subsets are found without the ratio, which is below 1 for others
            self.least[u] = _NEVER if last >= 1 else max(self.similarity, last)

    def close(self, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        """(stated text, text, ratio) of pairs that reach the least score, which may rise meanwhile."""
        letters = Letters(texts, GROUPS)
        places = letters.places()
        bits = (letters.counts[:, self.feature[:, 0]] > self.feature[:, 1]).astype("float32")
        names = np.concatenate((bits, -letters.sizes[:, None], -np.ones((len(texts), 1))), axis=1, dtype="float32").T
        open_ = np.flatnonzero(self.least <= 1)
        for at in range(0, len(open_), TEXTS):
            part = open_[at : at + TEXTS]
            least = self.least[part]
            asked = np.concatenate((self.matrix[part], least[:, None], (least * self.sizes[part] - 2 * self.over[part])[:, None]), axis=1, dtype="float32")
            hits = np.flatnonzero(asked @ names >= -0.01)
            for k in range(0, len(hits), PAIRS):
                u, j = np.divmod(hits[k : k + PAIRS], len(texts))
                u = part[u]
                yield from self._aligned(u, j, common(self, u, j, places, letters.sizes), texts)

    def _aligned(self, u: np.ndarray, j: np.ndarray, bound: np.ndarray, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        some = np.flatnonzero(bound >= self.least[u] - 1e-9)
        some = some[np.argsort(-bound[some], kind="stable")]
        for a, b, most in zip(u[some].tolist(), j[some].tolist(), bound[some].tolist()):
            if most >= self.least[a] - 1e-9 and (score := difflib.SequenceMatcher(None, self.texts[a], texts[b]).ratio()) >= self.least[a]:
                yield a, b, score


def search(batches: Iterator[pd.DataFrame], rows: list[tuple[int, str]], similarity: float, best: int | None) -> Iterator[pd.DataFrame]:
    """query_id, id, score for ``rows`` (query_id, name) and batches of id, name."""
    asked = Asked(rows, similarity, best)
    columns = ["query_id", "id", "score"]
    for pdf in batches:
        ids: dict[str, list[int]] = {}
        for i, name in zip(pdf["id"].tolist(), pdf["name"].tolist()):
            if t := tokens(name):
                ids.setdefault(" ".join(sorted(t)), []).append(i)
        out: list[tuple[int, int, float]] = []
        texts = list(ids)

        def take(u: int, text: str, score: float) -> None:
            if best is None:
                out.extend((q, i, score) for q in asked.ids[u] for i in ids[text])  # noqa: B023 - used within the turn
            else:
                asked.keep(u, score, ids[text])  # noqa: B023

        for found in ids.values():
            found.sort()
        full: set[tuple[int, str]] = set()
        for text in texts:
            for u in asked.within(frozenset(text.split(" ")), text):
                full.add((u, text))
                take(u, text, 1.0)
        for at in range(0, len(texts), NAMES):
            part = texts[at : at + NAMES]
            for u, j, score in asked.close(part):
                if (u, part[j]) not in full:
                    take(u, part[j], score)
        if best is None:
            yield pd.DataFrame(out, columns=columns)
    if best is not None:
        yield pd.DataFrame([(q, i, -s) for u, kept in enumerate(asked.kept) for s, i in kept for q in asked.ids[u]], columns=columns)


def as_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id, text of batches of id, name: the sorted distinct tokens; names without any are left out."""
    for pdf in batches:
        out = pd.DataFrame({"id": pdf["id"], "text": [" ".join(sorted(tokens(name))) for name in pdf["name"]]})
        yield out[out["text"] != ""]


def words(asked: Letters, letters: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of both sides, a bit for each of the 64 counts of letters that most texts reach, and how many letters of an asked text have none."""
    often = (letters.counts[:, :, None] >= np.arange(1, LEVELS + 1)).sum(axis=0).ravel()
    out = [np.zeros(len(side.sizes), "uint64") for side in (asked, letters)]
    for bit, feature in enumerate(np.argsort(-often, kind="stable")[:64]):
        group, level = divmod(int(feature), LEVELS)
        for word, side in zip(out, (asked, letters)):
            word |= (side.counts[:, group] > level).astype("uint64") << np.uint64(bit)
    return *out, asked.sizes - np.bitwise_count(out[0])


def nearest(asked: list[str], own: np.ndarray, texts: list[str], ids: np.ndarray, similarity: float) -> Iterator[tuple[str, int, float]]:
    """(asked text, id, ratio): the best of ``texts`` with another id than ``own``, the smallest id of equals.

    ``ids``: the two smallest of each text, equal where it has one.
    """
    by_size = lambda side: np.argsort([len(t) for t in side], kind="stable")
    rows, columns = by_size(asked), by_size(texts)
    asked, own, texts, ids = [asked[k] for k in rows], own[rows], [texts[k] for k in columns], ids[columns]
    a, b = Letters(asked, GROUPS + 1), Letters(texts, GROUPS)
    mine, theirs, over = words(a, b)
    places = b.places()
    edges = np.unique(np.concatenate((np.flatnonzero(np.diff(b.sizes, prepend=-1)), np.arange(0, len(texts), COLUMNS), [len(texts)])))
    buffers = np.empty(ROWS * COLUMNS, "uint64"), np.empty(ROWS * COLUMNS, "uint8"), np.empty(ROWS * COLUMNS + 8, "bool")
    for at in range(0, len(asked), ROWS):
        part = slice(at, at + ROWS)
        sizes, found = a.sizes[part], []
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
            size = int(b.sizes[start])
            like = min(max(size, int(sizes[0])), int(sizes[-1]))  # the asked size that comes nearest
            if 2 * min(size, like) < similarity * (size + like) - 1e-6:
                continue
            shape = len(sizes), stop - start
            both, count, hit = (buffer[: shape[0] * shape[1]].reshape(shape) for buffer in buffers)
            need = np.clip(np.ceil(similarity * (sizes + size) / 2 - over[part] - 1e-6), 0, 65).astype("uint8")
            np.bitwise_and(mine[part, None], theirs[None, start:stop], out=both)
            np.bitwise_count(both, out=count)
            np.greater_equal(count, need[:, None], out=hit)
            u, j = np.divmod(_set(buffers[2], hit.size), shape[1])
            if len(u):
                found.append((u + at, j + start))
        if found:
            yield from _first(*(np.concatenate(x) for x in zip(*found)), a, b, places, asked, own, texts, ids, similarity)


def _set(bits: np.ndarray, size: int) -> np.ndarray:
    """Where the first ``size`` are set: few are, so eight are looked at together."""
    whole = -(-size // 8) * 8
    bits[size:whole] = False
    at = (8 * np.flatnonzero(bits[:whole].view("uint64"))[:, None] + np.arange(8)).ravel()
    return at[bits[at]]


def _first(u: np.ndarray, j: np.ndarray, a: Letters, b: Letters, places: np.ndarray, asked: list[str], own: np.ndarray, texts: list[str], ids: np.ndarray, similarity: float) -> Iterator[tuple[str, int, float]]:
    """Of pairs the best of each asked text."""
    bound = np.concatenate([common(a, u[k : k + PAIRS], j[k : k + PAIRS], places, b.sizes) for k in range(0, len(u), PAIRS)])
    other = np.where(ids[j, 0] != own[u], ids[j, 0], ids[j, 1])
    some = np.flatnonzero((bound >= similarity - 1e-9) & (other != own[u]))
    some = some[np.lexsort((other[some], -bound[some], u[some]))]
    best: dict[int, tuple[float, int]] = {}
    for x, y, most, i in zip(u[some].tolist(), j[some].tolist(), bound[some].tolist(), other[some].tolist()):
        if x not in best or (-most, i) < best[x]:
            score = difflib.SequenceMatcher(None, asked[x], texts[y]).ratio()
            if score >= similarity:
                best[x] = min(best.get(x, (0.0, 0)), (-score, i))
    for x, (score, i) in best.items():
        yield asked[x], i, -score


def tile(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """text, id, score of a tile's asked texts; rows of asked, text, first, second (ids)."""
    asked, names = pdf[pdf["asked"]], pdf[~pdf["asked"]]
    found = nearest(asked["text"].tolist(), asked["first"].to_numpy("int64"), names["text"].tolist(), names[["first", "second"]].to_numpy("int64"), similarity) if len(asked) and len(names) else ()
    return pd.DataFrame(list(found), columns=["text", "id", "score"])
