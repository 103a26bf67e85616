"""Oversized texts into pieces under a limit, cut at natural boundaries, with an overlap.

Every position of a text has a boundary strength (paragraph, line, sentence, clause, word, none, forbidden). A sparse
table over (strength, position) answers in constant time which cut of a permissible window is the strongest, ties to
the right. The next piece begins ``overlap`` characters before the last one's end, at the nearest word start.

A text of at most ``size`` characters after trimming is one piece, made in the JVM; only longer ones reach Python.
Null gives no piece, blank text none. Positions count code points. A cut never falls inside a CR LF pair or between a
character and a combining mark, joiner or variation selector, unless a whole window holds nothing else; then the cut
is at the window's end. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 1000, 200
#: The shortest piece is this share of the limit where a cut of any strength exists in the rest.
LEAST_SHARE = 0.5
#: The start of the next piece may move by this share of the overlap to reach a word start.
SLACK_SHARE = 0.25
BLANKS = " \t\n\r"

FORBIDDEN, NONE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
_RULES = (
    (WORD, re.compile(r"\s(?=\S)")),
    (CLAUSE, re.compile(r"[,;:)\]|]\s+(?=\S)")),
    (SENTENCE, re.compile(r"[.!?…。！？][\"'”’)\]]*\s+(?=\S)")),
    (LINE, re.compile(r"\r?\n\s*(?=\S)")),
    (PARAGRAPH, re.compile(r"\n[ \t\r]*\n\s*(?=\S)")),
)
_JOINERS = "‍︎️"
#: Full stops after these are no sentence ends. Fixed values.
_ABBREVIATED = re.compile(r"\b(?:Dr|Mr|Mrs|Ms|Prof|St|No|vs|approx|e\.g|i\.e|[A-Z])\.\s+$")


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each position 0..len(text)."""
    out = np.full(len(text) + 1, NONE, "int8")
    for strength, pattern in _RULES:
        for m in pattern.finditer(text):
            if strength == SENTENCE and _ABBREVIATED.search(text, max(0, m.start() - 8), m.end()):
                continue
            out[m.end()] = strength
    if not text.isascii():
        for i, c in enumerate(text):
            if c > "˿" and (unicodedata.combining(c) or c in _JOINERS):
                out[i] = FORBIDDEN
                if c == "‍":
                    out[i + 1] = FORBIDDEN
    for m in re.finditer("\r\n", text):
        out[m.start() + 1] = FORBIDDEN
    return out


class RangeMax:
    """Sparse table over (strength, position): the strongest and of equals the rightmost position of a range."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        level = values.astype("int64") * (self.n + 1) + np.arange(self.n)
        self.levels = [level]
        width = 1
        while 2 * width <= self.n:
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def best(self, low: int, high: int) -> int:
        """Position in low..high (inclusive)."""
        k = (high - low + 1).bit_length() - 1
        row = self.levels[k]
        return int(max(row[low], row[high - (1 << k) + 1])) % (self.n + 1)


def pieces(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each piece of the trimmed text, as positions in the text given."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller than size")
    if not text or not (inner := text.strip(BLANKS)):
        return []
    shift = text.index(inner[0]) if text[0] != inner[0] else 0
    if len(inner) <= size:
        return [(shift, shift + len(inner))]
    power = strengths(inner)
    index = RangeMax(power)
    out, start, n = [], 0, len(inner)
    slack = int(overlap * SLACK_SHARE)
    while n - start > size:
        least = start + max(1, int(size * LEAST_SHARE), overlap + slack + 1 if size > overlap + slack + 1 else 1)
        cut = index.best(min(least, start + size), start + size)
        out.append((start, cut))
        target = max(cut - overlap, start + 1)
        start = _start(power, target, max(start + 1, target - slack), min(cut, target + slack)) if overlap else cut
    out.append((start, n))
    return [(a + shift, b + shift) for a, b in out]


def _start(power: np.ndarray, target: int, low: int, high: int) -> int:
    """The word start nearest to target within low..high; of two at one distance the earlier; else the target."""
    near = np.flatnonzero(power[low : high + 1] >= WORD) + low
    if len(near):
        return int(near[np.argmin(np.abs(near - target))])
    while target > low and power[target] == FORBIDDEN:
        target -= 1
    return target


_PIECE = "array<struct<start:int,end:int,text:string>>"


def split_column(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of pieces (start, end, text) of a text column."""

    @F.pandas_udf(_PIECE)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "text": t[a:b]} for a, b in pieces(t, size, overlap)] if t is not None else [])

    # else a filter on the pieces would run the function once more
    cut = cut.asNondeterministic()
    trimmed = F.btrim(text, F.lit(BLANKS))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(trimmed).alias("end"), trimmed.alias("text"))).cast(_PIECE)
    # only long texts reach Python: the others are null there
    long_only = F.when(F.length(trimmed) > size, trimmed)
    return F.when(trimmed.isNull() | (trimmed == ""), F.array().cast(_PIECE)).when(F.length(trimmed) <= size, whole).otherwise(cut(long_only))


def split_records(records: DataFrame, id_column: str = "id", text_column: str = "raw_text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """record_id, chunk_index (string, from 0 per record), n_chunks, start, end, text. No shuffle."""
    split = records.select(F.col(id_column).alias("record_id"), split_column(F.col(text_column), size, overlap).alias("pieces"))
    placed = split.select("record_id", F.size("pieces").alias("n_chunks"), F.posexplode("pieces").alias("i", "piece"))
    return placed.select("record_id", F.col("i").cast("string").alias("chunk_index"), "n_chunks", "piece.start", "piece.end", "piece.text")
