"""Texts as arrays of token numbers: each distinct piece between white space is taken apart once per process."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

NEWLINE = 0
#: Pieces and tokens that are kept; beyond that the memory starts anew.
LIMIT = 400_000


class Lexer:
    """``split`` takes a piece of text apart into (kind, token) pairs; ``describe`` turns a pair into numbers.

    ``columns`` holds one array per described number, by token number. Token 0 is the line break.
    """

    def __init__(self, pattern: re.Pattern, describe: Callable[[str, str], tuple[int, ...]]):
        self.pattern, self.describe = pattern, describe
        self.reset()

    def reset(self) -> None:
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.numbers: dict[tuple[str, str], int] = {("line", "\n"): NEWLINE}
        self.rows: list[tuple[int, ...]] = [self.describe("line", "\n")]
        self._columns, self._filled = np.zeros((len(self.rows[0]), 0), "int64"), 0

    def full(self) -> bool:
        return len(self.pieces) > LIMIT

    def _take_apart(self, piece: str) -> tuple[int, ...]:
        found = []
        for m in self.pattern.finditer(piece):
            pair = (m.lastgroup, m.group())
            number = self.numbers.get(pair)
            if number is None:
                number = self.numbers[pair] = len(self.rows)
                self.rows.append(self.describe(*pair))
            found.append(number)
        self.pieces[piece] = result = tuple(found)
        return result

    def encode(self, text: str) -> np.ndarray:
        known, out = self.pieces.get, []
        for line in text.split("\n"):
            for piece in line.split():
                found = known(piece)
                out += found if found is not None else self._take_apart(piece)
            out.append(NEWLINE)
        out.pop()
        return np.array(out, "int64")

    def columns(self) -> np.ndarray:
        """numbers x tokens; grown by doubling, so that a new token costs little."""
        n = len(self.rows)
        if self._filled < n:
            fresh = np.array(self.rows[self._filled :], "int64").T
            if self._columns.shape[1] < n:
                grown = np.zeros((fresh.shape[0], max(2 * n, 1024)), "int64")
                grown[:, : self._filled] = self._columns[:, : self._filled]
                self._columns = grown
            self._columns[:, self._filled : n] = fresh
            self._filled = n
        return self._columns
