"""Versioned zone transition tables: wall-clock time to UTC by one binary search over arrays.

The tables are read once on the driver, from the compiled zone files of the installed tz database, and shipped with
the task, so that every executor converts by the same version. Their size is bounded by the tz database (about 600
zones, a few hundred transitions each).
"""

from __future__ import annotations

import datetime as dt
import struct
import zoneinfo
from dataclasses import dataclass
from functools import lru_cache
from importlib import resources
from pathlib import Path

import numpy as np

#: Transitions by rule are written out to this year; zone files list most of them only to 2037.
LAST_YEAR = 2100

#: Offsets in minutes of abbreviations that a zone's own table does not settle.
ABBREVIATIONS = {
    "Z": 0,
    "UTC": 0,
    "GMT": 0,
    "WET": 0,
    "BST": 60,
    "CET": 60,
    "WEST": 60,
    "EET": 120,
    "CEST": 120,
    "EEST": 180,
    "IST": 330,
    "AWST": 480,
    "JST": 540,
    "ACST": 570,
    "AEST": 600,
    "ACDT": 630,
    "AEDT": 660,
    "NZST": 720,
    "NZDT": 780,
    "NDT": -150,
    "NST": -210,
    "ADT": -180,
    "AST": -240,
    "EDT": -240,
    "EST": -300,
    "CDT": -300,
    "CST": -360,
    "MDT": -360,
    "MST": -420,
    "PDT": -420,
    "PST": -480,
    "AKDT": -480,
    "AKST": -540,
    "HST": -600,
}


@dataclass(frozen=True)
class ZoneTable:
    """``offsets[i]`` (seconds) holds before ``walls[i]`` in wall-clock seconds, ``offsets[-1]`` after the last one."""

    walls: np.ndarray
    offsets: np.ndarray
    abbreviations: dict[str, int]

    def to_utc(self, wall_seconds: np.ndarray) -> np.ndarray:
        """A time that occurs twice is the first; one that was skipped takes the offset valid before the change."""
        return wall_seconds - self.offsets[np.searchsorted(self.walls, wall_seconds, side="right")]


def _file(key: str) -> bytes:
    for root in zoneinfo.TZPATH:
        path = Path(root, *key.split("/"))
        if path.is_file():
            return path.read_bytes()
    return resources.files("tzdata").joinpath("zoneinfo", *key.split("/")).read_bytes()


def _block(raw: bytes, at: int, wide: bool) -> tuple[list[int], list[tuple[int, str]], list[int], int]:
    n_gmt, n_std, n_leap, n_time, n_type, n_char = struct.unpack(">6l", raw[at + 20 : at + 44])
    at += 44
    size = 8 if wide else 4
    times = list(struct.unpack(f">{n_time}{'q' if wide else 'l'}", raw[at : at + n_time * size]))
    at += n_time * size
    index = list(raw[at : at + n_time])
    at += n_time
    types = [struct.unpack(">lbB", raw[at + 6 * i : at + 6 * i + 6]) for i in range(n_type)]
    at += 6 * n_type
    chars = raw[at : at + n_char]
    at += n_char + n_leap * (size + 4) + n_std + n_gmt
    named = [(off, chars[a : chars.index(b"\0", a)].decode()) for off, _, a in types]
    return times, named, index, at


#: Changes that a rule gives after a time; many zones share one.
_RULED: dict[tuple[bytes, int], list[tuple[int, int]]] = {}


def _changes(zone: zoneinfo.ZoneInfo, start: int) -> list[tuple[int, int]]:
    """(time, offset from then on) of all changes of a zone after ``start`` up to LAST_YEAR."""
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    offset = lambda s: int((epoch + dt.timedelta(seconds=s)).astimezone(zone).utcoffset().total_seconds())
    stop = int(dt.datetime(LAST_YEAR + 1, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    step, known, found = 14 * 86400, offset(start), []
    for s in range(start, stop, step):
        after = offset(s + step)
        if after != known:
            low, high = s, s + step
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == known else (low, mid)
            known = after
            found.append((high, known))
    return found


@lru_cache(maxsize=None)
def zone_table(key: str) -> ZoneTable:
    raw = _file(key)
    if raw[:4] != b"TZif":
        raise zoneinfo.ZoneInfoNotFoundError(key)
    times, named, index, at = _block(raw, 0, False)
    if raw[4:5] >= b"2":
        times, named, index, at = _block(raw, at, True)
    offsets = [named[index[0]][0] if index and not named else named[0][0], *(named[i][0] for i in index)]
    footer = raw[at:].strip(b"\n") if raw[4:5] >= b"2" else b""
    # years beyond the last transition follow the rule at the end of the file; without a comma it has no changes
    if b"," in footer:
        rule = (footer, times[-1] if times else 0)
        if rule not in _RULED:
            _RULED[rule] = _changes(zoneinfo.ZoneInfo(key), rule[1])
        times += [t for t, _ in _RULED[rule]]
        offsets += [o for _, o in _RULED[rule]]
    before, after, utc = np.array(offsets[:-1], "int64"), np.array(offsets[1:], "int64"), np.array(times, "int64")
    walls = np.maximum.accumulate(utc + np.maximum(before, after)) if len(utc) else utc
    return ZoneTable(walls, np.array(offsets, "int64"), {n: o for o, n in named if n.isalpha()})


def tz_version() -> str:
    for root in zoneinfo.TZPATH:
        path = Path(root, "tzdata.zi")
        if path.is_file():
            with path.open() as lines:
                return lines.readline().removeprefix("# version").strip()
    import tzdata

    return tzdata.IANA_VERSION


@lru_cache(maxsize=1)
def all_zones() -> tuple[str, dict[str, ZoneTable]]:
    """The version and the tables of all zones, for shipping to the executors."""
    return tz_version(), {k.lower(): zone_table(k) for k in zoneinfo.available_timezones()}
