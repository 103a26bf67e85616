"""Mixed timestamp formats and zones to one unambiguous form.

Each text is reduced to a shape mask (every digit ``9``, every run of letters ``A``) and its words. A distinct mask is
mapped to a parser once per process, which says where in the mask each field stands. All texts of a mask have their
digits at the same places and are converted together: fields are columns of one array of characters, calendar checks
and day numbers array arithmetic, zones come from the transition tables of :mod:`quernstone.functions.zones`.

Results for odd input: null, blank, null words, impossible dates (30 February), partial dates (year and month),
unknown month or zone names and masks without a parser give null. An all-numeric date with the year last needs a
``date_order`` (``MDY`` or ``DMY``); without one it is read only if one of its parts exceeds 12. Texts of any length
are read; no form has a mask of more than ``LONGEST_MASK`` characters, however long its words are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.zones import ABBREVIATIONS, ZoneTable, all_zones

LONGEST_MASK = 120

#: Month names of English, Spanish and German; three letters are enough where they are unambiguous.
MONTHS = {
    name: number
    for number, names in {
        1: "january enero januar jänner jan ene",
        2: "february febrero februar feb",
        3: "march marzo märz mar mär maerz",
        4: "april abril apr abr",
        5: "may mayo mai",
        6: "june junio juni jun",
        7: "july julio juli jul",
        8: "august agosto aug ago",
        9: "september septiembre setiembre sept sep",
        10: "october octubre oktober oct okt",
        11: "november noviembre nov",
        12: "december diciembre dezember dec dic dez",
    }.items()
    for name in names.split()
}

#: What fields look like in a mask, where a digit is a 9 and a word an A.
_WORD = "A"
_TIME = rf"(?P<H>9{{1,2}}):?(?P<M>9{{2}})(?::?(?P<S>9{{2}})(?:[.,](?P<f>9{{1,9}}))?)?(?:\s?(?P<x>{_WORD}))?"
_ZONE = rf"(?:\s?(?P<sign>[+-])(?P<oh>9{{2}}):?(?P<om>9{{2}})|\s(?P<region>{_WORD}(?:[/_-]{_WORD}){{1,8}}))?"
_TAIL = rf"(?:(?:(?P<t>A)| |,\s){_TIME}{_ZONE})?"
_DATES = {
    "ymd": r"(?P<Y>9{4})(?P<sep>[-/.])(?P<m>9{1,2})(?P=sep)(?P<d>9{1,2})" + _TAIL,
    "numeric": r"(?P<p>9{1,2})(?P<sep>[-/.])(?P<q>9{1,2})(?P=sep)(?P<Y>9{4}|9{2})" + _TAIL,
    "month_first": rf"(?:(?P<wd>{_WORD})[.,]?\s)?(?P<mon>{_WORD})\.?\s(?P<d>9{{1,2}})(?:{_WORD})?,?\s(?P<Y>9{{4}})" + _TAIL,
    "day_first": rf"(?:(?P<wd>{_WORD})[.,]?\s)?(?P<d>9{{1,2}})\.?[-\s]?(?P<mon>{_WORD})\.?[-,\s]{{0,4}}(?P<Y>9{{4}}|9{{2}})" + _TAIL,
    "day_de_month": rf"(?P<d>9{{1,2}})\s(?P<w1>{_WORD})\s(?P<mon>{_WORD})\s(?P<w2>{_WORD})\s(?P<Y>9{{4}})" + _TAIL,
    "compact": rf"(?P<Y>9{{4}})(?P<m>9{{2}})(?P<d>9{{2}})(?:(?P<t>A)?{_TIME}{_ZONE})?",
    "ordinal": r"(?P<Y>9{4})-(?P<doy>9{3})",
    "serial": r"(?P<serial>9{5})",
    "epoch": r"(?P<epoch>9{10}|9{13})",
}
#: Order matters where a mask fits two rules: eight digits are a date, ten or thirteen an epoch.
_ORDER = ("ymd", "numeric", "ordinal", "serial", "epoch", "compact", "month_first", "day_first", "day_de_month")
_COMPILED = {k: re.compile(v) for k, v in _DATES.items()}
_DIGITS = {ord(c): "9" for c in "0123456789"}
_LETTERS = re.compile(r"([^\W\d_]+)")


def taken_apart(text: str) -> tuple[str, list[str]]:
    """The text with A for each word, and the words."""
    parts = _LETTERS.split(text)
    return "A".join(parts[::2]), parts[1::2]


def shape_mask(text: str) -> str:
    return taken_apart(text)[0].translate(_DIGITS)


@lru_cache(maxsize=4096)
def _parser(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    for kind in _ORDER:
        found = _COMPILED[kind].fullmatch(mask)
        if found is not None:
            return kind, {name: found.span(name) for name, value in found.groupdict().items() if value is not None}
    return None


def parser_of(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """The rule that the mask fits, and where its fields stand."""
    return _parser(mask) if len(mask) <= LONGEST_MASK else None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 of the proleptic Gregorian calendar, and which triples are real dates."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    lengths = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    inside = (m >= 1) & (m <= 12)
    longest = lengths[np.where(inside, m, 0)] + (leap & (m == 2))
    ok = inside & (d >= 1) & (d <= longest) & (y >= 1)
    shifted = np.where(m <= 2, y - 1, y)
    era, month = shifted // 400, (m + 9) % 12
    of_era = shifted - era * 400
    day = (153 * month + 2) // 5 + d - 1
    return era * 146097 + of_era * 365 + of_era // 4 - of_era // 100 + day - 719468, ok


class Fields:
    """The fields of all texts of one mask: digits by column, words by their place among the words."""

    def __init__(self, mask: str, at: dict[str, tuple[int, int]], apart: list[tuple[str, list[str]]]):
        self.mask, self.at, self.apart, self.n = mask, at, apart, len(apart)
        self.codes = np.array([shape for shape, _ in apart]).view("uint32").reshape(self.n, len(mask))

    def width(self, name: str) -> int:
        a, b = self.at.get(name, (0, 0))
        return b - a

    def number(self, name: str, default: int = 0) -> np.ndarray:
        if name not in self.at:
            return np.full(self.n, default, "int64")
        a, b = self.at[name]
        return (self.codes[:, a:b].astype("int64") - 48) @ 10 ** np.arange(b - a - 1, -1, -1)

    def literal(self, name: str) -> str:
        a, b = self.at.get(name, (0, 0))
        return self.mask[a:b]

    def words(self, name: str, form: Callable[[str], str]) -> np.ndarray:
        if name not in self.at:
            return np.full(self.n, "", object)
        k = self.mask[: self.at[name][0]].count("A")
        return np.array([form(words[k]) for _, words in self.apart], object)

    def mapped(self, name: str, value: Callable[[str], int], default: int = 0) -> np.ndarray:
        """A number for each text's word; each distinct word is looked at once."""
        if name not in self.at:
            return np.full(self.n, default, "int64")
        words = self.words(name, str)
        known = {w: int(value(w)) for w in set(words.tolist())}
        return np.fromiter((known[w] for w in words), "int64", self.n)

    def region(self) -> np.ndarray | None:
        """Zone names as written, in lower case."""
        if "region" not in self.at:
            return None
        a, b = self.at["region"]
        k, marks = self.mask[:a].count("A"), self.mask[a:b].split("A")[1:]
        return np.array(["".join(w + m for w, m in zip(words[k:], marks)).lower() for _, words in self.apart], object)


class Converter:
    """Converts arrays of texts; ``instant`` asks for UTC microseconds, else for the calendar date as written."""

    def __init__(self, zones: dict[str, ZoneTable]):
        self.zones = zones

    def convert(self, texts: list[str], orders: list[str | None], zones: list[str | None], old: np.ndarray, instant: bool) -> tuple[np.ndarray, np.ndarray]:
        """Microseconds since the epoch (UTC, or midnight of the date) and validity. ``old``: two-digit years lie before 2000."""
        n = len(texts)
        micros, valid = np.zeros(n, "int64"), np.zeros(n, bool)
        by_mask: dict[str, list[int]] = {}
        apart = [taken_apart(text) for text in texts]
        for i, (shape, _) in enumerate(apart):
            if shape:
                by_mask.setdefault(shape.translate(_DIGITS), []).append(i)
        orders, zones = np.array(orders, object), np.array([z.lower() if isinstance(z, str) else "" for z in zones], object)
        for mask, rows in by_mask.items():
            parser = parser_of(mask)
            if parser is not None:
                at = np.array(rows)
                fields = Fields(mask, parser[1], [apart[i] for i in rows])
                micros[at], valid[at] = self._group(parser[0], fields, orders[at], zones[at], old[at], instant)
        return micros, valid

    def _group(self, kind: str, fields: Fields, orders: np.ndarray, zones: np.ndarray, old: np.ndarray, instant: bool) -> tuple[np.ndarray, np.ndarray]:
        ok = np.ones(fields.n, bool)
        if kind == "epoch":
            value = fields.number("epoch")
            micros = value * (1000 if fields.width("epoch") == 13 else 1_000_000)
            return micros, ok & instant
        if kind == "serial":
            return (fields.number("serial") - 25569) * 86_400_000_000, (fields.number("serial") > 0) & (not instant)
        year = fields.number("Y")
        if fields.width("Y") == 2:
            year = year + np.where(old, 1900, 2000)
        if kind == "ordinal":
            day, _ = _days(year, np.ones_like(year), np.ones_like(year))
            doy, leap = fields.number("doy"), (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
            return (day + doy - 1) * 86_400_000_000, (doy >= 1) & (doy <= 365 + leap) & (not instant)
        if kind == "numeric":
            p, q = fields.number("p"), fields.number("q")
            stated = (orders == "DMY") | (orders == "MDY")
            day_first = np.where(stated, orders == "DMY", p > 12)
            month, day = np.where(day_first, q, p), np.where(day_first, p, q)
            ok &= stated | (p > 12) | (q > 12)
        else:
            day = fields.number("d")
            month = fields.number("m") if kind in ("ymd", "compact") else fields.mapped("mon", lambda w: MONTHS.get(w.lower(), 0))
            if kind == "day_de_month":
                ok &= (fields.mapped("w1", lambda w: w.lower() == "de") & fields.mapped("w2", lambda w: w.lower() == "de")).astype(bool)
        ok &= fields.mapped("t", lambda w: w in ("T", "t"), 1).astype(bool)
        days, real = _days(year, month, day)
        ok &= real
        if not instant:
            return days * 86_400_000_000, ok
        hour, minute, second = fields.number("H", -1), fields.number("M"), fields.number("S")
        half = fields.mapped("x", lambda w: {"AM": 1, "PM": 2}.get(w.upper(), 0))
        ok &= (hour >= 0) & (minute < 60) & (second < 60) & np.where(half > 0, (hour >= 1) & (hour <= 12), hour < 24)
        hour = np.where(half > 0, hour % 12 + 12 * (half == 2), hour)
        wall = days * 86400 + hour * 3600 + minute * 60 + second
        fraction = fields.number("f") * 1_000_000 // 10 ** fields.width("f")
        sign = fields.literal("sign")
        if sign:
            # an offset with a word that isn't UTC or GMT (or AM, PM) contradicts itself
            ok &= fields.mapped("x", lambda w: w.upper() in ("UTC", "GMT", "AM", "PM"), 1).astype(bool)
            utc = wall - (-1 if sign == "-" else 1) * (fields.number("oh") * 3600 + fields.number("om") * 60)
            return utc * 1_000_000 + fraction, ok
        utc = wall.copy()
        names = fields.region()
        words = np.where(half > 0, "", fields.words("x", str.upper)) if names is None else np.full(fields.n, "", object)
        places = zones if names is None else names
        for word, zone in {*zip(words.tolist(), places.tolist())}:
            at = np.flatnonzero((words == word) & (places == zone))
            table = self.zones.get(zone)
            if word:
                seconds = table.abbreviations.get(word) if table else None
                if seconds is None and word in ABBREVIATIONS:
                    seconds = ABBREVIATIONS[word] * 60
                if seconds is None:
                    ok[at] = False
                else:
                    utc[at] = wall[at] - seconds
            elif table is None:
                ok[at] = False
            else:
                utc[at] = table.to_utc(wall[at])
        return utc * 1_000_000 + fraction, ok


_OUT = "src_table string, row_id long, field_name string, norm_value string"


def normalise(rows: DataFrame) -> DataFrame:
    """``rows``: src_table, row_id, field_name, value, date_order, time_zone, instant (boolean), old (boolean).

    One row per value that denotes a real date or time, with ``norm_value`` as ``YYYY-MM-DD`` or, for instants, as
    ``YYYY-MM-DDTHH:MM:SS.ffffffZ``. No shuffle; equal texts of a batch are converted once.
    """
    shipped = all_zones()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        converter = Converter(shipped[1])
        for pdf in batches:
            keys = ["value", "date_order", "time_zone", "instant", "old"]
            code, distinct = pd.factorize(pd.MultiIndex.from_frame(pdf[keys].astype(object).where(pdf[keys].notna(), None)), sort=False)
            parts = pd.DataFrame(list(distinct), columns=keys)
            norm = np.full(len(parts), None, object)
            for instant in (False, True):
                at = np.flatnonzero(parts["instant"].to_numpy(bool) == instant)
                if len(at):
                    own = parts.iloc[at]
                    micros, valid = converter.convert([str(v).strip() if v is not None else "" for v in own["value"]], list(own["date_order"]), list(own["time_zone"]), own["old"].to_numpy(bool), instant)
                    stamps = micros.astype("datetime64[us]")
                    text = np.datetime_as_string(stamps, unit="us" if instant else "D")
                    norm[at] = np.where(valid, np.char.add(text, "Z") if instant else text, None)
            out = pdf[["src_table", "row_id", "field_name"]].assign(norm_value=norm[code])
            yield out[out["norm_value"].notna()]

    return rows.select("src_table", "row_id", "field_name", "value", "date_order", "time_zone", "instant", "old").mapInPandas(run, _OUT)


def facility_of(source: Column) -> Column:
    """Code at the start of a file name (of the first one, where several are listed), upper case."""
    return F.upper(F.regexp_extract(source, r"^[^A-Za-z0-9]*([A-Za-z0-9]+)", 1))


def not_yet_normal(rows: DataFrame, facilities: DataFrame) -> DataFrame:
    """Normalised values of ``rows`` (src_table, row_id, field_name, value, source, instant, old) that are not in the target form yet.

    Values in the target form, and those without any digit, are left out before Python sees them.
    """
    target = F.when(F.col("instant"), F.col("value").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z$")).otherwise(F.col("value").rlike(r"^\d{4}-\d\d-\d\d$"))
    codes = facilities.select(F.upper("facility_code").alias("facility"), "date_order", "time_zone").dropDuplicates(["facility"])
    open_rows = rows.where(F.col("value").rlike(r"\d") & ~target).withColumn("facility", facility_of(F.col("source")))
    return normalise(open_rows.join(codes, "facility", "left"))
