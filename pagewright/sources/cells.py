"""How a spreadsheet shows its numbers: days, times and decimals, by the format of a cell."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta
from math import floor, isfinite
from xml.etree import ElementTree

#: The numbers of built-in formats of days, times, both, and decimals (places, in groups of three).
DAY_FORMATS, TIME_FORMATS, BOTH_FORMATS = (14, 15, 16, 17), (18, 19, 20, 21, 45, 46, 47), (22,)
DECIMAL_FORMATS = {1: (0, False), 2: (2, False), 3: (0, True), 37: (0, True), 38: (0, True), 4: (2, True), 39: (2, True), 40: (2, True), 43: (2, True), 44: (2, True)}


@dataclass(frozen=True)
class Shown:
    """Either a day, a time or both, or a decimal."""

    day: bool = False
    time: bool = False
    places: int = 0
    grouped: bool = False


def of_code(code: str) -> Shown | None:
    """By the code without what is quoted, escaped or in brackets; an m stands for a day, minutes or not. Shares,
    fractions and powers are none."""
    bare = re.sub(r'\\.|"[^"]*"?|\[[^\]]*\]?', "", code).lower()
    day, time = any(x in bare for x in "ymd"), "h" in bare
    if day or time:
        return Shown(day, time)
    if not re.search(r"[0#]", bare) or re.search(r"%|e\+|/|\?", bare):
        return None
    first = bare.split(";")[0]
    places = re.search(r"\.([0#]*)", first)
    return Shown(places=len(places[1]) if places else 0, grouped="," in first)


def of_number(number: int, codes: dict[int, str]) -> Shown | None:
    if codes.get(number):
        return of_code(codes[number])
    if number in DECIMAL_FORMATS:
        places, grouped = DECIMAL_FORMATS[number]
        return Shown(places=places, grouped=grouped)
    day, time = number in DAY_FORMATS + BOTH_FORMATS, number in TIME_FORMATS + BOTH_FORMATS
    return Shown(day, time) if day or time else None


def moment(serial: float, shown: Shown, since_1904: bool) -> str | None:
    """Day/month/year, hours:minutes or both. Days are counted from 1900 with a 29 February it never had, or from 1904."""
    if not isfinite(serial) or serial < 0:
        return None
    whole, out = floor(serial), []
    if shown.day:
        start = date(1904, 1, 1) if since_1904 else date(1899, 12, 31 if whole < 60 else 30)
        try:
            out.append((start + timedelta(whole)).strftime("%d/%m/") + f"{(start + timedelta(whole)).year:04d}")
        except OverflowError:
            return None
    if shown.time:
        minutes = floor((serial - whole) * 1440 + 0.5)
        out.append(f"{minutes // 60 % 24:02d}:{minutes % 60:02d}")
    return " ".join(out)


def decimal(value: float, shown: Shown) -> str | None:
    """With a comma before the places and blanks between groups."""
    if not isfinite(value):
        return None
    whole, _, rest = f"{abs(value):{',' if shown.grouped else ''}.{min(9, shown.places)}f}".partition(".")
    return ("-" if value < 0 else "") + whole.replace(",", " ") + (f",{rest}" if rest else "")


@dataclass(frozen=True)
class Formats:
    """The formats of a workbook's styles, in their order."""

    styles: tuple[Shown | None, ...] = ()
    since_1904: bool = False

    @classmethod
    def of(cls, styles: bytes | None, workbook: bytes | None) -> Formats:
        if styles is None:
            return cls()
        root = ElementTree.fromstring(styles)
        codes = {int(x.get("numFmtId", -1)): x.get("formatCode", "") for x in root.iter() if x.tag.endswith("}numFmt")}
        cells = next((x for x in root.iter() if x.tag.endswith("}cellXfs")), ())
        kinds = tuple(of_number(int(x.get("numFmtId", -1)), codes) for x in cells if x.tag.endswith("}xf"))
        about = () if workbook is None else ElementTree.fromstring(workbook).iter()
        since = next((x.get("date1904", "") for x in about if x.tag.endswith("}workbookPr")), "")
        return cls(kinds, since.lower() in ("1", "true"))

    def text(self, raw: str, style: str | None) -> str:
        """What the cell shows, then what it holds; what it holds alone where the format says nothing more."""
        k = int(style) if style and style.isdigit() else -1
        shown = self.styles[k] if 0 <= k < len(self.styles) else None
        try:
            value = float(raw)
        except ValueError:
            return raw
        if shown is None:
            return raw
        seen = moment(value, shown, self.since_1904) if shown.day or shown.time else decimal(value, shown)
        return raw if seen is None else f"{seen} {raw}"
