"""Range processors: what `a..b` in a search box means."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from ..operators.ast import Query


@dataclass(frozen=True)
class Range:
    """Strings of a slot. A marker (prefix, or suffix) is needed at the beginning, with `repeated` allowed at both ends."""

    slot: int
    marker: str = ""
    suffix: bool = False
    repeated: bool = False
    grouping: str | None = None

    def strip(self, a: str, b: str) -> tuple[str, str] | None:
        m = self.marker
        if not m:
            return a, b
        if not self.suffix:
            if a.startswith(m):
                return a[len(m) :], b[len(m) :] if self.repeated and b.startswith(m) else b
            return ("", b[len(m) :]) if not a and b.startswith(m) else None
        if b.endswith(m):
            return a[: -len(m)] if self.repeated and a.endswith(m) else a, b[: -len(m)]
        return (a[: -len(m)], "") if not b and a.endswith(m) else None

    def __call__(self, a: str, b: str) -> Query | None:
        ends = self.strip(a, b)
        return None if ends is None else self.query(*ends)

    def query(self, a: str, b: str) -> Query | None:
        return Query.value_ge(self.slot, a) if not b else Query.value_le(self.slot, b) if not a else Query.value_range(self.slot, a, b)


@dataclass(frozen=True)
class DateRange(Range):
    """YYYYMMDD, YYYY-MM-DD, D/M/Y or M/D/Y; two-digit years count from the epoch year."""

    mdy: bool = False
    epoch: int = 1970

    def day(self, s: str) -> str | None:
        if not s:
            return ""
        if re.fullmatch(r"\d{8}", s):
            return s
        if m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", s):
            y, mo, d = map(int, m.groups())
        elif m := re.fullmatch(r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{2}|\d{4})", s):
            d, mo, y = map(int, m.groups())
            if self.mdy:
                d, mo = mo, d
            if y < 100:
                y += self.epoch // 100 * 100
                y += 100 * (y < self.epoch)
        else:
            return None
        try:
            return date(y, mo, d).strftime("%Y%m%d")
        except ValueError:
            return None

    def query(self, a: str, b: str) -> Query | None:
        x, y = self.day(a), self.day(b)
        return None if x is None or y is None or not (x or y) else super().query(x, y)


_NUMBER = r"[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?"


@dataclass(frozen=True)
class NumberRange(Range):
    """Numbers of a slot, compared as numbers."""

    unit = 1.0

    def number(self, s: str) -> float | None:
        return float(s) if re.fullmatch(_NUMBER, s) else None

    def query(self, a: str, b: str) -> Query | None:
        x, y = (self.number(s) if s else None for s in (a, b))
        if a and x is None or b and y is None or not (a or b):
            return None
        if x is not None and y is not None and x > y:
            return Query.nothing()
        return Query.number_range(self.slot, x, y)


@dataclass(frozen=True)
class UnitRange(NumberRange):
    """Sizes in bytes: 4K, 1.5M; the second end's unit holds for a first end without one."""

    def query(self, a: str, b: str) -> Query | None:
        power = {"": 0, "B": 0, "K": 10, "M": 20, "G": 30, "T": 40}

        def read(s: str, other: str = ""):
            m = re.fullmatch(rf"({_NUMBER})([BKMGT]?)", s)
            return m and float(m.group(1)) * 2.0 ** power[m.group(5) or other]

        unit = b[-1:] if b[-1:] in power else ""
        if not (a or b) or a and read(a) is None or b and read(b) is None or not (unit or a[-1:] in power and a[-1:]):
            return None
        x, y = read(a, unit) if a else None, read(b) if b else None
        if x is not None and y is not None and x > y:
            return Query.nothing()
        return Query.number_range(self.slot, x, y)
