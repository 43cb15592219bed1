"""Weighting schemes as column expressions.

Columns of a posting: f (wdf), L (document length), u (distinct terms), m (largest wdf); of its query term: q (wqf),
n (termfreq), c (collection frequency), r (relevant documents with it). Numbers of the collection and query: N, T
(total length), avl (average length), Lmax, ql (query length), R (relevant documents).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)


def _ln(x: Column) -> Column:
    return F.log(x)


def _log2(x: Column) -> Column:
    return F.log(x) / LN2


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class Weight:
    """A scheme: part() is what a matching term adds, extra() what a document adds once."""

    name = ""

    def part(self, s: SimpleNamespace) -> Column:
        raise NotImplementedError

    def extra(self, s: SimpleNamespace) -> Column | None:
        return None


def _bm25_length(s, b: float, least: float) -> Column:
    return F.greatest(s.L / _num(s.avl), F.lit(least)) if s.avl else F.lit(1.0)


def _k3(s, k3: float) -> Column:
    return (k3 + 1) * s.q / (k3 + s.q)


@dataclass(frozen=True)
class BM25(Weight):
    k1: float = 1.0
    k2: float = 0.0
    k3: float = 1.0
    b: float = 0.5
    min_normlen: float = 0.5
    name = "bm25"

    def idf(self, s) -> Column:
        if s.R:
            t = ((s.r + 0.5) * (s.N - (s.R - s.r) - s.n + 0.5)) / ((s.R - s.r + 0.5) * (s.n - s.r + 0.5))
        else:
            t = (s.N - s.n + 0.5) / (s.n + 0.5)
        return _ln(F.when(t < 2, t * 0.5 + 1).otherwise(t))  # never negative, even for terms of most documents

    def part(self, s) -> Column:
        nl = _bm25_length(s, self.b, self.min_normlen)
        return self.idf(s) * _k3(s, self.k3) * (self.k1 + 1) * s.f / (self.k1 * (self.b * nl + (1 - self.b)) + s.f)

    def extra(self, s) -> Column | None:
        return 2 * self.k2 * s.ql / (1 + _bm25_length(s, self.b, self.min_normlen)) if self.k2 else None


@dataclass(frozen=True)
class BM25Plus(BM25):
    delta: float = 1.0
    name = "bm25+"

    def part(self, s) -> Column:
        nl = _bm25_length(s, self.b, self.min_normlen)
        return _ln((s.N + 1) / s.n) * _k3(s, self.k3) * ((self.k1 + 1) * s.f / (self.k1 * (self.b * nl + (1 - self.b)) + s.f) + self.delta)


@dataclass(frozen=True)
class Trad(Weight):
    k: float = 1.0
    name = "trad"

    def part(self, s) -> Column:
        return BM25(self.k, 0.0, 0.0, 1.0, 0.0).part(s)


@dataclass(frozen=True)
class TfIdf(Weight):
    normalizations: str = "ntn"
    slope: float = 0.2
    delta: float = 1.0
    name = "tfidf"

    def part(self, s) -> Column:
        f, n, F_ = s.f.cast("double"), s.n.cast("double"), s.c.cast("double")
        per = s.L / s.u
        wdf = {
            "n": lambda: f, "b": lambda: F.lit(1.0), "s": lambda: f * f, "l": lambda: 1 + _ln(f),
            "P": lambda: (1 + _ln(1 + _ln(f))) / (1 - self.slope + self.slope * s.L / _num(s.avl)) + self.delta,
            "L": lambda: (1 + _ln(f)) / (1 + _ln(per)), "a": lambda: 0.5 + 0.5 * f / s.m, "m": lambda: f / s.m,
            "A": lambda: 0.9 + 0.1 * f / per, "g": lambda: 0.2 + 0.8 * _ln(1 + f), "q": lambda: F.sqrt(f - 0.5) + 1,
        }[self.normalizations[0]]()
        idf = {
            "n": lambda: F.lit(1.0), "t": lambda: _ln(s.N / n), "s": lambda: _ln(s.N / n) * _ln(s.N / n), "f": lambda: 1 / n,
            "p": lambda: F.when(n >= s.N, 0.0).otherwise(_ln((s.N - n) / n)), "P": lambda: _ln((s.N + 1) / n),
            "G": lambda: F_ / n, "L": lambda: _ln(F_ / n + 1), "I": lambda: F_ / n + 1, "Q": lambda: F.sqrt(F_ / n - 0.9),
        }[self.normalizations[1]]()
        return wdf * idf * s.q


@dataclass(frozen=True)
class InL2(Weight):
    c: float = 1.0
    name = "inl2"

    def fn(self, s) -> Column:
        return s.f * _log2(1 + self.c * s.avl / s.L)

    def part(self, s) -> Column:
        fn = self.fn(s)
        return s.q * _log2((s.N + 1) / (s.n + 0.5)) * fn / (fn + 1)


@dataclass(frozen=True)
class IfB2(InL2):
    name = "ifb2"

    def idf(self, s) -> Column:
        return _log2((s.N + 1) / (s.c + 0.5))

    def part(self, s) -> Column:
        fn = self.fn(s)
        return s.q * self.idf(s) * fn * ((s.c + 1.0) / s.n) / (fn + 1)


@dataclass(frozen=True)
class IneB2(IfB2):
    name = "ineb2"

    def idf(self, s) -> Column:
        return _log2((s.N + 1) / (s.N * (1 - F.exp(-s.c / s.N)) + 0.5))


def _stirling(y: Column, x: Column, rest: Column) -> Column:
    """log2 of a binomial's leading terms."""
    return (y + 0.5) * _log2(x / y) + rest * _log2(x)


@dataclass(frozen=True)
class BB2(InL2):
    name = "bb2"

    def part(self, s) -> Column:
        c = s.c.cast("double")
        fn = F.least(self.fn(s), c - 1)
        b = s.q * (c + 1) / s.n / (fn + 1)
        wt = -1 / LN2 - math.log2(max(s.N, 2.0) - 1)
        first = _stirling(max(s.N - 2, 0.0) + c - fn, s.N + c - 1, fn + 1)
        return F.greatest(F.lit(0.0), b * (wt + first - _stirling(c - fn, c, fn)))


@dataclass(frozen=True)
class DLH(Weight):
    name = "dlh"

    def part(self, s) -> Column:
        f, L = s.f.cast("double"), s.L.cast("double")
        x = (f * _log2(f / L * s.T / s.c) + (L - f) * _log2(1 - f / L) + 0.5 * _log2(2 * math.pi * f * (1 - f / L))) / (f + 0.5)
        return F.when((f == 0) | (f == L), 0.0).otherwise(F.greatest(F.lit(0.0), x * s.q))


@dataclass(frozen=True)
class DPH(Weight):
    name = "dph"

    def part(self, s) -> Column:
        f, L = s.f.cast("double"), s.L.cast("double")
        norm = (1 - f / L) * (1 - f / L) / (f + 1)
        x = norm * (f * (_log2(f / L) + _log2(s.T / s.c)) + 0.5 * _log2(2 * math.pi * f * (1 - f / L)))
        return F.when((f == 0) | (f == L), 0.0).otherwise(F.greatest(F.lit(0.0), x * s.q))


@dataclass(frozen=True)
class PL2(InL2):
    name = "pl2"

    def p(self, s, fn) -> Column:
        mean = s.c / s.N
        return mean / LN2 + 0.5 * math.log2(2 * math.pi) + (fn + 0.5) * _log2(fn) - (_log2(mean) + 1 / LN2) * fn

    def part(self, s) -> Column:
        fn = self.fn(s)
        p = self.p(s, fn)
        return F.when(p <= 0, 0.0).otherwise(s.q * p / (fn + 1))


@dataclass(frozen=True)
class PL2Plus(PL2):
    delta: float = 0.8
    name = "pl2+"

    def part(self, s) -> Column:
        fn, d = self.fn(s), F.lit(self.delta)
        p = self.p(s, fn) / (fn + 1)
        low = self.p(s, d) / (d + 1)
        return F.when((s.c / s.N > 1) | (s.f == 0), 0.0).otherwise(F.greatest(F.lit(0.0), s.q * (p + low)))


@dataclass(frozen=True)
class LMJelinekMercer(Weight):
    lam: float = 0.0
    name = "lmjm"

    def part(self, s) -> Column:
        lam = self.lam
        if not 0 < lam < 1:
            lam = 0.1 if s.ql <= 2 else (s.ql - 1) / 10 if s.ql < 8 else 0.7
        return s.q * _ln(1 + (1 - lam) * s.T / (lam * s.c) * s.f / s.L)


@dataclass(frozen=True)
class LMDirichlet(Weight):
    mu: float = 2000.0
    delta: float = 0.05
    name = "lmdirichlet"

    def part(self, s) -> Column:
        w = s.q * _ln(1 + s.f * s.T / (s.c * self.mu))
        return w * _ln(1 + self.delta * s.T / (s.c * self.mu)) if self.delta else w

    def extra(self, s) -> Column:
        return s.ql * (math.log(s.Lmax + self.mu) - _ln(s.L + self.mu))


@dataclass(frozen=True)
class LMAbsDiscount(Weight):
    delta: float = 0.7
    name = "lmabsdiscount"

    def part(self, s) -> Column:
        return s.q * _ln(1 + (s.f - self.delta) / s.u * s.T / (self.delta * s.c))

    def extra(self, s) -> Column:
        return s.ql * math.log(s.Lmax) + s.ql * _ln(s.u / s.L)


@dataclass(frozen=True)
class LM2Stage(Weight):
    lam: float = 0.7
    mu: float = 2000.0
    name = "lm2stage"

    def part(self, s) -> Column:
        return s.q * _ln(1 + s.f / (self.lam * s.L + self.mu) * (1 - self.lam) * s.T / s.c)

    def extra(self, s) -> Column:
        top = (self.lam * s.Lmax + self.mu) / (s.Lmax + self.mu)
        return s.ql * (_ln((self.lam * s.L + self.mu) / (s.L + self.mu)) - math.log(top))


@dataclass(frozen=True)
class Dice(Weight):
    name = "dice"

    def part(self, s) -> Column:
        return 2 * s.q / (s.ql + s.u)


@dataclass(frozen=True)
class Coord(Weight):
    name = "coord"

    def part(self, s) -> Column:
        return F.lit(1.0)


@dataclass(frozen=True)
class Bool(Weight):
    name = "bool"

    def part(self, s) -> Column:
        return F.lit(0.0)


SCHEMES = {w.name: w for w in (BM25, BM25Plus, Trad, TfIdf, InL2, IfB2, IneB2, BB2, DLH, DPH, PL2, PL2Plus, LMJelinekMercer, LMDirichlet, LMAbsDiscount, LM2Stage, Dice, Coord, Bool)}


def create(text: str) -> Weight:
    """A scheme from its name and parameters, e.g. 'bm25 1.2 0 1 0.75'."""
    name, *args = text.split()
    if name not in SCHEMES:
        raise ValueError(f"no weighting scheme {name}")
    kinds = [f.type for f in fields(SCHEMES[name])]
    return SCHEMES[name](*(a if k == "str" else float(a) for k, a in zip(kinds, args)))
