"""The query algebra: immutable trees of match operators. Nothing here touches data."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

OPS = ("AND", "OR", "AND_NOT", "XOR", "AND_MAYBE", "FILTER", "NEAR", "PHRASE", "VALUE_RANGE", "SCALE_WEIGHT", "ELITE_SET", "VALUE_GE", "VALUE_LE", "SYNONYM", "MAX", "WILDCARD", "EDIT_DISTANCE")
LEAVES = ("TERM", "ALL", "NOTHING", "SOURCE", "VALUE_RANGE", "VALUE_GE", "VALUE_LE", "WILDCARD", "EDIT_DISTANCE")


class QueryError(ValueError):
    """A query that can't be built or run."""


@dataclass(frozen=True)
class Query:
    op: str = "NOTHING"
    subs: tuple[Query, ...] = ()
    args: tuple[tuple[str, Any], ...] = field(default=())

    def __getitem__(self, name: str) -> Any:
        return dict(self.args).get(name)

    # ---- leaves

    @staticmethod
    def term(term: str, wqf: int = 1, pos: int = 0) -> Query:
        return _make("TERM", (), term=term, wqf=wqf, pos=pos) if term else Query.all()

    @staticmethod
    def all() -> Query:
        return Query("ALL")

    @staticmethod
    def nothing() -> Query:
        return Query("NOTHING")

    @staticmethod
    def source(source: Any, name: str = "source") -> Query:
        """A posting source: a function of the catalog to a DataFrame (did, w)."""
        return _make("SOURCE", (), source=source, name=name)

    @staticmethod
    def value_range(slot: int, lo: str, hi: str) -> Query:
        if lo == "":
            return Query.value_le(slot, hi)
        return _make("VALUE_RANGE", (), slot=slot, lo=lo, hi=hi) if lo <= hi else Query.nothing()

    @staticmethod
    def value_ge(slot: int, lo: str) -> Query:
        return _make("VALUE_GE", (), slot=slot, lo=lo) if lo else Query.all()

    @staticmethod
    def value_le(slot: int, hi: str) -> Query:
        return _make("VALUE_LE", (), slot=slot, hi=hi)

    @staticmethod
    def number_range(slot: int, lo: float | None, hi: float | None) -> Query:
        """A range over the numbers of a slot (what the ordered byte encoding of numbers is for)."""
        return _make("VALUE_RANGE", (), slot=slot, lo=lo, hi=hi, number=True)

    @staticmethod
    def wildcard(pattern: str, most: int = 0, limit: str = "ERROR", combiner: str = "SYNONYM", patterns: bool = True, prefix: str = "") -> Query:
        """Terms that match: '*' any run, '?' one character (patterns), or all that begin with it. limit: ERROR, FIRST, MOST_FREQUENT."""
        return _make("WILDCARD", (), pattern=pattern, most=most, limit=limit, combiner=combiner, patterns=patterns)

    @staticmethod
    def edit_distance(term: str, edits: int = 2, fixed: int = 0, most: int = 0, limit: str = "ERROR", combiner: str = "SYNONYM") -> Query:
        """Terms within `edits` insertions, deletions, substitutions and swaps of neighbours; the first `fixed` characters are kept."""
        return _make("EDIT_DISTANCE", (), term=term, edits=edits, fixed=fixed, most=most, limit=limit, combiner=combiner)

    # ---- operators

    @staticmethod
    def of(op: str, subs: Iterable[Query | str], parameter: int = 0) -> Query:
        """Any operator of several sub-queries, trivial trees folded."""
        if op not in OPS:
            raise QueryError(f"no operator {op}")
        xs = tuple(Query.term(s) if isinstance(s, str) else s for s in subs)
        if op in ("AND", "NEAR", "PHRASE"):
            if any(x.op == "NOTHING" for x in xs):
                return Query.nothing()
        if op == "FILTER" and any(x.op == "NOTHING" for x in xs):
            return Query.nothing()
        if op in ("OR", "XOR", "MAX", "SYNONYM", "ELITE_SET"):
            xs = tuple(x for x in xs if x.op != "NOTHING")
        if op in ("AND_NOT", "AND_MAYBE"):
            if not xs or xs[0].op == "NOTHING":
                return Query.nothing()
            xs = xs[:1] + tuple(x.subs[0] if op == "AND_NOT" and x.op == "SCALE_WEIGHT" else x for x in xs[1:] if x.op != "NOTHING")
            if op == "AND_NOT" and any(x.op == "ALL" for x in xs[1:]):
                return Query.nothing()
        if op in ("NEAR", "PHRASE"):
            for x in xs:
                if x.op in ("ALL", "SOURCE"):
                    return Query.nothing()
                if x.op not in ("TERM", "OR", "SYNONYM", "WILDCARD", "EDIT_DISTANCE"):
                    raise QueryError(f"{op} of {x.op}")
        if not xs:
            return Query.nothing()
        if len(xs) == 1 and op not in ("SYNONYM",):
            return xs[0]
        if op == "SYNONYM" and len(xs) == 1 and xs[0].op in ("TERM", "ALL"):
            return xs[0]
        if op in ("AND", "OR", "XOR", "MAX"):  # an operator under itself is the same operator
            flat: list[Query] = []
            for x in xs:
                flat.extend(x.subs if x.op == op else [x])
            xs = tuple(flat)
        if op in ("NEAR", "PHRASE"):
            return _make(op, xs, window=max(parameter or len(xs), len(xs)))
        if op == "ELITE_SET":
            return _make(op, xs, size=parameter or 10)
        return Query(op, xs)

    def scale(self, factor: float) -> Query:
        if factor < 0:
            raise QueryError("a factor must not be negative")
        if self.op in ("NOTHING", "VALUE_RANGE", "VALUE_GE", "VALUE_LE"):
            return self
        if self.op == "SCALE_WEIGHT":
            return self.subs[0].scale(factor * self["factor"])
        return _make("SCALE_WEIGHT", (self,), factor=factor)

    def __and__(self, other: Query) -> Query:
        if other.op == "INVERSE":
            return Query.of("AND_NOT", [self, *other.subs])
        return Query.of("AND", [self, other])

    def __or__(self, other: Query) -> Query:
        return Query.of("OR", [self, other])

    def __xor__(self, other: Query) -> Query:
        return Query.nothing() if self is other else Query.of("XOR", [self, other])

    def __mul__(self, factor: float) -> Query:
        return self.scale(factor)

    __rmul__ = __mul__

    def __truediv__(self, factor: float) -> Query:
        return self.scale(1 / factor)

    def __invert__(self) -> Query:
        return Query("INVERSE", (self,))

    # ---- accessors

    def empty(self) -> bool:
        return self.op == "NOTHING"

    def leaves(self) -> list[Query]:
        return [self] if not self.subs else [x for s in self.subs for x in s.leaves()]

    def terms(self) -> list[str]:
        """Terms by query position."""
        return [x["term"] for x in sorted((x for x in self.leaves() if x.op == "TERM"), key=lambda x: x["pos"])]

    def unique_terms(self) -> list[str]:
        return sorted(set(self.terms()))

    def length(self) -> int:
        """Sum of the within-query frequencies; an expansion counts once."""
        return sum(x["wqf"] if x.op == "TERM" else 1 for x in self.leaves() if x.op in ("TERM", "WILDCARD", "EDIT_DISTANCE"))

    def serialise(self) -> str:
        def plain(q: Query) -> list:
            if q.op == "SOURCE":
                raise QueryError("a posting source can't be serialised")
            return [q.op, [plain(s) for s in q.subs], dict(q.args)]

        return json.dumps(plain(self))

    @staticmethod
    def unserialise(text: str) -> Query:
        def back(x: list) -> Query:
            return Query(x[0], tuple(back(s) for s in x[1]), tuple(x[2].items()))

        return back(json.loads(text))

    def describe(self) -> str:
        return f"Query({self._text()})"

    def _text(self) -> str:
        a = dict(self.args)
        if self.op == "NOTHING":
            return ""
        if self.op == "ALL":
            return "<alldocuments>"
        if self.op == "TERM":
            return a["term"] + (f"#{a['wqf']}" if a["wqf"] != 1 else "") + (f"@{a['pos']}" if a["pos"] else "")
        if self.op == "SOURCE":
            return f"PostingSource({a['name']})"
        if self.op == "SCALE_WEIGHT":
            return f"{a['factor']:g} * {self.subs[0]._text()}"
        if self.op in ("VALUE_RANGE", "VALUE_GE", "VALUE_LE"):
            if a.get("number"):
                lo, hi = a["lo"], a["hi"]
                return f"VALUE {a['slot']} " + (f"<= {hi:g}" if lo is None else f">= {lo:g}" if hi is None else f"{lo:g} .. {hi:g}")
            return {"VALUE_RANGE": lambda: f"VALUE_RANGE {a['slot']} {a['lo']} {a['hi']}", "VALUE_GE": lambda: f"VALUE_GE {a['slot']} {a['lo']}", "VALUE_LE": lambda: f"VALUE_LE {a['slot']} {a['hi']}"}[self.op]()
        if self.op == "WILDCARD":
            return f"WILDCARD {a['combiner']} {a['pattern']}"
        if self.op == "EDIT_DISTANCE":
            return f"EDIT_DISTANCE {a['combiner']} {a['term']}~{a['edits']}"
        name = self.op + (f" {a['window']}" if "window" in a else f" {a['size']}" if "size" in a else "")
        return "(" + f" {name} ".join(s._text() for s in self.subs) + ")"


def _make(op: str, subs: tuple[Query, ...], **args: Any) -> Query:
    return Query(op, subs, tuple(args.items()))
