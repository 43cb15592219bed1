"""A search page's request to a session: query strings, filters, date spans, ordering, collapsing, paging.

Parameters are a map from a name to its values, as a form sends them: P (and P.PREFIX) query strings; B and N filter
terms; START, END, SPAN with DATEVALUE (a slot) or as day, month and year terms; SORT, SORTREVERSE, SORTAFTER,
DOCIDORDER; COLLAPSE; THRESHOLD; R and MORELIKE; TOPDOC, HITSPERPAGE, MINHITS; DEFAULTOP.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame

from ..functions.weights import BM25, Weight
from ..operators.ast import Query
from ..operators.enquire import Enquire
from ..operators.eset import eset
from ..sources.catalog import Catalog
from .parser import DEFAULT_FLAGS, QueryParser

MORE_TERMS = 40


def one(params: dict[str, list[str]], name: str, default: str = "") -> str:
    return (params.get(name) or [default])[0]


def prefix_of(term: str) -> str:
    m = re.match(r"X[A-Z]*(?=:|[^A-Z])|[A-Z]", term)
    return m.group() if m else ""


def filters(terms: list[str], together: frozenset[str] = frozenset()) -> Query:
    """Filter terms of one prefix are alternatives (or, for prefixes of `together`, all needed); prefixes are all needed."""
    by: dict[str, list[str]] = {}
    for t in terms:
        by.setdefault(prefix_of(t), []).append(t)
    return Query.of("AND", [Query.of("AND" if p in together else "OR", ts) for p, ts in sorted(by.items())])


def _day(text: str) -> date | None:
    m = re.fullmatch(r"(\d{4})-?(\d{2})?-?(\d{2})?", text)
    return date(int(m[1]), int(m[2] or 1), int(m[3] or 1)) if m else None


def span(params: dict[str, list[str]], today: date | None = None) -> tuple[date | None, date | None]:
    """First and last day: from START and END, either with SPAN days, or SPAN days to today."""
    a, b, n = _day(one(params, "START")), _day(one(params, "END")), one(params, "SPAN")
    if n.isdigit():
        if a and not b:
            b = a + timedelta(int(n) - 1)
        elif not a:
            b = b or today or date.today()
            a = b - timedelta(int(n) - 1)
    return a, b


def date_terms(first: date, last: date) -> Query:
    """The days from first to last by the fewest terms: whole years, whole months, days; and those that are always new."""
    out, d = [Query.term("Dlatest")], first
    while d <= last:
        year, month = date(d.year + 1, 1, 1), date(d.year + d.month // 12, d.month % 12 + 1, 1)
        if d.month == d.day == 1 and year - timedelta(1) <= last:
            out.append(Query.term(f"Y{d.year:04d}"))
            d = year
        elif d.day == 1 and month - timedelta(1) <= last:
            out.append(Query.term(f"M{d:%Y%m}"))
            d = month
        else:
            out.append(Query.term(f"D{d:%Y%m%d}"))
            d += timedelta(1)
    return Query.of("OR", out)


def date_filter(params: dict[str, list[str]], today: date | None = None) -> Query | None:
    a, b = span(params, today)
    if not (a or b):
        return None
    slot = one(params, "DATEVALUE")
    if slot:
        lo, hi = (f"{x:%Y%m%d}" if x else "" for x in (a, b))
        return Query.value_ge(int(slot), lo) if not hi else Query.value_range(int(slot), lo, hi)
    return date_terms(a or date(1970, 1, 1), b or today or date.today())


@dataclass
class Request:
    """What a request asks of a catalog."""

    catalog: Catalog
    params: dict[str, list[str]]
    parser: QueryParser
    weight: Weight = BM25()
    flags: frozenset[str] = DEFAULT_FLAGS
    together: frozenset[str] = frozenset()
    today: date | None = None

    def relevant(self) -> DataFrame | None:
        ids = [int(x) for v in self.params.get("R", []) for x in re.findall(r"\d+", v)]
        return self.catalog.spark.createDataFrame([(i,) for i in ids], "did long") if ids else None

    def more_like(self) -> Query:
        """The best terms of documents given by id, or by a unique term."""
        spark, wanted = self.catalog.spark, self.params.get("MORELIKE", [])
        ids = [int(x) for x in wanted if x.isdigit()]
        terms = [x for x in wanted if not x.isdigit()]
        docs = spark.createDataFrame([(i,) for i in ids], "did long")
        if terms:
            docs = docs.unionByName(self.catalog.postings.where(self.catalog.postings.term.isin(terms)).select("did")).distinct()
        return Query.of("OR", [Query.term(r.term) for r in eset(self.catalog, docs, MORE_TERMS).collect()])

    def query(self) -> Query:
        parts = []
        for name, values in sorted(self.params.items()):
            if name == "P" or name.startswith("P."):
                prefix = name[2:]
                parts += [self.parser.parse(v, self.flags, prefix) for v in values if v.strip()]
        q = Query.of("AND" if one(self.params, "DEFAULTOP", "and").lower() == "and" else "OR", parts)
        if q.empty() and self.params.get("MORELIKE"):
            q = self.more_like()
        need = [filters(self.params["B"], self.together)] if self.params.get("B") else []
        if (d := date_filter(self.params, self.today)) is not None:
            need.append(d)
        if need:
            f = Query.of("AND", need)
            q = Query.of("FILTER", [q, f]) if not q.empty() else f * 0
        if self.params.get("N"):
            q = Query.of("AND_NOT", [Query.all() * 0 if q.empty() else q, Query.of("OR", self.params["N"])])
        return q

    def session(self) -> Enquire:
        p = self.params
        sort, slot, reverse = "relevance", None, one(p, "SORTREVERSE", "0") not in ("", "0")
        if m := re.match(r"([+-]?)(\d+)", one(p, "SORT")):
            slot = int(m[2])
            reverse = m[1] == "-" if m[1] else reverse
            sort = "relevance_value" if one(p, "SORTAFTER", "0") not in ("", "0") else "value_relevance"
        return Enquire(
            self.catalog, self.query(), self.weight, self.relevant(), sort=sort, slot=slot, reverse=reverse, descending_ids=one(p, "DOCIDORDER").upper() == "D",
            collapse_slot=int(one(p, "COLLAPSE")) if one(p, "COLLAPSE") else None, percent_cutoff=0 if sort.startswith("value") else int(one(p, "THRESHOLD", "0")),
        )

    def page(self) -> DataFrame:
        """The page asked for. A request for page n by its number sends [ n."""
        size, top = int(one(self.params, "HITSPERPAGE", "10")), int(one(self.params, "TOPDOC", "0"))
        if jump := one(self.params, "["):
            top = (int(jump) - 1) * size
        return self.session().mset(top, size, percent=True)
