"""Queries to DataFrames (did, w, subqs): which documents match, with which weight, by how many weighted leaves.

Leaf terms under one AND, OR, XOR or MAX are one scan of postings, with the terms' numbers joined from a table as long
as the query; documents are then put together by one aggregation. Boolean contexts carry no weights.
"""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.weights import BM25, Weight
from ..sources.catalog import Catalog
from .ast import Query, QueryError


class Matcher:
    """Compiles the queries of one session: a catalog, a scheme, and documents judged relevant."""

    def __init__(self, catalog: Catalog, weight: Weight | None = None, relevant: DataFrame | None = None, query_length: int | None = None):
        self.c, self.weight, self.rset, self.ql = catalog, weight or BM25(), relevant, query_length
        self.R = relevant.count() if relevant is not None else 0

    # ---- numbers

    def scope(self, **columns) -> SimpleNamespace:
        s = self.c.stats
        return SimpleNamespace(N=float(s["n"]), T=float(s["total_len"]), avl=float(s["avg_len"] or 0), Lmax=float(s["len_max"] or 0), ql=float(self.ql or 0), R=float(self.R), **columns)

    def relevant_numbers(self, terms: list[str]) -> dict[str, int]:
        if not self.R:
            return {}
        p = self.c.lists(terms).join(self.rset.select("did").distinct(), "did", "left_semi")
        return {r.term: r.n for r in p.groupBy("term").agg(F.count("*").alias("n")).collect()}

    def nothing(self) -> DataFrame:
        return self.c.documents.where(F.lit(False)).select("did", F.lit(0.0).alias("w"), F.lit(0).alias("subqs"))

    # ---- compilation

    def run(self, q: Query) -> DataFrame:
        """The matches of q with the document-independent extra of the scheme added."""
        if self.ql is None:
            self.ql = q.length()
        out = self.match(q, 1.0)
        if _weighted(q):
            none = F.lit(None)
            extra = self.weight.extra(self.scope(L=F.col("doclen"), u=F.col("uniq"), m=F.col("wdfmax"), f=none, q=none, n=none, c=none, r=none))
            if extra is not None:
                out = out.join(self.c.docstats, "did").select("did", (F.col("w") + extra * _factor(q)).alias("w"), "subqs")
        return out

    def match(self, q: Query, factor: float) -> DataFrame:
        op, subs = q.op, q.subs
        if op == "NOTHING":
            return self.nothing()
        if op == "ALL":
            return self.c.documents.select("did", F.lit(0.0).alias("w"), F.lit(0).alias("subqs"))
        if op == "TERM":
            return self.leaves([q], factor).select("did", "w", "subqs")
        if op == "SOURCE":
            x = q["source"](self.c).select("did", F.col("w").cast("double").alias("w"))
            return x.select("did", (F.col("w") * factor).alias("w"), F.lit(1 if factor else 0).alias("subqs"))
        if op in ("VALUE_RANGE", "VALUE_GE", "VALUE_LE"):
            return self.values(q).select("did", F.lit(0.0).alias("w"), F.lit(1 if factor else 0).alias("subqs"))
        if op == "SCALE_WEIGHT":
            return self.match(subs[0], factor * q["factor"])
        if op in ("AND", "OR", "XOR", "MAX"):
            return self.together(op, list(subs), factor)
        if op == "AND_NOT":
            return reduce(lambda x, s: x.join(self.match(s, 0.0).select("did"), "did", "left_anti"), subs[1:], self.match(subs[0], factor))
        if op == "FILTER":
            return reduce(lambda x, s: x.join(self.match(s, 0.0).select("did"), "did", "left_semi"), subs[1:], self.match(subs[0], factor))
        if op == "AND_MAYBE":
            x = self.match(subs[0], factor)
            if not factor:
                return x
            y = self.together("OR", list(subs[1:]), factor).select("did", F.col("w").alias("w2"), F.col("subqs").alias("s2"))
            zero = F.lit(0)
            return x.join(y, "did", "left").select("did", (F.col("w") + F.coalesce("w2", zero)).alias("w"), (F.col("subqs") + F.coalesce("s2", zero)).alias("subqs"))
        if op in ("NEAR", "PHRASE"):
            return self.positional(q, factor)
        if op == "ELITE_SET":
            return self.together("OR", self.elite(q, factor), factor)
        if op == "SYNONYM":
            return self.as_one(q, factor)
        if op in ("WILDCARD", "EDIT_DISTANCE"):
            return self.expansion(q, factor)
        raise QueryError(f"{op} can't be run")

    def leaves(self, terms: list[Query], factor: float, keep: tuple[str, ...] = ()) -> DataFrame:
        """did, leaf (index), w, subqs of postings of leaf terms; all in one scan."""
        names = [t["term"] for t in terms]
        numbers, rel = self.c.term_numbers(names), self.relevant_numbers(names)
        rows = [(t["term"], i, t["wqf"], *numbers[t["term"]][:2], rel.get(t["term"], 0)) for i, t in enumerate(terms)]
        side = self.c.spark.createDataFrame(rows, "term string, leaf int, q long, n long, c long, r long")
        x = self.c.lists(names)
        x = x.join(F.broadcast(side), "term")  # as long as the query
        return x.select("did", "leaf", self.scored(factor).alias("w"), F.lit(1 if factor and self.weight.name != "bool" else 0).alias("subqs"), *keep)

    def scored(self, factor: float) -> Column:
        if not factor:
            return F.lit(0.0)
        s = self.scope(f=F.col("wdf"), L=F.col("doclen"), u=F.col("uniq"), m=F.col("wdfmax"), q=F.col("q"), n=F.col("n"), c=F.col("c"), r=F.col("r"))
        w = self.weight.part(s).cast("double")
        return w if factor == 1 else w * factor

    def together(self, op: str, subs: list[Query], factor: float) -> DataFrame:
        terms = [s for s in subs if s.op == "TERM"]
        others = [s for s in subs if s.op != "TERM"]
        parts = [self.leaves(terms, factor).select("did", "leaf", "w", "subqs")] if terms else []
        parts += [self.match(s, factor).select("did", F.lit(len(terms) + i).alias("leaf"), "w", "subqs") for i, s in enumerate(others)]
        x = reduce(DataFrame.unionByName, parts)
        if len(subs) == 1:
            return x.select("did", "w", "subqs")
        if op == "MAX":
            return x.groupBy("did").agg(F.max("w").alias("w"), F.lit(1 if factor else 0).alias("subqs"))
        x = x.groupBy("did").agg(F.sum("w").alias("w"), F.sum("subqs").cast("int").alias("subqs"), F.count("*").alias("k"))
        if op == "AND":
            x = x.where(F.col("k") == len(subs))
        if op == "XOR":
            x = x.where(F.col("k") % 2 == 1)
        return x.select("did", "w", "subqs")

    def values(self, q: Query) -> DataFrame:
        v = self.c.value_stream(q["slot"])
        if q["number"]:
            c = F.col("num").isNotNull()
            c = c & (F.col("num") >= q["lo"]) if q["lo"] is not None else c
            return v.where(c & (F.col("num") <= q["hi"]) if q["hi"] is not None else c).select("did")
        if q.op == "VALUE_GE":
            return v.where(F.col("value") >= q["lo"]).select("did")
        if q.op == "VALUE_LE":
            return v.where(F.col("value") <= q["hi"]).select("did")
        return v.where(F.col("value").between(q["lo"], q["hi"])).select("did")

    # ---- positions

    def _positions(self, subs: tuple[Query, ...], factor: float) -> DataFrame:
        """did, leaf, w, positions of each operand; those of an OR are its terms' together."""
        terms, owner = [], []
        for i, s in enumerate(subs):
            for t in s.leaves():
                if t.op in ("WILDCARD", "EDIT_DISTANCE"):
                    new = [Query.term(r.term) for r in self.expanded(t).collect()]
                else:
                    new = [t]
                terms += new
                owner += [i] * len(new)
        own = F.element_at(F.lit(owner), F.col("leaf") + 1)
        x = self.leaves(terms, factor, ("positions", "wdf")).withColumn("leaf", own)
        if len(terms) > len(subs):
            x = x.groupBy("did", "leaf").agg(F.sum("w").alias("w"), F.sum("subqs").cast("int").alias("subqs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"), F.sum("wdf").alias("wdf"))
        return x

    def positional(self, q: Query, factor: float) -> DataFrame:
        """Documents whose operands stand in the window, from one scan and one aggregation."""
        k = len(q.subs)
        x = self._positions(q.subs, factor).groupBy("did").agg(
            F.sum("w").alias("w"), F.sum("subqs").cast("int").alias("subqs"), F.min("wdf").alias("wdf"), F.map_from_entries(F.collect_list(F.struct("leaf", "positions"))).alias("at"), F.count("*").alias("k")
        )
        x = x.where(F.col("k") == k).withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.col("at")[i]))
        test = near_test("p", k, q["window"], [s._text() for s in q.subs]) if q.op == "NEAR" else phrase_test("p", k, q["window"])
        return x.where(test).select("did", "w", "subqs", "wdf")

    # ---- many terms as one

    def as_one(self, q: Query, factor: float) -> DataFrame:
        """SYNONYM: matches as OR, weighs as one term. wdf: the sum, no more than the document's length; frequencies: as if the terms were independent."""
        x = self.wdfs(q.subs)
        n, c = self.estimate(Query.of("OR", q.subs) if len(q.subs) > 1 else q.subs[0])
        return self._weigh_one(x, n, c, factor)

    def _weigh_one(self, x: DataFrame, n: float, c: float, factor: float) -> DataFrame:
        x = x.groupBy("did").agg(F.sum("wdf").alias("wdf")).join(self.c.docstats, "did").withColumn("wdf", F.least("wdf", "doclen"))
        x = x.withColumns({"q": F.lit(1), "n": F.lit(n), "c": F.lit(c), "r": F.lit(0)})
        return x.select("did", self.scored(factor).alias("w"), F.lit(1 if factor else 0).alias("subqs"))

    def wdfs(self, subs: tuple[Query, ...]) -> DataFrame:
        """did, wdf of each sub-query's matches."""
        terms = [s for s in subs if s.op == "TERM"]
        parts = []
        if terms:
            parts.append(self.leaves(terms, 0.0, ("wdf",)).select("did", "wdf"))
        for s in subs:
            if s.op in ("NEAR", "PHRASE"):
                parts.append(self.positional(s, 0.0).select("did", "wdf"))
            elif s.op in ("WILDCARD", "EDIT_DISTANCE"):
                parts.append(self._postings_of(s).join(self.expanded(s).select("term"), "term").select("did", "wdf"))
            elif s.op == "ALL":
                parts.append(self.c.docstats.select("did", F.col("doclen").alias("wdf")))
            elif s.op != "TERM":
                parts.append(self.wdfs(s.subs).groupBy("did").agg(F.sum("wdf").alias("wdf")).join(self.match(s, 0.0).select("did"), "did", "left_semi"))
        return reduce(DataFrame.unionByName, parts) if parts else self.nothing().select("did", F.lit(0).cast("long").alias("wdf"))

    def estimate(self, q: Query) -> tuple[int, int]:
        """Estimated termfreq and collection frequency of a sub-query."""
        N, T = self.c.stats["n"], self.c.stats["total_len"]
        if not N:
            return 0, 0
        if q.op == "TERM":
            return self.c.term_numbers([q["term"]])[q["term"]][:2]
        if q.op == "ALL":
            return N, T
        if q.op in ("WILDCARD", "EDIT_DISTANCE"):
            x = self.expanded(q)
            miss = lambda c, of: F.exp(F.sum(F.log1p(-F.least(F.col(c) / F.lit(float(of)), F.lit(1 - 1e-15)))))
            r = x.agg(miss("termfreq", N).alias("n"), miss("collfreq", T or 1).alias("c")).first()
            return (0, 0) if r.n is None else (int((1 - r.n) * N + 0.5), int((1 - r.c) * T + 0.5))
        subs = [self.estimate(s) for s in q.subs]
        if q.op in ("OR", "SYNONYM", "MAX", "ELITE_SET"):
            n = c = 0.0
            for a, b in subs:
                n, c = n + a / N - n * a / N, c + b / (T or 1) - c * b / (T or 1)
            return int(n * N + 0.5), int(c * T + 0.5)
        if q.op == "XOR":
            n = c = 0.0
            for a, b in subs:
                n, c = n + a / N - 2 * n * a / N, c + b / (T or 1) - 2 * c * b / (T or 1)
            return int(n * N + 0.5), int(c * T + 0.5)
        if q.op == "AND_NOT":
            a, b = subs[0]
            for x, y in subs[1:]:
                a, b = a * (N - x) / N, b * ((T or 1) - y) / (T or 1)
            return int(a + 0.5), int(b + 0.5)
        if q.op in ("AND_MAYBE", "SCALE_WEIGHT"):
            return subs[0]
        n = c = 1.0
        for a, b in subs:
            n, c = n * a / N, c * b / (T or 1)
        n, c = n * N, c * T
        share = {"NEAR": 2, "PHRASE": 4 if q["window"] == len(q.subs) else 3}.get(q.op, 1)
        return int(n / share + 0.5), int(c / share + 0.5)

    def expanded(self, q: Query) -> DataFrame:
        """The dictionary's terms that an expansion takes, with their statistics."""
        from .expand import expand

        return expand(self.c, q)

    def _postings_of(self, q: Query) -> DataFrame:
        """Postings without positions, of all terms that an expansion takes and few others: no others are shuffled."""
        from .expand import candidate

        return self.c.counts_where(lambda t: candidate(t, q))

    def expansion(self, q: Query, factor: float) -> DataFrame:
        terms = self.expanded(q)
        x = self._postings_of(q).join(terms.withColumnsRenamed({"termfreq": "n", "collfreq": "c"}).select("term", "n", "c"), "term")
        if q["combiner"] == "SYNONYM":
            n, c = self.estimate(q)
            return self._weigh_one(x.select("did", "wdf"), n, c, factor)
        x = x.withColumns({"q": F.lit(1), "r": F.lit(0)}).select("did", self.scored(factor).alias("w"))
        agg = F.max("w") if q["combiner"] == "MAX" else F.sum("w")
        count = F.lit(1) if q["combiner"] == "MAX" else F.count("*").cast("int")
        return x.groupBy("did").agg(agg.alias("w"), (count if factor else F.lit(0)).alias("subqs"))

    def elite(self, q: Query, factor: float) -> list[Query]:
        """The sub-queries with the largest weights; one aggregation for all that are terms."""
        terms = [s for s in q.subs if s.op == "TERM"]
        most = {}
        if terms:
            by = {r.leaf: r.m for r in self.leaves(terms, factor or 1.0).groupBy("leaf").agg(F.max("w").alias("m")).collect()}
            most = {id(t): by.get(i, 0.0) for i, t in enumerate(terms)}
        for s in q.subs:
            if id(s) not in most:
                most[id(s)] = self.match(s, factor or 1.0).agg(F.max("w")).first()[0] or 0.0
        return sorted(q.subs, key=lambda s: -most[id(s)])[: q["size"]]

    def total_subqs(self, q: Query, weighted: bool = True) -> int:
        """Weighted leaves of a query: what a document that matches everything counts."""
        if not weighted or q.op in ("ALL", "NOTHING"):
            return 0
        if q.op in ("TERM", "SOURCE", "SYNONYM", "MAX", "VALUE_RANGE", "VALUE_GE", "VALUE_LE"):
            return 1
        if q.op in ("WILDCARD", "EDIT_DISTANCE"):
            return self.expanded(q).count() if q["combiner"] == "OR" else 1
        if q.op == "SCALE_WEIGHT":
            return self.total_subqs(q.subs[0], q["factor"] > 0)
        if q.op in ("AND_NOT", "FILTER"):
            return self.total_subqs(q.subs[0])
        if q.op == "ELITE_SET":
            return min(len(q.subs), q["size"])
        return sum(self.total_subqs(s) for s in q.subs)


def _weighted(q: Query) -> bool:
    return not (q.op in ("ALL", "NOTHING", "VALUE_RANGE", "VALUE_GE", "VALUE_LE", "SOURCE") or q.op == "SCALE_WEIGHT" and (q["factor"] == 0 or not _weighted(q.subs[0])))


def _factor(q: Query) -> float:
    return q["factor"] * _factor(q.subs[0]) if q.op == "SCALE_WEIGHT" else 1.0


def phrase_test(p: str, k: int, window: int) -> Column:
    """Operands in order, from first to last at most `window` places. p: an array of their positions' arrays."""
    if window == k:
        inner = f"{p}[0]"
        for i in range(1, k):
            inner = f"array_intersect({inner}, transform({p}[{i}], x -> x - {i}))"
        return F.expr(f"size({inner}) > 0")
    runs = f"transform({p}[0], x -> struct(x as s, x as e))"
    for i in range(1, k):
        runs = f"filter(transform({runs}, r -> struct(r.s as s, array_min(filter({p}[{i}], x -> x > r.e)) as e)), r -> r.e is not null)"
    return F.expr(f"exists({runs}, r -> r.e - r.s + 1 <= {window})")


def near_test(p: str, k: int, window: int, names: list[str]) -> Column:
    """Operands in any order within `window` places, an operand that is named twice at two places."""
    needs = {i: names[: i + 1].count(n) for i, n in enumerate(names)}
    inside = lambda i: f"filter({p}[{i}], x -> x >= a and x < a + {window})"
    each = " and ".join(f"size({inside(i)}) >= {needs[i]}" for i in range(k))
    places = f"size(array_distinct(flatten(array({', '.join(inside(i) for i in range(k))})))) >= {k}"
    return F.expr(f"exists(array_distinct(flatten({p})), a -> {each} and {places})")
