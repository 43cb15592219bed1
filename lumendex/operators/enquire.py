"""A match session: ranking, paging, sorting, collapsing, cut-offs, percentages, facets."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weights import BM25, Weight
from ..sources.catalog import Catalog
from .ast import Query
from .match import Matcher

EPSILON = 2.220446049250313e-16


@dataclass(frozen=True)
class Enquire:
    """Options are set by returning a changed copy; nothing runs before a result's rows are asked for."""

    catalog: Catalog
    query: Query
    weight: Weight = BM25()
    relevant: DataFrame | None = None
    query_length: int | None = None
    sort: str = "relevance"  # relevance, value, value_relevance, relevance_value, key, key_relevance, relevance_key
    slot: int | None = None
    key: Column | None = None  # a column of (did, w) joined with `keys`
    keys: DataFrame | None = None
    reverse: bool = False
    descending_ids: bool = False
    collapse_slot: int | None = None
    collapse_max: int = 1
    percent_cutoff: int = 0
    weight_cutoff: float = 0.0
    decider: object = None  # a function of the matches (did, w, subqs) to a filtered DataFrame

    def where(self, **changes) -> Enquire:
        return replace(self, **changes)

    @cached_property
    def matcher(self) -> Matcher:
        return Matcher(self.catalog, self.weight, self.relevant, self.query_length)

    @cached_property
    def matches(self) -> DataFrame:
        """did, w, subqs of all that match."""
        x = self.matcher.run(self.query)
        return self.decider(x) if self.decider else x

    def _value(self, x: DataFrame, slot: int, name: str) -> DataFrame:
        v = self.catalog.value_stream(slot).select("did", F.col("value").alias(name))
        return x.join(v, "did", "left").withColumn(name, F.coalesce(name, F.lit("")))

    def _order(self) -> list[Column]:
        did = F.col("did").desc() if self.descending_ids else F.col("did").asc()
        w = F.col("w").desc()
        k = F.col("sort_key").desc() if self.reverse else F.col("sort_key").asc()
        kind = self.sort.replace("key", "value")
        return {"relevance": [w, did], "value": [k, did], "value_relevance": [k, w, did], "relevance_value": [w, k, did]}[kind]

    def ranked(self) -> DataFrame:
        """did, w, subqs, sort_key, collapse_key, collapse_count: matches after cut-offs and collapsing, not yet in order."""
        x = self.matches
        if "value" in self.sort:
            x = self._value(x, self.slot, "sort_key")
        elif "key" in self.sort:
            x = x.join(self.keys, "did", "left").withColumn("sort_key", self.key)
        else:
            x = x.withColumn("sort_key", F.lit(None).cast("string"))
        if self.weight_cutoff > 0:
            x = x.where(F.col("w") >= self.weight_cutoff)
        if self.percent_cutoff > 0:
            x = self.with_percent(x).where(F.col("percent") >= self.percent_cutoff).drop("percent")
        if self.collapse_slot is None:
            return x.withColumns({"collapse_key": F.lit("").cast("string"), "collapse_count": F.lit(0).cast("long")})
        x = self._value(x, self.collapse_slot, "collapse_key")
        # rows with an empty key are never collapsed; of the others each task keeps its best few of a key before they meet, and
        # counts are summed apart, so that a key of most matches is no task of its own
        alone = x.where("collapse_key = ''").withColumn("collapse_count", F.lit(0).cast("long"))
        rest = x.where("collapse_key != ''")
        best = rest.withColumn("rn", F.row_number().over(Window.partitionBy("collapse_key").orderBy(*self._order()))).where(F.col("rn") <= self.collapse_max).drop("rn")
        same = rest.groupBy("collapse_key").agg(F.greatest(F.lit(0), F.count("*") - self.collapse_max).cast("long").alias("collapse_count"))
        return alone.unionByName(best.join(same, "collapse_key").select(*alone.columns))

    def with_percent(self, x: DataFrame) -> DataFrame:
        """x with percent: 100 for the best document if it matches all weighted leaves, else its share of them."""
        total = self.matcher.total_subqs(self.query)
        top = self.matches.agg(F.max(F.struct("w", (-F.col("did")).alias("d"), "subqs")).alias("top")).select(F.col("top.w").alias("top_w"), F.col("top.subqs").alias("top_s"))
        scale = F.col("top_s") / F.lit(float(max(total, 1))) / F.col("top_w") * 100.0
        pct = F.floor(F.col("w") * scale + 100.0 * EPSILON).cast("int")
        pct = F.when(F.col("top_w") <= 0, 100).when(F.col("w") <= 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(100), pct)))
        return x.join(F.broadcast(top), F.lit(True), "left").withColumn("percent", pct).drop("top_w", "top_s")

    def mset(self, first: int = 0, maxitems: int = 10, percent: bool = False) -> DataFrame:
        """rank, did, w, ...: a page of results. Planned as a bounded heap in each task, not as a sort."""
        x = self.ranked()
        page = x.orderBy(*self._order()).offset(first).limit(maxitems)
        page = page.withColumn("rank", (F.row_number().over(Window.orderBy(*self._order())) - 1 + first).cast("int"))  # over a page
        return self.with_percent(page) if percent else page

    # ---- counts

    def count(self) -> DataFrame:
        """matches, max_attained: exact, so lower bound, estimate and upper bound agree."""
        return self.matches.agg(F.count("*").alias("matches"), F.max("w").alias("max_attained"))

    def uncollapsed_count(self) -> DataFrame:
        return self.matches.agg(F.count("*").alias("matches"))

    def matching_terms(self) -> DataFrame:
        """did, terms: the query's terms that index each match, in query order."""
        order = {}
        for i, t in enumerate(self.query.terms()):
            order.setdefault(t, i)
        side = self.catalog.spark.createDataFrame(list(order.items()) or [("", 0)], "term string, pos int")
        p = self.catalog.lists(order).join(F.broadcast(side), "term").join(self.matches.select("did"), "did", "left_semi")
        return p.groupBy("did").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("terms"))

    def facet(self, slot: int, top: int | None = None) -> DataFrame:
        """value, n over all matches; the top by count, then value."""
        v = self.catalog.value_stream(slot).join(self.matches.select("did"), "did", "left_semi").groupBy("value").agg(F.count("*").alias("n"))
        return v.orderBy(F.desc("n"), "value").limit(top) if top else v

    def reweighted(self, weights: DataFrame) -> Enquire:
        """The same session with the matches' weights replaced by weights (did, w)."""
        x = self.matches.drop("w").join(weights.select("did", "w"), "did")
        return _Fixed(x.select("did", "w", "subqs"), self)


class _Fixed(Enquire):
    def __init__(self, matches: DataFrame, of: Enquire):
        for k, v in of.__dict__.items():
            object.__setattr__(self, k, v)
        object.__setattr__(self, "matches", matches)
