"""Terms of the dictionary that a pattern or a misspelling stands for."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.editdist import osa_distance
from ..sources.catalog import Catalog
from .ast import Query, QueryError


def like_regex(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def fixed_prefix(pattern: str) -> str:
    return re.split(r"[*?]", pattern, maxsplit=1)[0]


@F.pandas_udf(IntegerType())
def _osa(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for term, word, most in batches:
        yield pd.Series([osa_distance(a, b, int(k)) for a, b, k in zip(term, word, most)], dtype="int32")


def candidate(t: Column, q: Query) -> Column:
    """Whether a pattern takes a term, or a misspelling may stand for it."""
    if q.op == "WILDCARD":
        p = q["pattern"]
        if not q["patterns"]:
            return t.startswith(p)
        head = fixed_prefix(p)
        return (t.startswith(head) if head else t.rlike("^[^A-Z]")) & t.rlike(like_regex(p))
    word, k = q["term"], q["edits"]
    near = F.levenshtein(t, F.lit(word), 2 * k) >= 0  # a swap of neighbours counts two here
    return F.length(t).between(len(word) - k, len(word) + k) & (t.startswith(word[: q["fixed"]]) if q["fixed"] else t.rlike("^[^A-Z]")) & near


def matching(catalog: Catalog, q: Query) -> DataFrame:
    d = catalog.terms_where(lambda t: candidate(t, q))
    return d if q.op == "WILDCARD" else d.where(_osa("term", F.lit(q["term"]), F.lit(q["edits"])) <= q["edits"])


def expand(catalog: Catalog, q: Query) -> DataFrame:
    """term, termfreq, collfreq, wdf_ub, limited as the query says."""
    d = matching(catalog, q)
    most = q["most"]
    if not most:
        return d
    if q["limit"] == "FIRST":
        return d.orderBy("term").limit(most)
    if q["limit"] == "MOST_FREQUENT":
        return d.orderBy(F.desc("termfreq"), "term").limit(most)
    if d.limit(most + 1).count() > most:
        raise QueryError(f"{q._text()} stands for more than {most} terms")
    return d
