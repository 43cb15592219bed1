"""Snippets: the passage of a text that says most about a query, with its words marked."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.analysis import tokenize
from ..functions.stem import ALIASES, stem


def snippet(text: str, weights: dict[str, float], length: int = 500, language: str = "none", start: str = "<b>", end: str = "</b>", omit: str = "...", background: bool = True) -> str:
    """At most about `length` bytes of text around the words with the largest weights.

    weights: of terms (stems begin with Z). Each further word of a kind counts less, so that varied passages win."""
    words = [(w, at) for w, placed, at in tokenize(text) if placed]
    stems = ALIASES.get(language, language) != "none"
    worth = [max(weights.get(w, 0.0), weights.get("Z" + stem(w, language), 0.0) if stems else 0.0) for w, _ in words]
    if len(text.encode()) <= length:
        a, b = 0, len(words)
    else:
        best, a, b, i, total = -1.0, 0, 0, 0, 0.0
        seen: dict[str, int] = {}
        for j, (w, at) in enumerate(words):
            total += worth[j] / (1 + seen.get(w, 0))
            seen[w] = seen.get(w, 0) + 1
            close = at + len(w)
            while i < j and len(text[words[i][1] : close].encode()) > length:
                first = words[i][0]
                seen[first] -= 1
                total -= worth[i] / (1 + seen[first])
                i += 1
            if total > best + 1e-12:
                best, a, b = total, i, j + 1
        if best <= 0:
            a, b = 0, next((j for j, (w, at) in enumerate(words) if len(text[: at + len(w)].encode()) > length), len(words))
        while b < len(words) and len(text[words[a][1] : words[b][1] + len(words[b][0])].encode()) <= length:
            b += 1
    if a >= b:
        return html.escape(text, quote=False) if len(text.encode()) <= length else ""
    lo, hi = (0 if a == 0 else words[a][1]), (len(text) if b == len(words) else words[b - 1][1] + len(words[b - 1][0]))
    out, at = [omit if lo else ""], lo
    for (w, p), x in zip(words[a:b], worth[a:b]):
        if x > 0:
            m = re.match(r"[\w'’&+#.,-]*", text[p : p + len(w)])
            size = len(m.group()) or len(w)
            out += [html.escape(text[at:p], quote=False), start, html.escape(text[p : p + size], quote=False), end]
            at = p + size
    out += [html.escape(text[at:hi], quote=False), omit if hi < len(text) else ""]
    return "".join(out)


def snippets(text: Column, weights: dict[str, float], length: int = 500, language: str = "none", **marks) -> Column:
    """snippet() over a column; the query's term weights go with the function."""

    @F.pandas_udf(StringType())
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: snippet(t or "", weights, length, language, **marks))

    return f(text)
