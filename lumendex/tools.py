"""Command line: look at, check, compact and search an index.

python -m lumendex.tools delve INDEX [-r DID] [-t TERM] [-a] | check INDEX | compact INDEX... OUT | quest INDEX QUERY
| metadata INDEX get KEY | copy INDEX OUT | pos INDEX TERM DID
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.enquire import Enquire
from .plans.parser import DEFAULT_FLAGS, QueryParser
from .sources.catalog import Catalog
from .sources.writer import compacted


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lumendex", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    d = sub.add_parser("delve")
    d.add_argument("index"), d.add_argument("-r", type=int), d.add_argument("-t"), d.add_argument("-a", action="store_true")
    sub.add_parser("check").add_argument("index")
    c = sub.add_parser("compact")
    c.add_argument("indexes", nargs="+"), c.add_argument("out"), c.add_argument("--no-renumber", action="store_true")
    q = sub.add_parser("quest")
    q.add_argument("index"), q.add_argument("query"), q.add_argument("-m", type=int, default=10), q.add_argument("-s", default="none")
    m = sub.add_parser("metadata")
    m.add_argument("index"), m.add_argument("action", choices=["get", "list"]), m.add_argument("key", nargs="?", default="")
    y = sub.add_parser("copy")
    y.add_argument("index"), y.add_argument("out")
    o = sub.add_parser("pos")
    o.add_argument("index"), o.add_argument("term"), o.add_argument("did", type=int)
    a = p.parse_args(args)

    spark = SparkSession.builder.getOrCreate()
    if a.what == "compact":
        compacted([Catalog.open(spark, x) for x in a.indexes], not a.no_renumber).save(a.out)
        return 0
    k = Catalog.open(spark, a.index)
    if a.what == "delve":
        if a.r is not None:
            k.term_list(a.r).show(1000, False)
        elif a.t is not None:
            k.posting_list(a.t).orderBy("did").show(1000, False)
        elif a.a:
            k.termstats.orderBy("term").show(1000, False)
        else:
            k.collstats.show(truncate=False)
            k.slotstats.orderBy("slot").show(1000, False)
    elif a.what == "check":
        bad = k.checked().collect()
        print("\n".join(f"{r.problem}: {r.n}" for r in bad) or "No errors found")
        return int(bool(bad))
    elif a.what == "quest":
        query = QueryParser(a.s).parse(a.query, DEFAULT_FLAGS | {"wildcard", "pure_not"})
        print(f"Parsed query: {query.describe()}")
        Enquire(k, query).mset(0, a.m, percent=True).join(k.documents, "did").orderBy("rank").show(a.m, 120)
    elif a.what == "metadata":
        (k.metadata_keys(a.key) if a.action == "list" else k.metadata.where(k.metadata.key == a.key)).show(1000, False)
    elif a.what == "copy":
        k.save(a.out)
    elif a.what == "pos":
        k.position_list(a.term, a.did).show(100000, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
