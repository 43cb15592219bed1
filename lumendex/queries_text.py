"""Registered queries on text and language: the search box, ranges, places, functions, ingest, streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .functions import analysis, encode, geo, scalar as fn
from .functions.stem import stemmed
from .operators.ast import Query as Q
from .operators.enquire import Enquire
from .operators.snippet import snippets
from .plans.parser import DEFAULT_FLAGS, QueryParser
from .plans.ranges import DateRange, NumberRange, Range, UnitRange
from .queries import BM25, PRE, T, _r, add, catalog, corpus, leaves, table
from .sources import catalog as cat
from .sources import ingest, writer
from .streaming import ingest as streaming

# ---- the search box: text is parsed and run


def box(name, text, sql, flags=(), setup=None, **options):
    @add(f"parse_{name}", sql)
    def _(s, d):
        p = QueryParser(**options)
        if setup:
            setup(p)
        q = p.parse(text, DEFAULT_FLAGS | set(flags))
        return Enquire(catalog(s, d), q).matches.select("did", _r("w").alias("w"))


_SUM = f"SELECT did, round(sum({BM25}), 6) AS w FROM m"
_ZERO = "SELECT did, CAST(0 AS DOUBLE) AS w FROM d"
box("words", "thing der", PRE + leaves("thing", "der") + _SUM + " GROUP BY did")
box("default_and", "thing of", PRE + leaves("thing", "of") + _SUM + " GROUP BY did HAVING count(*) = 2", default_op="AND")
box("and_or", "(thing AND of) OR der", PRE + leaves("thing", "of", "der") + f"SELECT did, round(sum({BM25}), 6) AS w FROM (SELECT *, count(*) FILTER (leaf < 2) OVER (PARTITION BY did) AS k FROM m) WHERE leaf = 2 OR k = 2 GROUP BY did")
box("xor", "thing XOR with", PRE + leaves("thing", "with") + _SUM + " GROUP BY did HAVING count(*) = 1")
box("not", "of NOT thing", PRE + leaves("of") + _SUM + " WHERE did NOT IN (SELECT did FROM p WHERE term = 'thing') GROUP BY did")
box("love_hate", "+of thing -der", PRE + leaves("of", "thing") + _SUM + " WHERE did NOT IN (SELECT did FROM p WHERE term = 'der') GROUP BY did HAVING min(leaf) = 0")
box("pure_not", "NOT the", PRE + _ZERO + " WHERE did NOT IN (SELECT did FROM p WHERE term = 'the')", ["pure_not"])
box("phrase", '"of the"', PRE + leaves("of", "the") + ", h AS (SELECT DISTINCT a.did FROM tok a JOIN tok b ON a.did = b.did AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the') " + _SUM + " WHERE did IN (SELECT did FROM h) GROUP BY did")
box("joined_words", "of-the", PRE + leaves("of", "the") + ", h AS (SELECT DISTINCT a.did FROM tok a JOIN tok b ON a.did = b.did AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the') " + _SUM + " WHERE did IN (SELECT did FROM h) GROUP BY did")
box("near", "of NEAR/4 thing", PRE + leaves("of", "thing") + ", h AS (SELECT DISTINCT a.did FROM tok a JOIN tok b ON a.did = b.did AND abs(b.pos - a.pos) < 5 WHERE a.term = 'of' AND b.term = 'thing') " + _SUM + " WHERE did IN (SELECT did FROM h) GROUP BY did")
box("adj", "of ADJ/3 thing", PRE + leaves("of", "thing") + ", h AS (SELECT DISTINCT a.did FROM tok a JOIN tok b ON a.did = b.did AND b.pos > a.pos AND b.pos - a.pos < 4 WHERE a.term = 'of' AND b.term = 'thing') " + _SUM + " WHERE did IN (SELECT did FROM h) GROUP BY did")
_EXPAND = """, s AS (SELECT * FROM ts WHERE {w}), e AS (SELECT floor((1 - exp(sum(ln(1 - s.n / nn)))) * any_value(nn) + 0.5) AS n FROM s, cs), x AS (SELECT p.did, p.f, ds.l, cs.* FROM p JOIN s USING (term) JOIN ds USING (did), cs)
SELECT did, round(""" + BM25 + """, 6) AS w FROM (SELECT did, least(sum(f), max(l)) AS f, max(l) AS l, any_value(e.n) AS n, any_value(nn) AS nn, any_value(avl) AS avl, 1 AS q FROM x, e GROUP BY did)"""
box("wildcard", "tionin*", PRE + _EXPAND.format(w="starts_with(term, 'tionin')"), ["wildcard"])
box("wildcard_glob", "w?th", PRE + _EXPAND.format(w="term LIKE 'w_th'"), ["wildcard_single"])
box("fuzzy", "thing~1", PRE + _EXPAND.format(w="abs(length(term) - 5) <= 1 AND damerau_levenshtein(term, 'thing') <= 1"), ["fuzzy"])
box("synonym", "~der", PRE + _EXPAND.format(w="term IN ('der', 'die', 'das')"), ["synonym"], synonyms={"der": ["die", "das"]})
box("filter_range", "thing 00000500..00001500", PRE + leaves("thing") + _SUM + " WHERE did IN (SELECT did FROM d WHERE len8 BETWEEN '00000500' AND '00001500') GROUP BY did", setup=lambda p: p.add_range(Range(2)))
box("number_range", "thing $500..1500", PRE + leaves("thing") + _SUM + " WHERE did IN (SELECT did FROM d WHERE n_chars BETWEEN 500 AND 1500) GROUP BY did", setup=lambda p: p.add_range(NumberRange(2, "$")))
box("open_range", "size:1000..", PRE + _ZERO + " WHERE n_chars >= 1000", setup=lambda p: p.add_range(NumberRange(2, "size:")))
box("unit_range", "size:..2K", PRE + _ZERO + " WHERE n_chars <= 2048", setup=lambda p: p.add_range(UnitRange(2, "size:")))
box("stop_words", "the thing of", PRE + leaves("thing") + _SUM + " GROUP BY did", stopwords=["the", "of"])
box("all_stop_words", "the of", PRE + leaves("the", "of") + _SUM + " GROUP BY did", stopwords=["the", "of"])


@add("parse_boolean_filter", PRE + leaves("thing") + _SUM + " JOIN d USING (did) WHERE lang IN ('en', 'fr') GROUP BY did")
def _(s, d):
    docs = corpus(s, d)
    p = QueryParser()
    p.add_boolean_prefix("lang", lambda v: Q.value_range(0, v, v))
    return Enquire(catalog(s, d), p.parse("thing lang:en lang:fr")).matches.select("did", _r("w").alias("w"))


@add("parse_field", """WITH c AS (SELECT conv_id + 1 AS did, unnest(regexp_extract_all(lower(text), '<word>')) AS term FROM conversations WHERE turn = 0) SELECT did, count(*) AS wdf FROM c WHERE term = 'the' GROUP BY did""")
def _(s, d):
    c = table(s, d, "conversations").where("turn = 0").select((F.col("conv_id") + 1).alias("did"), "text")
    k = cat.Catalog(c.select("did", F.col("text").alias("data")), cat.postings_of(cat.tokens_of(c, prefix="S")), s.createDataFrame([], "did long, slot int, value string, num double"))
    p = QueryParser()
    p.add_prefix("title", "S")
    q = p.parse("title:the")
    return Enquire(k, q).matches.join(k.posting_list(q.terms()[0]), "did").select("did", "wdf")


@add("date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1996-07-01'")
def _(s, d):
    o = table(s, d, "orders")
    q = DateRange(1)("19960101", "30/06/1996")
    k = cat.Catalog(o.select(F.col("o_orderkey").alias("did"), F.lit("").alias("data")), s.createDataFrame([], "term string, did long, wdf long, positions array<int>, doclen long, uniq long, wdfmax long"), cat.values_of(o.withColumnRenamed("o_orderkey", "did"), {1: F.date_format("o_orderdate", "yyyyMMdd")}))
    return Enquire(k, q).matches.select(F.col("did").alias("o_orderkey"))


@add("value_sort_collapse_orders", """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS k FROM orders WHERE o_totalprice >= 1000)
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS collapse_key, k - 1 AS collapse_count FROM r WHERE rn = 1""")
def _(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_orderkey", "did")
    values = cat.values_of(o, {0: F.col("o_custkey"), 1: F.col("o_totalprice")})
    k = cat.Catalog(o.select("did", F.lit("").alias("data")), s.createDataFrame([], "term string, did long, wdf long, positions array<int>, doclen long, uniq long, wdfmax long"), values)
    keys = o.select("did", "o_totalprice")
    e = Enquire(k, Q.number_range(1, 1000.0, None), sort="key", keys=keys, key=F.col("o_totalprice"), reverse=True, collapse_slot=0)
    return e.ranked().select(F.col("did").alias("o_orderkey"), "collapse_key", "collapse_count")


@add("facets_lineitem", "SELECT l_returnflag AS value, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 GROUP BY l_returnflag")
def _(s, d):
    return table(s, d, "lineitem").where(F.col("l_quantity").between(10, 20)).groupBy(F.col("l_returnflag").alias("value")).agg(F.count("*").alias("n"))


# ---- places: coordinates from ids

_LL = "WITH g AS (SELECT s_suppkey AS did, (s_suppkey * 37 % 1800) / 10.0 - 90 AS lat, (s_suppkey * 91 % 3600) / 10.0 - 180 AS lon FROM supplier), h AS (SELECT did, 2 * 6372797.6 * asin(sqrt(least(1, pow(sin(radians(lat - 51.5) / 2), 2) + pow(sin(radians(lon + 0.1) / 2), 2) * cos(radians(lat)) * cos(radians(51.5))))) AS dist FROM g) "


def _places(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("did"), ((F.col("s_suppkey") * 37 % 1800) / 10.0 - 90).alias("lat"), ((F.col("s_suppkey") * 91 % 3600) / 10.0 - 180).alias("lon"))


add("geo_distance", _LL + "SELECT did, round(dist, 2) AS dist FROM h")(lambda s, d: _places(s, d).select("did", F.round(geo.distance(F.col("lat"), F.col("lon"), 51.5, -0.1), 2).alias("dist")))


@add("geo_source", _LL + "SELECT did, round(1000 / (dist + 1000), 6) AS w FROM h WHERE dist <= 5000000")
def _(s, d):
    x = _places(s, d).select("did", F.array(F.struct("lat", "lon")).alias("places"))
    k = cat.Catalog(x.select("did", F.lit("").alias("data")), s.createDataFrame([], "term string, did long, wdf long, positions array<int>, doclen long, uniq long, wdfmax long"), s.createDataFrame([], "did long, slot int, value string, num double"))
    return Enquire(k, Q.source(geo.source(x, (51.5, -0.1), 5e6))).matches.select("did", _r("w").alias("w"))


add("geo_sort", _LL + "SELECT did FROM h ORDER BY dist, did LIMIT 20")(lambda s, d: _places(s, d).orderBy(geo.distance(F.col("lat"), F.col("lon"), 51.5, -0.1), "did").limit(20).select("did"))
add("geo_box", _LL + "SELECT did FROM g WHERE lat BETWEEN -20 AND 30 AND (lon >= 150 OR lon <= -120)")(lambda s, d: _places(s, d).where(geo.in_box(F.col("lat"), F.col("lon"), -20, 150, 30, -120)).select("did"))

# ---- scalar functions

_NUM = {
    "add": (lambda: fn.add("p_size", F.lit(7), F.lit("3x")), "CAST(p_size AS BIGINT) + 10"),
    "sub": (lambda: fn.sub("p_size", F.lit(9)), "CAST(p_size AS BIGINT) - 9"),
    "mul": (lambda: fn.mul("p_size", F.lit(3)), "CAST(p_size AS BIGINT) * 3"),
    "div": (lambda: fn.div("p_partkey", "p_size"), "CAST(p_partkey // p_size AS VARCHAR)"),
    "div0": (lambda: fn.div("p_partkey", F.lit(0)), "'divide by 0'"),
    "mod": (lambda: fn.mod("p_partkey", "p_size"), "CAST(p_partkey % p_size AS VARCHAR)"),
    "muldiv": (lambda: fn.muldiv("p_partkey", F.lit(7), "p_size"), "CAST(p_partkey * 7 // p_size AS VARCHAR)"),
    "max": (lambda: fn.max_("p_size", F.lit(25)), "greatest(CAST(p_size AS BIGINT), 25)"),
    "min": (lambda: fn.min_("p_size", F.lit(25)), "least(CAST(p_size AS BIGINT), 25)"),
    "nice": (lambda: fn.nice(fn.mul("p_partkey", F.lit(12345))), "format('{:,}', p_partkey * 12345)"),
    "ge": (lambda: fn.ge("p_size", F.lit(25)), "CASE WHEN p_size >= 25 THEN 'true' ELSE '' END"),
    "gt": (lambda: fn.gt("p_size", F.lit(25)), "CASE WHEN p_size > 25 THEN 'true' ELSE '' END"),
    "le": (lambda: fn.le("p_size", F.lit(25)), "CASE WHEN p_size <= 25 THEN 'true' ELSE '' END"),
    "lt": (lambda: fn.lt("p_size", F.lit(25)), "CASE WHEN p_size < 25 THEN 'true' ELSE '' END"),
    "pack": (lambda: F.hex(fn.pack("p_partkey")), "upper(lpad(hex(p_partkey), 8, '0'))"),
    "unpack": (lambda: fn.unpack(fn.pack("p_partkey")), "p_partkey"),
    "chr": (lambda: fn.chr_(fn.add("p_size", F.lit(200))), "chr(p_size + 200)"),
    "ord": (lambda: fn.ord_("p_name"), "CAST(unicode(p_name) AS BIGINT)"),
    "lastpage": (lambda: fn.lastpage("p_partkey", F.lit(10)), "CAST(ceil(p_partkey / 10.0) AS BIGINT)"),
    "thispage": (lambda: fn.thispage("p_partkey", F.lit(10)), "p_partkey // 10 + 1"),
    "subdb": (lambda: fn.subdb(fn.add("p_partkey", F.lit(1)), 3), "p_partkey % 3"),
    "subid": (lambda: fn.subid(fn.add("p_partkey", F.lit(1)), 3), "p_partkey // 3 + 1"),
    "filesize": (lambda: fn.filesize("p_partkey", "K"), "CASE WHEN p_partkey = 1 THEN '1 byte' WHEN p_partkey < 1024 THEN p_partkey || ' bytes' ELSE CAST(round(p_partkey / 1024.0, 1) AS VARCHAR) || 'K' END"),
    "date": (lambda: fn.date(fn.mul("p_partkey", F.lit(86400))), "strftime(CAST('1970-01-01' AS DATE) + CAST(p_partkey AS INTEGER), '%Y-%m-%d')"),
}
_TXT = {
    "lower": (lambda: fn.lower("p_brand"), "lower(p_brand)"),
    "upper": (lambda: fn.upper("p_name"), "upper(p_name)"),
    "eq": (lambda: fn.eq("p_size", F.lit(5)), "CASE WHEN p_size = 5 THEN 'true' ELSE '' END"),
    "ne": (lambda: fn.ne("p_size", F.lit(5)), "CASE WHEN p_size != 5 THEN 'true' ELSE '' END"),
    "and": (lambda: fn.and_("p_name", F.lit("x")), "'true'"),
    "or": (lambda: fn.or_(F.lit(""), "p_name"), "p_name"),
    "not": (lambda: fn.not_("p_name"), "''"),
    "if": (lambda: fn.if_(fn.gt("p_size", F.lit(25)), "p_name", "p_type"), "CASE WHEN p_size > 25 THEN p_name ELSE p_type END"),
    "cond": (lambda: fn.cond(fn.gt("p_size", F.lit(40)), "big", fn.gt("p_size", F.lit(20)), "middle", "small"), "CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 20 THEN 'middle' ELSE 'small' END"),
    "switch": (lambda: fn.switch(F.col("p_size").cast("string"), "1", "one", "2", "two", "many"), "CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END"),
    "substr": (lambda: fn.substr("p_name", 2, 3), "substr(p_name, 3, 3)"),
    "substr_end": (lambda: fn.substr("p_name", -4), "right(p_name, 4)"),
    "contains": (lambda: fn.contains(F.lit("e"), "p_name"), "CASE WHEN strpos(p_name, 'e') > 0 THEN CAST(strpos(p_name, 'e') - 1 AS VARCHAR) ELSE '' END"),
    "html": (lambda: fn.html(F.concat(F.lit('<a b="&">'), "p_name")), "'&lt;a b=&quot;&amp;&quot;&gt;' || p_name"),
    "htmlstrip": (lambda: fn.htmlstrip(F.concat(F.lit("<b>"), "p_name", F.lit("</b>"))), "p_name"),
    "url": (lambda: fn.url("p_type"), "url_encode(p_type)"),
    "csv": (lambda: fn.csv(F.concat("p_name", F.lit(',"'))), "'\"' || p_name || ',\"\"\"'"),
    "base64": (lambda: fn.base64("p_name"), "base64(encode(p_name))"),
    "hash": (lambda: fn.hash_("p_name"), "md5(p_name)"),
    "match": (lambda: fn.match("^[a-m]", "p_name", "i"), "CASE WHEN regexp_matches(p_name, '^[a-mA-M]') THEN 'true' ELSE '' END"),
    "transform": (lambda: fn.transform("([aeiou])", r"<\1>", "p_name", "g"), r"regexp_replace(p_name, '([aeiou])', '<\1>', 'g')"),
    "transform_first": (lambda: fn.transform("[aeiou]", "_", "p_name"), "regexp_replace(p_name, '[aeiou]', '_')"),
    "hostname": (lambda: fn.hostname(F.concat(F.lit("http://"), "p_size", F.lit(".example.org:80/a?b"))), "p_size || '.example.org'"),
    "termprefix": (lambda: fn.termprefix(F.concat(F.lit("XAB:"), "p_name")), "'XAB'"),
    "unprefix": (lambda: fn.unprefix(F.concat(F.lit("S"), fn.lower("p_name"))), "lower(p_name)"),
    "prettyterm": (lambda: fn.prettyterm(F.concat(F.lit("ZS"), fn.lower("p_name"))), "lower(p_name) || '.'"),
    "highlight": (lambda: fn.highlight(F.lit("a b & c"), ["b"]), "'a <b>b</b> &amp; c'"),
    "json": (lambda: fn.json(F.concat("p_name", F.lit('"\\'))), "p_name || '\\\"\\\\'"),
    "prettyurl": (lambda: fn.prettyurl("p_type"), "p_type"),
    "field": (lambda: fn.field(F.concat(F.lit("a=1\nname="), "p_name", F.lit("\nz=2")), "name"), "p_name"),
}
_LST = {
    "split": (lambda: fn.split("p_type", " "), "string_split(p_type, ' ')"),
    "length": (lambda: fn.length(fn.split("p_type", " ")), "CAST(len(string_split(p_type, ' ')) AS INTEGER)"),
    "list": (lambda: fn.list_(fn.split("p_type", " "), "(", ", ", ")"), "'(' || array_to_string(string_split(p_type, ' '), ', ') || ')'"),
    "foreach": (lambda: fn.foreach(fn.split("p_type", " "), lambda x: F.concat(F.lit("["), x, F.lit("]"))), "'[' || array_to_string(string_split(p_type, ' '), '][') || ']'"),
    "map": (lambda: fn.map_(fn.split("p_type", " "), F.lower), "list_transform(string_split(p_type, ' '), lambda x: lower(x))"),
    "find": (lambda: fn.find(fn.split("p_type", " "), "BRASS"), "CASE WHEN list_position(string_split(p_type, ' '), 'BRASS') > 0 THEN CAST(list_position(string_split(p_type, ' '), 'BRASS') - 1 AS VARCHAR) ELSE '' END"),
    "range": (lambda: fn.range_(F.lit(1), "p_size"), "list_transform(range(1, p_size + 1), lambda x: CAST(x AS VARCHAR))"),
    "slice": (lambda: fn.slice_(fn.split("p_type", " "), F.array(F.lit(1), F.lit(0), F.lit(9))), "list_filter([string_split(p_type, ' ')[2], string_split(p_type, ' ')[1]], lambda x: x IS NOT NULL)"),
    "sort": (lambda: fn.sort(fn.split("p_name", "")), "list_sort(string_split(p_name, ''))"),
    "sort_unique_reverse": (lambda: fn.sort(fn.split("p_name", ""), "ru"), "list_reverse_sort(list_distinct(string_split(p_name, '')))"),
    "uniq": (lambda: fn.uniq(F.array(F.lit("a"), F.lit("a"), "p_brand", "p_brand", F.lit("a"))), "['a', p_brand, 'a']"),
    "unique": (lambda: fn.unique(F.array(F.lit("a"), "p_brand", F.lit("a"))), "['a', p_brand]"),
    "keys": (lambda: fn.keys(fn.setmap("b", F.col("p_name"), "a", F.col("p_type"))), "['a', 'b']"),
    "opt": (lambda: fn.opt(fn.setmap("b", F.col("p_name")), "b"), "p_name"),
    "jsonarray": (lambda: fn.jsonarray(fn.split("p_type", " ")), "'[\"' || array_to_string(string_split(p_type, ' '), '\",\"') || '\"]'"),
    "jsonobject": (lambda: fn.jsonobject(fn.setmap("k", F.col("p_name"))), "'{\"k\":\"' || p_name || '\"}'"),
    "jsonobject2": (lambda: fn.jsonobject2(F.array(F.lit("k")), F.array("p_name")), "'{\"k\":\"' || p_name || '\"}'"),
    "jsonbool": (lambda: fn.jsonbool("p_name"), "'true'"),
}


for _kind, _set in (("number", _NUM), ("text", _TXT), ("list", _LST)):

    @add(f"functions_{_kind}", "SELECT p_partkey, " + ", ".join(f"{e} AS f_{k}" for k, (_, e) in _set.items()) + " FROM part")
    def _(s, d, made=_set):
        return table(s, d, "part").select("p_partkey", *[_named(c).alias(f"f_{k}") for k, (c, _) in made.items()])


def _named(make):
    """The functions take columns or literals; here bare names of the part table are columns."""
    old = fn._c
    fn._c = lambda x: x if not isinstance(x, str) else F.col(x) if x.startswith("p_") else F.lit(x)
    try:
        return make()
    finally:
        fn._c = old


add("function_truncate")(lambda s, d: table(s, d, "documents").select("doc_id", fn.truncate(F.col("text"), 60, "...").alias("t")))


def _sortable(s, d):
    """Places by the encoded bytes are places by number."""
    @F.pandas_udf(BinaryType())
    def key(x: pd.Series) -> pd.Series:
        return x.map(encode.sortable)

    x = table(s, d, "orders").select("o_orderkey", F.struct(key("o_totalprice").alias("k"), "o_orderkey").alias("order"))
    return writer.numbered(x, "order").select("o_orderkey", F.col("did").alias("place"))


add("encode_sortable", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")(_sortable)

# ---- analysis and ingest

add("ngrams_and_unicode_terms")(lambda s, d: analysis.TermGenerator("none", "none", ngrams=True).counts(corpus(s, d)))
add("term_generator_english")(lambda s, d: analysis.TermGenerator("english", "some", tuple(analysis.STOPWORDS["english"])).counts(corpus(s, d)))
# the words that the query is given; the whole list is longer
_FEW = "a about an and are as at be by en for from how i in is it of on or that the this to was what when where which who why will with you your".split()
add("stop_words", PRE + "SELECT term, count(*) AS termfreq FROM p WHERE term NOT IN (" + ", ".join(f"'{w}'" for w in _FEW) + ") GROUP BY term")(
    lambda s, d: catalog(s, d).termstats.where(~F.col("term").isin(_FEW)).select("term", "termfreq")
)
for _lang in ("english", "porter", "french", "german", "spanish"):
    add(f"stem_{_lang}")(lambda s, d, lang=_lang: catalog(s, d).termstats.select("term", stemmed(F.col("term"), lang).alias("stem")))
add("html_parts")(lambda s, d: analysis.extracted(table(s, d, "pages")))
add("index_pages")(lambda s, d: ingest.pages_catalog(table(s, d, "pages")).termstats)
add("snippets")(lambda s, d: corpus(s, d).select("did", snippets(F.col("text"), {"thing": 2.0, "with": 1.0}, 200).alias("snippet")))


@add("date_terms", "SELECT o_orderkey, unnest(['D' || strftime(o_orderdate, '%Y%m%d'), 'M' || strftime(o_orderdate, '%Y%m'), 'Y' || strftime(o_orderdate, '%Y')]) AS term FROM orders")
def _(s, d):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return table(s, d, "orders").select("o_orderkey", F.explode(F.array(F.concat(F.lit("D"), day), F.concat(F.lit("M"), F.substring(day, 1, 6)), F.concat(F.lit("Y"), F.substring(day, 1, 4)))).alias("term"))


@add("index_script", """WITH w AS (SELECT p_partkey + 1 AS did, unnest(regexp_extract_all(lower(p_name), '<word>')) AS term FROM part)
SELECT did, term, CAST(2 * count(*) AS BIGINT) AS wdf FROM w GROUP BY did, term UNION ALL SELECT p_partkey + 1, 'XB:' || p_brand, CAST(0 AS BIGINT) FROM part UNION ALL SELECT p_partkey + 1, 'Q' || p_partkey, CAST(0 AS BIGINT) FROM part""")
def _(s, d):
    p = table(s, d, "part")
    fields = F.create_map(F.lit("id"), F.array(F.col("p_partkey").cast("string")), F.lit("name"), F.array("p_name"), F.lit("brand"), F.array("p_brand"), F.lit("size"), F.array(F.col("p_size").cast("string")))
    script = "id : unique=Q field\nname : weight=2 index field=title\nbrand : boolean=XB\nsize : valuenumeric=3\n"
    return ingest.scripted(p.select((F.col("p_partkey") + 1).alias("did"), fields.alias("fields")), script).postings.select("did", "term", "wdf")


@add("percolate", PRE + "SELECT did, 'a' AS query FROM p WHERE term IN ('thing', 'of') GROUP BY did HAVING count(*) = 2 UNION ALL SELECT did, 'b' FROM p WHERE term = 'der'")
def _(s, d):
    q = s.createDataFrame([("a", "thing"), ("a", "of"), ("b", "der")], "query string, term string")
    return streaming.percolate(corpus(s, d), q)


# ---- streams, run to their end over files

def _drain(s, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(name)


def _stream(s, d, name):
    t = table(s, d, name)
    return s.readStream.schema(t.schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "false").parquet(f"{d}/{name}.parq*")


@add("stream_running_facets", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def _(s, d):
    return _drain(s, streaming.running_facets(_stream(s, d, "events").withColumnRenamed("event_type", "value_").select(F.col("value_").alias("value"))), "complete", "facets_now")


@add("stream_windowed_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    return _drain(s, streaming.windowed_counts(_stream(s, d, "events"), size="1 hour"), "complete", "windows_now").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


# ---- requests of a search page

def request(name, params, sql, **options):
    @add(f"request_{name}", sql)
    def _(s, d):
        from .plans.request import Request

        return Request(catalog(s, d), params, QueryParser(), **options).page().select("did", "rank", _r("w").alias("w"))


_PAGE = "SELECT did, CAST(row_number() OVER ({o}) - 1 AS INTEGER) AS rank, round(w, 6) AS w FROM ({q}) ORDER BY rank LIMIT {n} OFFSET {k}"
request("words_and_paging", {"P": ["thing der"], "TOPDOC": ["10"], "HITSPERPAGE": ["15"]}, PRE + leaves("thing", "der") + _PAGE.format(o="ORDER BY w DESC, did", q=f"SELECT did, sum({BM25}) AS w FROM m GROUP BY did", n=15, k=10))
request("two_boxes_are_anded", {"P": ["thing", "with"], "HITSPERPAGE": ["20"]}, PRE + leaves("thing", "with") + _PAGE.format(o="ORDER BY w DESC, did", q=f"SELECT did, sum({BM25}) AS w FROM m GROUP BY did HAVING count(*) = 2", n=20, k=0))
request("sort_and_collapse", {"P": ["thing"], "SORT": ["-2"], "COLLAPSE": ["1"], "HITSPERPAGE": ["30"]}, PRE + leaves("thing") + _PAGE.format(o="ORDER BY len8 DESC, w DESC, did", q=f"SELECT * FROM (SELECT did, {BM25} AS w, len8, row_number() OVER (PARTITION BY source ORDER BY len8 DESC, {BM25} DESC, did) AS rn FROM m JOIN d USING (did)) WHERE rn = 1", n=30, k=0))
request("exclude", {"P": ["of"], "N": ["thing", "der"], "HITSPERPAGE": ["25"], "DOCIDORDER": ["D"]}, PRE + leaves("of") + _PAGE.format(o="ORDER BY w DESC, did DESC", q=f"SELECT did, sum({BM25}) AS w FROM m WHERE did NOT IN (SELECT did FROM p WHERE term IN ('thing', 'der')) GROUP BY did", n=25, k=0))


@add("request_date_terms", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-12-30' AND o_orderdate < '1997-02-03'")
def _(s, d):
    from .plans.request import Request

    o = table(s, d, "orders").withColumnRenamed("o_orderkey", "did")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    tokens = None
    for prefix, value in (("D", day), ("M", F.substring(day, 1, 6)), ("Y", F.substring(day, 1, 4))):
        t = cat.boolean_tokens(o, prefix, value)
        tokens = t if tokens is None else tokens.unionByName(t)
    k = cat.Catalog(o.select("did", F.lit("").alias("data")), cat.postings_of(tokens), s.createDataFrame([], "did long, slot int, value string, num double"))
    return Request(k, {"START": ["19951230"], "END": ["19970202"]}, QueryParser()).session().matches.select(F.col("did").alias("o_orderkey"))


@add("request_filter_terms", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3")
def _(s, d):
    from .plans.request import Request

    c = table(s, d, "customer").withColumnRenamed("c_custkey", "did")
    tokens = cat.boolean_tokens(c, "XSEG:", F.col("c_mktsegment")).unionByName(cat.boolean_tokens(c, "XNAT", F.col("c_nationkey").cast("string")))
    k = cat.Catalog(c.select("did", F.lit("").alias("data")), cat.postings_of(tokens), s.createDataFrame([], "did long, slot int, value string, num double"))
    return Request(k, {"B": ["XSEG:BUILDING", "XSEG:MACHINERY", "XNAT3"]}, QueryParser()).session().matches.select(F.col("did").alias("c_custkey"))


# ---- the remaining tables of a catalog

def _more_tables(s, d):
    p, n = table(s, d, "part"), table(s, d, "nation")
    return catalog(s, d).with_tables(
        metadata=n.select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value")),
        synonyms=p.select(F.lower("p_brand").alias("term"), F.lower("p_type").alias("synonym")).distinct(),
        spelling=p.groupBy(F.lower("p_name").alias("word")).agg(F.count("*").alias("freq")),
    )


add("metadata_get", "SELECT 'nation/7' AS key, n_name AS value FROM nation WHERE n_nationkey = 7")(lambda s, d: _more_tables(s, d).metadata.where("key = 'nation/7'"))
add("metadata_keys", "SELECT 'nation/' || n_nationkey AS key FROM nation WHERE n_nationkey BETWEEN 10 AND 19 OR n_nationkey = 1")(lambda s, d: _more_tables(s, d).metadata_keys("nation/1"))
add("scan_spelling", "SELECT lower(p_name) AS word, count(*) AS freq FROM part GROUP BY lower(p_name)")(lambda s, d: _more_tables(s, d).spelling)
add("scan_synonym_keys", "SELECT lower(p_brand) AS term, count(DISTINCT lower(p_type)) AS n FROM part GROUP BY 1")(lambda s, d: _more_tables(s, d).synonyms.groupBy("term").agg(F.count("*").alias("n")))
add("result_diversification")(lambda s, d: _diversified(s, d))


def _diversified(s, d):
    from .operators import cluster

    c = catalog(s, d)
    top = Enquire(c, Q.of("OR", T("thing", "der", "with"))).mset(0, 50).orderBy("rank").collect()
    order = cluster.diversified(cluster.page_matrix(c, [r.did for r in top]), [r.w for r in top], 20, 10)
    return s.createDataFrame([(k, top[i].did) for k, i in enumerate(order)], "place int, did long")
