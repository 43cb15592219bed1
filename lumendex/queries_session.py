"""Registered queries on sessions: ranking, paging, collapsing, facets, expansion, scans, statistics, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import weights as W
from .operators import clicks, cluster, eset, letor, spelling
from .operators.ast import Query as Q
from .operators.enquire import Enquire
from .operators.match import Matcher
from .queries import _REL, BM25, PRE, T, _r, add, catalog, corpus, judged, leaves, table
from .sources import catalog as cat
from .sources import writer

_OR = lambda: Q.of("OR", T("thing", "der", "with"))
_M = PRE + leaves("thing", "der", "with") + f", x AS (SELECT did, sum({BM25}) AS w, count(*) AS subqs FROM m GROUP BY did), xv AS (SELECT x.*, lang, source, len8 FROM x JOIN d USING (did))\n"


def page(name, order_sql, first=0, n=20, **options):
    @add(f"mset_{name}", _M + f"SELECT did, round(w, 6) AS w FROM xv ORDER BY {order_sql} LIMIT {n} OFFSET {first}")
    def _(s, d):
        return Enquire(catalog(s, d), _OR(), **options).mset(first, n).select("did", _r("w").alias("w"))


page("relevance", "w DESC, did")
page("second_page", "w DESC, did", first=20)
page("descending_ids", "w DESC, did DESC", descending_ids=True)
page("by_value", "len8, did", sort="value", slot=2)
page("by_value_reverse", "len8 DESC, did", sort="value", slot=2, reverse=True)
page("value_then_relevance", "source, w DESC, did", sort="value_relevance", slot=1)
page("relevance_then_value", "w DESC, len8 DESC, did", sort="relevance_value", slot=2, reverse=True)


@add("mset_by_key", _M + "SELECT did, round(w, 6) AS w FROM xv ORDER BY lang, source DESC, did LIMIT 25")
def _(s, d):
    keys = catalog(s, d).value_stream(0).select("did", F.col("value").alias("a")).join(catalog(s, d).value_stream(1).select("did", F.col("value").alias("b")), "did", "full")
    e = Enquire(catalog(s, d), _OR())
    x = e.ranked().join(keys, "did", "left").na.fill("", ["a", "b"])
    return x.orderBy("a", F.desc("b"), "did").limit(25).select("did", _r("w").alias("w"))


@add("mset_rank_and_percent", _M + """, t AS (SELECT w AS tw, subqs AS ts FROM x ORDER BY w DESC, did LIMIT 1)
SELECT CAST(row_number() OVER (ORDER BY w DESC, did) - 1 AS INTEGER) AS rank, did, CAST(greatest(1, least(100, floor(w * (ts / 3.0 / tw * 100.0) + 2.220446049250313e-14))) AS INTEGER) AS percent FROM x, t ORDER BY w DESC, did LIMIT 50""")
def _(s, d):
    return Enquire(catalog(s, d), _OR()).mset(0, 50, percent=True).select("rank", "did", "percent")


@add("mset_percent_cutoff", _M + """, t AS (SELECT w AS tw, subqs AS ts FROM x ORDER BY w DESC, did LIMIT 1)
SELECT did, round(w, 6) AS w FROM x, t WHERE greatest(1, least(100, floor(w * (ts / 3.0 / tw * 100.0) + 2.220446049250313e-14))) >= 40""")
def _(s, d):
    return Enquire(catalog(s, d), _OR(), percent_cutoff=40).ranked().select("did", _r("w").alias("w"))


@add("mset_weight_cutoff", _M + "SELECT did, round(w, 6) AS w FROM x WHERE w >= 1.0")
def _(s, d):
    return Enquire(catalog(s, d), _OR(), weight_cutoff=1.0).ranked().select("did", _r("w").alias("w"))


for _n in (1, 3):

    @add(f"mset_collapse_{_n}", _M + f""", r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, did) AS rn, count(*) OVER (PARTITION BY source) AS k FROM xv)
SELECT did, source AS collapse_key, CAST(greatest(0, k - {_n}) AS BIGINT) AS collapse_count FROM r WHERE rn <= {_n}""")
    def _(s, d, n=_n):
        return Enquire(catalog(s, d), _OR(), collapse_slot=1, collapse_max=n).ranked().select("did", "collapse_key", "collapse_count")


@add("mset_counts", _M + "SELECT count(*) AS matches, round(max(w), 6) AS max_attained FROM x")
def _(s, d):
    return Enquire(catalog(s, d), _OR()).count().select("matches", _r("max_attained").alias("max_attained"))


@add("mset_facets", _M + "SELECT lang AS value, count(*) AS n FROM xv GROUP BY lang")
def _(s, d):
    return Enquire(catalog(s, d), _OR()).facet(0)


@add("mset_facets_top", _M + "SELECT source AS value, count(*) AS n FROM xv GROUP BY source ORDER BY n DESC, value LIMIT 5")
def _(s, d):
    return Enquire(catalog(s, d), _OR()).facet(1, 5)


@add("mset_matching_terms", _M + "SELECT did, list(term ORDER BY leaf) AS terms FROM m GROUP BY did")
def _(s, d):
    return Enquire(catalog(s, d), _OR()).matching_terms()


@add("mset_reweighted", _M + "SELECT did, round(w * len(did::VARCHAR), 6) AS w FROM x ORDER BY w * len(did::VARCHAR) DESC, did LIMIT 30")
def _(s, d):
    e = Enquire(catalog(s, d), _OR())
    return e.reweighted(e.matches.select("did", (F.col("w") * F.length(F.col("did").cast("string"))).alias("w"))).mset(0, 30).select("did", _r("w").alias("w"))


@add("mset_match_decider", _M + "SELECT did, round(w, 6) AS w FROM x WHERE did % 3 = 0")
def _(s, d):
    return Enquire(catalog(s, d), _OR(), decider=lambda x: x.where("did % 3 = 0")).matches.select("did", _r("w").alias("w"))


@add("mset_value_set_decider", _M + "SELECT did, round(w, 6) AS w FROM xv WHERE lang NOT IN ('en', 'fr')")
def _(s, d):
    c = catalog(s, d)
    out = c.value_stream(0).where(F.col("value").isin("en", "fr")).select("did")
    return Enquire(c, _OR(), decider=lambda x: x.join(out, "did", "left_anti")).matches.select("did", _r("w").alias("w"))


# ---- posting sources

def _found(s, d, q):
    return Enquire(catalog(s, d), q).matches.select("did", _r("w").alias("w"))


@add("source_value_weight", PRE + "SELECT did, CAST(n_chars AS DOUBLE) AS w FROM d")
def _(s, d):
    return _found(s, d, Q.source(lambda c: c.value_stream(2).select("did", F.col("num").alias("w"))))


@add("source_value", PRE + "SELECT did, CAST(0 AS DOUBLE) AS w FROM d WHERE lang != ''")
def _(s, d):
    return _found(s, d, Q.source(lambda c: c.value_stream(0).select("did", F.lit(0.0).alias("w"))))


@add("source_value_map", PRE + "SELECT did, CAST(CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 ELSE 0.5 END AS DOUBLE) AS w FROM d")
def _(s, d):
    m = F.create_map(F.lit("en"), F.lit(3.0), F.lit("de"), F.lit(2.0))
    return _found(s, d, Q.source(lambda c: c.value_stream(0).select("did", F.coalesce(F.try_element_at(m, "value"), F.lit(0.5)).alias("w"))))


@add("source_fixed", PRE + "SELECT did, CAST(2.5 AS DOUBLE) AS w FROM d")
def _(s, d):
    return _found(s, d, Q.source(lambda c: c.documents.select("did", F.lit(2.5).alias("w"))))


@add("source_with_term", PRE + leaves("thing") + f"SELECT did, round({BM25} + n_chars / 1000.0, 6) AS w FROM m JOIN d USING (did)")
def _(s, d):
    return _found(s, d, Q.of("AND", [Q.term("thing"), Q.source(lambda c: c.value_stream(2).select("did", (F.col("num") / 1000).alias("w")))]))


# ---- scans and statistics

@add("scan_posting_list", """WITH d AS (SELECT doc_id + 1 AS did, regexp_extract_all(lower(text), '<word>') AS ws FROM documents)
SELECT did, CAST(len(list_filter(ws, lambda x: x = 'the')) AS BIGINT) AS wdf, CAST(len(ws) AS BIGINT) AS doclen, CAST(len(list_distinct(ws)) AS BIGINT) AS uniq,
CAST(list_max(map_values(list_aggregate(ws, 'histogram'))) AS BIGINT) AS wdfmax FROM d WHERE list_contains(ws, 'the')""")
def _(s, d):
    return catalog(s, d).posting_list("the").select("did", "wdf", "doclen", "uniq", "wdfmax")


@add("scan_all_documents", PRE + "SELECT did, l AS doclen FROM ds")
def _(s, d):
    return catalog(s, d).posting_list("").select("did", "doclen")


@add("scan_term_list", PRE + "SELECT term, f AS wdf, n AS termfreq FROM p JOIN ts USING (term) WHERE did = 7")
def _(s, d):
    return catalog(s, d).term_list(7).select("term", "wdf", "termfreq")


@add("scan_positions", PRE + "SELECT CAST(pos AS INTEGER) AS pos FROM tok WHERE term = 'the' AND did = 2")
def _(s, d):
    return catalog(s, d).position_list("the", 2)


@add("scan_dictionary", PRE + "SELECT term, n AS termfreq, c AS collfreq, ub AS wdf_ub FROM ts WHERE starts_with(term, 'th')")
def _(s, d):
    return catalog(s, d).all_terms("th")


@add("scan_value_stream", PRE + "SELECT did, lang AS value FROM d")
def _(s, d):
    return catalog(s, d).value_stream(0).select("did", "value")


@add("scan_document", "SELECT doc_id + 1 AS did, text AS data FROM documents WHERE doc_id = 11")
def _(s, d):
    return catalog(s, d).document(12)


@add("stats_collection", PRE + "SELECT count(*) AS n, CAST(sum(l) AS BIGINT) AS total_len, round(avg(l), 6) AS avg_len, CAST(min(l) AS BIGINT) AS len_min, CAST(max(l) AS BIGINT) AS len_max, min(u) AS uniq_min, max(u) AS uniq_max, max(did) AS last_did FROM ds")
def _(s, d):
    return catalog(s, d).collstats.withColumn("avg_len", _r("avg_len"))


@add("stats_documents", PRE + "SELECT did, CAST(l AS BIGINT) AS doclen, u AS uniq, CAST(m AS BIGINT) AS wdfmax FROM ds")
def _(s, d):
    return catalog(s, d).docstats.select("did", "doclen", "uniq", "wdfmax")


@add("stats_terms", PRE + "SELECT term, n AS termfreq, c AS collfreq, ub AS wdf_ub FROM ts")
def _(s, d):
    return catalog(s, d).termstats


@add("stats_slots", PRE + "SELECT 0 AS slot, count(*) AS freq, min(lang) AS lo, max(lang) AS hi FROM d UNION ALL SELECT 1, count(*), min(source), max(source) FROM d UNION ALL SELECT 2, count(*), min(len8), max(len8) FROM d")
def _(s, d):
    return catalog(s, d).slotstats


@add("reconstruct_text", PRE + "SELECT did, string_agg(term, ' ' ORDER BY pos) AS text FROM tok GROUP BY did")
def _(s, d):
    return catalog(s, d).reconstruct_text()


@add("check_catalog", "SELECT '' AS problem, CAST(0 AS BIGINT) AS n WHERE false")
def _(s, d):
    return catalog(s, d).checked()


@add("boolean_terms", "SELECT doc_id + 1 AS did, 'L' || lang AS term FROM documents WHERE lang IN ('de', 'fr')")
def _(s, d):
    docs = corpus(s, d)
    p = cat.postings_of(cat.boolean_tokens(docs, "L", F.col("lang")))
    return p.where(F.col("term").isin("Lde", "Lfr")).where("wdf = 0 and doclen = 0").select("did", "term")


# ---- shards and changes

def _part(s, d, k):
    docs = table(s, d, "documents").where(f"doc_id % 2 = {k}").select((F.floor(F.col("doc_id") / 2) + 1).cast("long").alias("did"), "text", "lang")
    return cat.from_text(docs, {0: F.col("lang")})


@add("shards_union", PRE + leaves("thing") + f"SELECT did, round({BM25}, 6) AS w FROM m")
def _(s, d):
    # document k of shard i is document (k - 1) * 2 + i + 1: the corpus again
    return Enquire(cat.Catalog.union([_part(s, d, 0), _part(s, d, 1)]), Q.term("thing")).matches.select("did", _r("w").alias("w"))


@add("compact_renumbered", PRE + "SELECT CASE WHEN (did - 1) % 2 = 0 THEN (did - 1) // 2 + 1 ELSE (SELECT count(*) FROM d WHERE (did - 1) % 2 = 0) + (did - 1) // 2 + 1 END AS did, CAST(l AS BIGINT) AS doclen FROM ds")
def _(s, d):
    return writer.compacted([_part(s, d, 0), _part(s, d, 1)]).docstats.select("did", "doclen")


@add("delete_by_term", PRE + "SELECT term, count(*) AS termfreq FROM p WHERE did NOT IN (SELECT did FROM p WHERE term = 'thing') GROUP BY term")
def _(s, d):
    return writer.deleted_by_term(catalog(s, d), "thing").termstats.select("term", "termfreq")


@add("delete_by_id", PRE + "SELECT did, CAST(l AS BIGINT) AS doclen FROM ds WHERE did % 5 != 0")
def _(s, d):
    c = catalog(s, d)
    return writer.deleted(c, c.documents.where("did % 5 = 0")).docstats.select("did", "doclen")


@add("replace_documents", PRE + "SELECT did, CAST(CASE WHEN did % 5 = 0 THEN 3 ELSE l END AS BIGINT) AS doclen FROM ds")
def _(s, d):
    c = catalog(s, d)
    new = c.documents.where("did % 5 = 0").select("did", F.lit("only three words").alias("text"))
    return writer.merged(c, cat.from_text(new)).docstats.select("did", "doclen")


@add("replace_by_unique_term", """WITH n AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS k FROM pages WHERE page_id % 2 = 1)
SELECT page_id AS key, CASE WHEN page_id % 2 = 0 THEN page_id + 1 ELSE (SELECT max(page_id) + 1 FROM pages WHERE page_id % 2 = 0) + k END AS did FROM pages LEFT JOIN n USING (page_id)""")
def _(s, d):
    p = table(s, d, "pages")

    def make(x):
        tokens = cat.boolean_tokens(x, "Q", F.lpad(F.col("key"), 12, "0"))
        return cat.Catalog(x.select("did", F.col("key").alias("data")), cat.postings_of(tokens), s.createDataFrame([], "did long, slot int, value string, num double"))

    key = F.lpad(F.col("page_id").cast("string"), 12, "0")
    old = make(p.where("page_id % 2 = 0").select((F.col("page_id") + 1).alias("did"), key.alias("key")))
    out = writer.replaced_by_term(old, p.select(key.alias("key")), "Q", make, old.stats["last_did"])
    return out.documents.select(F.col("data").cast("long").alias("key"), "did")


@add("add_documents", PRE + "SELECT did + (SELECT max(did) FROM d) AS did, CAST(l AS BIGINT) AS doclen FROM ds UNION ALL SELECT did, CAST(l AS BIGINT) FROM ds")
def _(s, d):
    c = catalog(s, d)
    new = writer.numbered(table(s, d, "documents").select("doc_id", "text"), "doc_id", c.stats["last_did"])
    return writer.merged(c, cat.from_text(new.select("did", "text"))).docstats.select("did", "doclen")


@add("edit_documents", PRE + "SELECT did, CAST(l + CASE WHEN did % 4 = 0 THEN 2 ELSE 0 END AS BIGINT) AS doclen, u + CASE WHEN did % 4 = 0 THEN 1 ELSE 0 END AS uniq FROM ds")
def _(s, d):
    c = catalog(s, d)
    more = c.documents.where("did % 4 = 0").select("did", F.lit("zzznew").alias("term"), F.lit(2).alias("wdf_inc"), F.lit(100000).alias("pos"))
    return writer.edited(c, more).docstats.select("did", "doclen", "uniq")


@add("remove_terms", PRE + "SELECT d.did, CAST(coalesce(sum(f), 0) AS BIGINT) AS doclen FROM d LEFT JOIN p ON p.did = d.did AND p.term NOT IN ('the', 'of') GROUP BY d.did")
def _(s, d):
    c = catalog(s, d)
    return writer.removed_terms(c, c.postings.where(F.col("term").isin("the", "of")).select("did", "term")).docstats.select("did", "doclen")


# ---- expansion

_RT = PRE + _REL + """, rp AS (SELECT p.*, ds.l FROM p JOIN rs USING (did) JOIN ds USING (did)),
e AS (SELECT term, count(*) AS r, sum(f) AS rf, sum(2.0 * f / (l / avl + f)) AS mult, any_value(avl) AS avl FROM rp, cs GROUP BY term),
w AS (SELECT e.term, n, mult * ln((r + 0.5) * (nn - n - (rn - r) + 0.5) / ((n - r + 0.5) * (rn - r + 0.5))) AS prob, rf * log2((1 + c / nn) / (c / nn)) + log2(1 + c / nn) AS bo1 FROM e JOIN ts USING (term), cs, rr)
"""
add("eset_prob", _RT + "SELECT term, round(prob, 6) AS w FROM w WHERE prob > 0 ORDER BY prob DESC, term DESC LIMIT 40")(lambda s, d: eset.eset(catalog(s, d), judged(s, d), 40).select("term", _r("w").alias("w")))
add("eset_bo1", _RT + "SELECT term, round(bo1, 6) AS w FROM w WHERE bo1 > 0")(lambda s, d: eset.candidates(catalog(s, d), judged(s, d), "bo1").select("term", _r("w").alias("w")))
add("eset_exclude_query_terms", _RT + "SELECT term, round(prob, 6) AS w FROM w WHERE prob > 0 AND term NOT IN ('the', 'thing') ORDER BY prob DESC, term DESC LIMIT 40")(
    lambda s, d: eset.eset(catalog(s, d), judged(s, d), 40, exclude=["the", "thing"]).select("term", _r("w").alias("w"))
)
add("eset_prefix_decider", _RT + "SELECT term, round(prob, 6) AS w FROM w WHERE prob > 0 AND starts_with(term, 'th') AND term NOT IN ('the')")(
    lambda s, d: eset.candidates(catalog(s, d), judged(s, d), decider=eset.both(eset.filter_prefix("th"), eset.filter_terms(["the"]))).select("term", _r("w").alias("w"))
)
add("eset_bound", _RT + "SELECT count(*) AS n FROM w WHERE prob > 0")(lambda s, d: eset.candidates(catalog(s, d), judged(s, d)).agg(F.count("*").alias("n")))


@add("more_like_documents", _RT.replace("SELECT DISTINCT doc_id + 1 AS did FROM labels WHERE quality = 1 AND toxic = 0", "SELECT unnest([3, 8, 21]) AS did") + ", best AS (SELECT term FROM w WHERE prob > 0 ORDER BY prob DESC, term DESC LIMIT 20)" + f", m AS (SELECT p.did, p.f, 1 AS q, ds.l, ts.n, cs.* FROM best JOIN p USING (term) JOIN ds USING (did) JOIN ts USING (term), cs) SELECT did, round(sum({BM25}), 6) AS w FROM m GROUP BY did")
def _(s, d):
    c = catalog(s, d)
    terms = [r.term for r in eset.eset(c, s.createDataFrame([(3,), (8,), (21,)], "did long"), 20).collect()]
    return Enquire(c, Q.of("OR", [Q.term(t) for t in terms])).matches.select("did", _r("w").alias("w"))


# ---- spelling

@add("spelling_dictionary", "SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(p_name), '<word>')) AS word FROM part) WHERE length(word) > 1 GROUP BY word")
def _(s, d):
    w = table(s, d, "part").select(F.explode(cat.words_of("p_name")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return spelling.added(s.createDataFrame([], "word string, freq long"), w)


_FRAG = "list_concat(['H' || left(w, 2), 'T' || right(w, 2)], CASE WHEN length(w) <= 4 THEN ['B' || left(w, 1) || right(w, 1)] ELSE [] END, list_transform(range(1, greatest(length(w) - 1, 1)), lambda i: 'M' || substr(w, i, 3)))"


#: asked words of two and three letters are looked up by their swapped forms too
_SWAPPED = "CASE length(w) WHEN 2 THEN ['H' || reverse(w), 'T' || reverse(w)] WHEN 3 THEN ['M' || reverse(left(w, 2)) || right(w, 1), 'M' || left(w, 1) || reverse(right(w, 2))] ELSE [] END"


# DuckDB's distance is one of bytes: letters beyond ASCII become capitals, which no word has
@add("spelling_suggestions", PRE + f""", k AS (SELECT term AS w, c AS freq FROM ts WHERE length(term) > 1 AND NOT regexp_matches(term, '[0-9]')),
q AS (SELECT DISTINCT left(w, 2) || substr(w, 4) AS w FROM (SELECT unnest(regexp_extract_all(lower(text), '<word>')) AS w FROM benchmark) WHERE length(w) >= 3),
a AS (SELECT DISTINCT w, unnest(list_concat({_FRAG}, {_SWAPPED})) AS g FROM q), b AS (SELECT w AS cand, freq, unnest({_FRAG}) AS g FROM k),
pr AS (SELECT DISTINCT a.w, cand, freq FROM a JOIN b USING (g) WHERE a.w != cand AND abs(length(a.w) - length(cand)) <= 1),
far AS (SELECT string_agg(DISTINCT c, '' ORDER BY c) AS far FROM (SELECT unnest(string_split(w, '')) AS c FROM k UNION ALL SELECT unnest(string_split(w, '')) FROM q) WHERE ascii(c) > 127),
nd AS (SELECT *, damerau_levenshtein(translate(w, coalesce(far, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'), translate(cand, coalesce(far, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789')) AS dist FROM pr, far),
ok AS (SELECT * FROM nd WHERE dist <= 1),
best AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY dist, freq DESC, cand) AS rn FROM ok)
SELECT q.w AS word, CASE WHEN coalesce(k.freq, 0) < best.freq THEN cand END AS suggestion FROM q LEFT JOIN best ON best.w = q.w AND rn = 1 LEFT JOIN k ON k.w = q.w""")
def _(s, d):
    t = catalog(s, d).termstats
    known = t.where("length(term) > 1 and not term rlike '[0-9]'").select(F.col("term").alias("word"), F.col("collfreq").alias("freq"))
    words = table(s, d, "benchmark").select(F.explode(cat.words_of("text")).alias("w")).where("length(w) >= 3")
    asked = words.select(F.expr("concat(left(w, 2), substring(w, 4))").alias("word")).distinct()
    return spelling.suggestions(known, asked, 1)


# ---- clustering, learning to rank, clicks

@add("cluster_points", PRE + leaves("thing", "der", "with") + f""", pg AS (SELECT did FROM m GROUP BY did ORDER BY sum({BM25}) DESC, did LIMIT 40), tp AS (SELECT p.* FROM p JOIN pg USING (did)), tf AS (SELECT term, count(*) AS tf FROM tp GROUP BY term HAVING count(*) > 1 AND count(*) < 40)
SELECT did, term, round((1 + ln(f)) * ln(40.0 / tf), 6) AS w FROM tp JOIN tf USING (term)""")
def _(s, d):
    return cluster.points(catalog(s, d), Enquire(catalog(s, d), _OR()).mset(0, 40).select("did")).select("did", "term", _r("w").alias("w"))


@add("cluster_distances", PRE + leaves("thing", "der", "with") + f""", pg AS (SELECT did FROM m GROUP BY did ORDER BY sum({BM25}) DESC, did LIMIT 40), tp AS (SELECT p.* FROM p JOIN pg USING (did)), tf AS (SELECT term, count(*) AS tf FROM tp GROUP BY term HAVING count(*) > 1 AND count(*) < 40),
v AS (SELECT did, term, (1 + ln(f)) * ln(40.0 / tf) AS w FROM tp JOIN tf USING (term)), nm AS (SELECT did, sum(w * w) AS s FROM v GROUP BY did)
SELECT a.did AS d1, b.did AS d2, round(1 - sum(a.w * b.w) / sqrt(any_value(x.s) * any_value(y.s)), 6) AS distance FROM v a JOIN v b ON a.term = b.term AND a.did < b.did JOIN nm x ON x.did = a.did JOIN nm y ON y.did = b.did GROUP BY a.did, b.did""")
def _(s, d):
    p = cluster.points(catalog(s, d), Enquire(catalog(s, d), _OR()).mset(0, 40).select("did"))
    return cluster.cosine_distances(p).select("d1", "d2", _r("distance").alias("distance"))


def _clustered(s, d, how):
    c = catalog(s, d)
    top = [r.did for r in Enquire(c, _OR()).mset(0, 100).select("did", "rank").orderBy("rank").collect()]
    own = how(cluster.page_matrix(c, top), 5)
    return s.createDataFrame([(int(a), int(b)) for a, b in zip(top, own)], "did long, cluster int")


add("cluster_kmeans")(lambda s, d: _clustered(s, d, cluster.kmeans))
add("cluster_equal_groups")(lambda s, d: _clustered(s, d, cluster.equal_groups))

_FIELDS = """WITH c AS (SELECT conv_id + 1 AS did, turn, regexp_extract_all(lower(text), '<word>') AS ws FROM conversations),
tok AS (SELECT did, CASE WHEN turn = 0 THEN 'title' ELSE 'body' END AS part, unnest(ws) AS term FROM c), ids AS (SELECT DISTINCT did FROM c),
q AS (SELECT unnest(['the', 'of', 'and']) AS term), ln_ AS (SELECT ids.did, count(*) FILTER (part = 'title') AS lt, count(*) FILTER (part = 'body') AS lb, count(term) AS lw FROM ids LEFT JOIN tok USING (did) GROUP BY ids.did),
cl AS (SELECT sum(lt) AS ct, sum(lb) AS cb, sum(lw) AS cw, count(*) AS n FROM ln_),
st AS (SELECT term, count(*) FILTER (part = 'title') AS ft, count(*) FILTER (part = 'body') AS fb, count(*) AS fw, count(DISTINCT did) FILTER (part = 'title') AS nt, count(DISTINCT did) FILTER (part = 'body') AS nb, count(DISTINCT did) AS nw FROM tok JOIN q USING (term) GROUP BY term),
tf AS (SELECT did, term, count(*) FILTER (part = 'title') AS tt, count(*) FILTER (part = 'body') AS tb, count(*) AS tw FROM tok JOIN q USING (term) GROUP BY did, term),
g AS (SELECT l.did, lt, lb, lw, ct, cb, cw, n, ft, fb, fw, nt, nb, nw, coalesce(tt, 0) AS tt, coalesce(tb, 0) AS tb, coalesce(tw, 0) AS tw FROM ln_ l CROSS JOIN st LEFT JOIN tf ON tf.did = l.did AND tf.term = st.term CROSS JOIN cl)
SELECT did, """ + ", ".join(
    f"round(sum(log10(1 + t{x})), 6) AS tf_{n}, round(sum(log10(1 + t{x} / (1 + l{x}))), 6) AS tf_doclen_{n}, round(sum(log10(1 + log10(n / (1 + n{x})))), 6) AS idf_{n}, round(sum(log10(1 + c{x} / (1 + f{x}))), 6) AS colltf_colllen_{n}, round(sum(log10(1 + t{x} * log10(n / (1 + n{x})) / (1 + l{x}))), 6) AS tfidf_doclen_{n}, round(sum(log10(1 + t{x} * c{x} / (1 + l{x} * f{x}))), 6) AS tf_doclen_colltf_colllen_{n}"
    for x, n in (("t", "title"), ("b", "body"), ("w", "whole"))
) + " FROM g GROUP BY did"


def _conversations(s, d):
    c = table(s, d, "conversations").select((F.col("conv_id") + 1).alias("did"), "turn", "text")
    tokens = cat.tokens_of(c.where("turn = 0"), prefix="S").unionByName(cat.tokens_of(c.where("turn != 0"), gap=10_000))
    return cat.Catalog(c.groupBy("did").agg(F.min("text").alias("data")), cat.postings_of(tokens), s.createDataFrame([], "did long, slot int, value string, num double"))


@add("letor_features", _FIELDS)
def _(s, d):
    c = _conversations(s, d)
    f = letor.features(c, ["the", "of", "and"], c.documents)
    return f.select("did", *[_r(x).alias(x) for x in f.columns if x != "did"])


_LISTS = "WITH l AS (SELECT doc_id % 20 AS qid, doc_id, quality + toxic AS label, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS rank FROM (SELECT DISTINCT * FROM labels))"


def _lists(s, d):
    from pyspark.sql import Window

    x = table(s, d, "labels").distinct().select((F.col("doc_id") % 20).alias("qid"), "doc_id", (F.col("quality") + F.col("toxic")).alias("label"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id")))


@add("letor_ndcg", _LISTS + ", g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY label DESC) AS best FROM l) SELECT qid, round(CASE WHEN sum((pow(2, label) - 1) / log2(rank + 1)) = 0 THEN 0 ELSE sum((pow(2, label) - 1) / log2(rank + 1)) / sum((pow(2, label) - 1) / log2(best + 1)) END, 6) AS ndcg FROM g GROUP BY qid")
def _(s, d):
    return letor.ndcg(_lists(s, d)).select("qid", _r("ndcg").alias("ndcg"))


@add("letor_err", _LISTS + """, g AS (SELECT *, (pow(2, label) - 1) / pow(2, max(label) OVER (PARTITION BY qid)) AS stop FROM l),
h AS (SELECT *, coalesce(product(1 - stop) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS p FROM g) SELECT qid, round(sum(p * stop / rank), 6) AS err FROM h GROUP BY qid""")
def _(s, d):
    return letor.err(_lists(s, d)).select("qid", _r("err").alias("err"))


@add("letor_normalised", _LISTS + " SELECT qid, doc_id, round(rank / max(rank) OVER (PARTITION BY qid), 6) AS a, round(label / CASE WHEN max(label) OVER (PARTITION BY qid) = 0 THEN 1.0 ELSE max(label) OVER (PARTITION BY qid) END, 6) AS b FROM l")
def _(s, d):
    x = _lists(s, d).withColumns({"a": F.col("rank").cast("double"), "b": F.col("label").cast("double")})
    return letor.normalised(x, ["a", "b"], ["qid"]).select("qid", "doc_id", _r("a").alias("a"), _r("b").alias("b"))


def _ranked(s, d, gradient, rounds):
    x = _lists(s, d).withColumns({"a": F.col("rank").cast("double"), "b": F.col("doc_id").cast("double")})
    x = letor.normalised(x, ["a", "b"], ["qid"])
    w = letor.train(x, ["a", "b"], gradient, rounds=rounds)
    return letor.score(x, ["a", "b"], w).select("qid", "doc_id", _r("score", 9).alias("score"))


add("letor_listnet")(lambda s, d: _ranked(s, d, letor.listnet_gradient, 15))
add("letor_listmle")(lambda s, d: _ranked(s, d, letor.listmle_gradient, 10))
add("letor_training_file")(lambda s, d: letor.training_lines(letor.normalised(_lists(s, d).withColumnsRenamed({"doc_id": "did"}).withColumn("a", F.col("rank").cast("double")), ["a"], ["qid"]), ["a"]))

_LOG = """WITH v AS (SELECT user_id % 50 AS qid, (event_id // 10) AS sess, event_id % 10 AS i, event_id % 37 AS did, event_type = 'click' AS hit FROM events),
s AS (SELECT DISTINCT sess, min(qid) OVER (PARTITION BY sess) AS qid, i, did, hit FROM v), l AS (SELECT *, max(CASE WHEN hit THEN i ELSE -1 END) OVER (PARTITION BY sess) AS last FROM s),
g AS (SELECT qid, did, count(*) FILTER (i <= last AND hit) AS a1, count(*) FILTER (i <= last AND NOT hit) AS a0, count(*) FILTER (hit AND i = last) AS s1, count(*) FILTER (hit AND i < last) AS s0 FROM l GROUP BY qid, did)
SELECT qid, did, round((a1 + 1) / (a1 + a0 + 2) * ((s1 + 1) / (s1 + s0 + 2)), 6) AS relevance FROM g"""


@add("click_model_relevance", _LOG)
def _(s, d):
    v = table(s, d, "events").select((F.col("user_id") % 50).alias("qid"), F.expr("event_id div 10").alias("sess"), (F.col("event_id") % 10).alias("i"), (F.col("event_id") % 37).alias("did"), (F.col("event_type") == "click").alias("hit"))
    log = v.groupBy("sess").agg(F.min("qid").alias("qid"), F.sort_array(F.collect_list(F.struct("i", "did", "hit"))).alias("l"))
    log = log.select("qid", F.col("l.did").alias("hits"), F.map_from_entries(F.expr("transform(filter(l, x -> x.hit), x -> struct(x.did, 1))")).alias("clicks"))
    return clicks.relevances(log).select("qid", "did", _r("relevance").alias("relevance"))
