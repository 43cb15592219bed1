"""The engine's registered queries, and the SQL each is held against.

All run over the documents table as the corpus (did = doc_id + 1; slots 0 language, 1 source, 2 length), each over its
whole table. Limits occur where a result page is the feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import weights as W
from .operators.ast import Query as Q
from .operators.enquire import Enquire
from .operators.match import Matcher
from .sources.catalog import WORD, Catalog, from_text

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_OPEN: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("did"), "text", "lang", "source", "n_chars")


#: Of a corpus of no more bytes the session keeps the postings; of a larger one each pass makes what it needs of the texts.
KEPT_BYTES = 32 << 20


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The corpus' catalog; a small one's postings are kept by the session, so that queries on it tokenise it once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        docs = corpus(spark, sf_dir)
        small = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= KEPT_BYTES
        docs = docs.repartition(spark.sparkContext.defaultParallelism, "did") if small else docs  # a small table may be one task
        c = from_text(docs, {0: F.col("lang"), 1: F.col("source"), 2: F.lpad(F.col("n_chars").cast("string"), 8, "0")})
        _OPEN[key] = c.kept() if small else c
    return _OPEN[key]


def add(name: str, sql: str | None = None):
    """Register a query, and its SQL: <word> in it stands for the word rule."""
    def f(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql.replace("<word>", WORD)
        return fn

    return f


def _r(c, n: int = 6):
    return F.round(c, n)


#: The inverted index in SQL.
PRE = """WITH d AS (SELECT doc_id + 1 AS did, regexp_extract_all(lower(text), '<word>') AS ws, text, lang, source, n_chars, lpad(CAST(n_chars AS VARCHAR), 8, '0') AS len8 FROM documents),
tok AS (SELECT did, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS pos FROM d),
p AS (SELECT did, term, count(*) AS f, list(pos ORDER BY pos) AS positions FROM tok GROUP BY ALL),
ds AS (SELECT d.did, coalesce(sum(f), 0) AS l, count(f) AS u, coalesce(max(f), 0) AS m FROM d LEFT JOIN p ON p.did = d.did GROUP BY d.did),
ts AS (SELECT term, count(*) AS n, CAST(sum(f) AS BIGINT) AS c, max(f) AS ub FROM p GROUP BY term),
cs AS (SELECT CAST(count(*) AS DOUBLE) AS nn, CAST(sum(l) AS DOUBLE) AS tt, sum(l) / CAST(count(*) AS DOUBLE) AS avl, CAST(max(l) AS DOUBLE) AS lmax FROM ds)
"""
BM25_IDF = "ln(CASE WHEN (nn - n + 0.5) / (n + 0.5) < 2 THEN (nn - n + 0.5) / (n + 0.5) * 0.5 + 1 ELSE (nn - n + 0.5) / (n + 0.5) END)"
BM25 = f"{BM25_IDF} * 2.0 * q / (1 + q) * 2.0 * f / (0.5 * greatest(l / avl, 0.5) + 0.5 + f)"


def leaves(*terms, name: str = "m") -> str:
    """A CTE: a row for each posting of each query term, with all that weights need."""
    rows = ", ".join(f"({i}, '{t}', {q})" for i, (t, q) in enumerate(t if isinstance(t, tuple) else (t, 1) for t in terms))
    return f""", {name} AS (SELECT t.leaf, t.term, t.q, p.did, p.f, p.positions, ds.l, ds.u, ds.m, ts.n, ts.c, cs.* FROM (VALUES {rows}) t(leaf, term, q) JOIN p USING (term) JOIN ds USING (did) JOIN ts USING (term), cs)
"""


def T(*terms: str) -> list[Q]:
    return [Q.term(t, 1, i + 1) for i, t in enumerate(terms)]


def found(spark, sf_dir, q: Q, weight: W.Weight | None = None, **options) -> DataFrame:
    """did and weight of every match."""
    return Enquire(catalog(spark, sf_dir), q, weight or W.BM25(), **options).matches.select("did", _r("w").alias("w"))


# ---- flagship and boolean algebra

@add("bm25_or_top10", PRE + leaves("the", "of", "and") + f"SELECT did, round(sum({BM25}), 6) AS w FROM m GROUP BY did ORDER BY sum({BM25}) DESC, did LIMIT 10")
def _(s, d):
    return Enquire(catalog(s, d), Q.of("OR", T("the", "of", "and"))).mset(0, 10).select("did", _r("w").alias("w"))


_ALGEBRA = {
    "term": (lambda: Q.term("the"), PRE + leaves("the") + f"SELECT did, round(sum({BM25}), 6) AS w FROM m GROUP BY did"),
    "match_all": (lambda: Q.all(), PRE + "SELECT did, CAST(0 AS DOUBLE) AS w FROM d"),
    "match_nothing": (lambda: Q.nothing(), PRE + "SELECT did, CAST(0 AS DOUBLE) AS w FROM d WHERE false"),
    "and": (lambda: Q.of("AND", T("the", "of", "der")), PRE + leaves("the", "of", "der") + f"SELECT did, round(sum({BM25}), 6) AS w FROM m GROUP BY did HAVING count(*) = 3"),
    "or": (lambda: Q.of("OR", T("the", "der", "les")), PRE + leaves("the", "der", "les") + f"SELECT did, round(sum({BM25}), 6) AS w FROM m GROUP BY did"),
    "or_same_term_twice": (lambda: Q.of("OR", T("the", "the")), PRE + leaves("the", "the") + f"SELECT did, round(sum({BM25}), 6) AS w FROM m GROUP BY did"),
    "term_wqf": (lambda: Q.term("the", 3), PRE + leaves(("the", 3)) + f"SELECT did, round(sum({BM25}), 6) AS w FROM m GROUP BY did"),
    "xor": (lambda: Q.of("XOR", T("the", "of", "in")), PRE + leaves("the", "of", "in") + f"SELECT did, round(sum({BM25}), 6) AS w FROM m GROUP BY did HAVING count(*) % 2 = 1"),
    "and_not": (lambda: Q.of("AND_NOT", T("the", "for", "with")), PRE + leaves("the") + f"SELECT did, round(sum({BM25}), 6) AS w FROM m WHERE did NOT IN (SELECT did FROM p WHERE term IN ('for', 'with')) GROUP BY did"),
    "and_maybe": (lambda: Q.of("AND_MAYBE", T("the", "for", "with")), PRE + leaves("the", "for", "with") + f"SELECT did, round(sum({BM25}), 6) AS w FROM m GROUP BY did HAVING min(leaf) = 0"),
    "filter": (lambda: Q.of("FILTER", T("the", "for")), PRE + leaves("the") + f"SELECT did, round(sum({BM25}), 6) AS w FROM m WHERE did IN (SELECT did FROM p WHERE term = 'for') GROUP BY did"),
    "max": (lambda: Q.of("MAX", T("the", "for", "with")), PRE + leaves("the", "for", "with") + f"SELECT did, round(max({BM25}), 6) AS w FROM m GROUP BY did"),
    "scale_weight": (lambda: Q.of("OR", T("the", "for")) * 2.5, PRE + leaves("the", "for") + f"SELECT did, round(sum(2.5 * {BM25}), 6) AS w FROM m GROUP BY did"),
    "scale_zero": (lambda: Q.of("OR", T("the", "for")) * 0, PRE + leaves("the", "for") + "SELECT did, CAST(0 AS DOUBLE) AS w FROM m GROUP BY did"),
    "value_range": (lambda: Q.value_range(2, "00000500", "00001500"), PRE + "SELECT did, CAST(0 AS DOUBLE) AS w FROM d WHERE len8 BETWEEN '00000500' AND '00001500'"),
    "value_ge": (lambda: Q.value_ge(2, "00002000"), PRE + "SELECT did, CAST(0 AS DOUBLE) AS w FROM d WHERE len8 >= '00002000'"),
    "value_ge_empty": (lambda: Q.value_ge(2, ""), PRE + "SELECT did, CAST(0 AS DOUBLE) AS w FROM d"),
    "value_le": (lambda: Q.value_le(0, "en"), PRE + "SELECT did, CAST(0 AS DOUBLE) AS w FROM d WHERE lang <= 'en' AND lang != ''"),
    "number_range": (lambda: Q.number_range(2, 800.0, None), PRE + "SELECT did, CAST(0 AS DOUBLE) AS w FROM d WHERE n_chars >= 800"),
    "filter_value_range": (lambda: Q.of("FILTER", [Q.term("the"), Q.value_range(0, "de", "es")]), PRE + leaves("the") + f"SELECT did, round({BM25}, 6) AS w FROM m JOIN d USING (did) WHERE lang BETWEEN 'de' AND 'es'"),
    "elite_set": (
        lambda: Q.of("ELITE_SET", T("the", "of", "der", "les", "with"), 2),
        PRE + leaves("the", "of", "der", "les", "with") + f", best AS (SELECT leaf FROM m GROUP BY leaf ORDER BY max({BM25}) DESC, leaf LIMIT 2) SELECT did, round(sum({BM25}), 6) AS w FROM m WHERE leaf IN (SELECT leaf FROM best) GROUP BY did",
    ),
    "phrase_exact": (lambda: Q.of("PHRASE", T("of", "the")), PRE + leaves("of", "the") + f", h AS (SELECT DISTINCT a.did FROM tok a JOIN tok b ON a.did = b.did AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the') SELECT did, round(sum({BM25}), 6) AS w FROM m WHERE did IN (SELECT did FROM h) GROUP BY did"),
    "phrase_window": (lambda: Q.of("PHRASE", T("of", "the", "and"), 9), PRE + leaves("of", "the", "and") + f", h AS (SELECT DISTINCT a.did FROM tok a JOIN tok b ON a.did = b.did AND b.pos > a.pos AND b.pos < a.pos + 9 JOIN tok c ON a.did = c.did AND c.pos > b.pos AND c.pos < a.pos + 9 WHERE a.term = 'of' AND b.term = 'the' AND c.term = 'and') SELECT did, round(sum({BM25}), 6) AS w FROM m WHERE did IN (SELECT did FROM h) GROUP BY did"),
    "near": (lambda: Q.of("NEAR", T("of", "the", "and"), 6), PRE + leaves("of", "the", "and") + f", h AS (SELECT DISTINCT a.did FROM tok a JOIN tok b ON a.did = b.did AND abs(b.pos - a.pos) < 6 JOIN tok c ON a.did = c.did AND abs(c.pos - a.pos) < 6 AND abs(c.pos - b.pos) < 6 WHERE a.term = 'of' AND b.term = 'the' AND c.term = 'and') SELECT did, round(sum({BM25}), 6) AS w FROM m WHERE did IN (SELECT did FROM h) GROUP BY did"),
    "near_same_term_twice": (lambda: Q.of("NEAR", T("the", "the"), 3), PRE + leaves("the", "the") + f", h AS (SELECT DISTINCT a.did FROM tok a JOIN tok b ON a.did = b.did AND b.pos > a.pos AND b.pos - a.pos < 3 WHERE a.term = 'the' AND b.term = 'the') SELECT did, round(sum({BM25}), 6) AS w FROM m WHERE did IN (SELECT did FROM h) GROUP BY did"),
    "phrase_of_or": (lambda: Q.of("PHRASE", [Q.of("OR", T("of", "in")), Q.term("the")]), PRE + leaves("of", "in", "the") + f", h AS (SELECT DISTINCT a.did FROM tok a JOIN tok b ON a.did = b.did AND b.pos = a.pos + 1 WHERE a.term IN ('of', 'in') AND b.term = 'the') SELECT did, round(sum({BM25}), 6) AS w FROM m WHERE did IN (SELECT did FROM h) GROUP BY did"),
}
for _name, (_q, _sql) in _ALGEBRA.items():
    add(f"op_{_name}", _sql)(lambda s, d, q=_q: found(s, d, q()))

# An AND nested in an OR, under a NOT: operators compose.
add("op_nested", PRE + leaves("the", "of", "der") + f"SELECT did, round(sum({BM25}), 6) AS w FROM (SELECT *, count(*) FILTER (leaf < 2) OVER (PARTITION BY did) AS k FROM m) WHERE (leaf = 2 OR k = 2) AND did NOT IN (SELECT did FROM p WHERE term = 'to') GROUP BY did")(
    lambda s, d: found(s, d, (Q.of("AND", T("the", "of")) | Q.term("der")) & ~Q.term("to"))
)

# ---- one term out of many: SYNONYM, wildcards, edit distance

ONE = f"""ROUND({BM25}, 6) AS w FROM (SELECT did, least(sum(f), max(l)) AS f, max(l) AS l, any_value(e.n) AS n, any_value(nn) AS nn, any_value(avl) AS avl, 1 AS q FROM x, e GROUP BY did)"""


def synonym_sql(where: str) -> str:
    return PRE + f""", s AS (SELECT * FROM ts WHERE {where}),
e AS (SELECT floor((1 - exp(sum(ln(1 - s.n / nn)))) * any_value(nn) + 0.5) AS n FROM s, cs),
x AS (SELECT p.did, p.f, ds.l, cs.* FROM p JOIN s USING (term) JOIN ds USING (did), cs) SELECT did, {ONE}"""


add("op_synonym", synonym_sql("term IN ('der', 'les', 'los')"))(lambda s, d: found(s, d, Q.of("SYNONYM", T("der", "les", "los"))))
add("op_wildcard_synonym", synonym_sql("term LIKE 'thi%' AND NOT regexp_matches(term, '^[A-Z]')"))(lambda s, d: found(s, d, Q.wildcard("thi*")))
add("op_wildcard_truncation", synonym_sql("starts_with(term, 'tionin')"))(lambda s, d: found(s, d, Q.wildcard("tionin", patterns=False)))
add("op_wildcard_single", synonym_sql("term LIKE 'th__'"))(lambda s, d: found(s, d, Q.wildcard("th??")))
_EXP = ", s AS (SELECT * FROM ts WHERE {w}), m AS (SELECT p.did, p.f, 1 AS q, ds.l, s.n, cs.* FROM p JOIN s USING (term) JOIN ds USING (did), cs) "
add("op_wildcard_or", PRE + _EXP.format(w="term LIKE 'w%h'") + f"SELECT did, round(sum({BM25}), 6) AS w FROM m GROUP BY did")(lambda s, d: found(s, d, Q.wildcard("w*h", combiner="OR")))
add("op_wildcard_max", PRE + _EXP.format(w="term LIKE '%ing%' AND term LIKE 'w%'") + f"SELECT did, round(max({BM25}), 6) AS w FROM m GROUP BY did")(lambda s, d: found(s, d, Q.wildcard("w*ing*", combiner="MAX")))
add("op_wildcard_most_frequent", PRE + ", s0 AS (SELECT * FROM ts WHERE term LIKE 'an%' ORDER BY n DESC, term LIMIT 5)" + _EXP.format(w="term IN (SELECT term FROM s0)") + f"SELECT did, round(sum({BM25}), 6) AS w FROM m GROUP BY did")(
    lambda s, d: found(s, d, Q.wildcard("an*", 5, "MOST_FREQUENT", "OR"))
)
add("op_wildcard_first", PRE + ", s0 AS (SELECT * FROM ts WHERE term LIKE 'an%' ORDER BY term LIMIT 7)" + _EXP.format(w="term IN (SELECT term FROM s0)") + f"SELECT did, round(sum({BM25}), 6) AS w FROM m GROUP BY did")(
    lambda s, d: found(s, d, Q.wildcard("an*", 7, "FIRST", "OR"))
)
add("op_edit_distance", PRE + _EXP.format(w="abs(length(term) - 5) <= 1 AND damerau_levenshtein(term, 'thing') <= 1") + f"SELECT did, round(sum({BM25}), 6) AS w FROM m GROUP BY did")(
    lambda s, d: found(s, d, Q.edit_distance("thing", 1, combiner="OR"))
)
add("op_edit_distance_fixed_prefix", PRE + _EXP.format(w="starts_with(term, 'th') AND abs(length(term) - 5) <= 2 AND levenshtein(term, 'thing') <= 2") + f"SELECT did, round(max({BM25}), 6) AS w FROM m GROUP BY did")(
    lambda s, d: found(s, d, Q.edit_distance("thing", 2, fixed=2, combiner="MAX"))
)

# ---- weighting schemes

_FN = "(f * (ln(1 + avl / l) / ln(2)))"
_PL = "(c / nn / ln(2) + 0.5 * log2(2 * pi()) + ({x} + 0.5) * log2({x}) - (log2(c / nn) + 1 / ln(2)) * {x})"
_BBF = f"least({_FN}, c - 1)"
_TF = {
    "n": "f", "b": "1.0", "s": "f * f", "l": "(1 + ln(f))", "P": "((1 + ln(1 + ln(f))) / (1 - 0.2 + 0.2 * l / avl) + 1)", "L": "((1 + ln(f)) / (1 + ln(l / u)))",
    "m": "(f / m)", "a": "(0.5 + 0.5 * f / m)", "A": "(0.9 + 0.1 * f / (l / u))", "g": "(0.2 + 0.8 * ln(1 + f))", "q": "(sqrt(f - 0.5) + 1)",
}
_IDF = {
    "n": "1.0", "t": "ln(nn / n)", "s": "pow(ln(nn / n), 2)", "f": "(1.0 / n)", "p": "(CASE WHEN n >= nn THEN 0 ELSE ln((nn - n) / n) END)", "P": "ln((nn + 1) / n)",
    "G": "(c / n)", "L": "ln(c / n + 1)", "I": "(c / n + 1)", "Q": "sqrt(c / n - 0.9)",
}
_SCHEMES = {
    "bm25_params": (W.BM25(1.2, 0.0, 2.0, 0.75, 0.3), f"{BM25_IDF} * 3.0 * q / (2 + q) * 2.2 * f / (1.2 * (0.75 * greatest(l / avl, 0.3) + 0.25) + f)"),
    "bm25plus": (W.BM25Plus(), "ln((nn + 1) / n) * 2.0 * q / (1 + q) * (2.0 * f / (0.5 * greatest(l / avl, 0.5) + 0.5 + f) + 1)"),
    "trad": (W.Trad(), f"{BM25_IDF} * 2.0 * f / (greatest(l / avl, 0) + f)"),
    "inl2": (W.InL2(), f"q * log2((nn + 1) / (n + 0.5)) * {_FN} / ({_FN} + 1)"),
    "ifb2": (W.IfB2(), f"q * log2((nn + 1) / (c + 0.5)) * {_FN} * ((c + 1) / n) / ({_FN} + 1)"),
    "ineb2": (W.IneB2(), f"q * log2((nn + 1) / (nn * (1 - exp(-c / nn)) + 0.5)) * {_FN} * ((c + 1) / n) / ({_FN} + 1)"),
    "bb2": (W.BB2(), f"greatest(0, q * (c + 1) / n / ({_BBF} + 1) * (-1 / ln(2) - log2(nn - 1) + (nn - 2 + c - {_BBF} + 0.5) * log2((nn + c - 1) / (nn - 2 + c - {_BBF})) + ({_BBF} + 1) * log2(nn + c - 1) - (c - {_BBF} + 0.5) * log2(c / (c - {_BBF})) - {_BBF} * log2(c)))"),
    "dlh": (W.DLH(), "CASE WHEN f = l THEN 0 ELSE greatest(0, (f * log2(f / l * tt / c) + (l - f) * log2(1 - f / l) + 0.5 * log2(2 * pi() * f * (1 - f / l))) / (f + 0.5)) END"),
    "dph": (W.DPH(), "CASE WHEN f = l THEN 0 ELSE greatest(0, pow(1 - f / l, 2) / (f + 1) * (f * (log2(f / l) + log2(tt / c)) + 0.5 * log2(2 * pi() * f * (1 - f / l)))) END"),
    "pl2": (W.PL2(), f"CASE WHEN {_PL.format(x=_FN)} <= 0 THEN 0 ELSE {_PL.format(x=_FN)} / ({_FN} + 1) END"),
    "pl2plus": (W.PL2Plus(), f"CASE WHEN c / nn > 1 THEN 0 ELSE greatest(0, {_PL.format(x=_FN)} / ({_FN} + 1) + {_PL.format(x='0.8')} / 1.8) END"),
    "lmjm": (W.LMJelinekMercer(), "ln(1 + 0.8 * tt / (0.2 * c) * f / l)"),
    "lmjm_fixed": (W.LMJelinekMercer(0.4), "ln(1 + 0.6 * tt / (0.4 * c) * f / l)"),
    "lmdirichlet": (W.LMDirichlet(), "ln(1 + f * tt / (c * 2000)) * ln(1 + 0.05 * tt / (c * 2000))", "3 * (ln(lmax + 2000) - ln(l + 2000))"),
    "lmabsdiscount": (W.LMAbsDiscount(), "ln(1 + (f - 0.7) / u * tt / (0.7 * c))", "3 * ln(lmax) + 3 * ln(u / l)"),
    "lm2stage": (W.LM2Stage(), "ln(1 + f / (0.7 * l + 2000) * 0.3 * tt / c)", "3 * (ln((0.7 * l + 2000) / (l + 2000)) - ln((0.7 * lmax + 2000) / (lmax + 2000)))"),
    "dice": (W.Dice(), "2.0 * q / (3 + u)"),
    "coord": (W.Coord(), "1.0"),
    "bool": (W.Bool(), "0.0"),
    "bm25_k2": (W.BM25(k2=0.7), BM25, "2 * 0.7 * 3 / (1 + greatest(l / avl, 0.5))"),
}
_SCHEMES |= {f"tfidf_wdf_{k if k.islower() else 'upper_' + k.lower()}": (W.TfIdf(k + "tn"), f"{e} * {_IDF['t']}") for k, e in _TF.items()}
_SCHEMES |= {f"tfidf_idf_{k if k.islower() else 'upper_' + k.lower()}": (W.TfIdf("l" + k + "n"), f"{_TF['l']} * {e}") for k, e in _IDF.items()}
for _name, (_w, _sql, *_extra) in _SCHEMES.items():
    _x = f" + max({_extra[0]})" if _extra else ""
    add(f"weight_{_name}", PRE + leaves("thing", "der", "with") + f"SELECT did, round(sum({_sql}){_x}, 6) AS w FROM m GROUP BY did")(
        lambda s, d, w=_w: found(s, d, Q.of("OR", T("thing", "der", "with")), w)
    )

# ---- relevance: documents labelled of high quality

_REL = ", rs AS (SELECT DISTINCT doc_id + 1 AS did FROM labels WHERE quality = 1 AND toxic = 0), rr AS (SELECT count(*) AS rn FROM rs JOIN d USING (did))"


def judged(s, d):
    return table(s, d, "labels").where("quality = 1 and toxic = 0").select((F.col("doc_id") + 1).alias("did")).distinct()


add(
    "weight_bm25_relevance",
    PRE + _REL + leaves("thing", "der", "with") + """, rt AS (SELECT term, count(*) AS r FROM p JOIN rs USING (did) GROUP BY term),
x AS (SELECT m.*, coalesce(r, 0) AS r, rn, ((coalesce(r, 0) + 0.5) * (nn - (rn - coalesce(r, 0)) - n + 0.5)) / ((rn - coalesce(r, 0) + 0.5) * (n - coalesce(r, 0) + 0.5)) AS tw FROM m LEFT JOIN rt USING (term), rr)
SELECT did, round(sum(ln(CASE WHEN tw < 2 THEN tw * 0.5 + 1 ELSE tw END) * 2.0 * f / (0.5 * greatest(l / avl, 0.5) + 0.5 + f)), 6) AS w FROM x GROUP BY did""",
)(lambda s, d: found(s, d, Q.of("OR", T("thing", "der", "with")), relevant=judged(s, d)))


def _register() -> None:
    """The other modules of queries add to the same tables."""
    from . import queries_session, queries_text  # noqa: F401


_register()
