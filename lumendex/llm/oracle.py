"""SQL for the queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from . import sharding

_WORDS = r"list_filter(string_split_regex(t, '[ \t\n\x0b\x0c\r]+'), lambda x: x != '')"
_SPACES = r"regexp_replace(t, '[ \t\n\x0b\x0c\r]+', '', 'g')"


# written without the operator's constants, so that a mistake in those shows
OP1 = rf"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, {_WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^ \t\n\x0b\x0c\r]')) AS ls FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM x)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM tri) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
b0 AS (SELECT x.doc_id, lang, source, len(ws) AS n_words, length({_SPACES}) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM x LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 coalesce(1000 * word_chars // nullif(n_words, 0), 0) AS m1, coalesce(10000 * n_symbols // nullif(word_chars, 0), 0) AS m2, coalesce(10000 * n_dup_lines // nullif(n_lines, 0), 0) AS m3, coalesce(10000 * n_repeat_words // nullif(n_words, 0), 0) AS m4,
 coalesce(1000000 // nullif(word_chars, 0), 0) AS u2, coalesce(1000000 // nullif(n_lines, 0), 0) AS u3, coalesce(6000000 // nullif(n_words, 0), 0) AS u4 FROM b0),
v AS (SELECT lang, source, unnest(['m1', 'm2', 'm3', 'm4', 'u2', 'u3', 'u4']) AS m, unnest([m1, m2, m3, m4, u2, u3, u4]) AS v FROM b WHERE NOT base_failed),
bins AS (SELECT lang, source, m, CAST(CASE WHEN v <= 0 THEN 0 ELSE 1 + floor(ln(v) * 100) END AS INTEGER) AS bin FROM v),
sk AS (SELECT 2 AS level, lang, source, m, bin, count(*) AS n FROM bins GROUP BY ALL UNION ALL SELECT 1, lang, NULL, m, bin, count(*) FROM bins GROUP BY ALL UNION ALL SELECT 0, NULL, NULL, m, bin, count(*) FROM bins GROUP BY ALL),
up AS (SELECT *, sum(n) OVER (w ORDER BY bin) AS cum, sum(n) OVER w AS al FROM sk WINDOW w AS (PARTITION BY level, lang, source, m)),
q0 AS (SELECT level, lang, source, m, min(bin) FILTER (cum >= ceil(al / 4)) AS b1, min(bin) FILTER (cum >= ceil(al / 2)) AS b2, min(bin) FILTER (cum >= ceil(al * 0.75)) AS b3, max(al) AS rows_ FROM up GROUP BY ALL),
q AS (SELECT *, CASE WHEN b1 = 0 THEN 0 ELSE exp((b1 - 1) / 100) END AS q1, CASE WHEN b2 = 0 THEN 0 ELSE exp((b2 - 0.5) / 100) END AS q2, CASE WHEN b3 = 0 THEN 0 ELSE exp(b3 / 100) END AS q3 FROM q0),
w AS (SELECT level, lang, source, max(rows_) AS n, {", ".join(f"max(q1) FILTER (m = 'm{k}') AS a{k}, max(q3) FILTER (m = 'm{k}') AS c{k}, max(q2) FILTER (m = 'u{k}') AS e{k}" for k in (1, 2, 3, 4))} FROM q GROUP BY ALL),
th AS (SELECT level, lang, source, n, a1 - 3 * (c1 - a1) AS lo1, c1 + 3 * (c1 - a1) AS hi1, {", ".join(f"c{k} + greatest(3 * (c{k} - a{k}), e{k} / 5) AS hi{k}" for k in (2, 3, 4))} FROM w),
j AS (SELECT b.*, th.level AS lev, lo1, hi1, hi2, hi3, hi4 FROM b LEFT JOIN th ON level = 0 OR (n >= 100 AND b.lang IS NOT DISTINCT FROM th.lang AND (level = 1 OR b.source IS NOT DISTINCT FROM th.source)) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(m1 >= lo1 AND m1 <= hi1 AND m2 <= hi2 AND m3 <= hi3 AND m4 <= hi4, true) AS kept, CAST(lev AS INTEGER) AS threshold_level FROM j"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes: the table of one byte's remainders, folded over the bytes."""
    entries = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        entries.append(n)
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    fold = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, x: xor(c >> 8, {entries}[(xor(c, x) & 255) + 1]))"
    return f"xor({fold}, 4294967295)"


def op2() -> str:
    """The curve alone is the operator's: that it visits every cell and steps to a neighbour is tested apart."""
    code = lambda t, v: f"coalesce((SELECT r FROM {t} WHERE v = {v} AND r < 12), 12 + {crc32_sql(v)} % 4)"
    top = lambda c: f"SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS r FROM k GROUP BY {c}"
    return f"""WITH k AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
lt AS ({top('lang')}), st AS ({top('source')}), lc AS (SELECT v AS lang, {code('lt', 'lc0.v')} AS q_lang FROM lt lc0), sc AS (SELECT v AS source, {code('st', 'sc0.v')} AS q_source FROM st sc0),
zb AS (SELECT floor(ln(size) * 20) AS bin, count(*) AS n FROM k GROUP BY 1), zc AS (SELECT bin, CAST(16 * (sum(n) OVER (ORDER BY bin) - n) // sum(n) OVER () AS INTEGER) AS q_size FROM zb),
q AS (SELECT k.*, CAST(q_lang AS INTEGER) AS q_lang, CAST(q_source AS INTEGER) AS q_source, q_size FROM k JOIN lc USING (lang) JOIN sc USING (source) JOIN zc ON zc.bin = floor(ln(k.size) * 20)),
h AS (SELECT *, {sharding.curve()}[q_lang * 256 + q_source * 16 + q_size + 1] AS hilbert FROM q),
c AS (SELECT *, ceil(count(*) OVER (PARTITION BY hilbert) / 4096.0) AS runs FROM h),
r AS (SELECT *, row_number() OVER (ORDER BY hilbert, CASE WHEN runs = 1 THEN 0 ELSE {crc32_sql("CAST(doc_id AS VARCHAR)")} % CAST(runs AS BIGINT) END, text_crc32, doc_id) - 1 AS place, count(*) OVER () AS n FROM c)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 16 // n AS INTEGER) AS shard, place - ((place * 16 // n) * n + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(hilbert AS INTEGER) AS hilbert, q_lang, q_source, q_size FROM r"""


OP4 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), g AS (SELECT *, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != best THEN best END AS refers_to FROM g"""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP5 = rf"""WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS t FROM documents), x AS (SELECT doc_id, {_WORDS} AS ws FROM d),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM x)),
n AS MATERIALIZED (SELECT x.doc_id, count(g) AS n FROM x LEFT JOIN s USING (doc_id) GROUP BY x.doc_id),
l AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT l.v, reach.seen FROM reach JOIN l ON l.u = reach.node)
SELECT n.doc_id, n.n AS n_shingles, min(reach.seen) AS component_id FROM n JOIN reach ON reach.node = n.doc_id GROUP BY n.doc_id, n.n"""

ORACLE_SQL = {"op1_quality_rules": OP1, "op2_sharding": op2(), "op4_warc": OP4, "op5_ngram_jaccard": OP5}
