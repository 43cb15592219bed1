"""The template language's scalar commands as column expressions.

Lists are arrays of strings, true is any non-empty string, an empty string is false. Names are the commands' own; those
that are Python words end in an underscore. Commands on a session (hits, pages, filters) take it as arguments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def truth(cond: Column) -> Column:
    """A condition as the language's true or false."""
    return F.when(cond, "true").otherwise("")


def is_true(x) -> Column:
    return F.coalesce(_c(x), F.lit("")) != ""


# ---- arithmetic

def integer(x) -> Column:
    """The number at the beginning of a string, 0 without one."""
    x = _c(x)
    return F.coalesce(F.regexp_extract(x.cast("string"), r"^\s*([-+]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def add(*xs) -> Column:
    return reduce(lambda a, b: a + b, map(integer, xs))


def sub(a, b) -> Column:
    return integer(a) - integer(b)


def mul(*xs) -> Column:
    return reduce(lambda a, b: a * b, map(integer, xs))


def _over(a: Column, b: Column, symbol: str) -> Column:
    return F.when(b == 0, "divide by 0").otherwise(F.try_divide(a - F.try_mod(a, b), b).cast("long").cast("string") if symbol == "/" else F.try_mod(a, b).cast("string"))


def div(a, b) -> Column:
    return _over(integer(a), integer(b), "/")


def mod(a, b) -> Column:
    return _over(integer(a), integer(b), "%")


def muldiv(a, b, c) -> Column:
    return _over(integer(a) * integer(b), integer(c), "/")


def max_(*xs) -> Column:
    return F.greatest(*map(integer, xs)) if len(xs) > 1 else integer(xs[0])


def min_(*xs) -> Column:
    return F.least(*map(integer, xs)) if len(xs) > 1 else integer(xs[0])


def nice(x, thousands: str = ",") -> Column:
    out = F.format_number(integer(x), 0)
    return out if thousands == "," else F.replace(out, F.lit(","), F.lit(thousands))


def random(upper: int, seed: int | None = None) -> Column:
    return F.floor((F.rand(seed) if seed is not None else F.rand()) * (upper + 1)).cast("long")


# ---- logic

def and_(*xs) -> Column:
    return truth(reduce(lambda a, b: a & b, map(is_true, xs)))


def or_(*xs) -> Column:
    return F.coalesce(*[F.when(is_true(x), _c(x)) for x in xs], F.lit(""))


def not_(x) -> Column:
    return truth(~is_true(x))


def if_(cond, then, other="") -> Column:
    return F.when(is_true(cond), _c(then)).otherwise(_c(other))


def cond(*pairs) -> Column:
    """cond(c1, v1, c2, v2, ..., default)"""
    out = _c(pairs[-1]) if len(pairs) % 2 else F.lit("")
    for c, v in reversed(list(zip(pairs[: len(pairs) // 2 * 2 : 2], pairs[1::2]))):
        out = F.when(is_true(c), _c(v)).otherwise(out)
    return out


def switch(x, *pairs) -> Column:
    return cond(*[truth(_c(x) == _c(p)) if i % 2 == 0 and i + 1 < len(pairs) else p for i, p in enumerate(pairs)])


def eq(a, b) -> Column:
    return truth(_c(a) == _c(b))


def ne(a, b) -> Column:
    return truth(_c(a) != _c(b))


def ge(a, b) -> Column:
    return truth(integer(a) >= integer(b))


def gt(a, b) -> Column:
    return truth(integer(a) > integer(b))


def le(a, b) -> Column:
    return truth(integer(a) <= integer(b))


def lt(a, b) -> Column:
    return truth(integer(a) < integer(b))


# ---- strings

def lower(x) -> Column:
    return F.lower(_c(x))


def upper(x) -> Column:
    return F.upper(_c(x))


def length(lst) -> Column:
    return F.size(lst)


def substr(x, start: int, count: int | None = None) -> Column:
    """Negative: from the end, or all but so many characters."""
    x, n = _c(x), F.length(_c(x))
    first = F.lit(start) if start >= 0 else F.greatest(F.lit(0), n + start)
    if count is None:
        size = n
    elif count >= 0:
        size = F.lit(count)
    else:
        size = F.greatest(F.lit(0), n + count - first)
    return F.substring(x, first + 1, F.greatest(size.cast("int"), F.lit(0)))


def contains(needle, hay) -> Column:
    """Place of a string in another from 0, or empty."""
    at = F.instr(_c(hay), _c(needle))
    return F.when(at > 0, (at - 1).cast("string")).otherwise("")


def truncate(x, size: int, indicate: str = "", indicate_nonword: str | None = None) -> Column:
    """At most size characters, not within a word if there is another choice."""
    x = _c(x)
    cut = F.substring(x, 1, size - len(indicate) if size >= len(indicate) else size)
    word = F.regexp_replace(cut, r"\s+\S*$", "")
    return F.when(F.length(x) <= size, x).otherwise(F.concat(F.when(F.substring(x, size - len(indicate) + 1, 1).rlike(r"^\s"), F.rtrim(cut)).otherwise(word), F.lit(indicate)))


def html(x) -> Column:
    x = _c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def htmlstrip(x) -> Column:
    return F.regexp_replace(_c(x), "<[^>]*>", "")


def url(x) -> Column:
    return F.replace(F.url_encode(_c(x)), F.lit("+"), F.lit("%20"))


def prettyurl(x) -> Column:
    """%XX of printable ASCII that may stand in a URL, undone."""
    safe = "(?i)%(2D|2E|5F|7E|3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A])"
    return F.expr(f"aggregate(sequence(1, 16), {_sql(x)}, (s, i) -> if(s rlike '{safe}', replace(s, concat('%', regexp_extract(s, '{safe}', 1)), char(cast(conv(regexp_extract(s, '{safe}', 1), 16, 10) as int))), s))")


def _sql(x) -> str:
    if isinstance(x, Column):
        raise TypeError("name the column")
    return f"`{x}`"


def hostname(x) -> Column:
    return F.regexp_extract(_c(x), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^:/?#]*)", 1)


def csv(x, always: bool = False) -> Column:
    x = _c(x)
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return quoted if always else F.when(x.rlike('[",\r\n]'), quoted).otherwise(x)


def base64(x) -> Column:
    return F.base64(_c(x).cast("binary"))


def hash_(x) -> Column:
    return F.md5(_c(x).cast("binary"))


def chr_(x) -> Column:
    """The character of a code point."""
    n = integer(x)
    rest = n - 0x10000
    pair = F.when(n < 0x10000, n).otherwise(((rest / 1024).cast("long") + 0xD800) * 65536 + rest % 1024 + 0xDC00)
    return F.decode(F.unhex(F.lpad(F.hex(pair), F.when(n < 0x10000, 4).otherwise(8), F.lit("0"))), "UTF-16BE")


def ord_(x) -> Column:
    """The code point of the first character."""
    return F.ascii(_c(x)).cast("long")


def match(pattern: str, x, flags: str = "") -> Column:
    return truth(_c(x).rlike((f"(?{flags})" if flags else "") + pattern))


def transform(pattern: str, new: str, x, flags: str = "") -> Column:
    """Substitution, of the first match or (g) of all; \\1 to \\9 are groups."""
    import re

    inline = "".join(f for f in flags if f in "imsx")
    p, r = (f"(?{inline})" if inline else "") + pattern, re.sub(r"\\(\d)", r"$\1", new.replace("$", "\\$"))
    x = _c(x)
    if "g" in flags:
        return F.regexp_replace(x, p, r)
    at = F.regexp_instr(x, F.lit(p))
    hit = F.regexp_substr(x, F.lit(p))
    return F.when(at == 0, x).otherwise(F.concat(F.substring(x, F.lit(1), at - 1), F.regexp_replace(hit, p, r), F.substring(x, at + F.length(hit), F.length(x))))


# ---- lists

def split(x, sep: str = " ") -> Column:
    import re

    return F.split(_c(x), re.escape(sep)) if sep else F.split(_c(x), "")


def list_(lst, *marks: str) -> Column:
    """list_(l, between) or (l, before, between, after) or (l, before, between, last, after)."""
    if len(marks) == 1:
        return F.array_join(lst, marks[0])
    before, between, after = marks[0], marks[1], marks[-1]
    if len(marks) == 3:
        body = F.array_join(lst, between)
    else:
        n = F.size(lst)
        body = F.when(n < 2, F.array_join(lst, between)).otherwise(F.concat(F.array_join(F.slice(lst, F.lit(1), F.greatest(n - 1, F.lit(1))), between), F.lit(marks[2]), F.element_at(lst, -1)))
    return F.when(F.size(lst) == 0, "").otherwise(F.concat(F.lit(before), body, F.lit(after)))


def foreach(lst, f) -> Column:
    return F.array_join(F.transform(lst, f), "")


def map_(lst, f) -> Column:
    return F.transform(lst, f)


def find(lst, item) -> Column:
    at = F.array_position(lst, _c(item))
    return F.when(at > 0, (at - 1).cast("string")).otherwise("")


def range_(a, b) -> Column:
    a, b = integer(a), integer(b)
    return F.when(a > b, F.array().cast("array<string>")).otherwise(F.sequence(a, F.greatest(a, b)).cast("array<string>"))


def slice_(lst, positions) -> Column:
    return F.filter(F.transform(positions, lambda p: F.when((p >= 0) & (p < F.size(lst)), F.element_at(lst, (F.greatest(p, F.lit(0)) + 1).cast("int")))), lambda x: x.isNotNull()) if isinstance(positions, Column) else slice_(lst, F.lit(positions))


def sort(lst, options: str = "") -> Column:
    """r: descending, u: without repeats, # or n: by number."""
    out = F.array_distinct(lst) if "u" in options else lst
    if "#" in options or "n" in options:
        keyed = F.sort_array(F.transform(out, lambda x: F.struct(integer(x).alias("k"), x.alias("x"))), asc="r" not in options)
        return F.transform(keyed, lambda s: s["x"])
    return F.sort_array(out, asc="r" not in options)


def uniq(lst) -> Column:
    """Neighbours that are equal become one."""
    return F.filter(lst, lambda x, i: (i == 0) | (x != F.element_at(lst, F.greatest(i, F.lit(1)))))


def unique(lst) -> Column:
    return F.array_distinct(lst)


def keys(m) -> Column:
    return F.sort_array(F.map_keys(m))


def opt(m, key) -> Column:
    return F.coalesce(F.try_element_at(m, _c(key)), F.lit(""))


lookup = opt


def setmap(*pairs) -> Column:
    return F.create_map(*[_c(p) for p in pairs])


# ---- JSON

def json(x) -> Column:
    """A string's characters as they stand in a JSON string, without its quotes."""
    return F.regexp_extract(F.to_json(F.array(_c(x))), r'(?s)^\["(.*)"\]$', 1)


def jsonarray(lst) -> Column:
    return F.to_json(lst)


def jsonbool(x) -> Column:
    return F.when(is_true(x), "true").otherwise("false")


def jsonobject(m) -> Column:
    return F.to_json(m)


def jsonobject2(ks, vs) -> Column:
    return F.to_json(F.map_from_arrays(ks, vs))


# ---- time, sizes, packed numbers

def date(x, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.timestamp_seconds(integer(x)), pattern)


def now() -> Column:
    return F.unix_timestamp()


def filesize(x, units: str = "KMGT") -> Column:
    """A size in the first of the units that leaves less than 1024, or the last, with one decimal at every size."""
    n = integer(x)
    out = F.when(n < 0, "").when(n == 1, "1 byte").when(n < 1024, F.concat(n.cast("string"), F.lit(" bytes")))
    for k, u in enumerate(units, 1):
        unit = F.format_string(f"%.1f{u}", n / float(1024**k))
        out = out.when(n < 1024 ** (k + 1), unit) if k < len(units) else out.otherwise(unit)
    return out


def pack(x) -> Column:
    """A number as four bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(integer(x)), 8, "0"))


def unpack(x) -> Column:
    return F.conv(F.hex(x), 16, 10).cast("long")


# ---- terms and pages

def termprefix(term) -> Column:
    return F.regexp_extract(_c(term), r"^(X[A-Z]*|[A-Z])", 1)


def unprefix(term) -> Column:
    return F.regexp_replace(_c(term), r"^(X[A-Z]*:?|[A-Z]:?)", "")


def prettyterm(term) -> Column:
    """A term as a user writes it: a stem with a point, without its prefix."""
    t = _c(term)
    return F.when(t.startswith("Z"), F.concat(unprefix(F.substring(t, 2, 1 << 20)), F.lit("."))).otherwise(unprefix(t))


def field(data, name: str) -> Column:
    """A name=value line of a document's data."""
    return F.regexp_extract(_c(data), f"(?m)^{name}=(.*)$", 1)


def highlight(x, words: list[str], start: str = "<b>", end: str = "</b>") -> Column:
    """HTML-escaped text with a query's words tagged."""
    import re

    if not words:
        return html(x)
    alt = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    return F.regexp_replace(html(x), rf"(?i)(?<![A-Za-z0-9])({alt})(?![A-Za-z0-9])", f"{start}$1{end}")


def last(top: Column, per_page, size) -> Column:
    return F.least(top + _c(per_page), _c(size))


def lastpage(size, per_page) -> Column:
    return F.ceil(_c(size) / _c(per_page)).cast("long")


def thispage(top, per_page) -> Column:
    return F.floor(_c(top) / _c(per_page)).cast("long") + 1


def score(percent) -> Column:
    return F.floor(_c(percent) / 10).cast("long")


def subdb(did, shards: int) -> Column:
    return (_c(did) - 1) % shards


def subid(did, shards: int) -> Column:
    return F.floor((_c(did) - 1) / shards).cast("long") + 1
