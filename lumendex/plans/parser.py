"""The search-box language: text to a query. Runs on the driver; only the dictionary is looked up, and only if asked for.

Binding, loosest first: OR, XOR, AND and NOT, then words side by side. Loved (+), hated (-) and plain parts of one
group combine at its end, with the group's filters and ranges.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from ..functions.analysis import INFIX, INFIX_NUMBER, is_wordchar
from ..functions.stem import ALIASES, stem
from ..operators.ast import Query, QueryError

FLAGS = ("boolean", "phrase", "lovehate", "boolean_any_case", "wildcard", "wildcard_multi", "wildcard_single", "pure_not", "partial", "synonym", "auto_synonyms", "fuzzy", "spelling", "ngrams", "no_proper_noun_heuristic", "no_positions", "accumulate")
DEFAULT_FLAGS = frozenset({"boolean", "phrase", "lovehate"})
_NO_STEM_BEFORE = "(/\\@<>=*[{\""
_OPERATORS = {"AND", "OR", "XOR", "NOT", "NEAR", "ADJ", "SYN"}
_JOINERS = ".-/:\\@"


@dataclass
class Prefix:
    terms: tuple[str, ...]
    boolean: bool = False
    exclusive: bool = True
    grouping: str | None = None
    processor: Callable[[str], Query] | None = None


@dataclass
class Word:
    """One word of the input and how it may be changed."""

    text: str
    prefixes: tuple[str, ...]
    pos: int
    stemming: bool
    kind: str = "word"  # word, wildcard, partial, fuzzy, synonym
    edits: int = 2


@dataclass
class Group:
    """Parts of a group as they are met."""

    plain: list[Query] = field(default_factory=list)
    love: list[Query] = field(default_factory=list)
    hate: list[Query] = field(default_factory=list)
    filters: dict[str, list[tuple[Query, bool]]] = field(default_factory=dict)
    not_filters: list[Query] = field(default_factory=list)
    ranges: dict[object, list[Query]] = field(default_factory=dict)


class QueryParser:
    def __init__(self, language: str = "none", strategy: str = "some", default_op: str = "OR", stopwords: Iterable[str] = (), synonyms: dict[str, list[str]] | None = None, suggest: Callable[[str], str | None] | None = None, known: Callable[[str], bool] | None = None):
        if default_op not in ("AND", "OR", "NEAR", "PHRASE", "ELITE_SET", "SYNONYM", "MAX"):
            raise QueryError(f"{default_op} can't be the default operator")
        self.language, self.strategy, self.default_op = ALIASES.get(language, language), strategy, default_op
        self.stopwords, self.synonyms, self.suggest, self.known = frozenset(stopwords), synonyms or {}, suggest, known
        self.prefixes: dict[str, Prefix] = {"": Prefix(("",))}
        self.ranges: list = []
        self.max_expansion, self.min_wildcard_prefix = 0, 0
        self.stoplist: list[str] = []
        self.unstem: dict[str, list[str]] = {}
        self.corrected = ""

    # ---- set up

    def add_prefix(self, field_: str, prefix: str | Callable[[str], Query]) -> None:
        if callable(prefix):
            self.prefixes[field_] = Prefix((), processor=prefix)
        else:
            old = self.prefixes.get(field_)
            self.prefixes[field_] = Prefix((*(old.terms if old else ()), prefix))

    def add_boolean_prefix(self, field_: str, prefix: str | Callable[[str], Query], exclusive: bool = True, grouping: str | None = None) -> None:
        made = Prefix((), True, exclusive, grouping or field_, prefix) if callable(prefix) else Prefix((*(self.prefixes[field_].terms if field_ in self.prefixes else ()), prefix), True, exclusive, grouping or field_)
        self.prefixes[field_] = made

    def add_range(self, processor) -> None:
        self.ranges.append(processor)

    # ---- reading

    def parse(self, text: str, flags: Iterable[str] = DEFAULT_FLAGS, default_prefix: str = "") -> Query:
        self.flags = frozenset(flags)
        if bad := self.flags - set(FLAGS):
            raise QueryError(f"no flag {sorted(bad)}")
        if "accumulate" not in self.flags:
            self.stoplist, self.unstem = [], {}
        self.text, self.at, self.pos, self.base = text, 0, 0, default_prefix
        self.corrected, self._edits = text, []
        self.items = self._lex()
        self.i = 0
        q = self._expression()
        while self.i < len(self.items):  # brackets that close nothing are passed over
            self.i += 1
            more = self._expression()
            q = q if more.empty() else more if q.empty() else self._join([q, more])
        for a, b, new in sorted(self._edits, reverse=True):
            self.corrected = self.corrected[:a] + new + self.corrected[b:]
        return q

    def _lex(self) -> list[tuple]:
        """('op', name, n), ('(',), (')',), ('+',), ('-',), ('word', Word), ('phrase', [Word], op), ('filter', field, Query), ('range', key, Query)."""
        out: list[tuple] = []
        s, n, i = self.text, len(self.text), 0
        depth = 0
        while i < n:
            c = s[i]
            if c.isspace():
                i += 1
                continue
            before = s[i - 1] if i else " "
            fresh = before.isspace() or before in "(+-"
            m = re.match(r"\S*?\.\.\S*", s[i:]) if fresh and self.ranges else None
            if m and (r := self._range(m.group())):
                out.append(("range", *r))
                i += m.end()
                continue
            m = re.match(r"(\w[\w.]*):(?=\S)", s[i:]) if fresh else None
            if m and m.group(1) in self.prefixes and m.group(1):
                p = self.prefixes[m.group(1)]
                if p.boolean:
                    i += m.end()
                    v = re.match(r'"((?:[^"]|"")*)"|([^\s)]+)', s[i:])
                    if v:
                        value = v.group(1).replace('""', '"') if v.group(1) is not None else v.group(2)
                        out.append(("filter", m.group(1), self._boolean(p, value)))
                        i += v.end()
                    continue
                if p.processor is not None:
                    i += m.end()
                    v = re.match(r'"([^"]*)"|([^\s)]+)', s[i:])
                    if v:
                        out.append(("query", p.processor(v.group(1) if v.group(1) is not None else v.group(2))))
                        i += v.end()
                    continue
                rest = s[i + m.end() : i + m.end() + 1]
                if rest in '"(' or is_wordchar(rest):
                    i += m.end()
                    if rest == "(":
                        out.append(("field", p.terms))
                        continue
                    i = self._words(out, i, p.terms)
                    continue
            if c == '"' and "phrase" in self.flags:
                i = self._words(out, i, self.prefixes[""].terms if not self.base else (self.base,))
                continue
            if c == "(" and "boolean" in self.flags:
                depth += 1
                out.append(("(",))
                i += 1
                continue
            if c == ")" and "boolean" in self.flags:
                if depth:
                    depth -= 1
                    out.append((")",))
                i += 1
                continue
            if c in "+-" and "lovehate" in self.flags and fresh and i + 1 < n and (is_wordchar(s[i + 1]) or s[i + 1] in '"('):
                out.append((c,))
                i += 1
                continue
            if c == "~" and "synonym" in self.flags and i + 1 < n and (is_wordchar(s[i + 1]) or s[i + 1] == '"'):
                i += 1
                k = len(out)
                i = self._words(out, i, (self.base,))
                for item in out[k:]:
                    if item[0] == "word":
                        item[1].kind = "synonym"
                continue
            if "boolean" in self.flags and fresh and (m := re.match(r"(AND|OR|XOR|NOT|SYN|NEAR|ADJ)(?:/(\d+))?(?=[\s()]|$)", s[i:], re.I if "boolean_any_case" in self.flags else 0)):
                name = m.group(1).upper()
                if m.group(2) is None or name in ("NEAR", "ADJ"):
                    out.append(("op", name, int(m.group(2) or 0)))
                    i += m.end()
                    continue
            if is_wordchar(c) or c in "*?" and {"wildcard_multi", "wildcard_single"} & self.flags:
                i = self._words(out, i, (self.base,))
                continue
            i += 1
        return out

    def _one(self, i: int, prefixes: tuple[str, ...], inside: bool) -> tuple[Word | None, int]:
        """The word that begins at i and where it ends."""
        s, n, start = self.text, len(self.text), i
        m = re.match(r"(?:[A-Z]\.)+[A-Z]?(?!\w)", s[i:])
        word = []
        if m and len(m.group()) >= 3:
            word, i = list(m.group().replace(".", "")), i + m.end()
        else:
            marks = ("*" if "wildcard_multi" in self.flags else "") + ("?" if "wildcard_single" in self.flags else "")
            while i < n:
                c = s[i]
                if is_wordchar(c) or c in marks and (i + 1 < n and is_wordchar(s[i + 1]) or c == "*" or c == "?" and word):
                    word.append(c)
                    i += 1
                elif i + 1 < n and is_wordchar(s[i + 1]) and (c in INFIX or c in INFIX_NUMBER and word[-1:] and word[-1].isdigit() and s[i + 1].isdigit()):
                    word.append(INFIX.get(c, c))
                    i += 1
                else:
                    break
            k = i
            while k < n and s[k] in "+#":
                k += 1
            if 0 < k - i <= 3 and (k == n or not is_wordchar(s[k])):
                full = "".join(word) + s[i:k]
                if s[i:k] != "+" and self.known is None or self.known is not None and self.known(full.lower()):
                    word += s[i:k]
                    i = k
        text = "".join(word)
        if not text:
            return None, i + 1
        self.pos += 1
        proper = text[0].isupper() and "no_proper_noun_heuristic" not in self.flags and self.strategy == "some"
        blocked = i < n and s[i] in _NO_STEM_BEFORE
        w = Word(text.lower(), prefixes, self.pos, not (proper or blocked or inside and self.strategy == "some"))
        if any(c in text for c in "*?") and {"wildcard_multi", "wildcard_single"} & self.flags:
            w.kind = "pattern"
        elif i < n and s[i] == "*" and "wildcard" in self.flags and (i + 1 == n or not is_wordchar(s[i + 1])):
            if len(text) >= self.min_wildcard_prefix:
                w.kind = "wildcard"
            i += 1
        elif "fuzzy" in self.flags and i < n and s[i] == "~":
            m = re.match(r"~(\d+\.\d+|\d+)?", s[i:])
            w.kind, i = "fuzzy", i + m.end()
            if m.group(1):
                w.edits = int(float(m.group(1)) * len(text)) if "." in m.group(1) else int(m.group(1))
        elif "partial" in self.flags and i == n:
            w.kind = "partial"
        elif "spelling" in self.flags and self.suggest and not inside and (new := self.suggest(w.text)):
            self._edits.append((start, i, new))
        return w, i

    def _words(self, out: list[tuple], i: int, prefixes: tuple[str, ...]) -> int:
        """A quoted phrase, or a word with those that joiners tie to it."""
        s, n = self.text, len(self.text)
        if s[i] == '"':
            i += 1
            words = []
            while i < n and s[i] != '"':
                if is_wordchar(s[i]):
                    w, i = self._one(i, prefixes, True)
                    if w:
                        words.append(w)
                else:
                    i += 1
            out.append(("phrase", words, "PHRASE"))
            return i + 1
        w, i = self._one(i, prefixes, False)
        words = [w] if w else []
        while i + 1 < n and s[i] in _JOINERS and is_wordchar(s[i + 1]) and words and words[-1].kind == "word":
            w, i = self._one(i + 1, prefixes, True)
            words.append(w)
        if len(words) > 1:
            for w in words:
                w.stemming = False if self.strategy == "some" else w.stemming
            out.append(("phrase", words, "PHRASE"))
        elif words:
            out.append(("word", words[0]))
        return i

    def _range(self, text: str):
        a, _, b = text.partition("..")
        for r in self.ranges:
            q = r(a, b)
            if q is not None:
                return getattr(r, "grouping", None) or ("slot", getattr(r, "slot", id(r))), q
        return None

    def _boolean(self, p: Prefix, value: str) -> Query:
        if p.processor:
            return p.processor(value)
        made = [Query.term(t + (":" if len(t) > 1 and value[:1] and (value[0].isupper() or value[0] == ":") else "") + value) for t in p.terms]
        return Query.of("OR", made)

    # ---- terms

    def _term(self, w: Word, prefix: str) -> Query:
        sep = ":" if len(prefix) > 1 and prefix[-1] != ":" and (w.text[0].isupper() or w.text[0] == ":") else ""
        plain = prefix + sep + w.text
        most = self.max_expansion
        if w.kind == "wildcard":
            return Query.wildcard(plain, most, patterns=False)
        if w.kind == "pattern":
            return Query.wildcard(plain, most)
        if w.kind == "fuzzy":
            return Query.edit_distance(plain, w.edits, len(prefix), most)
        if w.kind == "partial":
            exact = Query.term(self._form(w, prefix), 1, w.pos)
            return Query.of("OR", [Query.wildcard(plain, most or 100, "MOST_FREQUENT", patterns=False), exact])
        q = Query.term(self._form(w, prefix), 1, w.pos)
        wanted = w.kind == "synonym" or "auto_synonyms" in self.flags
        if wanted and (found := self.synonyms.get(plain) or self.synonyms.get(self._form(w, prefix))):
            return Query.of("SYNONYM", [q, *(Query.term(prefix + t, 1, w.pos) for t in found)])
        return q

    def _form(self, w: Word, prefix: str) -> str:
        sep = ":" if len(prefix) > 1 and prefix[-1] != ":" and (w.text[0].isupper() or w.text[0] == ":") else ""
        if self.language == "none" or self.strategy == "none" or not w.text[0].isalpha():
            out = prefix + sep + w.text
        elif self.strategy in ("all", "all_z"):
            out = ("Z" if self.strategy == "all_z" else "") + prefix + sep + stem(w.text, self.language)
        elif w.stemming:
            out = "Z" + prefix + sep + stem(w.text, self.language)
        else:
            out = prefix + sep + w.text
        self.unstem.setdefault(out, []).append(w.text)
        return out

    def _query(self, w: Word) -> Query:
        return Query.of("OR", [self._term(w, p) for p in w.prefixes])

    def _stopped(self, w: Word) -> bool:
        return w.kind == "word" and w.text in self.stopwords

    # ---- grammar

    def _peek(self, *kinds: str) -> tuple | None:
        item = self.items[self.i] if self.i < len(self.items) else None
        return item if item and (item[0] in kinds or item[0] == "op" and item[1] in kinds) else None

    def _take(self, *kinds: str) -> tuple | None:
        item = self._peek(*kinds)
        if item:
            self.i += 1
        return item

    def _expression(self) -> Query:
        out = [self._xor()]
        while self._take("OR"):
            out.append(self._right("OR", self._xor))
        return out[0] if len(out) == 1 else Query.of("OR", out)

    def _right(self, name: str, rule) -> Query:
        q = rule()
        if q.empty() and self.i >= len(self.items):
            raise QueryError(f"Syntax: <expression> {name} <expression>")
        return q

    def _xor(self) -> Query:
        out = [self._and()]
        while self._take("XOR"):
            out.append(self._right("XOR", self._and))
        return out[0] if len(out) == 1 else Query.of("XOR", out)

    def _and(self) -> Query:
        if self._peek("NOT"):
            if "pure_not" not in self.flags:
                raise QueryError("Syntax: <expression> NOT <expression>")
            self._take("NOT")
            q = Query.of("AND_NOT", [Query.all() * 0, self._right("NOT", self._and)])
        else:
            q = self._group()
        while True:
            if self._take("AND"):
                if self._take("NOT"):
                    q = Query.of("AND_NOT", [q, self._right("AND NOT", self._group)])
                else:
                    if q.empty() and self.i <= 1:
                        raise QueryError("Syntax: <expression> AND <expression>")
                    q = Query.of("AND", [q, self._right("AND", self._group)])
            elif self._take("NOT"):
                q = Query.of("AND_NOT", [q, self._right("NOT", self._group)])
            else:
                return q

    def _atom(self) -> tuple[Query, Word | None] | None:
        if item := self._take("word"):
            return self._query(item[1]), item[1]
        if item := self._take("phrase"):
            if not item[1]:
                return Query.nothing(), None
            if "no_positions" in self.flags:
                return Query.of("AND", [self._query(w) for w in item[1]]), None
            per = [Query.of("PHRASE", [Query.term(p + w.text if self.strategy in ("some", "none") or self.language == "none" else self._form(w, p), 1, w.pos) for w in item[1]], len(item[1])) for p in item[1][0].prefixes]
            return Query.of("OR", per), None
        if item := self._take("query"):
            return item[1], None
        if item := self._take("field"):
            old = self.base
            k = self.i
            for it in self.items[k:]:
                if it[0] == ")":
                    break
                for w in [it[1]] if it[0] == "word" else it[1] if it[0] == "phrase" else []:
                    w.prefixes = item[1]
            out = self._atom()
            self.base = old
            return out
        if self._take("("):
            q = self._expression()
            self._take(")")
            return q, None
        return None

    def _group(self) -> Query:
        g, stops, sign = Group(), [], ""
        while True:
            if item := self._take("+", "-"):
                sign = item[0]
                continue
            if item := self._take("filter"):
                p = self.prefixes[item[1]]
                if sign == "-":
                    g.not_filters.append(item[2])
                else:
                    g.filters.setdefault(p.grouping if p.exclusive else f"{p.grouping}\0{len(g.filters)}", []).append((item[2], p.exclusive))
                sign = ""
                continue
            if item := self._take("range"):
                g.ranges.setdefault(item[1], []).append(item[2])
                sign = ""
                continue
            at = self._atom()
            if at is None:
                break
            q, w = at
            if near := self._peek("NEAR", "ADJ"):
                q, w = self._nearby(q, near), None
            if syn := self._peek("SYN"):
                qs = [q]
                while self._take("SYN"):
                    qs.append(self._atom()[0])
                q, w = Query.of("SYNONYM", qs), None
            if sign == "+":
                g.love.append(q)
            elif sign == "-":
                g.hate.append(q)
            elif w is not None and self._stopped(w):
                stops.append(q)
                self.stoplist.append(w.text)
            else:
                g.plain.append(q)
            sign = ""
        if stops and not g.plain and not g.love:  # a group of stop words alone means them
            g.plain = stops
            self.stoplist = self.stoplist[: -len(stops)]
        return self._combined(g)

    def _nearby(self, first: Query, item: tuple) -> Query:
        op, window, qs = item[1], 0, [first]
        while nxt := self._take(op):
            window = max(window, nxt[2])
            at = self._atom()
            if at is None:
                break
            qs.append(at[0])
        if len(qs) == 1:
            return first
        return Query.of("NEAR" if op == "NEAR" else "PHRASE", qs, (window or 10) + len(qs) - 1)

    def _join(self, qs: list[Query]) -> Query:
        if self.default_op in ("NEAR", "PHRASE"):
            simple = [q for q in qs if q.op == "TERM"]
            if len(simple) == len(qs):
                return Query.of(self.default_op, qs, len(qs) + 9)
            return Query.of("AND", qs)
        return Query.of(self.default_op, qs)

    def _combined(self, g: Group) -> Query:
        plain = self._join(g.plain) if g.plain else Query.nothing()
        if g.love:
            love = Query.of("AND", g.love)
            q = love if plain.empty() else Query.of("AND", [love, plain]) if self.default_op == "AND" else Query.of("AND_MAYBE", [love, plain])
        else:
            q = plain
        filters = []
        for made in g.filters.values():
            qs = [x for x, _ in made]
            filters.append(Query.of("OR" if made[0][1] else "AND", qs))
        for qs in g.ranges.values():
            filters.append(Query.of("OR", qs))
        if filters:
            f = Query.of("AND", filters)
            q = Query.of("FILTER", [q, f]) if not q.empty() else f * 0 if f.op not in ("VALUE_RANGE", "VALUE_GE", "VALUE_LE") else f
        bad = g.hate + g.not_filters
        if bad:
            if q.empty():
                q = Query.all() * 0
            q = Query.of("AND_NOT", [q, Query.of("OR", bad)])
        return q
