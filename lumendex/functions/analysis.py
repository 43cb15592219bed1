"""Text analysis: Unicode words, the term generator, stop words, n-grams.

tokenize() is the whole rule on one text; terms() runs it over a column in batches. The ASCII rule of the catalog
(words_of) stays JVM-side and is the one for plain corpora.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stem import ALIASES, stem
from .stopwords import STOPWORDS  # noqa: F401

MAX_WORD = 64
_WORD_CATEGORIES = {"Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Me", "Mc", "Nd", "Nl", "No", "Pc"}
# Characters that join parts of a word, parts of a number, or are dropped within a word.
INFIX = {"'": "'", "’": "'", "‛": "'", "&": "&", "·": "·", "״": "״", "‧": "‧"}
INFIX_NUMBER = set(",.;·") | {";", "։", "،", "؍", "߸", "⁄", "︐", "︓", "︔"}
IGNORED = {"­", "​", "‌", "‍", "⁠", "﻿"}
SUFFIXES = "+#"

# Scripts written without spaces, as ranges of code points.
_UNSPACED = ((0x1100, 0x11FF), (0x2E80, 0x2FFF), (0x3040, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF65, 0xFFDC), (0x20000, 0x323AF), (0x0E00, 0x0EFF), (0x1780, 0x17FF), (0x1000, 0x109F))


def is_wordchar(c: str) -> bool:
    return unicodedata.category(c) in _WORD_CATEGORIES


def unspaced(c: str) -> bool:
    n = ord(c)
    return n >= 0x0E00 and any(a <= n <= b for a, b in _UNSPACED)


# The rule of _by_characters as one expression, for texts whose characters Python's \w and \d tell as the categories do.
_INFIX, _NUMBER = re.escape("".join(INFIX)), re.escape("".join(sorted(INFIX_NUMBER)))
_WORDS = re.compile(rf"[A-Z]\.(?:(?:[A-Z]\.)+[A-Z]?|[A-Z])(?!\w)|\w+(?:(?:[{_INFIX}](?=\w)|(?<=\d)[{_NUMBER}](?=\d))\w+)*(?:[+#]{{1,3}}(?![\w+#]))?")
_ACRONYM = re.compile(r"[A-Z]\.[A-Z.]+")
_APOSTROPHES = str.maketrans({c: x for c, x in INFIX.items() if c != x})
_plain: dict[bool, set[str]] = {False: set(), True: set()}


def _is_plain(c: str, ngrams: bool) -> bool:
    return is_wordchar(c) == bool(re.match(r"\w", c)) and c.isdigit() == c.isdecimal() and c not in IGNORED and not (ngrams and unspaced(c))


def plain(text: str, ngrams: bool = False) -> bool:
    """Whether _WORDS finds the text's words."""
    known = _plain[ngrams]
    new = set(text) - known
    if not new:
        return True
    good = {c for c in new if _is_plain(c, ngrams)}
    known |= good
    return len(good) == len(new)


def _written(found: str) -> str:
    """The term of what _WORDS found."""
    return (found.replace(".", "") if _ACRONYM.fullmatch(found) else found.translate(_APOSTROPHES)).lower()


def tokenize(text: str, ngrams: bool = False) -> Iterator[tuple[str, bool, int]]:
    """(term, whether it takes a position, offset of its first character) of each word of a text, lower-cased."""
    if plain(text, ngrams):
        return ((_written(m.group()), True, m.start()) for m in _WORDS.finditer(text))
    return _by_characters(text, ngrams)


def _by_characters(text: str, ngrams: bool = False) -> Iterator[tuple[str, bool, int]]:
    """tokenize(), for any text."""
    i, n = 0, len(text)
    while i < n:
        if not is_wordchar(text[i]):
            i += 1
            continue
        start = i
        if ngrams and unspaced(text[i]):
            while i < n and unspaced(text[i]):
                i += 1
            for k in range(start, i):
                yield text[k].lower(), True, k
                if k + 1 < i:
                    yield text[k : k + 2].lower(), False, k
            continue
        m = re.match(r"(?:[A-Z]\.)+[A-Z]?(?!\w)", text[i:]) if text[i].isupper() else None
        if m and m.group().count(".") >= 1 and len(m.group()) >= 3:
            yield m.group().replace(".", "").lower(), True, start
            i += m.end()
            continue
        word = []
        while i < n:
            c = text[i]
            if c in IGNORED:
                i += 1
                continue
            if is_wordchar(c) and not (ngrams and unspaced(c)):
                word.append(c)
                i += 1
                continue
            j = i + 1
            while j < n and text[j] in IGNORED:
                j += 1
            if j < n and is_wordchar(text[j]):
                if c in INFIX:
                    word.append(INFIX[c])
                    i = j
                    continue
                if c in INFIX_NUMBER and word and word[-1].isdigit() and text[j].isdigit():
                    word.append(c)
                    i = j
                    continue
            break
        k = i
        while k < n and text[k] in SUFFIXES:
            k += 1
        if 0 < k - i <= 3 and (k == n or not is_wordchar(text[k])):
            word += text[i:k]
            i = k
        yield "".join(word).lower(), True, start


@dataclass(frozen=True)
class TermGenerator:
    """Words to terms. strategy: none, some (stems beside words, without positions), some_full_pos, all, all_z."""

    language: str = "none"
    strategy: str = "some"
    stopwords: tuple[str, ...] = ()
    stop: str = "stemmed"  # none, all, stemmed: which forms stop words lose
    ngrams: bool = False
    max_word: int = MAX_WORD

    def terms(self, text: str, prefix: str = "", first: int = 0) -> Iterator[tuple[str, int | None]]:
        """(term, position or None)."""
        pos, stops, known = first, set(self.stopwords), {}
        for word, placed, _ in tokenize(text, self.ngrams):
            forms = known.get((word, placed))
            if forms is None:
                forms = known[word, placed] = self._forms(word, placed, prefix, stops)
            if forms is SKIPPED:
                continue
            pos += placed
            for term, at in forms:
                yield term, pos if at else None

    def _forms(self, word: str, placed: bool, prefix: str, stops: set[str]) -> list[tuple[str, bool]] | None:
        """(term, whether it takes the word's position) of a word; SKIPPED: too long, and not counted by positions."""
        if len(word.encode()) > self.max_word:
            return SKIPPED
        if self.stop == "all" and word in stops:
            return []
        stemming = ALIASES.get(self.language, self.language) != "none"
        out = [(prefix + word, placed)] if self.strategy in ("some", "none", "some_full_pos") or not stemming else []
        if not stemming or self.strategy == "none" or not placed and self.ngrams or self.stop == "stemmed" and word in stops or not self._stemmable(word):
            return out
        root = stem(word, self.language)
        return [*out, (prefix + root if self.strategy == "all" else "Z" + prefix + root, placed and self.strategy != "some")]

    @staticmethod
    def _stemmable(word: str) -> bool:
        return word[0].isalpha()

    def tokens(self, docs: DataFrame, text: str = "text", prefix: str = "", wdf_inc: int = 1, first: int = 0, positions: bool = True) -> DataFrame:
        """(did, term, wdf_inc, pos) of docs (did, text), in frames of some CHUNK rows."""

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made() -> pa.RecordBatch:
                out = pa.record_batch([pa.array(dids, pa.int64()), pa.array(terms, pa.string()), pa.array([wdf_inc] * len(dids), pa.int32()), pa.array(at, pa.int32())], names=["did", "term", "wdf_inc", "pos"])
                for x in (dids, terms, at):
                    x.clear()
                return out

            dids, terms, at = [], [], []
            for did, x in _rows(batches):
                for term, p in self.terms(x, prefix, first):
                    dids.append(did), terms.append(term), at.append(p if positions else None)
                    if len(dids) >= CHUNK:
                        yield made()
            yield made()

        small_batches(docs.sparkSession)
        return docs.select(F.col("did").cast("long").alias("did"), F.col(text).alias("text")).mapInArrow(f, "did long, term string, wdf_inc int, pos int")

    def counts(self, docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
        """term, n: how often each term occurs in all of docs (text), as tokens() has it. Words are counted before terms are made."""

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made() -> pa.RecordBatch:
                n = Counter()
                for found, k in words.items():
                    for term, _ in self._forms(_written(found), True, prefix, stops) or ():
                        n[term] += k
                for (word, placed), k in odd.items():
                    for term, _ in self._forms(word, placed, prefix, stops) or ():
                        n[term] += k
                words.clear(), odd.clear()
                return pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

            words, odd, stops = Counter(), Counter(), set(self.stopwords)
            for _, x in _rows(batches):
                # a long text counts in pieces, cut at blanks, which no word holds
                for piece in _pieces(x):
                    if plain(piece, self.ngrams):
                        words.update(_WORDS.findall(piece))
                    else:
                        odd.update((w, placed) for w, placed, _ in _by_characters(piece, self.ngrams))
                    if len(words) + len(odd) >= CHUNK:
                        yield made()
            yield made()

        small_batches(docs.sparkSession)
        x = docs.select(F.lit(0).cast("long").alias("did"), F.col(text).alias("text")).mapInArrow(f, "term string, n long")
        return x.groupBy("term").agg(F.sum("n").alias("n"))


#: What TermGenerator says of words that are too long.
SKIPPED = None
#: Rows of a frame that goes back to Spark; characters of a text that are counted at a time; bytes of a batch that comes from Spark.
CHUNK, PIECE, BATCH_BYTES = 1 << 16, 1 << 20, 8 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Python gets texts in batches of some BATCH_BYTES for the session, unless it has a smaller limit: texts are long rows."""
    now = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_BYTES)))
    if now > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    """did, text of each row with a text, one by one."""
    for b in batches:
        for did, x in zip(b.column(0), b.column(1)):
            if x := x.as_py():
                yield did.as_py(), x


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE and (m := _BLANK.search(text, at + PIECE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


_BLANK = re.compile(r"[ \n]")


# ---- markup

_TAG = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_BREAK = re.compile(r"^</?(p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|title|option|pre|blockquote|center|dd|dt|dl|fieldset|form|hr|frameset)\b", re.I)


def html_parts(page: str) -> dict[str, str]:
    """title, text, description, keywords, author, robots of an HTML page."""
    out = {k: "" for k in ("title", "text", "description", "keywords", "author", "robots")}
    for tag in re.findall(r"<meta\b[^>]*>", page, re.I):
        a = {k.lower(): html.unescape(v.strip("'\"")) for k, v in re.findall(r"([\w-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", tag)}
        if a.get("name", "").lower() in out:
            out[a["name"].lower()] = a.get("content", "")
    m = re.search(r"<title[^>]*>(.*?)</title\s*>", page, re.I | re.S)
    out["title"] = _squash(html.unescape(m.group(1))) if m else ""
    body = re.sub(r"<title[^>]*>.*?</title\s*>", " ", page, flags=re.I | re.S)
    out["text"] = _squash(html.unescape(_TAG.sub(lambda t: " " if _BREAK.match(t.group()) else "", body)))
    return out


def _squash(s: str) -> str:
    return re.sub(r"[ \t\r\n\f\v]+", " ", s).strip(" ")


def strip_xml(text: str) -> str:
    return _squash(re.sub(r"<[^>]*>", " ", text))


PARTS = ("title", "text", "description", "keywords", "author", "robots")
#: Characters of pages that are taken apart for one frame.
PAGES = 4 << 20


def extracted(pages: DataFrame, html: bool = False) -> DataFrame:
    """page_id, url and the parts of each page's html; and the html too."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names) if rows else pa.record_batch([pa.array([], k) for k in kinds], names=names)
            rows.clear()
            return out

        rows, size = [], 0
        for b in batches:
            for one in zip(*b.columns):
                page, url, text = (x.as_py() for x in one)
                parts = html_parts(text or "")
                rows.append((page, url, *[parts[k] for k in PARTS], *([text] if html else [])))
                size += len(text or "")
                if size >= PAGES:
                    size = 0
                    yield made()
        yield made()

    names = ["page_id", "url", *PARTS, *(["html"] if html else [])]
    kinds = [pa.int64(), *[pa.string()] * (len(names) - 1)]
    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(f, "page_id long, " + ", ".join(f"{x} string" for x in names[1:]))
