"""Record dumps and files to documents: an index script's actions, date terms, long-term hashing, pages and files."""

from __future__ import annotations

import hashlib
import re
import shlex
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import analysis
from ..functions.stem import ALIASES
from .catalog import Catalog, boolean_tokens, postings_of

MAX_TERM = 239


# ---- dumps

def parse_records(lines: str) -> list[dict[str, list[str]]]:
    """field=value lines; a line that begins with '=' goes on with the field before."""
    out: list[dict[str, list[str]]] = []
    for block in re.split(r"\n[ \t]*\n+", lines.strip("\n")):
        rec: dict[str, list[str]] = {}
        name = None
        for line in block.split("\n"):
            if line.startswith("=") and name:
                rec[name][-1] += "\n" + line[1:]
            elif "=" in line:
                name, value = line.split("=", 1)
                rec.setdefault(name, []).append(value)
        if rec:
            out.append(rec)
    return out


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """rec, fields (map of a field to its values) of a dump: split at blank lines by the text source, whatever its size."""

    @F.pandas_udf("map<string,array<string>>")  # a session exists: path is being read
    def fields(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: (parse_records(t) or [{}])[0])

    x = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) != ''")
    return x.select(F.monotonically_increasing_id().alias("rec"), fields("value").alias("fields"))


# ---- index scripts

@dataclass
class Action:
    name: str
    arg: str = ""


@dataclass
class Script:
    """fields : actions lines. Each action changes the text that the next ones see, or makes part of the document."""

    lines: list[tuple[list[str], list[Action]]] = field(default_factory=list)

    @staticmethod
    def parse(text: str) -> Script:
        out = Script()
        for line in text.split("\n"):
            line = line.split("#", 1)[0].strip() if not line.strip().startswith("#") else ""
            if not line:
                continue
            names, _, rest = line.partition(":")
            lex = shlex.shlex(rest, posix=True)
            lex.whitespace_split, lex.commenters = True, ""
            actions = []
            for word in lex:
                name, _, arg = word.partition("=")
                if name not in ACTIONS:
                    raise ValueError(f"unknown action {name}")
                actions.append(Action(name, arg))
            out.lines.append((names.split(), actions))
        return out


ACTIONS = frozenset("boolean date field gap hash hextobin index indexnopos load lower ltrim parsedate rtrim spell split squash trim truncate unhtml unique unxml value valuenumeric valuepacked weight".split())


@dataclass
class Record:
    """What a script made of one record."""

    data: list[str] = field(default_factory=list)
    tokens: list[tuple[str, int, int | None]] = field(default_factory=list)
    values: list[tuple[int, str, float | None]] = field(default_factory=list)
    spell: list[str] = field(default_factory=list)
    unique: str | None = None
    pos: int = 0


def date_terms(yyyymmdd: str) -> list[str]:
    return [f"D{yyyymmdd}", f"M{yyyymmdd[:6]}", f"Y{yyyymmdd[:4]}"] if re.fullmatch(r"\d{8}", yyyymmdd) else []


def hash_term(term: str, length: int = MAX_TERM) -> str:
    """A long term cut, its tail a hash of what was cut off."""
    if len(term) <= length:
        return term
    return term[: length - 6] + hashlib.md5(term[length - 6 :].encode()).hexdigest()[:6]


def truncate_words(text: str, size: int) -> str:
    """At most size bytes, not within a word if there is another choice."""
    raw = text.encode()
    if len(raw) <= size:
        return text
    cut = raw[:size].decode(errors="ignore")
    if not raw[size : size + 1].isspace() and (m := re.match(r"(?s)(.*\S)\s+\S*$", cut)):
        cut = m.group(1)
    return cut.rstrip()


def run_script(script: Script, rec: dict[str, list[str]], language: str = "none") -> Record:
    out = Record()
    gen = analysis.TermGenerator(language)
    for names, actions in script.lines:
        for name in names:
            for value in rec.get(name, []):
                _apply(out, name, value, actions, gen)
    return out


def _apply(out: Record, name: str, text: str, actions: list[Action], gen: analysis.TermGenerator, weight: int = 1, spell: bool = False) -> None:
    from datetime import datetime, timezone

    for k, a in enumerate(actions):
        if a.name == "weight":
            weight = int(a.arg)
        elif a.name == "spell":
            spell = True
        elif a.name in ("index", "indexnopos"):
            for t, p in gen.terms(text, a.arg, out.pos):
                placed = p if a.name == "index" else None
                out.tokens.append((t, weight, placed))
                if a.name == "index" and p is not None:
                    out.pos = max(out.pos, p)
                if spell and not a.arg and not t.startswith("Z"):
                    out.spell.append(t)
        elif a.name == "gap":
            out.pos += int(a.arg or 100)
        elif a.name == "boolean":
            if text:
                out.tokens.append((a.arg + (":" if len(a.arg) > 1 and (text[0].isupper() or text[0] == ":") else "") + text, 0, None))
        elif a.name == "field":
            if text:
                out.data.append(f"{a.arg or name}={text}")
        elif a.name == "lower":
            text = text.lower()
        elif a.name in ("ltrim", "rtrim", "trim"):
            chars = a.arg or " \t\r\n\f\v"
            text = {"ltrim": text.lstrip, "rtrim": text.rstrip, "trim": text.strip}[a.name](chars)
        elif a.name == "squash":
            chars = re.escape(a.arg) if a.arg else r" \t\r\n\f\v"
            text = re.sub(f"[{chars}]+", " ", text).strip(" ")
        elif a.name == "truncate":
            text = truncate_words(text, int(a.arg))
        elif a.name == "hash":
            text = hash_term(text, int(a.arg or MAX_TERM))
        elif a.name == "hextobin":
            text = bytes.fromhex(text).decode("latin-1") if len(text) % 2 == 0 and re.fullmatch("[0-9A-Fa-f]*", text) else text
        elif a.name == "load":
            raise ValueError("load reads files on the driver's disk; join the files' contents instead")
        elif a.name == "unhtml":
            text = analysis.html_parts(text)["text"]
        elif a.name == "unxml":
            text = analysis.strip_xml(text)
        elif a.name == "unique":
            if text:
                out.unique = a.arg.split(",")[0] + text
                out.tokens.append((out.unique, 0, None))
        elif a.name == "value":
            if text:
                out.values.append((int(a.arg), text, None))
        elif a.name == "valuenumeric":
            if re.fullmatch(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*", text):
                out.values.append((int(a.arg), text.strip(), float(text)))
        elif a.name == "valuepacked":
            if text.strip().isdigit():
                out.values.append((int(a.arg), text.strip().zfill(10), float(text)))
        elif a.name == "date":
            day = text
            if a.arg in ("unix", "unixutc") and text.strip().isdigit():
                day = datetime.fromtimestamp(int(text), timezone.utc).strftime("%Y%m%d")
            out.tokens += [(t, 0, None) for t in date_terms(day)]
        elif a.name == "parsedate":
            try:
                text = str(int(datetime.strptime(text, a.arg).replace(tzinfo=timezone.utc).timestamp()))
            except ValueError:
                return
        elif a.name == "split":
            sep, _, how = a.arg.partition(",")
            if sep:
                parts = [p for p in text.split(sep) if p]
                if how == "dedup":
                    parts = list(dict.fromkeys(parts))
                elif how == "sort":
                    parts = sorted(parts)
                elif how == "prefixes":
                    at = [m.start() for m in re.finditer(re.escape(sep), text) if m.start() > 0]
                    parts = [text[:i] for i in at] + [text]
                for p in parts:
                    _apply(out, name, p, actions[k + 1 :], gen, weight, spell)
            return


#: Records of a task: a file that is read by one may hold many, as it is packed.
RECORDS = 50_000


def dealt(records: DataFrame) -> DataFrame:
    """records (did, ...) dealt to tasks whose number grows with them."""
    n = -(-records.count() // RECORDS)
    return records.repartition(max(n, records.sparkSession.sparkContext.defaultParallelism), "did")


def scripted(records: DataFrame, script: str, language: str = "none") -> Catalog:
    """records (did, fields map<string,array<string>>) through a script, in batches; a catalog."""
    parsed = Script.parse(script)

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for did, fields in zip(b["did"], b["fields"]):
                r = run_script(parsed, {k: list(v) for k, v in dict(fields).items()}, language)
                rows.append((did, "\n".join(r.data), [{"term": t, "wdf_inc": w, "pos": p} for t, w, p in r.tokens], [{"slot": s, "value": v, "num": n} for s, v, n in r.values], r.spell))
            yield pd.DataFrame(rows, columns=["did", "data", "tokens", "vals", "spell"])

    x = dealt(records.select("did", "fields")).mapInPandas(f, "did long, data string, tokens array<struct<term:string,wdf_inc:int,pos:int>>, vals array<struct<slot:int,value:string,num:double>>, spell array<string>").persist()
    tokens = x.select("did", F.explode("tokens").alias("t")).select("did", "t.term", "t.wdf_inc", "t.pos")
    values = x.select("did", F.explode("vals").alias("v")).select("did", "v.slot", "v.value", F.coalesce("v.num", F.col("v.value").try_cast("double")).alias("num"))
    spelling = x.select(F.explode("spell").alias("word")).where("length(word) > 1").groupBy("word").agg(F.count("*").alias("freq"))
    return Catalog(x.select("did", "data"), postings_of(tokens), values, spelling)


# ---- pages and files

def pages_catalog(pages: DataFrame, language: str = "none") -> Catalog:
    """page_id, url, html as a crawler indexes them: title with weight 5 and prefix S, text, host H, URL U, type T, size and checksum slots."""
    x = analysis.extracted(pages, html=True).withColumn("did", F.col("page_id") + 1).persist()
    gen = analysis.TermGenerator(language)
    title = gen.tokens(x, "title", "S", 5)
    body = gen.tokens(x, "text", "", 1, first=100)
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^:/?#]*)", 1)
    terms = [boolean_tokens(x, p, v) for p, v in (("H", host), ("U", F.col("url")), ("T", F.lit("text/html")), ("E", F.lit("html")))]
    tokens = title.unionByName(body)
    for t in terms:
        tokens = tokens.unionByName(t)
    size = F.octet_length("html").cast("double")
    values = x.select("did", F.explode(F.array(F.struct(F.lit(1).alias("slot"), F.md5(F.col("html").cast("binary")).alias("value"), F.lit(None).cast("double").alias("num")), F.struct(F.lit(2).alias("slot"), size.cast("long").cast("string").alias("value"), size.alias("num")))).alias("v")).select("did", "v.*")
    data = F.concat_ws("\n", F.concat(F.lit("url="), "url"), F.concat(F.lit("caption="), "title"), F.concat(F.lit("sample="), F.substring("text", 1, 200)), F.lit("type=text/html"))
    return Catalog(x.select("did", data.alias("data")), postings_of(tokens), values)


# Types by extension.
MIME = {"txt": "text/plain", "text": "text/plain", "htm": "text/html", "html": "text/html", "xhtml": "text/html", "csv": "text/csv", "md": "text/markdown", "xml": "text/xml", "svg": "image/svg+xml", "json": "application/json"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, type, title, text of the files in a folder, by extension; others have no text."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, raw in zip(b["path"], b["content"]):
                kind = MIME.get(p.rsplit(".", 1)[-1].lower(), "application/octet-stream")
                try:
                    text = bytes(raw).decode("utf-8")
                except UnicodeDecodeError:
                    text = bytes(raw).decode("latin-1")
                title = ""
                if kind == "text/html":
                    parts = analysis.html_parts(text)
                    title, text = parts["title"], parts["text"]
                elif kind in ("text/xml", "image/svg+xml"):
                    text = analysis.strip_xml(text)
                elif kind == "text/csv":
                    text = re.sub(r'[",]+', " ", text)
                elif kind == "application/octet-stream":
                    text = ""
                rows.append((p, kind, title, text))
            yield pd.DataFrame(rows, columns=["path", "type", "title", "text"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(f, "path string, type string, title string, text string")
