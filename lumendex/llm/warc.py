"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole WARC records (about FRAME bytes of them), then a
skippable frame that maps each record's identifier to its frame and its place in the frame's content, then the seek
table: a skippable frame with the compressed and decompressed size of every frame before it, and a footer. Any
Zstandard reader decodes the whole; with the seek table one frame is enough for one record.

Records with equal payloads (by SHA-1 and length): that with the largest page_id is the response, the others are
revisits that refer to it and carry no payload. Only (digest, page_id) is aggregated to find them, and the join that
brings the answer back is salted, so that one very common payload doesn't meet in one task.

Spark writes the files: a bundle is a row, and the writer's line separator is the magic number that ends a seek table.
So a lost executor's attempt leaves nothing behind, and any store that Spark reaches will do.

Defined results: a null html is an empty payload; rows with a null page_id are archived with an empty identifier and
refer or are referred to like others (a null is smaller than any id); rows alike are archived each, and all rows of
the response's id are responses; an empty table gives no file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import new_path, small_batches, table

FRAME = 1 << 18
BUNDLE = 1 << 24
LEVEL = 3
SALTS = 16
LEAST_REVISIT = 0
# Fixed values of the Zstandard seekable format.
MAGIC_SKIP_TABLE, MAGIC_SKIP_MAP, MAGIC_FOOTER = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_END = struct.pack("<I", MAGIC_FOOTER)
_DATE = "1970-01-01T00:00:00Z"


def record(kind: str, page: str, url: str, payload: bytes, length: int, digest: str, refers_to: str | None) -> bytes:
    """One WARC record. Its block is an HTTP response head and, for a response, the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that begins at `at`."""
    stop = data.index(b"\r\n\r\n", at)
    headers = dict(line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:])
    start = stop + 4
    end = start + int(headers["Content-Length"])
    return headers, data[start:end], end + 4


class Bundler:
    """Collects records into frames and frames into a bundle."""

    def __init__(self, frame: int = FRAME, level: int = LEVEL):
        import zstandard

        self.compress, self.most = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress, frame
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.map: list[tuple[str, int, int]] = []
        self.open, self.filled, self.length = [], 0, 0

    def add(self, name: str, data: bytes) -> None:
        self.map.append((name, len(self.sizes), self.filled))
        self.open.append(data)
        self.filled += len(data)
        if self.filled >= self.most:
            self._close()

    def _close(self) -> None:
        if self.open:
            out = self.compress(b"".join(self.open))
            self.frames.append(out)
            self.sizes.append((len(out), self.filled))
            self.length += len(out)
            self.open, self.filled = [], 0

    def finish(self) -> bytes:
        """The whole bundle but for the last four bytes, which the writer puts after every row."""
        self._close()
        names = "\n".join(f"{n}\t{f}\t{o}" for n, f, o in self.map).encode()
        names = self.compress(names)
        sizes = [*self.sizes, (len(names) + 8, 0)]
        entries = b"".join(struct.pack("<II", c, d) for c, d in sizes)
        seek = struct.pack("<II", MAGIC_SKIP_TABLE, len(entries) + 9) + entries + struct.pack("<IB", len(sizes), 0)
        return b"".join(self.frames) + struct.pack("<II", MAGIC_SKIP_MAP, len(names)) + names + seek


class Bundle:
    """Random access to a bundle's bytes."""

    def __init__(self, data: bytes):
        import zstandard

        if data[-4:] != _END:
            raise ValueError("no seek table at the end")
        self.data, self.decoder = data, zstandard.ZstdDecompressor()
        n, _ = struct.unpack("<IB", data[-9:-4])
        start = len(data) - 9 - 8 * n
        if struct.unpack("<I", data[start - 8 : start - 4])[0] != MAGIC_SKIP_TABLE:
            raise ValueError("no seek table where the footer says")
        self.frames, at = [], 0
        for k in range(n):
            c, d = struct.unpack("<II", data[start + 8 * k : start + 8 * k + 8])
            self.frames.append((at, c, d))
            at += c

    def frame(self, k: int) -> bytes:
        at, c, _ = self.frames[k]
        return self.decoder.decompress(self.data[at : at + c])

    def places(self) -> list[tuple[str, int, int]]:
        """(record's identifier, frame, offset in the frame's content)."""
        at, c, _ = self.frames[-1]
        lines = self.decoder.decompress(self.data[at + 8 : at + c]).decode()
        return [(n, int(f), int(o)) for n, f, o in (x.rsplit("\t", 2) for x in lines.split("\n"))] if lines else []

    def read(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (hex), first (the response's id if other rows have this payload)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    x = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    x = x.withColumns({"length": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    same = x.select("page_id", "digest", "length").where(F.col("length") >= LEAST_REVISIT).groupBy("digest", "length").agg(F.max("page_id").alias("first"), F.count("*").alias("rows"))
    same = same.where("rows > 1").select("digest", "length", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = x.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return salted.join(same, ["digest", "length", "salt"], "left").select("page_id", "url", "payload", "digest", "first")


def write_archives(pages: DataFrame, path: str, frame: int = FRAME, bundle: int = BUNDLE) -> None:
    """pages as bundles of about `bundle` compressed bytes in the folder `path`."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = Bundler(frame), 0
        for b in batches:
            for page, url, payload, digest, first in zip(*(b.column(k).to_pylist() for k in range(5))):
                name = "" if page is None else str(page)
                kind = "response" if first is None or page == first else "revisit"
                short = base64.b32encode(bytes.fromhex(digest)).decode()
                url = url.replace("\r", "%0D").replace("\n", "%0A")
                out.add(name, record(kind, name, url, payload, len(payload), short, None if first is None else str(first)))
                if out.length >= bundle:
                    yield pa.RecordBatch.from_arrays([pa.array([out.finish()], pa.binary())], ["bundle"])
                    out = Bundler(frame)
        if out.map:
            yield pa.RecordBatch.from_arrays([pa.array([out.finish()], pa.binary())], ["bundle"])

    rows = decided(pages).mapInArrow(f, "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    rows.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", _END.decode("latin-1")).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """record, bundle (the file), frame, offset: from each bundle's own map."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                places = Bundle(data).places()
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in places]), pa.array([name] * len(places)), pa.array([p[1] for p in places], pa.int32()), pa.array([p[2] for p in places], pa.int64())], ["record", "bundle", "frame", "offset"])

    return _files(spark, path).select("path", "content").mapInArrow(f, "record string, bundle string, frame int, offset long")


def lookup(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """record, headers, block of the records at `places` (rows of index()): one frame is decoded for each run."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                z, at, content = Bundle(data), None, b""
                for w in sorted(wanted, key=lambda w: (w["frame"], w["offset"])):
                    if w["frame"] != at:
                        at, content = w["frame"], z.frame(w["frame"])
                    headers, block, _ = parse(content, w["offset"])
                    yield pa.RecordBatch.from_arrays([pa.array([w["record"]]), pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())], ["record", "headers", "block"])

    wanted = places.groupBy("bundle").agg(F.collect_list(F.struct("record", "frame", "offset")).alias("wanted"))  # a bundle's records
    x = _files(spark, path).join(wanted, F.col("path") == F.col("bundle"))
    return x.select("content", "wanted").mapInArrow(f, "record string, headers map<string,string>, block binary")


_BACK = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, offset long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record in the folder, read by the bundles' seek tables and maps.

    A response's length and digest are those of the payload as decoded; a revisit has none and gives its headers'."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident = lambda s: int(s[10:-1]) if s and s[10:-1] not in ("", "None") else None
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in _BACK.split(", ")]
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                z, rows, at, content = Bundle(data), [], None, b""
                for _, k, offset in z.places():
                    if k != at:
                        at, content = k, z.frame(k)
                    h, block, _ = parse(content, offset)
                    kind = h["WARC-Type"]
                    size, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:]
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((ident(h["WARC-Record-ID"]), size, digest, kind, ident(h.get("WARC-Refers-To")), name, k, offset))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return _files(spark, path).select("path", "content").mapInArrow(f, _BACK)


def op4(spark, sf_dir):
    small_batches(spark)
    path = new_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
