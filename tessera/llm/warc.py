"""WARC archives and their two-level capture index.

Archives are files of gzip members, a record each. The index has a line for each record, under the key of its address
with the host reversed; the lines are sorted over all shards and written in compressed blocks. Each shard ends with a
sparse directory, a line for each block. A look-up searches the list of shards, then a shard's directory, then a block,
by bisection, and reads the record by its range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import kept, shared_folder, small_side, store

#: Payloads of fewer bytes are stored again each time.
LEAST_BYTES = 1000
#: Lines of an index block; bytes after which an archive is followed by another.
BLOCK_LINES = 1000
ARCHIVE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
_ENTRY = "key string, file string, offset long, length long"


def surt(url: str | None) -> str:
    """Sortable form of an address: host labels reversed and comma-joined, `)`, then port, path and query. Blanks and
    control characters are percent-encoded; null is the empty string; what has no host is taken as a path."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    try:
        parts = urlsplit(clean)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"){clean}"
    if not host:
        return f"){clean}" if clean else ""
    rest = parts._replace(scheme="", netloc="").geturl()
    return f"{','.join(reversed(host.lower().split('.')))}{f':{port}' if port else ''}){rest}"


def record(kind: str, ident: str, url: str | None, payload: bytes, digest: str, size: int, refers: str | None) -> bytes:
    """A WARC record with its HTTP response; that of a revisit ends with the HTTP headers, which keep the full length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{ident}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Capture:
    kind: str
    ident: str
    refers: str | None
    digest: str  # of the payload; for a revisit, of the payload that it refers to
    size: int
    payload: bytes | None


def parse(data: bytes) -> Capture:
    """A record as record() makes it."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    name = lambda x: re.fullmatch(r"<urn:x-page:(.*)>", x, re.S)[1]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "revisit":
        return Capture("revisit", name(fields["WARC-Record-ID"]), name(fields["WARC-Refers-To"]), digest, size, None)
    found = hashlib.sha1(payload).hexdigest()
    if found != digest or len(payload) != size:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return Capture("response", name(fields["WARC-Record-ID"]), None, digest, size, payload)


def line_key(url: str | None, ident: str) -> str:
    return f"{surt(url)} {ident}"


def write(pages: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str, least: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives and returns their capture index: (key, file, offset, length), a row for each row of pages.

    Of records with equal payloads of `least` bytes or more, that of the largest id is a response and the others revisit
    it; rows that repeat that id are responses too, and so are all if their ids are null. A null payload is empty.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "utf-8")))
    repeated = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    repeated = kept(repeated.where("n > 1").select("digest", "first"), "repeated")
    rows = rows.join(small_side(repeated), "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    text = F.when(refers.isNull(), F.col("payload"))
    rows = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "url", text.alias("payload"), "digest", F.octet_length("payload").alias("size"), refers.cast("string").alias("refers"))

    def archive(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = store(folder)
        out, name, at = None, "", 0
        try:
            for pdf in pdfs:
                entries = []
                for r in pdf.itertuples(index=False):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0  # a task that runs again writes files of its own
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    kind = "response" if r.refers is None else "revisit"
                    data = gzip.compress(record(kind, r.id, r.url, (r.payload or "").encode("utf-8", "surrogatepass"), r.digest, r.size, r.refers), 4, mtime=0)
                    out.write(data)
                    entries.append((line_key(r.url, r.id), name, at, len(data)))
                    at += len(data)
                yield pd.DataFrame(entries, columns=["key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return kept(rows.mapInPandas(archive, _ENTRY), "captures")


@dataclass
class Index:
    """The sorted index in a folder; shards: (first key, file, place and length of the directory), sorted."""

    folder: str
    shards: list[tuple[str, str, int, int]]
    blocks_kept: int = 8
    _directories: OrderedDict = field(default_factory=OrderedDict)
    _blocks: OrderedDict = field(default_factory=OrderedDict)
    _open: OrderedDict = field(default_factory=OrderedDict)

    def read(self, file: str, offset: int, length: int) -> bytes:
        if file not in self._open:
            files, base = store(self.folder)
            self._open[file] = files.open_input_file(f"{base}/{file}")
            if len(self._open) > 64:
                self._open.popitem(last=False)[1].close()
        return self._open[file].read_at(length, offset)

    def _cached(self, cache: OrderedDict, file: str, offset: int, length: int) -> list[list[str]]:
        if (file, offset) not in cache:
            text = zlib.decompress(self.read(file, offset, length)).decode("utf-8", "surrogatepass")
            cache[file, offset] = [line.rsplit("\t", 3) for line in text.split("\n")]
            if len(cache) > self.blocks_kept:
                cache.popitem(last=False)
        return cache[file, offset]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of every capture under a key. Strings compare by their UTF-8 bytes, as Spark sorts."""
        order = lambda x: x[0].encode("utf-8", "surrogatepass")
        wanted = key.encode("utf-8", "surrogatepass")
        # the last shard and block that begin before the key, as equal keys may go on from one to the next
        for s in range(max(0, bisect.bisect_left(self.shards, wanted, key=order) - 1), len(self.shards)):
            if order(self.shards[s]) > wanted:
                return
            directory = self._cached(self._directories, *self.shards[s][1:])
            for b in range(max(0, bisect.bisect_left(directory, wanted, key=order) - 1), len(directory)):
                if order(directory[b]) > wanted:
                    return
                lines = self._cached(self._blocks, self.shards[s][1], int(directory[b][2]), int(directory[b][3]))
                for line in lines[bisect.bisect_left(lines, wanted, key=order) :]:
                    if order(line) != wanted:
                        break
                    yield line[1], int(line[2]), int(line[3])


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> Index:
    """Sorts the captures by key over all shards and writes the index; the list of shards has one entry a partition."""

    def shard(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = store(folder)
        name, at, directory, lines, out = f"{uuid.uuid4().hex}.idx", 0, [], [], None

        def put(rows: list[str]) -> tuple[int, int]:
            nonlocal at
            data = zlib.compress("\n".join(rows).encode("utf-8", "surrogatepass"), 6)
            out.write(data)
            at += len(data)
            return at - len(data), len(data)

        def block() -> None:
            place = put([f"{k}\t{f}\t{o}\t{n}" for k, f, o, n in lines])
            directory.append(f"{lines[0][0]}\t{name}\t{place[0]}\t{place[1]}")
            lines.clear()

        for pdf in pdfs:
            for line in pdf.itertuples(index=False, name=None):
                out = out or files.open_output_stream(f"{base}/{name}", compression=None)
                lines.append(line)
                if len(lines) == block_lines:
                    block()
        if out is None:
            return
        if lines:
            block()
        place = put(directory)
        out.close()
        yield pd.DataFrame([(directory[0].rsplit("\t", 3)[0], name, *place)], columns=["key", "file", "offset", "length"])

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    shards = kept(ordered.mapInPandas(shard, _ENTRY), "shards").collect()  # one row for each partition
    return Index(folder, sorted(((r.key, r.file, r.offset, r.length) for r in shards), key=lambda x: x[0].encode("utf-8", "surrogatepass")))


def page_keys(ids: Column, urls: Column) -> Column:
    @F.pandas_udf("string")
    def key(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([line_key(url, ident) for ident, url in zip(a, b, strict=True)], dtype=object)

    return key(F.coalesce(ids.cast("string"), F.lit("")), urls)


def look_up(keys: DataFrame, index: Index, with_payload: bool = False) -> DataFrame:
    """The captures under the keys of a table (key), each key asked for once; sorted first, so that neighbours share
    blocks: id (string), payload_bytes, payload_digest, record_type, refers_to (string), payload if asked for."""
    folder, shards = index.folder, keys.sparkSession.sparkContext.broadcast(index.shards)

    def fetch(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Index(folder, shards.value)
        for pdf in pdfs:
            rows = []
            for key in pdf["key"]:
                for place in own.find(key):
                    c = parse(gzip.decompress(own.read(*place)))
                    rows.append((c.ident, c.size, c.digest, c.kind, c.refers) + ((c.payload,) if with_payload else ()))
            yield pd.DataFrame(rows, columns=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload)

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.select("key").distinct().repartitionByRange(n, "key").sortWithinPartitions("key")
    return ordered.mapInPandas(fetch, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Archives every row and reads each capture back by its key: page_id (null if it was), payload_bytes,
    payload_digest, record_type, refers_to. Repeated rows are archived and read each for itself."""
    folder = shared_folder(pages.sparkSession, "archives")
    index = build_index(write(pages, folder, id_col, url_col, payload_col, least), folder)
    found = look_up(pages.select(page_keys(F.col(id_col), F.col(url_col)).alias("key")), index)
    kind = pages.schema[id_col].dataType
    ident = F.when(F.col("id") != "", F.col("id")).cast(kind).alias(id_col)
    return found.select(ident, "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
