"""WARC archives with a two-level capture index.

**Write.** Each task appends gzip members, one record each, to archive files
of its own in the shared folder and returns where each record lies. Equal
payloads of ``REVISIT_BYTES`` or more are stored once: the record with the
largest page_id is the response, the others are revisits that refer to it.

**Index.** Captures are range-partitioned and sorted by (reversed-host key,
page_id). Each partition is an index file of compressed blocks of ``LINES``
lines with a sparse directory behind them: the first key of each block and
where it lies. The upper level is one row per index file, as many as there
are range partitions.

**Look up.** The keys asked for are dealt in key order. A task finds the file
by binary search in the upper level, the block by binary search in the
file's directory, the lines by binary search in the block, and then reads the
record's bytes alone out of the archive.

Files are reached through ``pyarrow.fs``, so the shared folder may be a local
mount or an object store. File names are new in each attempt and only named
by the rows of finished tasks, so a lost executor leaves at worst unnamed
files behind.

Defined cases: a null html is an empty payload, a null url has the key ``)``;
null page_ids sort first and refer to, or are, whatever the largest id of
their payload says. Repeated rows are records each (those with the largest
id are all responses). An empty table gives empty results. Extra columns are
ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, Scratch, open_fs, rows_at_once, whole
from tidemark.llm.urlfilter import host_and_path

REVISIT_BYTES, LINES, ARCHIVE_BYTES = 1000, 256, 64 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def capture_key(url: str = "url") -> Column:
    """Reversed host labels, then path and query: ``org,example,www)/path?x``."""
    host, _ = host_and_path(url)
    rest = F.regexp_extract(F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"), r"^[^/?#]*([^#]*)", 1)
    rest = F.when(F.instr(url, "://") > 0, rest).otherwise(F.col(url))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.coalesce(rest, F.lit("")))


def typed(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``page_id, url, html, key, bytes, digest, refers_to``.

    The digests of payloads that occur twice are written first: Spark knows
    their size then, and moves no payload if they can be broadcast.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.select("*", capture_key().alias("key"), F.octet_length("html").cast("long").alias("bytes"),
                 F.sha1("html").alias("digest"))
    # digests alone are shuffled here; only payloads that occur twice go on
    same = scratch.write(p.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest")
            .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "same")
    older = F.col("page_id").isNull() | (F.col("page_id") < F.col("first"))
    return p.join(same, "digest", "left").withColumn(
        "refers_to", F.when(F.col("first").isNotNull() & older, F.col("first"))).drop("first")


def record(page_id, url, html: str, digest: str, refers_to) -> bytes:
    payload = html.encode("utf-8", "surrogatepass")
    block = HTTP if refers_to is not None else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head.append(f"X-Refers-To-Page: {refers_to}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record is cut")
    return headers, rest[:n]


def write_archives(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Write all records; ``(key, page_id, file, start, length)`` of each."""
    root = scratch.root

    def run(frames: Iterator[pd.DataFrame]):
        fs, base = open_fs(root)
        fs.create_dir(f"{base}/archive")
        name, out, at = None, None, 0
        try:
            for pdf in frames:
                rows = []
                ids, refs = pdf["page_id"], pdf["refers_to"]
                for key, i, url, html, digest, ref in zip(pdf["key"], ids, pdf["url"], pdf["html"], pdf["digest"], refs):
                    i, ref = (None if x == NO_ID else int(x) for x in (i, ref))
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"archive/{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    z = gzip.compress(record(i, url, html, digest, ref), 6, mtime=0)
                    out.write(z)
                    rows.append((key, name, at, len(z)))
                    at += len(z)
                d = pd.DataFrame(rows, columns=["key", "file", "start", "length"])
                d.insert(1, "page_id", ids.to_numpy(np.int64))
                yield d
        finally:
            if out is not None:
                out.close()

    return typed(pages, scratch).select("key", whole("page_id"), "url", "html", "digest", whole("refers_to")).mapInPandas(
        run, "key string, page_id long, file string, start long, length long")


def write_index(captures: DataFrame, root: str) -> DataFrame:
    """Sorted compressed blocks with a directory per file; one row per index file."""
    def run(frames: Iterator[pd.DataFrame]):
        fs, base = open_fs(root)
        fs.create_dir(f"{base}/index")
        name, at, directory, lines, last = f"index/{uuid.uuid4().hex}.cdx", 0, [], [], None
        out = None

        def flush():
            nonlocal at, lines
            z = zlib.compress(b"\n".join(lines))
            out.write(z)
            directory.append((lines[0].split(b"\t", 2)[:2], at, len(z)))
            at, lines = at + len(z), []

        for pdf in frames:
            for k, i, f, s, n in zip(pdf["key"], pdf["page_id"], pdf["file"], pdf["start"], pdf["length"]):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                last = _line_key(k)
                lines.append(b"\t".join([last, *(str(x).encode() for x in (i, f, s, n))]))
                if len(lines) == LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            z = zlib.compress(b"\n".join(b"\t".join([*k, str(s).encode(), str(n).encode()]) for k, s, n in directory))
            out.write(z)
            out.close()
            (k, i), _, _ = directory[0]
            yield pd.DataFrame([(k, int(i), name, at, len(z), len(directory))],
                               columns=["key", "page_id", "file", "start", "length", "blocks"])

    order = [F.col("sort"), F.col("page_id")]
    c = captures.withColumn("sort", _sort_key("key"))
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (c.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("sort")
            .mapInPandas(run, "key binary, page_id long, file string, start long, length long, blocks long"))


def _line_key(key: str) -> bytes:
    """A key as bytes without tabs or line breaks; the same escapes as ``_sort_key``."""
    return key.encode("utf-8", "surrogatepass").replace(b"%", b"%25").replace(b"\t", b"%09").replace(b"\n", b"%0A")


def _sort_key(c: str) -> Column:
    x = F.replace(F.col(c), F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(x, F.lit("\t"), F.lit("%09")), F.lit("\n"), F.lit("%0A"))


class Index:
    """Binary search through both levels, with the last used directories and blocks at hand."""

    def __init__(self, root: str, files: list[tuple]):
        self.fs, self.base = open_fs(root)
        self.files = sorted(files)  # (key, page_id, file, start, length)
        self.first = [f[:2] for f in self.files]
        self.cache: OrderedDict = OrderedDict()
        self.streams: OrderedDict = OrderedDict()

    def read(self, file: str, start: int, length: int) -> bytes:
        s = self.streams.pop(file, None) or self.fs.open_input_file(f"{self.base}/{file}")
        self.streams[file] = s
        if len(self.streams) > 64:
            self.streams.popitem(last=False)[1].close()
        s.seek(start)
        return s.read(length)

    def _kept(self, what: tuple, load):
        if what not in self.cache:
            self.cache[what] = load()
            if len(self.cache) > 32:
                self.cache.popitem(last=False)
        self.cache.move_to_end(what)
        return self.cache[what]

    def _directory(self, f: tuple):
        rows = [x.split(b"\t") for x in zlib.decompress(self.read(*f[2:5])).split(b"\n")]
        return [(k, int(i)) for k, i, _, _ in rows], [(int(s), int(n)) for _, _, s, n in rows]

    def _block(self, file: str, start: int, length: int):
        rows = [x.split(b"\t") for x in zlib.decompress(self.read(file, start, length)).split(b"\n")]
        return [(r[0], int(r[1])) for r in rows], [(r[2].decode(), int(r[3]), int(r[4])) for r in rows]

    def find(self, key: bytes, page_id: int) -> list[tuple[str, int, int]]:
        """Places of all captures of a key and page."""
        want, out = (key, page_id), []
        for f in range(max(bisect.bisect_left(self.first, want) - 1, 0), len(self.files)):
            if self.first[f] > want:
                break
            entry = self.files[f]
            firsts, places = self._kept((entry[2], -1), lambda: self._directory(entry))  # noqa: B023
            for b in range(max(bisect.bisect_left(firsts, want) - 1, 0), len(firsts)):
                if firsts[b] > want:
                    break
                keys, where = self._kept((entry[2], b), lambda: self._block(entry[2], *places[b]))  # noqa: B023
                lo, hi = bisect.bisect_left(keys, want), bisect.bisect_right(keys, want)
                out += where[lo:hi]
        return out


def look_up(asked: DataFrame, index_files: DataFrame, root: str) -> DataFrame:
    """Records of the distinct ``(key, page_id)`` of ``asked``, read back through the index."""
    files = [(bytes(r[0]), *r[1:5]) for r in index_files.select("key", "page_id", "file", "start", "length").collect()]
    shared = asked.sparkSession.sparkContext.broadcast(files)  # one row per index file: the range partitions

    def run(frames: Iterator[pd.DataFrame]):
        index = Index(root, shared.value)
        for pdf in frames:
            rows = []
            for k, i in zip(pdf["key"], pdf["page_id"]):
                for place in index.find(_line_key(k), i):
                    headers, block = read_record(gzip.decompress(index.read(*place)))
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size, ref = int(headers["X-Payload-Length"]), headers.get("X-Refers-To-Page")
                    if headers["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"payload of page {i} differs from its digest")
                    rows.append((i, headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"], ref))
            cols = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            out = pd.DataFrame(rows, columns=cols, dtype=object)
            for c in ("page_id", "refers_to"):
                out[c] = pd.array([None if x in (None, NO_ID) else int(x) for x in out[c]], "Int64")
            yield out

    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long")
    return (asked.select("key", whole("page_id")).distinct()
            .withColumn("sort", _sort_key("key")).repartitionByRange("sort", "page_id")
            .sortWithinPartitions("sort", "page_id").drop("sort").mapInPandas(run, schema))


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write archives and index of ``pages``; the index files and the folder they lie in."""
    rows_at_once(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "warc")
    captures = scratch.write(write_archives(pages, scratch), "captures")
    files = scratch.write(write_index(captures, scratch.root), "files")
    scratch.drop("captures", "same")
    return files, scratch.root
