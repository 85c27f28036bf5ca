"""WARC archives of pages, written and read by Spark, and a merged capture index over them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import BATCHES, folder, settings, settle, small_join

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
#: Gzip ends with the length, least byte first; below this length its last byte is 0.
MEMBER = (1 << 24) - 1


def url_key(url: str | None) -> str:
    """The host's labels reversed, then the rest, in lower case: com,example)/path?query. Scheme, user, www, port and fragment don't count."""
    m = re.match(r"(?:(?:[a-z][a-z0-9+.-]*:)?//)?(?:[^/?#@]*@)?(?:www\d*\.)?(\[[^\]]*\]|[^/?#:]*)(?::\d*)?([^#]*)", (url or "").strip().lower())
    host, rest = m.groups()
    return f"{','.join(reversed(host.split('.')))}){rest or '/'}" if host else ""


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    when = EPOCH + timedelta(seconds=(page_id or 0) % 10**9)
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:x-page:{'' if page_id is None else page_id}>",
        "WARC-Date": when.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]|"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Refers-To": None if refers_to is None else f"<urn:x-page:{refers_to}>",
        "WARC-Profile": None if refers_to is None else REVISIT,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _members(record: bytes) -> bytes:
    """The record as gzip members of less than 16 MiB each, so that the last byte is always 0."""
    return b"".join(gzip.compress(record[i : i + MEMBER], 4, mtime=0) for i in range(0, len(record), MEMBER))


def _archive(chunk_bytes: int) -> Callable:
    """mapInArrow function from pages to chunks: the members of records one after another, of chunk_bytes or one record more, without the last byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["chunk"])
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for row in batch.slice(i, 64).to_pylist():
                    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                    held.append(_members(_record(row["page_id"], row["url"], row["payload"], digest, row["refers_to"])))
                    size += len(held[-1])
                    if size >= chunk_bytes:
                        yield out()
                        held.clear()
                        size = 0
        if held:
            yield out()

    return run


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 0, chunk_bytes: int = 2 << 20, file_chunks: int = 16) -> None:
    """Writes a record of every page (page_id, url, html) into gzipped WARC files under path, on any file system that Spark writes to.

    Of pages with equal payloads of least_bytes or more, the one with the largest page_id is a response and the others
    are revisits that refer to it. Each record is a gzip member of its own. A file holds at most file_chunks chunks of chunk_bytes and a
    record each, so that it can be read as one row. Spark's text writer puts the files together: a
    chunk's last byte, always 0, is left to it as its line separator. Executors may be lost; its committer keeps whole files.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    shared = rows.where(F.length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    # only digests that repeat, and ids, meet their rows: payloads aren't shuffled, and the rows of a common one stay where they are
    named = small_join(rows, settle(shared), "sha1", "left").withColumn("refers_to", F.expr("nullif(last, page_id)")).select("page_id", "url", "payload", "sha1", "refers_to")
    with settings(pages.sparkSession, BATCHES):
        named.mapInArrow(_archive(chunk_bytes), "chunk binary").select(F.col("chunk").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", file_chunks).text(path)


#: Bytes of an archive that are unpacked at once.
SLICE = 1 << 14


def _parsed(content: bytes) -> Iterator[tuple[int, int, dict, dict, bytes]]:
    """(offset, length, WARC head, HTTP head, payload) of each record of an archive."""
    at, data, start, view = 0, b"", 0, memoryview(content)
    while at < len(content):
        member, parts = zlib.decompressobj(31), [data]
        while not member.eof and at < len(view):  # slices, as what follows a member is handed back as a copy
            part = view[at : at + SLICE]
            parts.append(member.decompress(part))
            at += len(part) - len(member.unused_data)
        data = b"".join(parts)
        while (cut := data.find(b"\r\n\r\n")) >= 0:
            head = dict(x.split(": ", 1) for x in data[:cut].decode().split("\r\n")[1:])
            end = cut + 4 + int(head["Content-Length"])
            if len(data) < end + 4:
                break
            http, _, payload = data[cut + 4 : end].partition(b"\r\n\r\n")
            yield start, at - start, head, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload
            data, start = data[end + 4 :], at


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


CAPTURE = "url_key string, captured string, page_id long, run string, seq int, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted run of captures from each archive (path, content); a response's payload must have the digest that its head states."""
    names = [c.split()[0] for c in CAPTURE.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = []
            for offset, length, head, http, payload in _parsed(content.as_py()):
                digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"a payload in {path} at {offset} isn't what its head says")
                found.append((url_key(head.get("WARC-Target-URI")), head["WARC-Date"], _page(head["WARC-Record-ID"]), offset, length, kind, int(http["Content-Length"]), digest, _page(head.get("WARC-Refers-To"))))
            found.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3]))
            rows = [(*r[:3], path.rsplit("/", 1)[-1], i, *r[3:]) for i, r in enumerate(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*rows, strict=True), CAPTURE.split(", "), strict=True)], names)


def read_captures(spark, path: str) -> DataFrame:
    """The captures of all archives under path, each archive's as one sorted run (run, seq)."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(_captures, CAPTURE)


class LoserTree:
    """Merges sorted runs: each inner place holds the loser of its match, the winner stands apart."""

    def __init__(self, runs: list[Iterator], key: Callable) -> None:
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; a run that's out comes last."""
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _play(self, i: int) -> None:
        place = (i + self.k) // 2
        while place:
            if self.losers[place] < 0:  # the first to arrive waits for the other
                self.losers[place] = i
                return
            if self._beats(self.losers[place], i):
                self.losers[place], i = i, self.losers[place]
            place //= 2
        self.losers[0] = i

    def __iter__(self):
        while (head := self.heads[self.losers[0]]) is not None:
            yield head[2]
            self.heads[head[1]] = self._next(head[1])
            self._play(head[1])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs' slices of one key range; rows arrive by run and place in it."""
    runs: dict[str, list[dict]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for row in batch.to_pylist():
            runs.setdefault(row["run"], []).append(row)
    part = TaskContext.get().partitionId()
    if not runs:
        return
    tree = LoserTree([iter(r) for r in runs.values()], lambda r: (r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0))
    out: list[dict] = []
    done = 0
    for row in tree:
        out.append(row)
        if len(out) == 5000:
            yield _numbered(out, schema, part, done)
            done, out = done + len(out), []
    if out:
        yield _numbered(out, schema, part, done)


def _numbered(rows: list[dict], schema: pa.Schema, part: int, done: int) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_pylist(rows, schema)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(rows), pa.int32()), pa.array(range(done, done + len(rows)), pa.int64())], [*schema.names, "range", "at"])


def merged_index(captures: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """captures in one global order by URL key, time and page_id: adds position, from 0.

    The sorted runs are cut at sampled keys into ranges of about range_rows; a task merges the runs' slices of its range
    by a loser tree. page_id is part of the key, so that a URL or host with any share of the captures spans as many ranges as it needs.
    """
    captures = settle(captures)
    ranges = max(1, -(-captures.count() // range_rows))
    dealt = captures.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("run", "seq")
    merged = settle(dealt.mapInArrow(_merge, f"{CAPTURE}, range int, at long"))
    sizes = merged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return merged.join(F.broadcast(before), "range").withColumn("position", F.col("before") + F.col("at")).drop("range", "at", "before")


def archive_index(pages: DataFrame, **parameters) -> DataFrame:
    """The merged index of archives that write_archives() makes of pages in the shared folder.

    Captures hold what was read back: page_id, payload_bytes and payload_digest (bare base32 SHA-1, both of the full
    payload), record_type, refers_to, url_key, captured, run, offset, length, and position in the global order. Revisits
    state the full payload's length in their HTTP head. captured is 2024 plus page_id seconds, pages having no time.

    A null html is an empty payload, and empty payloads are equal like others. A null url has no URL key. A null page_id comes
    back null; it is a response unless equal payloads have a page_id. Rows that repeat the largest page_id are all
    responses. Very long payloads take several gzip members. Other columns are ignored. Empty table: no rows.
    """
    path = folder(pages.sparkSession)
    write_archives(pages, path, **parameters)
    return merged_index(read_captures(pages.sparkSession, path))
