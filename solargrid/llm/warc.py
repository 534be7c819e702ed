"""WARC archives with one record per page, and their capture index.

Writing: every task streams its rows into one archive of its own in the shared folder, a gzip member for each record, so
that a record can be read from its offset and length. The task also returns the archive's index rows, RUN_ROWS at a time
and sorted by URL key and timestamp: capture runs. Archive names hold a fresh id for each task attempt, and only the rows of attempts that
succeed reach the run table, so a lost executor leaves at most a file that no index row names.

Index: the runs are dealt by ranges of (URL key, timestamp, page, archive, offset) and each range is merged from its runs by
a loser tree that streams them from disk. Ranges follow one another, so the merged rows are in global order; `position` numbers them. The range key
goes down to single records, so a URL that holds a third of all captures is spread over many ranges.

Reading: index rows are grouped by archive and stretch of it, read in offset order and parsed.

A payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least MIN_REVISIT bytes, that with the
largest page_id is a response and the others are revisits that refer to it; smaller ones are all responses.

Nulls and odd input: a null page_id is written and read back as null and refers to nothing else first: it sorts below
every number, so it is the response only among nulls. Rows that repeat the largest page_id are each a response. A null
or empty url gets the key of an unknown host. Control characters in a url are percent-encoded. An empty table gives an
empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import itertools
import mmap
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solargrid.llm.storage import fresh_path, input_partitions, stored

MIN_REVISIT = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows without a capture time get one second after another from here, by page_id.
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
STRETCH = 8 << 20
#: Captures that a task sorts as one run, and rows that a merge reads of each run at once.
RUN_ROWS, READ_ROWS = 100_000, 1000

RUN = "url_key string, ts string, page_id long, archive string, offset long, length long, run int"


def url_key(url: str | None) -> str:
    """Sort-friendly form: the host's labels reversed, then path and query; scheme, www., port and fragment go."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return f"invalid){url}"
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def timestamp(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % (10**9))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit without payload if it refers to another page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:x-unknown"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {timestamp(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of a record and its payload; a record that breaks its own lengths or digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its header")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    full = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    page = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", fields.get(x, ""))) else None
    if fields["warc-type"] == "response" and (len(payload) != full or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    return {"page_id": page("warc-record-id"), "record_type": fields["warc-type"], "refers_to": page("warc-refers-to"), "payload_digest": digest, "payload_bytes": full, "payload": payload, "uri": fields["warc-target-uri"], "date": fields["warc-date"]}


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+://", uri) or uri.startswith("file:") else f"file://{uri}")


def decisions(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest and refers_to for every row."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= MIN_REVISIT
    first = p.where(large).groupBy(F.col("digest").alias("d_digest")).agg(F.max("page_id").alias("d_page"), F.count("*").alias("n")).where("n > 1").drop("n")
    j = p.join(first, large & (p["digest"] == first["d_digest"]), "left")
    return j.select("page_id", "url", "html", "digest", F.when(F.col("page_id").isNull() | (F.col("d_page") != F.col("page_id")), F.col("d_page")).alias("refers_to"))


def write(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Archives in folder; returns the capture runs, one for each archive."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, offset, run, out, uri = [], 0, 0, None, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            for page_id, url, html, digest, refers_to in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    files, path = _open(uri)
                    files.create_dir(path.rpartition("/")[0])
                    out = files.open_output_stream(path, compression=None, buffer_size=1 << 20)
                z = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = z.compress(record(page_id, url, html.encode("utf-8", "replace"), digest, refers_to)) + z.flush()
                out.write(data)
                rows.append((url_key(url), timestamp(page_id), page_id, uri, offset, len(data), run))
                offset += len(data)
                if len(rows) >= RUN_ROWS:
                    yield from _batches(sorted(rows, key=sort_key))
                    rows, run = [], run + 1
        if out is not None:
            out.close()
            yield from _batches(sorted(rows, key=sort_key))

    return decisions(pages, **columns).mapInArrow(archive, RUN)


def sort_key(r: tuple):
    return r[0], r[1], r[2] is not None, r[2] or 0, r[3], r[4]


NAMES = [x.split()[0] for x in RUN.split(", ")]
TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]


def _batches(rows: Iterable[tuple], position: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows in batches; with position, each gets its place from there on."""
    rows = iter(rows)
    while part := list(itertools.islice(rows, 10_000)):
        cols = [pa.array(c, t) for c, t in zip(zip(*part, strict=True), TYPES, strict=True)]
        if position is None:
            yield pa.RecordBatch.from_arrays(cols, NAMES)
        else:
            yield pa.RecordBatch.from_arrays([*cols, pa.array(range(position, position + len(part)), pa.int64())], [*NAMES, "position"])
            position += len(part)


def loser_tree(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs: each inner node holds the loser of its match, so a step replays one path from leaf to root."""
    k = len(runs)
    its = [iter(r) for r in runs]
    end = (1,)
    head = [next(it, None) for it in its]
    keys = [(0, sort_key(h)) if h is not None else end for h in head]
    tree = [-1] * k
    for leaf in range(k):
        at, who = (leaf + k) // 2, leaf
        while at and tree[at] != -1:
            if keys[tree[at]] < keys[who]:
                tree[at], who = who, tree[at]
            at //= 2
        tree[at] = who
    while k and keys[tree[0]] != end:
        who = tree[0]
        yield head[who]
        head[who] = next(its[who], None)
        keys[who] = (0, sort_key(head[who])) if head[who] is not None else end
        at = (who + k) // 2
        while at:
            if keys[tree[at]] < keys[who]:
                tree[at], who = who, tree[at]
            at //= 2
        tree[0] = who


def _spilled(batches: Iterator[pa.RecordBatch], file) -> list[int]:
    """Write rows that are sorted by run and key to a file, a stream for each run; where these start."""
    starts, writer, last = [], None, None
    for b in batches:
        runs = list(zip(b.column(3).to_pylist(), b.column(6).to_pylist(), strict=True))
        edges = [0, *[i for i in range(1, len(runs)) if runs[i] != runs[i - 1]], len(runs)]
        for i, j in zip(edges, edges[1:], strict=False):
            if runs[i] != last:
                if writer is not None:
                    writer.close()
                starts.append(file.tell())
                writer, last = pa.ipc.new_stream(file, b.schema), runs[i]
            for k in range(i, j, READ_ROWS):
                writer.write_batch(b.slice(k, min(READ_ROWS, j - k)))
    if writer is not None:
        writer.close()
    return starts


def _run(data: pa.Buffer, start: int) -> Iterator[tuple]:
    for b in pa.ipc.open_stream(pa.BufferReader(data.slice(start))):
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def merged_index(runs: DataFrame) -> DataFrame:
    """The runs in global order of URL key and timestamp, with position.

    A range's rows come sorted by run, by Spark's own spilling sort; the task lays the runs down in one unnamed file and
    merges them from there, with READ_ROWS rows of each in memory.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        with tempfile.TemporaryFile() as file:
            starts = _spilled(batches, file)
            if starts:
                file.flush()
                data = pa.py_buffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
                yield from _batches(loser_tree([_run(data, s) for s in starts]), TaskContext.get().partitionId() << 40)

    spark = runs.sparkSession
    key = ["url_key", "ts", "page_id", "archive", "offset"]
    return runs.repartitionByRange(input_partitions(spark), *key).sortWithinPartitions("archive", "run", *key).mapInArrow(merge, f"{RUN}, position long")


def read(index: DataFrame) -> DataFrame:
    """The records that an index names, parsed from the archives."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, source = None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["archive"] != uri:
                    files, path = _open(uri := r["archive"])
                    source = files.open_input_file(path)
                source.seek(r["offset"])
                x = parse(zlib.decompress(source.read(r["length"]), 31))
                rows.append((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"], r["url_key"], x["date"], r["position"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position"])

    stretch = F.floor(F.col("offset") / STRETCH)
    dealt = index.repartition(input_partitions(index.sparkSession), "archive", stretch).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, position long")


def round_trip(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write all pages, merge the index and read every record back."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    runs = stored(write(pages, folder, **columns), "capture-runs")
    return read(stored(merged_index(runs), "capture-index"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {MIN_REVISIT} AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= {MIN_REVISIT} AND top <> page_id THEN top END AS refers_to FROM m"""
