"""WARC archives: a writer of gzip members and a splittable reader.

A reader task owns the records that start inside its byte range. It scans the
range for the gzip magic, decodes the beginning of every candidate and accepts
it when a WARC header comes out; a record is then read to its end, past the
end of the range where it has to be. Ranges of one file need no knowledge of
each other and can be read again by any task.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.llm.common import stored
from chronogrid.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
SPLIT_BYTES = 4 << 20
CHUNK = 1 << 16
DECODED_CHUNK = 1 << 20
MIN_REVISIT_BYTES = 100
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_LINE = str.maketrans({"\r": " ", "\n": " "})


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all tasks share; a bare path is local to the machine."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{key}')}>"


def record(key: object, url: str | None, payload: bytes, digest: str, refers_to: object = None) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the response."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {url.translate(_LINE)}")
    if key is not None:
        lines.append(f"X-Page-Id: {key}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(refers_to)}")
        lines.append(f"X-Refers-To-Page-Id: {refers_to}")
    head = VERSION + "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n"
    squeezer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeezer.compress(head + body + b"\r\n\r\n") + squeezer.flush()


def assign_revisits(pages: DataFrame, key: str, html: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(k, digest, refers_to): the smallest key of equal payloads for all but that row; only digests move."""
    digests = pages.select(
        F.col(key).alias("k"),
        F.sha2(F.coalesce(F.col(html), F.lit("")), 256).alias("digest"),
        F.octet_length(F.coalesce(F.col(html), F.lit(""))).alias("n"),
    )
    large = digests.where(F.col("n") >= min_bytes)
    first = large.groupBy("digest").agg(F.min("k").alias("response"))
    return (
        large.select("k", "digest")
        .distinct()
        .join(first, "digest")
        .where("k <> response")
        .select("k", "digest", F.col("response").alias("refers_to"))
    )


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Write every row of ``pages``; (path, bytes, records) of the finished archives, stored once.

    A task writes a file under a name of its own and only then reports it, so an
    attempt that is lost or doubled leaves an archive that nobody reads.
    """
    roles = assign_revisits(pages, key, html)
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.coalesce(F.col(html), F.lit("")).alias("h"))
    rows = rows.withColumn("digest", F.sha2("h", 256))
    joined = rows.join(roles, ["k", "digest"], "left").select("k", "u", "h", "digest", "refers_to")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(folder)
        path, out, n, size = posixpath.join(root, f"{uuid.uuid4().hex}.warc.gz"), None, 0, 0
        for batch in batches:
            keys, refers = batch["k"].astype("object"), batch["refers_to"].astype("object")
            for k, u, h, digest, r in zip(keys, batch["u"], batch["h"], batch["digest"], refers):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                member = record(_whole(k), u, h.encode("utf-8"), digest, _whole(r))
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [n]})

    return stored(joined.mapInPandas(work, "path string, bytes bigint, records bigint"), "archives")


def _whole(value: object) -> int | None:
    return None if value is None or value != value else int(value)


class Member:
    """The gzip member at ``at``: iterating gives its decoded chunks, after which ``end`` is where it ends.

    Raises zlib.error on anything else. A chunk is bounded however far its bytes
    expand; what is not yet decoded comes before further bytes.
    """

    def __init__(self, stream: BinaryIO, at: int):
        self.end = at
        self.chunks = self._decoded(stream, at)

    def __iter__(self) -> Iterator[bytes]:
        return self.chunks

    def _decoded(self, stream: BinaryIO, at: int) -> Iterator[bytes]:
        stream.seek(at)
        opener = zlib.decompressobj(31)
        while not opener.eof:
            data = opener.unconsumed_tail or stream.read(CHUNK)
            if not data:
                raise zlib.error("the member is cut off")
            yield opener.decompress(data, DECODED_CHUNK)
        self.end = stream.tell() - len(opener.unused_data)


def read_header(stream: BinaryIO, at: int) -> tuple[dict[str, str], bytes, Member] | None:
    """Header fields, the body bytes decoded so far and the rest; None when no WARC record starts at ``at``.

    Only the first bytes can turn a candidate down, so neither a long header nor a long body is taken for none.
    """
    member, seen = Member(stream, at), b""
    try:
        for chunk in member:
            searched = max(len(seen) - 3, 0)
            seen += chunk
            if seen[: len(VERSION)] != VERSION[: len(seen)]:
                return None
            end = seen.find(b"\r\n\r\n", searched)
            if end >= 0:
                fields = {}
                for line in seen[len(VERSION) : end].split(b"\r\n"):
                    name, colon, value = line.partition(b":")
                    if not colon:
                        return None
                    fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
                return (fields, seen[end + 4 :], member) if fields.get("content-length", "").isdigit() else None
    except zlib.error:
        return None
    return None


def starts_in(stream: BinaryIO, start: int, end: int) -> Iterator[int]:
    """Offsets of the gzip magic in [start, end); blocks overlap by the length of the magic."""
    at = start
    while at < end:
        stream.seek(at)
        block = stream.read(min(SPLIT_BYTES, end - at) + len(MAGIC) - 1)
        found = block.find(MAGIC)
        while found >= 0 and at + found < end:
            yield at + found
            found = block.find(MAGIC, found + 1)
        at += SPLIT_BYTES


def records_in(stream: BinaryIO, start: int, end: int, keep_payload: bool = False) -> Iterator[dict]:
    """The records that start in [start, end); a magic inside an owned record is not looked at."""
    free = start
    for at in starts_in(stream, start, end):
        if at < free:
            continue
        opened = read_header(stream, at)
        if opened is None:
            continue
        fields, body, rest = opened
        length, digest, got, kept = int(fields["content-length"]), hashlib.sha256(), 0, []
        try:
            for chunk in _chained(body, rest):
                part = chunk[: max(length - got, 0)]
                digest.update(part)
                got += len(part)
                if keep_payload:
                    kept.append(part)
        except zlib.error as error:
            raise ValueError(f"the record at byte {at} is damaged: {error}") from error
        if got != length:
            raise ValueError(f"the record at byte {at} has {got} of {length} bytes")
        free = max(rest.end, at + 1)
        yield {"fields": fields, "length": length, "digest": digest.hexdigest(), "payload": b"".join(kept), "at": at}


def _chained(first: bytes, rest: Member) -> Iterator[bytes]:
    yield first
    yield from rest


def read_archives(
    spark: SparkSession, archives: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = False
) -> DataFrame:
    """One row per record of the archives (path, bytes): a task per byte range, whatever the size of a file."""
    ranges = archives.select(
        "path",
        F.col("bytes").alias("size"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))).alias("start"),
    )
    # as many tasks as there are ranges' worth of bytes: a number that adaptive execution does not merge, though the rows are tiny
    total = archives.agg(F.sum("bytes")).first()[0] or 0
    spread = ranges.repartition(max(-(-total // split_bytes), 1), "path", "start")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, start, size in zip(batch["path"], batch["start"], batch["size"]):
                rows, held = [], 0
                with fs.open_input_file(path) as stream:
                    for r in records_in(stream, start, min(start + split_bytes, size), with_payload):
                        f = r["fields"]
                        revisit = f.get("warc-type") == "revisit"
                        rows.append(
                            (
                                _number(f.get("x-page-id")),
                                f.get("warc-target-uri"),
                                int(f.get("x-payload-length", r["length"])) if revisit else r["length"],
                                f.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else r["digest"],
                                f.get("warc-type"),
                                _number(f.get("x-refers-to-page-id")),
                                path,
                                r["at"],
                                *([r["payload"]] if with_payload else []),
                            )
                        )
                        held += len(r["payload"])
                        if held > SPLIT_BYTES or len(rows) >= 4096:
                            yield _frame(rows, with_payload)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, with_payload)

    schema = (
        "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint, path string, at bigint" + (", payload binary" if with_payload else "")
    )
    return spread.mapInPandas(work, schema)


def all_read(found: DataFrame, archives: DataFrame) -> DataFrame:
    """``found`` when it has as many rows of every archive as were written there, else an error; both are read twice."""
    counts = found.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    both = archives.select("path", "records").join(counts, "path", "full")
    n, records = F.coalesce("n", F.lit(0)), F.coalesce("records", F.lit(0))
    wrong = both.where(n != records).select("path", n.alias("n"), records.alias("records")).first()
    if wrong is not None:
        raise ValueError(f"{wrong['n']} of {wrong['records']} records came back from {wrong['path']}")
    return found


def _number(text: str | None) -> int | None:
    return int(text) if text is not None else None


def _frame(rows: list[tuple], with_payload: bool) -> pd.DataFrame:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "at"]
    frame = pd.DataFrame(rows, columns=names + ["payload"] * with_payload)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, path, at): written, then read back.

    Null html is an empty payload. Of equal payloads of at least 100 bytes the
    smallest key is the response and the others refer to it; rows that repeat
    that key are responses too, and so are rows without a key among equals
    without one. Rows with a null key are written without an id and come back
    with a null one. An empty table writes nothing. Other columns are not read.
    An archive that gives back more or fewer records than it holds is an error.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    archives = write_archives(pages, folder, key, url, html)
    return all_read(stored(read_archives(spark, archives, folder).drop("url"), "records"), archives)
