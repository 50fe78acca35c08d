"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is a gzip member of its own. The reader's tasks get byte ranges: a task scans its range for gzip
magic, takes a hit for a member only if its first bytes decode to a WARC header, and owns the records that
start inside its range, even if they end beyond it. So an archive of any size is read by many tasks.

Of pages with equal payloads of at least ``least`` bytes, those with the smallest id are written in full
(response); the others become revisit records that name it. Null html is an empty payload. A null id counts
as larger than any other; if all ids of a payload are null, all are responses, and rows that share the
smallest id are all responses. An empty table gives no archives and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from urllib.parse import quote

from tidemark.llm import common, files

LEAST_BYTES = 100
SPLIT = 4 << 20
MAGIC = b"\x1f\x8b\x08"
_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ROWS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is set where the row is a revisit."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # Who revisits whom is decided on ids and digests alone; html then moves by (page_id, digest), which no common payload fills.
    narrow = rows.filter(F.octet_length("html") >= least).select("page_id", "digest")
    again = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = again.filter("n > 1 and first is not null").select("digest", "first")
    revisits = narrow.distinct().join(again, "digest").filter(~F.col("first").eqNullSafe(F.col("page_id")))
    revisits = revisits.select(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest"), F.col("first").alias("refers_to"))
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left")
    return joined.select("page_id", "url", "html", "digest", "refers_to")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """One archive a partition; returns (file, n_bytes, starts): how many records start in each SPLIT bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, starts, name = None, [], f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.gz"
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    out = out or files.Output(name)
                    starts += [0] * (out.size // SPLIT + 1 - len(starts))
                    starts[-1] += 1
                    out.write(_record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to))
        if out:
            out.close()
            starts += [0] * ((out.size - 1) // SPLIT + 1 - len(starts))
            yield pa.RecordBatch.from_pydict({"file": [name], "n_bytes": [out.size], "starts": pa.array([starts], pa.list_(pa.int32()))})

    return with_records(pages, least).mapInArrow(write, "file string, n_bytes long, starts array<int>")


class _Bytes:
    """A file's bytes from ``start`` on, read as far as they are asked for."""

    def __init__(self, uri: str, start: int, n: int):
        system, path = files.place(uri)
        self.file, self.start = system.open_input_file(path), start
        self.size, self.data = self.file.size(), self.file.read_at(n, start)

    def more(self) -> bool:
        have = self.start + len(self.data)
        if have >= self.size:
            return False
        self.data += self.file.read_at(max(1 << 18, len(self.data) // 2), have)
        return True


def _header(raw: bytes) -> dict[str, str] | None:
    """The named fields of a WARC header, or None if this is not the start of a record."""
    head, found, _ = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/1."):
        return None
    fields = {k.decode("latin-1").lower(): v.strip().decode("utf-8", "replace") for k, s, v in (x.partition(b":") for x in lines[1:]) if s}
    return fields if {"warc-type", "content-length"} <= fields.keys() else None


def _member(source: _Bytes, at: int) -> tuple[bytes, int] | None:
    """(contents, end) of the gzip member at ``at`` if it holds a WARC record."""
    z, out, fed = zlib.decompressobj(31), [], at
    checked = False
    try:
        while not z.eof:
            if fed >= len(source.data) and not source.more():
                return None
            piece = source.data[fed : fed + (1 << 16)]
            fed += len(piece)
            out.append(z.decompress(piece))
            if not checked and sum(map(len, out)) >= 7:
                if not b"".join(out).startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    whole = b"".join(out)
    fields = _header(whole)
    if fields is None or not fields["content-length"].isdigit() or len(whole) != whole.index(b"\r\n\r\n") + 8 + int(fields["content-length"]):
        return None
    return whole, fed - len(z.unused_data)


def records(uri: str, start: int, stop: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records that start in [start, stop)."""
    source = _Bytes(uri, start, stop - start + len(MAGIC) - 1)
    at = 0
    while 0 <= (at := source.data.find(MAGIC, at)) < stop - start:
        got = _member(source, at)
        if got is None:
            at += 1
            continue
        whole, at = got
        cut = whole.index(b"\r\n\r\n") + 4
        yield _header(whole), whole[cut:-4]
        if at >= len(source.data) - len(MAGIC):
            source.more()


def _number(field: str | None) -> int | None:
    digits = (field or "").removeprefix(f"<{_ID}").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def read_archives(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """(file, n_bytes) of archives -> a row for each response or revisit record; see _ROWS. payload is null for a revisit.

    Bytes that decode to no record are passed over, as in archives of others; where ``starts`` of the writer is
    given, a split of SPLIT bytes in which fewer or more records start than were written is an error.
    """
    starts = F.col("starts") if "starts" in archives.columns and split == SPLIT else F.lit(None).cast("array<int>")
    splits = archives.filter("n_bytes > 0").select("file", "n_bytes", starts.alias("starts"), F.explode(F.sequence(F.lit(0), ((F.col("n_bytes") - 1) / split).cast("long"))).alias("k"))
    splits = splits.withColumn("due", F.try_element_at("starts", F.col("k").cast("int") + 1)).drop("starts")
    total = archives.agg(F.sum("n_bytes")).head()[0] or 0
    splits = splits.repartition(common.tasks_for(archives.sparkSession, total, 4 * SPLIT), "file", "k")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: list[dict] = []
                seen = 0
                for fields, block in records(row["file"], row["k"] * split, min((row["k"] + 1) * split, row["n_bytes"])):
                    seen += 1
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    named = {k: v.strip() for k, _, v in (x.lower().partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
                    full = fields["warc-type"] == "response"
                    digest = hashlib.sha256(payload).hexdigest() if full else fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    if full and fields.get("warc-payload-digest", f"sha256:{digest}") != f"sha256:{digest}":
                        raise ValueError(f"payload digest differs in {row['file']}: {fields['warc-record-id']}")
                    out.append({"page_id": _number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload": payload if full else None, "payload_bytes": len(payload) if full else int(named.get("content-length") or 0), "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": _number(fields.get("warc-refers-to"))})
                    if len(out) == 256:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)
                if row["due"] is not None and seen != row["due"]:
                    raise ValueError(f"{row['file']}: {seen} of {row['due']} records in split {row['k']}")

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return splits.mapInArrow(read, _ROWS)


def round_trip(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    folder = common.shared_dir(pages.sparkSession, "warc")
    return read_archives(common.written(write_archives(pages, folder, least), "warc-names"))
