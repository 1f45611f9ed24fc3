"""WARC archives: writing captures with revisit records, reading records, assembling transactions.

A capture is three records, each a gzip member: a response (or a revisit of a
capture with the same payload), and a request and a metadata record that name it
in WARC-Concurrent-To. Reading parses archives into one row per record; assembly
joins the records of a transaction through those identifiers, wherever they stand,
and gives one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.llm.common import bloom, column_of, discard, keyed, new_folder, ship, slices, stored
from plexora.llm.files import read_files, write_file

#: Payload bytes of an archive before the next is begun.
ARCHIVE_BYTES = 16 << 20
#: Fixed values of the format.
VERSION, REVISIT = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SPACES = re.compile(r"\s")
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page_id: int | None, row: int) -> str:
    """The same for each run of a task, so that a file that is written again is the same; row tells rows with one page_id apart."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}/{page_id}/{row}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return gzip.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def capture(row: int, page_id: int | None, url: str | None, payload: bytes, payload_digest: str, first: tuple[int | None, int] | None) -> bytes:
    """The records of one capture; first is page_id and row of the response that has the payload, None if this one does.

    White space within a url is written percent-encoded, as a header's line can't hold it.
    """
    uri = [("WARC-Target-URI", SPACES.sub(lambda m: quote(m[0]), url.strip()))] if url and url.strip() else []
    common = [("WARC-Date", DATE), *uri]
    own = record_id("capture", page_id, row)
    kind = [("WARC-Type", "response")] if first is None else [("WARC-Type", "revisit"), ("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id("capture", *first))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    main = record([*kind, ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Content-Type", "application/http; msgtype=response")], http + (payload if first is None else b""))
    request = record([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page_id, row)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\n\r\n")
    meta = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page_id, row)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], meta)
    return request + main + metadata


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, parts, captures = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size, captures
            name = f"capture-{part:06d}-{number:06d}.warc.gz"
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", part, number)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: plexora\r\n")
            write_file(folder, name, info + b"".join(parts))
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([captures], pa.int64())], ["name", "captures"])
            parts.clear()
            number, size, captures = number + 1, 0, 0
            return row

        for whole in batches:
            for batch in slices(whole, name="html"):
                for row, page_id, url, html, sha, first, first_row in zip(*(column_of(batch, c).to_pylist() for c in ("_row", "page_id", "url", "html", "sha", "first", "first_row")), strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    d = base64.b32encode(bytes.fromhex(sha)).decode()
                    parts.append(capture(row, page_id, url, payload, d, None if first_row is None else (first, first_row)))
                    size, captures = size + len(payload), captures + 1
                    if size >= ARCHIVE_BYTES:
                        yield flush()
        if parts:
            yield flush()

    return run


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes archives of all rows into folder; returns their names and numbers of captures.

    Of rows with equal payloads of at least least_bytes bytes, that with the smallest
    page_id is a response, the others are revisits of it; a null page_id counts as the
    largest, and of equal ones the first row is taken. A null html is an empty payload.
    Payloads stay where they are, but for those of revisits.
    """
    ship(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = keyed(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha")))
    sums = rows.select("_row", "page_id", "sha", F.octet_length("html").alias("bytes")).where(F.col("bytes") >= least_bytes)
    # A payload of a third of all pages is one row per task after the partial minimum.
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_row")).alias("f")
    first = sums.groupBy("sha", "bytes").agg(least, F.count("*").alias("k")).where("k > 1").select("sha", "bytes", F.col("f.page_id").alias("first"), F.col("f._row").alias("first_row"))
    marked = stored(sums.join(first, ["sha", "bytes"]).where("_row <> first_row").select("_row", "first", "first_row"), "revisits")
    shared = pages.sparkSession.sparkContext.broadcast(bloom(marked.select("_row"), marked.count()))

    @F.pandas_udf("boolean")
    def perhaps(row: pd.Series) -> pd.Series:
        return pd.Series(shared.value(row.to_numpy().astype(np.int64)))

    none = F.lit(None).cast("long")
    alone = rows.where(~perhaps("_row")).withColumn("first", none).withColumn("first_row", none)
    others = rows.where(perhaps("_row")).join(marked, "_row", "left").sortWithinPartitions("_row")  # in order: a task that runs again writes the same files
    out = stored(alone.unionByName(others).mapInArrow(_write(folder), "name string, captures long"), "archives")
    discard(rows, marked)
    return out


def unzipped(data: bytes) -> bytes:
    """The contents of all gzip members. Each is fed in small pieces, so that what follows it isn't copied once a member."""
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        member, step = zlib.decompressobj(wbits=31), 2048
        while not member.eof and at < len(view):
            out.append(member.decompress(view[at : at + step]))
            at, step = at + step, 2 * step
        if not member.eof:
            raise EOFError("the archive ends within a gzip member")
        at = min(at, len(view)) - len(member.unused_data)
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive."""
    raw = unzipped(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, found, v in (x.partition(":") for x in lines[1:]) if found}
        size = int(headers.get("content-length", 0))
        yield headers, raw[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, headers map<string,string>, block binary"


def _records(blocks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for content in column_of(batch, "content"):
                rows, size = [], 0
                for h, block in parse(content.as_buffer().to_pybytes()):
                    kind = h.get("warc-type", "")
                    named, n = h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        if kind == "response":  # from the bytes that are there
                            if named and named != (found := digest(payload)):
                                raise ValueError(f"{h.get('warc-record-id')}: the payload's digest is {found}, not {named}")
                            n = len(payload)
                        else:
                            n = next((int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    keep = block if blocks or kind == "metadata" else None
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), named, n, list(h.items()), keep))
                    size += len(keep or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read_records(spark, folder: str, blocks: bool = True) -> DataFrame:  # noqa: ANN001
    """One row per record of the archives in folder; without blocks only those of metadata records are kept."""
    return read_files(spark, folder, "*.warc.gz").select("content").mapInArrow(_records(blocks), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: key, capture, request, metadata (structs of the record columns; null where there is none).

    A record belongs to the record that its WARC-Concurrent-To names, or to the one
    that that one names; records that name each other belong together. Of several
    requests or metadata records of a capture, that with the smallest id is taken;
    records of one transaction never are more than a few. Transactions without
    response or revisit give no row.
    """
    own = records.where(F.col("type").isin("response", "revisit", "request", "metadata") & F.col("record_id").isNotNull())
    named = own.select(F.col("record_id").alias("to"), F.col("concurrent_to").alias("next")).where("next is not null").distinct()
    held = own.join(named, own["concurrent_to"] == named["to"], "left")
    key = F.when(F.col("next") == F.col("record_id"), F.least("record_id", "concurrent_to")).otherwise(F.coalesce("next", "concurrent_to", "record_id"))
    row = F.struct(*own.columns)

    def of(*kinds: str):  # noqa: ANN202
        return F.min_by(F.when(F.col("type").isin(*kinds), row), F.when(F.col("type").isin(*kinds), F.col("record_id")))

    return held.withColumn("key", key).groupBy("key").agg(of("response", "revisit").alias("capture"), of("request").alias("request"), of("metadata").alias("metadata")).where("capture is not null")


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    page_id and refers_to (the page of the response that a revisit names) come from
    the assembled records. Every row of pages gives a row, those with a null
    or repeated page_id too. Payloads of any length are written whole; an empty table
    gives no rows.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    if write_warc(pages, folder, least_bytes).isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
    page = F.regexp_extract(F.decode("metadata.block", "UTF-8"), r"page-id: (-?\d+)", 1)
    records = stored(read_records(spark, folder, blocks=False).drop("headers"), "records")  # assembly reads them twice
    found = assemble(records).select(
        F.when(page != "", page.cast("long")).alias("page_id"), "capture.record_id", "capture.payload_bytes", "capture.payload_digest", F.col("capture.type").alias("record_type"), F.col("capture.refers_to").alias("names"), F.col("capture.target_uri").alias("url")
    )
    found = stored(found, "captures")
    named = found.where("record_type = 'response'").select(F.col("record_id").alias("names"), F.col("page_id").alias("refers_to"))
    return found.join(named, "names", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
