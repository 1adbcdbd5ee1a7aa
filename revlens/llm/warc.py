"""WARC archives: one gzip member per record, written and read in sequence by tasks.

Writing: payloads are told apart by SHA-256; of equal payloads the row with the largest
``page_id`` is a response, the others are revisit records that name it and keep the HTTP
headers only. Tasks write archives of at most ``ARCHIVE_BYTES`` (one record may exceed
it) into a shared folder under names no other attempt uses, and hand over a manifest;
the manifest is a table, so files of failed attempts are in the folder but not in it.

A record's id is made from its page, payload and number among repeats, so a revisit refers to
the id of the very record that responds.

Reading: a task opens an archive and reads it front to back in blocks. Each gzip member
is decompressed incrementally, the record's headers are parsed from its start, and
Content-Length frames its body; a member that holds less or more, a wrong block digest
or a wrong payload digest fails the read. Records of other kinds (warcinfo, request, ...) are
framed and skipped; digests that are missing or of another kind than SHA-1 are not compared,
and ids that are not of this module's kind give no page. Memory holds one record and one block.

Null html counts as an empty payload; null urls have no target URI; rows without a
``page_id`` never come before rows with one. Of rows that repeat the responding id, one
is the response. Pages may be of any size; one is one value. An empty table writes no archive
and gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import stored
from revlens.session import scratch_dir

ARCHIVE_BYTES = 256 << 20
BLOCK = 1 << 20
CREATED = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


class WarcError(ValueError):
    """An archive that is cut off, misframed or fails a digest."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]
    return "\r\n".join(lines).encode() + CRLF + CRLF


def record_id(page_id: int | None, sha: bytes, number: int) -> str:
    """The id of a page's record: a function of the page, its payload, and of the row among repeats of both."""
    return f"<urn:page:{'-' if page_id is None else page_id}:{sha.hex()}:{number}>"


_PAGE = re.compile(r"<urn:page:(-?\d+):[0-9a-f]{64}:\d+>")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_response: bool, number: int = 1) -> bytes:
    """One record as a gzip member. The response of a payload is number 1 of its page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    target = None if url is None else "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    sha = hashlib.sha256(payload).digest()
    head = _header([
        ("WARC-Type", "response" if is_response else "revisit"),
        ("WARC-Record-ID", record_id(page_id, sha, number)),
        ("WARC-Date", CREATED),
        ("WARC-Target-URI", target),
        ("WARC-Profile", None if is_response else PROFILE),
        ("WARC-Refers-To", None if is_response else record_id(refers_to, sha, 1)),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + CRLF + CRLF) + packer.flush()


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:/", "file:///", 1))


def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to, is_response, n (among repeats of page and payload). The html is
    shuffled once, by payload and id."""
    page_id = F.col("page_id").cast("long")
    rows = pages.select(
        page_id.alias("page_id"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"),
        F.coalesce(page_id.cast("string"), F.lit("-")).alias("id"),  # a key without nulls, so that one shuffle does
    ).withColumn("sha", F.unhex(F.sha2("html", 256)))
    ids = rows.select("sha", "id", "page_id").distinct()
    best = ids.groupBy("sha").agg(F.max("page_id").alias("best"))
    known = ids.select("sha", "id").join(best, "sha")
    one = Window.partitionBy("sha", "id").orderBy(F.col("url").asc_nulls_last())
    return (
        rows.withColumn("n", F.row_number().over(one))
        .join(known.hint("merge"), ["sha", "id"])
        .withColumn("is_response", F.col("page_id").eqNullSafe(F.col("best")) & (F.col("n") == 1))
        .select("page_id", "url", "html", F.col("best").alias("refers_to"), "is_response", "n")
    )


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``classified`` rows; returns the manifest (file, records, bytes). Runs when stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        out, done, records, size = None, [], 0, 0
        for pdf in batches:
            for page_id, url, html, refers_to, is_response, n in pdf.itertuples(index=False, name=None):
                if out is None or size >= archive_bytes:
                    if out is not None:
                        out.close()
                        done.append((name, records, size))
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                number = lambda x: None if pd.isna(x) else int(x)
                member = record(number(page_id), url, html.encode(), number(refers_to), bool(is_response), int(n))
                out.write(member)
                records, size = records + 1, size + len(member)
        if out is not None:
            out.close()
            done.append((name, records, size))
        yield pd.DataFrame(done, columns=["file", "records", "bytes"])

    return pages.mapInPandas(run, "file string, records long, bytes long")


def read_members(stream) -> Iterator[bytes]:
    """Whole decompressed gzip members of a byte stream, one after another."""
    raw = b""
    while raw or (raw := stream.read(BLOCK)):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not raw and not (raw := stream.read(BLOCK)):
                raise WarcError("the archive ends inside a record")
            try:
                parts.append(member.decompress(raw))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            raw = member.unused_data
        yield b"".join(parts)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _check(stated: str | None, data: bytes, what: str) -> None:
    """Compare with a stated digest; other algorithms and records without one are not checked."""
    name, _, value = (stated or "").partition(":")
    if name.lower() == "sha1" and len(value) == 32 and value.upper() != digest(data):
        raise WarcError(f"wrong {what} digest")


def parse(member: bytes) -> dict | None:
    """Headers and payload of one record, framed by Content-Length and checked by its digests;
    None for a record that is neither a response nor a revisit of one (warcinfo, request, ...)."""
    head, gap, rest = member.partition(CRLF + CRLF)
    if not gap or not head.startswith(b"WARC/1."):
        raise WarcError("no WARC header")
    fields = _fields(head)
    if not fields.get("content-length", "").isdigit():
        raise WarcError("no Content-Length")
    n = int(fields["content-length"])
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != CRLF + CRLF:
        raise WarcError(f"Content-Length {n} does not frame the record")
    _check(fields.get("warc-block-digest"), block, "block")
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(CRLF + CRLF)
    length = _fields(http).get("content-length", "")
    if kind == "response":
        if length.isdigit() and int(length) != len(payload):
            raise WarcError(f"a payload of {len(payload)} bytes instead of {length}")
        _check(fields.get("warc-payload-digest"), payload, "payload")
    stated = fields.get("warc-payload-digest")
    page = lambda k: int(m[1]) if (m := _PAGE.fullmatch(fields.get(k, ""))) else None
    return {
        "page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"),
        "payload_bytes": len(payload) if kind == "response" else int(length) if length.isdigit() else None,
        "payload_digest": stated.partition(":")[2] if stated else digest(payload) if kind == "response" else None,
        "record_type": kind, "refers_to": page("warc-refers-to"), "payload": payload,
        "record_id": fields.get("warc-record-id"), "refers_to_record": fields.get("warc-refers-to"),
    }


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """The responses and revisits in the archives of a manifest (``records``: how many records of
    any kind an archive holds, null where that is not known); an archive is read by one task."""
    names = [
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record",
        *["payload"] * keep_payload,
    ]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        for pdf in batches:
            for file, expected in zip(pdf["file"], pdf["records"], strict=True):
                found, rows, size = 0, [], 0
                with store.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for member in read_members(stream):
                        found, row = found + 1, parse(member)
                        if row is None:
                            continue
                        size += len(row["payload"]) * keep_payload
                        rows.append(row)
                        if not keep_payload:
                            del row["payload"]
                        if len(rows) >= 4096 or size >= 16 << 20:
                            yield _frame(rows, names)
                            rows, size = [], 0
                if not pd.isna(expected) and found != expected:
                    raise WarcError(f"{file} has {found} records, not {expected}")
                yield _frame(rows, names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    schema += "record_id string, refers_to_record string"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(tasks, "file").mapInPandas(run, schema + ", payload binary" * keep_payload)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.assign(**{c: frame[c].astype("Int64") for c in ("page_id", "payload_bytes", "refers_to")})


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, keep_payload: bool = True) -> DataFrame:
    """Write every page to archives in ``folder`` (default: the shared one), then read them back."""
    folder = folder or scratch_dir(spark, "warc")
    manifest = stored(spark, write_archives(classified(pages), folder), "warc-manifest")
    return read_archives(spark, manifest, folder, keep_payload)
