"""WARC archives: written by Spark, read back by a reader that salvages what lies behind damage."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timetab.session import materialise

END = "\r\n\r\n"  # closes the head of a record, and the record
DATE = "1970-01-01T00:00:00Z"
RECORDS = (
    "file string, offset long, length long, status string, reason string, type string, record_id string, target_uri string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary"
)
# Fixed values of the format: version line, revisit profile.
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MEMBER = b"\x1f\x8b\x08"
_STEP, _PIECE = 1 << 16, 1 << 8
FILE_BYTES = 128 << 20


def payload_roles(pages: DataFrame, page_id: str, html: str, least_bytes: int) -> DataFrame:
    """``digest, response_id`` of payloads of ``least_bytes`` or more that several rows share; copies combine before the shuffle."""
    body = F.coalesce(F.col(html), F.lit(""))
    return pages.where(F.octet_length(body) >= least_bytes).groupBy(F.sha2(body, 256).alias("digest")).agg(
        F.max(page_id).alias("response_id"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").drop("n")


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def _heads(*lines: tuple[str, Column]) -> Column:
    return F.concat_ws("\r\n", *[F.concat(F.lit(f"{name}: "), value) for name, value in lines])


def warc_records(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000, roles: DataFrame | None = None
) -> DataFrame:
    """One column ``record``: a response or revisit record per row, without its closing line ends.

    ``roles``: what ``payload_roles`` gives, where ``pages`` is only a part of the rows.
    """
    roles = materialise(payload_roles(pages, page_id, html, least_bytes), "roles") if roles is None else roles
    body = F.coalesce(F.col(html), F.lit(""))
    taken = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), body.alias("body")).withColumn(
        # Small payloads look nothing up, and their rows must not meet in one task.
        "digest", F.when(F.octet_length("body") >= least_bytes, F.sha2("body", 256)).otherwise(F.concat(F.lit("page "), F.uuid()))
    )
    known = taken.join(roles, "digest", "left")
    revisit = F.coalesce(F.col("response_id").isNotNull() & ~F.col("page").eqNullSafe(F.col("response_id")), F.lit(False))
    size = F.octet_length("body").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    # White space and controls would break a header line.
    safe_url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "_")
    known = known.withColumns({"revisit": revisit, "block": block})
    first = [("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", _urn(F.col("page")))]
    later = [
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("body"))),
        ("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        ("X-Payload-Length", size),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length("block").cast("string")),
    ]
    target = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), safe_url))
    refers = F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("response_id"))))
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), _heads(*first), target, refers, _heads(*later))
    return known.select(F.concat(head, F.lit(END), F.col("block")).alias("record"))


def write_warc(
    pages: DataFrame, path: str, records_per_file: int = 2000, compression: str = "gzip", file_bytes: int = FILE_BYTES, page_id: str = "page_id",
    url: str = "url", html: str = "html", least_bytes: int = 1000,
) -> None:
    """Write archives of at most ``records_per_file`` records to a folder that Spark can reach.

    The payload of a record is the html in UTF-8. Of equal payloads of ``least_bytes`` or more, rows with the largest page_id
    are responses and others revisit them; if no such row has a page_id, all are responses.

    Pages are written by size, large ones fewer to a file, so that a file holds ``file_bytes`` besides its heads, or one page that
    is longer: the reader takes a file as one value.
    """
    roles = materialise(payload_roles(pages, page_id, html, least_bytes), "roles")
    size = F.coalesce(F.octet_length(html), F.lit(0)) + F.coalesce(F.octet_length(url), F.lit(0))
    room = max(1, file_bytes // records_per_file)
    # A class has pages of up to 16 times the bytes of the one before, and a 16th of their number to a file.
    steps = [room * 16**i for i in range(len(f"{records_per_file:x}"))]
    nth = sum(((size > s).cast("int") for s in steps), F.lit(0))
    present = sorted(r[0] for r in pages.groupBy(nth).count().collect()) or [0]
    for i in present:
        mode = "errorifexists" if i == present[0] else "append"
        records = warc_records(pages.where(nth == i), page_id, url, html, least_bytes, roles)
        # The text writer ends each value with the separator, which is just how a record ends.
        records.write.mode(mode).option("lineSep", END).option("maxRecordsPerFile", max(1, records_per_file // 16**i)).option(
            "compression", compression
        ).text(path)


def _segments(data: bytes) -> Iterator[tuple[int, int, bytes, str | None]]:
    """``(offset, length, content, fault)`` of the gzip members of a file, or all of a plain one.

    A broken member yields what was inflated before the fault, up to the next place where a member begins and inflates.
    """
    if not data.startswith(_MEMBER) and not (_MEMBER in data and not _VERSION.match(data)):
        yield 0, len(data), data, None
        return
    at = 0
    while at < len(data):
        out, fault, end = [], None, at
        if data.startswith(_MEMBER, at):
            member = zlib.decompressobj(31)
            try:
                while not member.eof and end < len(data):
                    before = member.copy()
                    out.append(member.decompress(data[end : end + _STEP]))
                    end += _STEP
                out.append(member.flush())
                fault = None if member.eof else "member cut short"
                end = min(end, len(data)) - len(member.unused_data)
            except zlib.error as e:
                fault = f"member broken: {e}"
                out.extend(_up_to_fault(before, data[end : end + _STEP]))
        else:
            fault = "no member"
        if fault:
            end = data.find(_MEMBER, at + 1)
            while end >= 0 and not _inflates(data, end):
                end = data.find(_MEMBER, end + 1)
            end = len(data) if end < 0 else end
        yield at, end - at, b"".join(out), fault
        at = end


def _up_to_fault(member, data: bytes) -> Iterator[bytes]:
    """What a decompressor gives of a step that fails as a whole: small pieces, and the failing one byte by byte of its output."""
    for at in range(0, len(data), _PIECE):
        before = member.copy()
        try:
            yield member.decompress(data[at : at + _PIECE])
        except zlib.error:
            rest = data[at : at + _PIECE]
            break
    else:
        return
    try:
        while got := before.decompress(rest, 1):
            yield got
            rest = before.unconsumed_tail
    except zlib.error:
        return


def _inflates(data: bytes, at: int) -> bool:
    try:
        return bool(zlib.decompressobj(31).decompress(data[at : at + _STEP], 64))
    except zlib.error:
        return False


def _record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """``(headers, block, end)`` of the record at a place, or why there is none."""
    version = _VERSION.match(data, at)
    if not version:
        return "no version line"
    close = data.find(b"\r\n\r\n", version.end() - 2)
    if close < 0:
        return "head not closed"
    heads = {}
    for line in data[version.end() : close].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        heads[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = heads.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return "no content length"
    start, end = close + 4, close + 4 + int(size)
    if end > len(data):
        return "block cut short"
    if data[end : end + 4] != b"\r\n\r\n"[: len(data) - end]:
        return "record not closed"
    block = data[start:end]
    said = heads.get("warc-block-digest", "")
    if said.startswith("sha1:") and hashlib.sha1(block).hexdigest() != said[5:].lower():
        return "block digest differs"
    return heads, block, min(end + 4, len(data))


def salvage(data: bytes) -> Iterator[tuple]:
    """``(offset, length, reason, headers, block)`` per record (reason null) and per quarantined gap (headers null), in order.

    Offsets are those of the inflated stream of the gzip member for records and gaps inside one, else of the file.
    """
    for offset, length, content, fault in _segments(data):
        at = 0
        while at < len(content):
            got = _record(content, at)
            if isinstance(got, tuple):
                yield offset + at, got[2] - at, None, got[0], got[1]
                at = got[2]
                continue
            # Search on for the next version line that begins a valid record.
            after = at
            while True:
                found = _VERSION.search(content, after + 1)
                after = found.start() if found else len(content)
                if not found or isinstance(_record(content, after), tuple):
                    break
            yield offset + at, after - at, got, None, None
            at = after
        if fault:
            yield offset, length, fault, None, None


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record (status ``record``) and per quarantined stretch of bytes (status ``gap``, with its reason).

    After a failed check (version line, headers, length, closing lines, digest, gzip member) the reader goes on at the next
    member or version line that begins a valid record. payload_bytes and payload_digest are measured on the payload read;
    a revisit has no payload of its own and tells what its headers say. Empty files give no rows.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                rows = []
                for offset, length, reason, heads, block in salvage(data):
                    if heads is None:
                        rows.append((name, offset, length, "gap", reason, None, None, None, None, None, None, None))
                        continue
                    kind = heads.get("warc-type")
                    payload, size, digest = None, None, heads.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None
                    if kind == "revisit":
                        told = heads.get("x-payload-length", "")
                        size = int(told) if told.isascii() and told.isdigit() else None
                    else:
                        http = heads.get("content-type", "").startswith("application/http")
                        payload = block.partition(b"\r\n\r\n")[2] if http else block
                        size, measured = len(payload), hashlib.sha1(payload).hexdigest()
                        if digest is not None and digest != measured:
                            rows.append((name, offset, length, "gap", "payload digest differs", None, None, None, None, None, None, None))
                            continue
                        digest = measured
                    rows.append((
                        name, offset, length, "record", None, kind, heads.get("warc-record-id"), heads.get("warc-target-uri"),
                        heads.get("warc-refers-to"), size, digest, payload if with_payload else None,
                    ))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
                yield out.astype({"offset": "Int64", "length": "Int64", "payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, RECORDS)


def page_of(urn: Column) -> Column:
    """The page_id in a record's name."""
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
