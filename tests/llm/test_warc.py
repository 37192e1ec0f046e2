"""Archives: round trip, revisits, and what is salvaged from damaged files."""

from __future__ import annotations

import gzip
import hashlib
import zlib

import pytest
from made import SF_DIR

from timetab.llm.warc import page_of, read_warc, salvage, warc_records, write_warc
from timetab.session import fresh_path

SCHEMA = "page_id long, url string, html string, digest string, body string, record string"
BIG, OTHER = "<p>é " * 400, "<b>x</b>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60


def pages():
    rows = [
        (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "http://a/ b\r\nX: y", BIG), (4, None, "small"), (5, "u", "small"), (6, "u", None),
        (7, "u", ""), (None, "u", BIG), (None, None, None), (8, "u", OTHER), (9, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "x" * 1000),
        (12, "u", "x" * 1000), (12, "u", "x" * 1000), (None, "u", "lone" * 500), (None, "u", "lone" * 500),
    ]
    return [(*r, "d", "b", "r") for r in rows]


def written(spark, rows, **options):
    path = fresh_path(spark, "warc")
    write_warc(spark.createDataFrame(rows, SCHEMA).repartition(2), path, **options)
    return path


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, compression):
    rows = pages()
    got = read_warc(spark, written(spark, rows, compression=compression, records_per_file=3)).collect()
    assert all(r["status"] == "record" for r in got)
    back = sorted(
        (str(page_id), r["type"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"]), r["refers_to"])
        for r in got for page_id in [r["record_id"].removeprefix("<urn:page:").removesuffix(">")]
    )
    last = {BIG: 3, "x" * 1000: 12}
    want = []
    for page_id, _, html, *_ in rows:
        body = (html or "").encode()
        revisit = html in last and page_id != last[html]
        want.append((
            "null" if page_id is None else str(page_id), "revisit" if revisit else "response", len(body), hashlib.sha1(body).hexdigest(),
            None if revisit else body, f"<urn:page:{last[html]}>" if revisit else None,
        ))
    assert back == sorted(want, key=lambda x: tuple(str(y) for y in x)) or sorted(back, key=str) == sorted(want, key=str)


def test_files_are_bounded_by_bytes(spark):
    """Large pages are fewer to a file, the largest alone; copies are found across sizes of files."""
    rows = [(i, "u", f"{i} " + "s" * 50, "d", "b", "r") for i in range(60)] + [(100 + i, "u", f"{i} " + "m" * 900, "d", "b", "r") for i in range(40)]
    rows += [(200 + i, "u", f"{i % 3} " + "l" * 30_000, "d", "b", "r") for i in range(6)]
    path = fresh_path(spark, "warc")
    write_warc(spark.createDataFrame(rows, SCHEMA).repartition(2), path, compression="none", records_per_file=40, file_bytes=4000)
    got = read_warc(spark, path).where("status = 'record'").collect()
    assert sorted(int(r["record_id"].split(":")[-1][:-1]) for r in got) == [r[0] for r in rows]
    files = {}
    for r in got:
        files.setdefault(r["file"], []).append(r["payload_bytes"])
    assert all(len(n) == 1 or sum(n) <= 4000 for n in files.values()) and max(map(len, files.values())) == 30
    assert sum(r["type"] == "revisit" for r in got) == 3


def test_pages_table(spark):
    df = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    path = fresh_path(spark, "warc")
    write_warc(df, path)
    back = read_warc(spark, path).where("status = 'record' AND type = 'response'")
    got = {r["p"]: bytes(r["payload"]).decode() for r in back.select(page_of("record_id").alias("p"), "payload").collect()}
    want = {r["page_id"]: r["html"] for r in df.collect()}
    assert got and all(want[k] == v for k, v in got.items())


def stream(spark, n=6):
    rows = [(i, f"http://a/{i}", f"<p>page {i}</p>" * (5 + i), "", "", "") for i in range(n)]
    records = warc_records(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    return [(r["record"] + "\r\n\r\n").encode() for r in records]


def names(data):
    return [h["warc-record-id"] for _, _, _, h, _ in salvage(data) if h]


def spans(data):
    out = [(o, n) for o, n, *_ in salvage(data)]
    assert sum(n for _, n in out) == len(data) and all(a + n == b for (a, n), (b, _) in zip(out, out[1:]))


def test_salvage_plain(spark):
    parts = stream(spark)
    whole = b"".join(parts)
    every = names(whole)
    assert len(every) == 6
    spans(whole)
    # Garbage before and between.
    assert names(b"garbage\n" + parts[0] + b"WARC/1.1\r\nnoise\r\n\r\n" + b"".join(parts[1:])) == every
    # A broken length, a flipped byte in a block, a damaged version line: that record goes, the later ones come back.
    for bad in (
        parts[2].replace(b"Content-Length: ", b"Content-Length: 9", 1), parts[2].replace(b"page 2", b"pagX 2", 1), b"XARC" + parts[2][4:],
        parts[2][: len(parts[2]) // 2], parts[2].replace(b"\r\nWARC-Date:", b"\r\nno colon here\r\nWARC-Date", 1).replace(b"no colon here", b"nocolon"),
    ):
        data = b"".join([*parts[:2], bad, *parts[3:]])
        assert names(data) == every[:2] + every[3:]
        gaps = [(o, n, why) for o, n, why, h, _ in salvage(data) if not h]
        assert [(o, n) for o, n, _ in gaps] == [(len(b"".join(parts[:2])), len(bad))] and all(w for *_, w in gaps)
        spans(data)
    assert names(b"") == [] and names(b"\x00" * 50) == []


def test_salvage_members(spark):
    parts = stream(spark)
    members = [gzip.compress(p) for p in parts]
    every = names(b"".join(parts))
    assert names(b"".join(members)) == every
    broken = bytearray(members[2])
    broken[len(broken) // 2] ^= 0xFF
    for bad in (bytes(broken), members[2][:40], b"junk" * 5):
        data = b"".join([*members[:2], bad, *members[3:]])
        assert names(data) == every[:2] + every[3:]
        assert any(not h for _, _, _, h, _ in salvage(data))
    # A member cut short still gives the records before the cut.
    long = gzip.compress(b"".join(parts))
    assert names(long[: len(long) - 12])[:5] == every[:5]
    assert zlib.crc32(b"") == 0


def test_salvage_flipped_bits_in_one_member(spark):
    """A damaged archive of one member, as Spark's writer makes them, gives every intact record before the damage, and all
    records when only the closing checksum is wrong."""
    rows = [(i, f"http://a/{i}", "".join(chr(97 + (i * i * 31 + k * k * 7 + k * i) % 26) for k in range(1500)), "", "", "") for i in range(40)]
    records = warc_records(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    parts = [(r["record"] + "\r\n\r\n").encode() for r in records]
    whole = b"".join(parts)
    every, data = names(whole), gzip.compress(whole)
    assert len(every) == 40 and len(data) < 1 << 16
    checksum = bytearray(data)
    checksum[-6] ^= 1
    assert names(bytes(checksum)) == every
    for place in (len(data) // 4, len(data) // 2, len(data) * 9 // 10):
        broken = bytearray(data)
        broken[place] ^= 1 << 4
        # What stands before the damage inflates as it was, whatever comes after.
        intact = len(zlib.decompressobj(31).decompress(data[:place]))
        sure, size = 0, 0
        for p in parts:
            size += len(p)
            sure += size <= intact
        got = names(bytes(broken))
        assert sure > 0 and got[:sure] == every[:sure] and set(got) <= set(every)
        assert any(why and why.startswith("member broken") for _, _, why, _, _ in salvage(bytes(broken)))


def test_empty(spark):
    path = written(spark, [])
    assert read_warc(spark, path).count() == 0
