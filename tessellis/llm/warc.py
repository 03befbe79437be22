"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame a record.

Archives travel as rows (path, content): what the writer makes is a table of such rows in the shared folder, and
what ``spark.read.format("binaryFile")`` gives for archives from elsewhere reads just as well. The reader takes the
dictionary from the first frame (itself compressed or not), finds the frames by their block headers, decodes one at
a time and checks each record: version line, header lines, lengths, block and payload digests. A record that fails
comes back with its ``error``; an archive that cannot be cut into frames gives one row with an error.

An archive is read as one value, so one of gigabytes must be cut into several files before. Page ids are whole numbers (long).

Cases: a null payload is empty, a null url is written as an empty target; rows that share a payload all revisit the
one with the smallest page id, and a null id is larger than any; rows that repeat that id are all responses; an
empty table makes no archive and gives no record; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellis.llm.common import spread_join, written

DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
DICT_BYTES, DICT_SAMPLES = 65_536, 400
ARCHIVE_BYTES = 8_000_000
RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, error string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def trained_dictionary(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", samples: int = DICT_SAMPLES, size: int = DICT_BYTES) -> bytes:
    """A dictionary from the payloads of ``samples`` page ids, chosen by hash, of at most ``size`` characters each; empty if there are too few."""
    full = pages.select(pages[id_col].alias("id"), pages[html_col].alias("html")).filter(F.col("id").isNotNull() & (F.length("html") > 0))
    ids = [r["id"] for r in full.select("id").orderBy(F.xxhash64("id"), "id").limit(samples).collect()]
    rows = full.filter(F.col("id").isin(ids)).groupBy("id").agg(F.min(F.substring("html", 1, size)).alias("t")).orderBy("id").collect() if ids else []
    try:
        return zstandard.train_dictionary(size, [r["t"].encode() for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    name = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{n}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {quote(url or '', safe=''':/?#[]@!$&'()*+,;=%-._~''')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers_to}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def marked_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to, revisit): which rows repeat the payload of a smaller page id."""
    html = F.coalesce(pages[html_col], F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    large = rows.filter(F.octet_length("html") >= least_bytes)
    first = written(large.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter(F.col("n") > 1), "repeated-payloads")
    joined = spread_join(rows, first, "sha1", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.octet_length("html") >= least_bytes)
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(rows: DataFrame, dictionary: bytes = b"", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, content) of the archives of (page_id, url, html, refers_to, revisit), each near ``archive_bytes``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        make = zstandard.ZstdCompressor(level=3, dict_data=kept, write_checksum=True, write_content_size=True)
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        lead = struct.pack("<II", DICT_MAGIC, len(packed)) + packed
        frames, size = [], 0
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(batch[c] for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                whole = lambda n: None if pd.isna(n) else int(n)
                frames.append(make.compress(_record(whole(page_id), url, html.encode(), whole(refers_to), bool(revisit))))
                size += len(frames[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"path": [f"{uuid.uuid4().hex}.warc.zst"], "content": [lead + b"".join(frames)]})
                    frames, size = [], 0
        if frames:
            yield pd.DataFrame({"path": [f"{uuid.uuid4().hex}.warc.zst"], "content": [lead + b"".join(frames)]})

    # 2**53 bounds what pandas holds without loss in a column with nulls: ids travel as text
    text = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"), "revisit")
    return text.mapInPandas(run, "path string, content binary")


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends: its header, then blocks up to the last, then the checksum if it has one."""
    head = bytes(data[at : at + 18])
    checksum = zstandard.get_frame_parameters(head).has_checksum
    at += zstandard.frame_header_size(head)
    while True:
        if at + 3 > len(data):
            raise ValueError("the archive ends within a frame")
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * checksum


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, each with the dictionary of the leading skippable frame."""
    data, at, make = memoryview(content), 0, None
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("the archive ends within a frame header")
        magic, size = struct.unpack("<II", data[at : at + 8])
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            body = bytes(data[at + 8 : at + 8 + size])
            if len(body) < size:
                raise ValueError("the archive ends within a skippable frame")
            if magic == DICT_MAGIC and at == 0:
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                make = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) if body else None
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame starts at byte {at}")
        make = make or zstandard.ZstdDecompressor()
        end = _frame_end(data, at)
        if end > len(data):
            raise ValueError("the archive ends within a frame")
        yield make.decompressobj().decompress(data[at:end])
        at = end


def _headers(data: bytes) -> tuple[str, dict[str, str], bytes]:
    head, gap, body = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = [line.split(":", 1) for line in lines]
    if not gap or any(len(p) < 2 for p in pairs):
        raise ValueError("malformed header")
    return first, {k.strip().lower(): v.strip() for k, v in pairs}, body


def parse_record(data: bytes) -> dict[str, object]:
    """The fields of one record; raises ValueError where it breaks the format."""
    first, head, body = _headers(data)
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    if not head.get("content-length", "").isdigit():
        raise ValueError("no Content-Length")
    length = int(head["content-length"])
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as Content-Length says")
    block = body[:length]
    if (digest := head.get("warc-block-digest")) and digest != f"sha1:{base32_sha1(block)}":
        raise ValueError("the block does not match its digest")
    kind = head.get("warc-type", "")
    _, http, payload = _headers(block)
    declared = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if declared is not None and declared != len(payload):
            raise ValueError("the payload is not as long as its Content-Length says")
        if digest and digest != base32_sha1(payload):
            raise ValueError("the payload does not match its digest")
    number = lambda name: int(head[name]) if name in head else None
    return {
        "page_id": number("x-page-id"), "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": number("x-refers-to-page-id"),
        "payload": payload if kind == "response" else None, "payload_bytes": declared if declared is not None else len(payload), "payload_digest": digest, "error": None,
    }


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of (path, content) rows, validated; see RECORDS for the columns."""
    names = [part.split()[0] for part in RECORDS.split(", ")]
    longs = ("page_id", "refers_to", "payload_bytes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = []
                try:
                    for data in frames(content):
                        try:
                            found.append(parse_record(data))
                        except ValueError as error:
                            found.append({"error": str(error)})
                        if not with_payload:
                            found[-1]["payload"] = None
                        if len(found) == 500:
                            yield _frame(found)
                            found = []
                except (ValueError, zstandard.ZstdError) as error:
                    found.append({"error": f"archive: {error}"})
                yield _frame(found)

    def _frame(found: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.array([r.get(c) for r in found], "Int64") if c in longs else pd.Series([r.get(c) for r in found], dtype="object") for c in names})

    return archives.select("content").mapInPandas(run, RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes a record for every page, reads the archives back, and returns what the records say."""
    archives = written(write_archives(marked_revisits(pages), trained_dictionary(pages)), "warc-archives")
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, unhex(sha1(b))::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY b) AS first_id FROM p
)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    substr(bits, i * 5 + 1, 1)::INT * 16 + substr(bits, i * 5 + 2, 1)::INT * 8 + substr(bits, i * 5 + 3, 1)::INT * 4
    + substr(bits, i * 5 + 4, 1)::INT * 2 + substr(bits, i * 5 + 5, 1)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to,
  NULL::VARCHAR AS error
FROM d
"""
