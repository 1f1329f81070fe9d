"""WARC archives: writing and sequential reading (operator 7).

An archive is a series of gzip members, one for each record. Writing gives rows of
(archive, segment, content), where each content is a whole number of members and so a
WARC file of its own; the segments of an archive in their order are the archive. The
same reader takes files that ``spark.read.format("binaryFile")`` has read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, materialize, text_slices

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SEGMENT = 1 << 20
_FEED = 1 << 14
_SPACE = uuid.UUID("5b0f4f1e-6f0c-5a39-9a53-3a1d0e8a4c11")


def _base32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member. A revisit holds the HTTP head only, which still tells the payload's length."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    clean = "".join(c if c > " " and c != "\x7f" else "%20" for c in url or "urn:none")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{refers_to}')}>"), ("X-Refers-To-Page", str(refers_to))] if revisit else []),
        *([("X-Page-ID", str(page_id))] if page_id is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def _parsed(whole: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Fields (names in lower case), block and what is wrong of an unpacked record."""
    cut = whole.find(b"\r\n\r\n")
    lines = whole[: max(cut, 0)].decode("utf-8", "replace").split("\r\n")
    if cut < 0 or not lines[0].startswith("WARC/"):
        return {}, b"", "no WARC record"
    fields: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded field
            fields[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            fields[last] = value.strip()
    size = fields.get("content-length", "")
    if not size.isascii() or not size.isdigit() or whole[cut + 4 + int(size) :].strip(b"\r\n") or len(whole) < cut + 4 + int(size):
        return fields, b"", "the record's length is not its Content-Length"
    block = whole[cut + 4 : cut + 4 + int(size)]
    if not _matches(fields.get("warc-block-digest", ""), block):
        return fields, block, "the block does not match its digest"
    return fields, block, None


def _matches(digest: str, data: bytes) -> bool:
    """Whether a labelled digest, in base 32 or hexadecimal, is that of ``data``; one by an unknown algorithm isn't tested."""
    name, _, value = digest.partition(":")
    name = name.strip().lower().replace("-", "")
    if not value or name not in ("md5", "sha1", "sha256", "sha512"):
        return True
    raw = hashlib.new(name, data).digest()
    return value.strip().lower() == raw.hex() or value.strip().upper().rstrip("=") == _base32(raw).rstrip("=")


def _stream(chunks) -> Iterator[tuple[dict[str, str], bytes, str | None, int]]:
    """(fields, block, what is wrong, bytes read so far) of each record: one gzip member after the other, unpacked piece by piece."""
    source, view, at, before = iter(chunks), memoryview(b""), 0, 0

    def more() -> bool:
        nonlocal view, at, before
        while at >= len(view):
            before, at = before + len(view), 0
            try:
                view = memoryview(next(source))
            except StopIteration:
                view = memoryview(b"")
                return False
        return True

    while more():
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not more():
                raise ValueError("the archive ends inside a record")
            piece = view[at : at + _FEED]
            try:
                parts.append(member.decompress(piece))
            except zlib.error as e:
                raise ValueError(f"broken gzip member: {e}") from e
            at += len(piece) - len(member.unused_data)
        yield (*_parsed(b"".join(parts)), before + at)


def records(chunks) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, their names in lower case, and block) of each record of a stream of byte strings.

    Content-Length frames the block. Raises ValueError at a broken member, frame or digest.
    """
    for fields, block, error, _ in _stream(chunks):
        if error:
            raise ValueError(error)
        yield fields, block


def _salvaged(content: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(fields, block, what is wrong) of each record of an archive; behind a broken member, reading goes on at the next one that unpacks."""
    start, lost = 0, False
    while start < len(content):
        used = 0
        try:
            for fields, block, error, used in _stream([memoryview(content)[start:]]):
                lost = False
                yield fields, block, error
            return
        except ValueError as e:
            if not lost or used:
                yield {}, b"", str(e)
            lost = True
        start = content.find(b"\x1f\x8b\x08", start + used + 1)
        if start < 0:
            return


def mark_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0, most_groups: int = 200_000) -> DataFrame:
    """``pages`` with ``payload`` (binary), ``payload_sha1`` (hex) and ``refers_to``: the smallest id with an equal payload, null for that page itself.

    Payloads under ``least_bytes`` never refer. Rows that repeat the smallest id are all
    responses. Null ids come last: they refer to any other page with the payload. Only ids and digests are grouped;
    up to ``most_groups`` groups of equal payloads are broadcast to the pages, by their counted number. More of them
    are first brought to the ids of their pages, and join the payloads by id and digest, so that no common payload gathers in a task.
    """
    first_id, sha1, n, own = fresh(pages, "first_id", "first_sha1", "group_rows", "group_id")
    sized = pages.withColumn("payload", F.encode(F.coalesce(column(html_col), F.lit("")), "UTF-8")).withColumn("payload_sha1", F.sha1("payload"))
    ids = sized.select(column(id_col).alias(own), F.col("payload_sha1").alias(sha1))
    groups = materialize(ids.groupBy(sha1).agg(F.min(own).alias(first_id), F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).drop(n), "groups")
    same = F.col("payload_sha1") == F.col(sha1)
    if groups.count() <= most_groups:
        joined = sized.join(F.broadcast(groups), same, "left")
    else:
        named = ids.distinct().join(groups, sha1)
        joined = sized.join(named, same & column(id_col).eqNullSafe(F.col(own)), "left").drop(own)
    far = (F.length("payload") >= least_bytes) & ~F.col(first_id).eqNullSafe(column(id_col))
    return joined.withColumn("refers_to", F.when(far, F.col(first_id))).drop(first_id, sha1)


def write_segments(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (archive, segment, content) for pages that :func:`mark_revisits` has marked; each task writes an archive of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, segment, members, size = f"part-{TaskContext.get().partitionId():05d}.warc.gz", 0, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([segment], pa.int64()), pa.array([b"".join(members)], pa.binary())], names=["archive", "segment", "content"])

        for batch in text_slices(batches, 2, 1 << 22):
            for page_id, url, payload, sha1, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                members.append(_record(page_id, url, payload, _base32(bytes.fromhex(sha1)), refers))
                size += len(members[-1])
                if size >= _SEGMENT:
                    yield flush()
                    segment, members, size = segment + 1, [], 0
        if members:
            yield flush()

    return pages.select(id_col, url_col, "payload", "payload_sha1", "refers_to").mapInArrow(run, "archive string, segment long, content binary")


def read_records(files: DataFrame, content_col: str = "content", with_payload: bool = False) -> DataFrame:
    """One row for each response and revisit of WARC files (a binary column): page_id, url, payload_bytes, payload_digest, record_type, refers_to, error.

    ``error`` tells what is wrong with a record, else it is null: a block or payload that does not match its digest, a
    frame that does not match its Content-Length, a member that does not unpack (the other columns may be null then). Damage
    never ends the job. Fields are read whatever the case of their names; a block without an HTTP head is all payload;
    where no SHA-1 digest of the payload is given, it is computed. Null or empty contents hold no record.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def number(text: str | None) -> int | None:
        return int(text) if text and text.lstrip("-").isascii() and text.lstrip("-").isdigit() else None

    def row(fields: dict[str, str], block: bytes, error: str | None) -> tuple:
        kind = fields.get("warc-type", "").lower() or None
        cut = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[: max(cut, 0)].decode("latin-1").split("\r\n")[1:])}
        payload = block[cut + 4 :] if cut >= 0 else b"" if block.startswith(b"HTTP/") else block
        given = fields.get("warc-payload-digest", "")
        if not error and kind != "revisit" and not _matches(given, payload):
            error = "the payload does not match its digest"
        digest = given[5:].strip() if given[:5].lower() == "sha1:" else None if kind == "revisit" or error else _base32(hashlib.sha1(payload).digest())
        size = number(http.get("content-length")) if kind == "revisit" else None if error else len(payload)
        return (number(fields.get("x-page-id")), fields.get("warc-target-uri"), size, digest, kind, number(fields.get("x-refers-to-page")), error) + ((None if kind == "revisit" or error else payload,) if with_payload else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for fields, block, error in _salvaged(content.as_py() or b""):
                    if error or fields.get("warc-type", "").lower() in ("response", "revisit"):
                        out.append(row(fields, block, error))
                        size += len(block)
                    if len(out) == 1000 or size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds, strict=True)], names=names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds, strict=True)], names=names)

    return files.select(column(content_col)).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, ["long", "string", "long", "string", "string", "long", "string", "binary"])))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes an archive record for every page to the shared folder and reads the archives back: a row for each page.

    A missing page is an empty payload; long pages are kept whole; repeated rows are records of their own; an empty
    table gives an empty one; other columns are not read, whatever their names.
    """
    narrow = pages.select("page_id", "url", "html")
    return read_records(materialize(write_segments(mark_revisits(narrow, least_bytes=least_bytes)), "warc"))
