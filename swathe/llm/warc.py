"""Web archives: a writer of deduplicated WARC files and a sequential reader.

Every record is a gzip member of its own. The reader inflates step by step,
frames records by Content-Length and verifies the digests, so its memory
doesn't depend on the size of an archive; only payloads that are asked for are held,
one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, scratch_folder
from .words import text_slices

ARCHIVE_BYTES = 32 << 20
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
c = F.col


def _base32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def record(page: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, level: int = 4) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit, which holds no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page)), ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", _base32(digest)), ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest())),
        *([("WARC-Profile", REVISIT), ("WARC-Refers-To", _urn(refers_to))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block) + z.compress(b"\r\n\r\n") + z.flush()


class Damaged(ValueError):
    """An archive that breaks off, or whose lengths or digests don't fit."""


def _inflated(stream) -> Iterator[bytes | None]:
    """Pieces of the members' content; None ends a member."""
    z, data = zlib.decompressobj(31), b""
    begun = False
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            if begun:
                raise Damaged("the archive ends inside a member")
            return
        begun = True
        try:
            out = z.decompress(data, CHUNK)
        except zlib.error as e:
            raise Damaged(str(e)) from None
        data = z.unconsumed_tail
        if out:
            yield out
        if z.eof:
            data, z, begun = z.unused_data, zlib.decompressobj(31), False
            yield None


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def read_records(stream, payloads: bool = False) -> Iterator[dict]:
    """Records of an archive in order: page, url, type, length and digest of the full payload, what it refers to, and the payload if asked for.

    Raises ``Damaged`` when a length or a digest doesn't fit.
    """
    pieces = _inflated(stream)
    for piece in pieces:
        if piece is None:
            continue
        held = bytearray(piece)

        def more(held=held) -> bool:
            nxt = next(pieces, None)
            held.extend(nxt or b"")
            return nxt is not None

        def until_blank(held=held, more=more, start: int = 0) -> int:
            while (end := held.find(b"\r\n\r\n", start)) < 0:
                if not more():
                    raise Damaged("a head without an end")
            return end

        end = until_blank()
        warc = _fields(bytes(held[:end]))
        left = int(warc["content-length"])
        del held[: end + 4]
        end = until_blank()
        http = _fields(bytes(held[:end]))
        block, payload, kept, size = hashlib.sha1(held[: end + 4]), hashlib.sha1(), [], 0
        left -= end + 4
        del held[: end + 4]
        while left:
            if not held and not more():
                raise Damaged("a block shorter than its length")
            part = bytes(held[:left])
            del held[: len(part)]
            left, size = left - len(part), size + len(part)
            block.update(part), payload.update(part)
            if payloads:
                kept.append(part)
        while len(held) < 4 and more():
            pass
        if held != b"\r\n\r\n" or more():
            raise Damaged("a member that goes on behind its record")
        revisit = warc["warc-type"] == "revisit"
        if _base32(block.digest()) != warc["warc-block-digest"] or not revisit and _base32(payload.digest()) != warc["warc-payload-digest"]:
            raise Damaged(f"a wrong digest in {warc['warc-record-id']}")
        yield {
            "page_id": _page(warc["warc-record-id"]), "url": warc["warc-target-uri"], "payload_bytes": int(http["content-length"]) if revisit else size,
            "payload_digest": base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex(), "record_type": warc["warc-type"],
            "refers_to": _page(warc.get("warc-refers-to")), "payload": b"".join(kept) if payloads and not revisit else None,
        }


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") and not path.startswith("file:/") else path.replace("file:/", "file:///", 1))


def _writing(folder: str):
    def run(batches):
        system, base = _system(folder)
        out, path, size, n = None, None, 0, 0
        done = []
        for batch in batches:
            for part in text_slices(batch, "html"):
                for page, url, html, digest, refers in zip(*(part.column(x).to_pylist() for x in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    if out is None:
                        path, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(path, compression=None)
                    member = record(page, url, (html or "").encode(), bytes.fromhex(digest), refers)
                    out.write(member)
                    size, n = size + len(member), n + 1
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        done.append((path, n))
                        out = None
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, smallest: int = 1000) -> DataFrame:
    """Writes one record per row of ``pages`` (page_id long, url, html) into ``folder``; returns (path, records).

    Of pages with equal payloads of at least ``smallest`` bytes the one with
    the largest page_id is written as response and the others as revisits of it. A null html is an empty
    payload; a row without page_id can be a revisit, never what others refer to; repeated rows are all
    written. The result lists only files of tasks that ended, so
    what a lost task has left behind is never read.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(c("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    groups = rows.where(c("size") >= smallest).groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    told = rows.join(groups, ["digest", "size"], "left")
    refers = F.when(c("last").isNotNull() & ~c("page_id").eqNullSafe(c("last")), c("last"))
    system, base = _system(folder)
    system.create_dir(base, recursive=True)
    return cut(told.select("page_id", "url", "html", "digest", refers.alias("refers_to")).mapInArrow(_writing(folder), "path string, records long"), "archives")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _reading(folder: str, payloads: bool):
    def run(batches):
        system, _ = _system(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream, payloads):
                        rows.append(r)
                        size += 200 + len(r["payload"] or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the archives listed in ``archives`` (path), read sequentially, one archive at a time per task."""
    n, cores = archives.count(), archives.sparkSession.sparkContext.defaultParallelism
    dealt = archives.select("path").repartition(max(1, min(n, cores), n // 8), c("path"))  # paths are too small for adaptive execution to tell the work behind them
    return dealt.mapInArrow(_reading(folder, payloads), RECORD)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages into a new folder of archives and reads them back."""
    folder = folder or os.path.join(scratch_folder(pages.sparkSession), f"warc-{uuid.uuid4().hex}")
    return read_archives(write_archives(pages, folder), folder)
