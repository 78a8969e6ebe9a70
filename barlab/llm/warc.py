"""WARC archives: a writer of gzip members and a splittable reader.

Every record is one gzip member. Tasks write one file each into a shared folder and report its name; only reported files
are read, so a retried task leaves no trace. The reader cuts files into byte ranges. A task looks for the gzip magic in
its range, takes a candidate for a record only if its bytes decode to a WARC header and the file's end or another member
follows it, and owns the records that start inside its range, reading past its end where the last one needs it. A payload
that is itself an archive of several members and that deflate stores as it is could be taken for records by a range that
begins inside it; texts in UTF-8 cannot hold the magic.

Of records with equal payloads of at least `least_bytes`, those with the smallest id are responses and the others
revisits, which carry the payload's digest and length but not the payload.

Defined cases: a null html is an empty payload; a null url has no target; a null page_id comes back as null and counts
as larger than all others; repeated rows are records of their own, of the same
type; an empty table gives no file and no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm import common as C

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
#: Header names of the format, fixed values.
ID, TYPE, URI, DIGEST, REFERS = "WARC-Record-ID", "WARC-Type", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLOCK = 1 << 20
SALTS = 32
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed."""
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"{TYPE}: {kind}", f"{ID}: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"{URI}: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url))
    if refers_to is not None:
        head += [f"{REFERS}: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"{DIGEST}: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _number(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").rpartition(":")[2]
    return int(text) if text else None


def parse_record(raw: bytes) -> tuple:
    """The columns of RECORDS."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields[TYPE] == "revisit"
    length = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    digest = fields[DIGEST].removeprefix("sha256:")
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"digest of record {fields[ID]} does not match")
    return _number(fields[ID]), fields.get(URI), length, digest, fields[TYPE], _number(fields.get(REFERS)), None if revisit else payload


def _write(folder: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        name, out, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for rows in batches:
            for page_id, url, html, digest, refers_to in zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = packer.compress(record_bytes(page_id, url, html.encode(), digest, refers_to)) + packer.flush()
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(name, compression=None)  # members are packed one by one
                out.write(raw)
                size, n = size + len(raw), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(name)]), pa.array([size]), pa.array([n])], names=["file", "bytes", "records"])

    return write


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 100, level: int = 6) -> DataFrame:
    """Write one record per row of (page_id, url, html); returns (file, bytes, records) of the written files."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    narrow = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    # only payloads that occur more than once are looked up
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.col("first"))
    # a payload of many pages is dealt by several keys
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    typed = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return C.checkpointed(typed.mapInArrow(_write(folder, level), "file string, bytes long, records long"))


def _follows(file, size: int, at: int, known: bytes) -> bool:
    """Whether the file ends at a place or a gzip member starts there."""
    if at < size and len(known) < len(MAGIC):
        file.seek(at)
        known = file.read(len(MAGIC))
    return at >= size or known.startswith(MAGIC)


def records_in(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The decoded members that start in [start, end) of an open file."""
    window, base = b"", start  # bytes [base, base + len(window)) of the file

    def more() -> bool:
        nonlocal window
        at = base + len(window)
        if at >= size:
            return False
        file.seek(at)
        window += file.read(min(_BLOCK, size - at))
        return True

    at = start
    while at < end:
        i = window.find(MAGIC, at - base)
        if i < 0 or base + i >= end:
            if base + len(window) < min(end + len(MAGIC) - 1, size):
                keep = max(at - base, len(window) - len(MAGIC) + 1)
                at = max(at, base + keep)
                window, base = window[keep:], base + keep
                more()
                continue
            return
        at = base + i
        window, base = window[i:], at
        decoder, out, used, valid = zlib.decompressobj(31), [], 0, None
        try:
            while not decoder.eof:
                if used >= len(window) and not more():
                    break
                out.append(decoder.decompress(window[used:]))
                used = len(window)
                if valid is None and sum(map(len, out)) >= 7:
                    valid = b"".join(out).startswith(b"WARC/1.")
                    if not valid:
                        break
        except zlib.error:
            valid = False
        raw = b"".join(out) if valid and decoder.eof else b""
        after = at + used - len(decoder.unused_data)
        if b"\r\n\r\n" in raw and _follows(file, size, after, decoder.unused_data):
            yield raw
            at = after
        else:
            at += 1


def _read(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        if not with_payload:
            types, names = types[:-1], names[:-1]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for splits in batches:
            for s in splits.to_pylist():
                with fs.open_input_file(f"{root}/{s['file']}") as f:
                    rows, held = [], 0
                    for raw in records_in(f, s["bytes"], s["start"], s["stop"]):
                        rows.append(parse_record(raw)[: len(types)])
                        held += len(raw) if with_payload else 500
                        if held > 16 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    yield batch(rows)

    return read


def read_warc(files: DataFrame, folder: str, split_bytes: int = 4 << 20, with_payload: bool = True) -> DataFrame:
    """The records of the (file, bytes) rows in a folder; see RECORDS for the columns."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = files.select("file", "bytes", start.alias("start")).withColumn("stop", F.least(F.col("start") + split_bytes, F.col("bytes")))
    schema = RECORDS if with_payload else RECORDS.removesuffix(", payload binary")
    return splits.repartition("file", "start").mapInArrow(_read(folder, with_payload), schema)


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write the pages to a new folder in the shared folder and read them back."""
    folder = f"{C.shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_warc(write_warc(pages, folder), folder, with_payload=with_payload)
