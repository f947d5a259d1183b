"""Web archives (WARC) as Zstandard files with a shared dictionary: a writer, and a reader that checks what it reads.

An archive is a file of Zstandard frames, one for each record, so that every record can be decoded alone. Its dictionary
stands before them in a skippable frame. Pages with equal payloads are stored once: the first of them is a response, the
others revisit it.

Writing: one pass finds the digests that repeat, with their smallest id. The pages are then compressed before anything is
shuffled; compressed records meet the repeated digests in a join. Digests with more than a ten-thousandth of all pages are
fewer than ten thousand: they are broadcast and their records are dealt freely. Each task joins records to archives of a bounded size.
Archives are written by Spark's own text writer, to any file system that Spark can write: a value is a whole archive, and
the "line end" is an empty skippable frame, which every reader of the format passes over.

Reading: archives are whole files of bounded size. The reader takes the dictionary from the leading frame, steps from
frame to frame by their block headers, and checks frame checksums, headers, lengths and digests.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import freed_shuffles, removed_at_end, shared_folder, stored, whole_text

#: Fixed values of the formats.
FRAME, DICTIONARY_FRAME, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
DICTIONARY = b"\x37\xa4\x30\xec"
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "1970-01-01T00:00:00Z"
NO_URL = "about:blank"
URI_SAFE = "!#$%&'()*+,/:;=?@[]~"

#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
#: An archive ends with the record that makes it longer than this.
ARCHIVE_BYTES = 16 << 20
#: The dictionary is fitted on the beginnings of so many pages; it changes only how small archives are.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 8192, 32 << 10
LEVEL = 3
#: Digests with more than this part of all pages are broadcast.
HOT_PART = 10_000


def fitted_dictionary(payloads: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """A trained dictionary; None where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, payloads).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


def compressor(dictionary: bytes | None, level: int = LEVEL) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if held:
        held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=True, write_content_size=True)


def leading_frame(dictionary: bytes | None) -> bytes:
    """The skippable frame with the compressed dictionary."""
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed


def record_id(page: str | None, digest: str) -> str:
    return f"<urn:x-page:{quote(page, safe='')}>" if page is not None else f"<urn:x-no-page:{digest}>"


def page_of(record: str) -> str | None:
    return unquote(record[len("<urn:x-page:") : -1]) if record.startswith("<urn:x-page:") else None


def record_bytes(page: str | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: str | None = None) -> bytes:
    """One record. A revisit has no payload: its block ends with the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=URI_SAFE) if url else NO_URL}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (len(payload) if refers_to is None else 0)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + (payload if refers_to is None else b"") + b"\r\n\r\n"


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its header and its blocks' headers."""
    descriptor = data[at + 4]
    single, checksum = descriptor >> 5 & 1, descriptor >> 2 & 1
    p = at + 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + (single, 2, 4, 8)[descriptor >> 6]
    while True:
        head = int.from_bytes(data[p : p + 3], "little")
        if p + 3 > len(data) or head >> 1 & 3 == 3:
            raise ValueError("a block header is cut short or not valid")
        p += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    p += 4 * checksum
    if p > len(data):
        raise ValueError("the frame is cut short")
    return p


def headers_of(lines: bytes) -> dict[str, str]:
    """Named fields by lower-case name; continued lines belong to the field before."""
    out, name = {}, None
    for line in lines.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode()
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:80]!r}")
        name = name.strip().decode().lower()
        out[name] = value.strip().decode()
    return out


def parsed(record: bytes) -> dict:
    """The checked fields of a record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Payload and digest are checked where the record holds the payload; ValueError says what is wrong.
    """
    head, blank, block = record.partition(b"\r\n\r\n")
    version, _, fields = head.partition(b"\r\n")
    if not blank or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"not a record of WARC 1.0 or 1.1: {version[:40]!r}")
    h = headers_of(fields)
    if missing := [m for m in MANDATORY if m not in h]:
        raise ValueError(f"missing {', '.join(missing)}")
    if not h["content-length"].isdigit():
        raise ValueError("Content-Length is not a number")
    length = int(h["content-length"])
    if len(block) != length + 4 or block[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {length}, the block has {len(block) - 4} bytes")
    kind, payload, size = h["warc-type"], block[:length], length
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind in ("response", "revisit") and h.get("content-type", "").startswith("application/http"):
        http, blank, payload = payload.partition(b"\r\n\r\n")
        status, _, rest = http.partition(b"\r\n")
        if not blank or not status.startswith(b"HTTP/"):
            raise ValueError("the block doesn't begin with HTTP headers")
        stated = headers_of(rest).get("content-length") if rest else None
        size = int(stated) if stated is not None and stated.isdigit() else len(payload)
    if kind == "revisit":
        if payload:
            raise ValueError("a revisit holds a payload")
        if "warc-refers-to" not in h or digest is None:
            raise ValueError("a revisit names no record or no digest")
        payload = None
    else:
        if size != len(payload):
            raise ValueError(f"HTTP's Content-Length is {size}, the payload has {len(payload)} bytes")
        found = hashlib.sha256(payload).hexdigest()
        if digest not in (None, found):
            raise ValueError("the payload's digest differs")
        digest = found
    url = h.get("warc-target-uri")
    refers = page_of(h["warc-refers-to"]) if kind == "revisit" else None
    return {"page_id": page_of(h["warc-record-id"]), "url": None if url == NO_URL else url, "record_type": kind, "refers_to": refers, "payload_bytes": size, "payload_digest": digest, "payload": payload}


def records_of(data: bytes) -> Iterator[tuple[int, bytes | ValueError]]:
    """(offset, record) of each frame of an archive; what can't be decoded is given as the error.

    After an error in a frame's layout nothing more can be found.
    """
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        dictionary = bytes(view[8 : 8 + struct.unpack_from("<I", data, 4)[0]])
        if dictionary[:4] != DICTIONARY:
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while at < len(data):
        try:
            magic, size = struct.unpack_from("<II", data.ljust(at + 8, b"\0") if at + 8 > len(data) else data, at)
            if magic in SKIPPABLE:
                if at + 8 + size > len(data):
                    raise ValueError("a skippable frame is cut short")
                at += 8 + size
                continue
            if magic != FRAME:
                raise ValueError("no Zstandard frame")
            end = frame_end(view, at)
        except (ValueError, IndexError) as wrong:
            yield at, ValueError(str(wrong))
            return
        try:
            yield at, decoder.decompressobj().decompress(view[at:end])
        except zstandard.ZstdError as wrong:
            yield at, ValueError(str(wrong))
        at = end


def payloads(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes and payload_digest of every page."""
    payload = whole_text(html_col).cast("binary")
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    return d.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per page to archives under ``path`` (which must not exist).

    Of pages with equal payloads of at least REVISIT_BYTES those with the smallest id are responses and the others revisit
    it; all others are responses. A null payload is empty; a null url is written as ``about:blank``; a page with a null id
    is a revisit only where another page of its group has an id. Repeated rows are written as often as they occur.
    """
    spark = pages.sparkSession
    d = payloads(pages, id_col, url_col, html_col)
    sample = d.select(F.substring("payload", 1, SAMPLE_CHARS).alias("p")).limit(SAMPLE_PAGES).collect()
    dictionary = fitted_dictionary([bytes(r["p"]) for r in sample if r["p"]])
    large = F.col("payload_bytes") >= REVISIT_BYTES
    groups = d.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = stored(groups.where((F.col("n") > 1) & F.col("first").isNotNull()))
    limit = pages.count() // HOT_PART
    hot = groups.where(F.col("n") > limit).select("payload_digest", F.col("first").alias("hot_first"))
    other = groups.where(F.col("n") <= limit).select(F.col("payload_digest").alias("key"), "first")
    kind = d.schema["page_id"].dataType.simpleString()

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = compressor(dictionary).compress
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("name", "url", "payload_digest", "payload_bytes", "payload")))
            frames = pa.array([pack(record_bytes(p, u, g, n, x)) for p, u, g, n, x in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "url", "payload_bytes", "payload_digest")] + [frames], ["page_id", "url", "payload_bytes", "payload_digest", "frame"])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, parts, size = compressor(dictionary).compress, [], 0
        for batch in batches:
            for p, u, n, g, frame, first in zip(*(c.to_pylist() for c in batch.columns)):
                parts.append(frame if first is None else pack(record_bytes(p, u, g, n, None, first)))
                size += len(parts[-1])
                if size > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([leading_frame(dictionary) + b"".join(parts)], pa.binary())], ["archive"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([leading_frame(dictionary) + b"".join(parts)], pa.binary())], ["archive"])

    frames = d.withColumn("name", F.col("page_id").cast("string")).mapInArrow(compress, f"page_id {kind}, url string, payload_bytes long, payload_digest string, frame binary")
    frames = frames.join(F.broadcast(hot), "payload_digest", "left")
    alone = ~large | F.col("hot_first").isNotNull()
    frames = frames.withColumn("key", F.when(alone, F.concat(F.lit("-"), F.monotonically_increasing_id())).otherwise(F.col("payload_digest")))
    first = F.coalesce("hot_first", "first")
    refers_to = F.when(~first.eqNullSafe(F.col("page_id")), first).cast("string")
    joined = frames.join(other, "key", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "payload_bytes", "payload_digest", F.when(refers_to.isNull(), F.col("frame")).alias("frame"), refers_to.alias("refers_to"))
    archives = joined.mapInArrow(join_up, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, page_type: str = "string", keep_payload: bool = True, on_error: str = "fail") -> DataFrame:
    """A row per record of the archives under ``path``: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Revisits have no payload; their size and digest are those of the payload they refer to. A record that can't be decoded
    or doesn't check out fails the job with its archive and offset, or with ``on_error="keep"`` gives a row with nulls
    and the reason in the column ``error``. Frames of archives without a dictionary are read as well.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * keep_payload
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    limit = 4 << 20

    def table_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in [*names, "error"]], [*names, "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                place, rows, size = batch.column(0)[i].as_py(), [], 0
                for at, record in records_of(batch.column(1)[i].as_py()):
                    try:
                        if isinstance(record, ValueError):
                            raise record
                        row = parsed(record)
                    except (ValueError, UnicodeDecodeError) as wrong:
                        reason = f"{place}, byte {at}: {wrong}"
                        if on_error != "keep":
                            raise ValueError(reason) from None
                        row = {"error": reason}
                    rows.append(row)
                    size += 500 + len(row.get("payload") or b"") * keep_payload
                    if size > limit:
                        yield table_of(rows)
                        rows, size = [], 0
                if rows:
                    yield table_of(rows)

    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * keep_payload + ", error string"
    d = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
    typed: Column = lambda c: F.col(c).cast(page_type).alias(c)
    d = d.select(typed("page_id"), "url", "record_type", typed("refers_to"), *names[4:], "error")
    return d if on_error == "keep" else d.drop("error")


def archive_report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages to archives in the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Archives are removed as the session ends. An empty table gives no rows; further columns are not read. Nulls, ties and
    repeats are treated as ``write_archives`` says.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        write_archives(pages, path, id_col, url_col, html_col)
    removed_at_end(spark, path)
    found = read_archives(spark, path, pages.schema[id_col].dataType.simpleString(), keep_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
