"""WARC: archives written with segmented, chunked records, and read back by reassembling segments.

A page is a ``response`` record whose block is an HTTP response in chunked transfer framing; a block
beyond ``SEGMENT_BYTES`` goes on in ``continuation`` records. Pages with equal payloads of at least
``REVISIT_BYTES`` are ``revisit`` records of the one with the largest page_id. Spark's text writer compresses the
files; a row of it is a stretch of records, each ended by the two line breaks of the format, and files are bounded by
bytes, however large or many the pages.

Reading parses files by their Content-Length fields; segments are grouped by origin id, ordered by
segment number, checked against the total length and the payload digest, and unframed. Only segments
carry payload through that shuffle, a group is one record, and salting deals a payload that many pages
share over ``SALTS`` tasks.

Defined cases: a null html is an empty payload; a null url is an empty target; a null page_id is kept as
null and is never the largest; rows that repeat the largest page_id of a payload are all responses; an
empty table gives no records; columns other than page_id, url and html are ignored. A block whose
segments, lengths or digest do not agree raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelens.llm.session import parts_for, scratch_path, worker_imports
from cuelens.llm.textkit import slices

REVISIT_BYTES = 1000
CHUNK_BYTES = 8 << 10
SEGMENT_BYTES = 32 << 10
SALTS = 16
#: Raw bytes of records that are written as one row, about, and rows in a file at most: a file is read as one value and must fit a task's memory.
ROW_BYTES, FILE_ROWS = 4 << 20, 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_FIELDS = "page_id long, url string, payload string, digest string, bytes long, first_id long, first_url string"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of ``payload``."""
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for i in range(0, len(payload), size) if (x := payload[i : i + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The payload that chunked framing holds; chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        stop = data.find(b"\r\n", at)
        if stop < 0:
            raise ValueError("a chunk has no size line")
        size = int(data[at:stop].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        if data[stop + 2 + size : stop + 4 + size] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        parts.append(data[stop + 2 : stop + 2 + size])
        at = stop + 4 + size


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def _line(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def _write(row_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        def row(out: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(out)], pa.binary())], ["value"])

        out: list[bytes] = []
        held = 0
        for batch in slices(batches, "payload", row_bytes):
            for r in batch.to_pylist():
                if held >= row_bytes:
                    yield row(out)
                    out, held = [], 0
                payload, origin = r["payload"].encode(), f"<urn:uuid:{uuid.uuid4()}>"
                digest = "sha1:" + base64.b32encode(bytes.fromhex(r["digest"])).decode()
                common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _line(r["url"]))]
                about = [("WARC-Payload-Digest", digest), ("WARC-Payload-Length", str(len(payload)))] + ([] if r["page_id"] is None else [("WARC-Page-ID", str(r["page_id"]))])
                if r["first_id"] is not None and r["page_id"] != r["first_id"]:
                    refers = [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _line(r["first_url"])), ("WARC-Refers-To-Page-ID", str(r["first_id"]))]
                    out.append(_record([("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *common, *about, *refers], b""))
                    held += len(out[-1])
                    continue
                block = _HTTP + chunked(payload)
                parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
                kind = [("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, *about, ("Content-Type", "application/http; msgtype=response")]
                out.append(_record(kind + ([("WARC-Segment-Number", "1")] if len(parts) > 1 else []), parts[0]))
                held += len(out[-1])
                for k, part in enumerate(parts[1:], 2):
                    if held >= row_bytes:
                        yield row(out)
                        out, held = [], 0
                    more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *common, ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(k))]
                    out.append(_record(more + ([("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []), part))
                    held += len(out[-1])
        if out:
            yield row(out)

    return run


def write_warc(pages: DataFrame, path: str) -> None:
    """Write an archive of ``pages`` (page_id, url, html) as compressed WARC files under ``path``."""
    worker_imports(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.select("*", F.sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    shared = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes").agg(F.max("page_id").alias("first_id"), F.max_by("url", "page_id").alias("first_url"), F.count("*").alias("n"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")
    shared = shared.where("n > 1").select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "first_id", "first_url", salts)
    salted = rows.select("*", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    joined = salted.join(shared, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")) & (F.col("salt") == F.col("s")), "left")
    fields = [x.split()[0] for x in _FIELDS.split(", ")]
    records = joined.select(*fields).mapInArrow(_write(ROW_BYTES), "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, names in lower case, and block of each record of a file, compressed in any number of members or plain."""
    buffer, raw, at, gz = b"", data, 0, data[:2] == b"\x1f\x8b"
    unpack = zlib.decompressobj(31) if gz else None

    def more() -> bool:
        nonlocal buffer, raw, at, unpack
        if unpack is None:
            if not raw:
                return False
            buffer, raw, at = buffer[at:] + raw, b"", 0
            return True
        while raw:
            got = unpack.decompress(raw, 1 << 20)
            raw = unpack.unconsumed_tail or unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)
            if got:
                buffer, at = buffer[at:] + got, 0
                return True
        if rest := unpack.flush():  # what was unpacked but beyond the last call's measure
            buffer, at = buffer[at:] + rest, 0
            return True
        return False

    while True:
        while (stop := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if buffer[at:].strip():
                    raise ValueError("a record has no end of its fields")
                return
        head = buffer[at:stop].decode().split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError("a record does not begin with its version")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(fields["content-length"])
        at = stop + 4
        while len(buffer) - at < size + 4:
            if not more():
                break
        if len(buffer) - at < size or buffer[at + size : at + size + 4].strip():
            raise ValueError("a block is not as long as its Content-Length")
        yield fields, buffer[at : at + size]
        at += size + 4


_PARSED = "origin string, segment int, total long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary"


def _result(fields: dict[str, str], block: bytes | None) -> dict:
    """Of a whole record: its page and payload; the payload must have the digest and length the fields say."""
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(fields["warc-payload-length"])
    if block is not None:
        _check(block, digest, size)
    page, first = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
    return {
        "page_id": None if page is None else int(page), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"],
        "refers_to": None if first is None else int(first),
    }


def _check(block: bytes, digest: str, size: int) -> None:
    payload = unchunked(block[block.index(b"\r\n\r\n") + 4 :])
    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload does not have its digest and length")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())]
    )
    for batch in batches:
        for data in batch.column("content"):
            rows, held = [], 0
            for fields, block in records(data.as_py()):
                number = int(fields.get("warc-segment-number", 0))
                if fields["warc-type"] == "continuation":
                    total = fields.get("warc-segment-total-length")
                    rows.append({"origin": fields["warc-segment-origin-id"], "segment": number, "total": None if total is None else int(total), "block": block})
                elif number:
                    rows.append({"origin": fields["warc-record-id"], "segment": 1, "block": block} | _result(fields, None))
                else:
                    rows.append({"origin": fields["warc-record-id"], "segment": 0} | _result(fields, block if fields["warc-type"] == "response" else None))
                held += len(block)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


_OUT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by origin and segment: whole records pass, segments are joined and checked."""
    group: list[dict] = []

    def close() -> dict:
        first, last = group[0], group[-1]
        block = b"".join(x["block"] for x in group)
        if [x["segment"] for x in group] != list(range(1, len(group) + 1)) or last["total"] != len(block):
            raise ValueError(f"the segments of {first['origin']} do not make its total length")
        _check(block, first["payload_digest"], first["payload_bytes"])
        return {k: first[k] for k in _OUT}

    schema = None
    for batch in slices(batches, "block", ROW_BYTES):
        schema = pa.schema([batch.schema.field(k) for k in _OUT])
        out = []
        for row in batch.to_pylist():
            if group and row["origin"] != group[0]["origin"]:
                out.append(close())
                group = []
            if row["segment"]:
                group.append(row)
            else:
                out.append({k: row[k] for k in _OUT})
        yield pa.RecordBatch.from_pylist(out, schema)
    if group:
        yield pa.RecordBatch.from_pylist([close()], schema)


def read_warc(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page archived under ``path``."""
    worker_imports(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parsed = files.mapInArrow(_parse, _PARSED)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = parsed.repartition(parts, "origin").sortWithinPartitions("origin", "segment")
    return grouped.mapInArrow(_reassemble, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_digest(pages: DataFrame) -> DataFrame:
    """Write an archive of ``pages``, read it back: one row a page."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path, parts_for(pages, 16 << 20, least=int(spark.conf.get("spark.sql.shuffle.partitions"))))
