"""WARC archives: writing with segments, chunked framing and revisits, and reading back whole payloads.

Writing: a payload's digest decides the page that answers for all that are equal to it; the others become revisits.
Records are rows, and Spark's text sink writes their bytes with the blank line that ends a record as its line separator, so
the archives (gzip, one file a task) are committed as any table is, in any file system that Spark writes to.

Reading: Spark's text source with the same separator streams an archive as pieces in order; a task joins pieces to
records by their Content-Length and holds one record. Whole records are decoded where they are read. Segments alone are
shuffled: grouped by the origin's record id, in order of segment number, one payload at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilesmith.llm.common import released, small, written

BLANK = "\r\n\r\n"
END = BLANK.encode()
#: Longer blocks are cut into segments.
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
#: Bytes of rows that a mapper hands on at once.
BATCH_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in HTTP's chunked framing."""
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over. ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]+)\s*(;.*)?", body[at:end], re.S) if end >= 0 else None
        if not size:
            raise ValueError("chunk without a size")
        n, at = int(size[1], 16), end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk cut off")
        out.append(body[at : at + n])
        at += n + 2


def entity(block: bytes) -> bytes:
    """The payload of an HTTP response: what follows its header, out of its framing."""
    header, found, body = block.partition(END)
    if not found:
        raise ValueError("no end of the HTTP header")
    return unchunked(body) if re.search(rb"\r\ntransfer-encoding:[ \t]*chunked[ \t]*(\r\n|$)", header, re.I) else body


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record but for the blank line that ends it. Headers without a value are left out."""
    lines = [f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None]
    return b"WARC/1.1\r\n" + "".join(lines).encode() + b"\r\n" + block


def _uri(url: str | None) -> str | None:
    """The URL with control characters and blanks escaped, which would break a header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda x: quote(x[0]), url) if url is not None else None


def _records(job: str, date: str, segment_bytes: int, chunk_bytes: int):
    """Mapper of (page_id, url, payload, revisits, url of the page that answers) to records."""

    def of_page(new_id, page_id, url, payload: bytes, revisits: bool, first_url) -> Iterator[bytes]:
        common = [("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http; msgtype=response")]
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
        if revisits:
            yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", new_id()), ("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _uri(first_url)), ("WARC-Refers-To-Date", date), *common], http)
            return
        block, origin = http + chunked(payload, chunk_bytes), new_id()
        cuts = range(0, len(block), segment_bytes)
        if len(cuts) == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, ("WARC-Block-Digest", f"sha1:{digest_of(block)}")], block)
            return
        for n, at in enumerate(cuts, 1):
            piece = block[at : at + segment_bytes]
            kind = [("WARC-Type", "response"), ("WARC-Record-ID", origin), *common] if n == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", new_id()), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Segment-Origin-ID", origin)]
            total = len(block) if n == len(cuts) else None
            yield _record([*kind, ("WARC-Block-Digest", f"sha1:{digest_of(piece)}"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], piece)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0

        def new_id() -> str:  # the same in each attempt of a task
            nonlocal made
            made += 1
            return f"<urn:uuid:{uuid.uuid5(uuid.UUID(job), f'{part}-{made}')}>"

        part = TaskContext.get().partitionId()
        held = [_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", new_id()), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")]
        size = 0
        for batch in batches:
            for row in zip(*batch.columns):
                for record in of_page(new_id, *(x.as_py() for x in row)):
                    held.append(record)
                    size += len(record)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    return run


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str | None = None, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES
) -> None:
    """A record for each page in gzip archives under path, a folder that must not exist yet.

    Of equal payloads of at least ``least`` bytes the page of the smallest id is a response, the others are revisits
    of it. Rows that share that id and payload are responses all; a null id is larger than any. A null payload is empty, a null
    url gives no target URI. An empty table gives archives without pages. Repeated rows are records each.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    shared = F.when(F.octet_length("payload") >= least, F.sha1("payload"))  # null: never shared
    order = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "url")
    firsts = rows.select(shared.alias("digest"), order.alias("page")).where("digest is not null").groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = written(firsts.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "firsts")
    joined = rows.withColumn("own", shared).join(small(firsts), F.col("own") == F.col("digest"), "left")
    revisits = F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = joined.select("page_id", "url", "payload", revisits, "first_url").mapInArrow(_records(str(uuid.uuid4()), date, segment_bytes, chunk_bytes), "record binary")
    records.select(F.col("record").cast("string")).write.text(path, compression="gzip", lineSep=BLANK)


RECORD = "record_id string, page_id long, target_uri string, record_type string, payload_digest string, payload_bytes long, refers_to_uri string, origin string, segment int, total long, payload binary, error string"
NAMES = [x.split(" ")[0] for x in RECORD.split(", ")]
ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k]) for n, k in (x.split(" ") for x in RECORD.split(", "))])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, ARROW)


def _number(x: str | None) -> int | None:
    n = int(x) if x is not None and re.fullmatch(r"-?[0-9]{1,19}", x) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def _decoded(row: dict, block: bytes, payloads: bool) -> dict:
    """row with the payload of an HTTP block, checked against its digest."""
    try:
        payload = entity(block)
    except ValueError as e:
        return row | {"error": str(e)}
    digest = digest_of(payload)
    wrong = None if row["payload_digest"] in (None, digest) else "payload differs from its digest"
    return row | {"payload_digest": digest, "payload_bytes": len(payload), "payload": payload if payloads else None, "error": wrong}


def _parsed(header: bytes, block: bytes, payloads: bool) -> dict | None:
    """The row of a record, or None for kinds that are no part of a page."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in re.sub(r"\r\n[ \t]+", " ", header.decode("utf-8", "replace")).split("\r\n")[1:])}
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit", "continuation"):
        return None
    digest = fields.get("warc-payload-digest")
    row = dict.fromkeys(NAMES) | {
        "record_id": fields.get("warc-record-id"), "page_id": _number(fields.get("x-page-id")), "target_uri": fields.get("warc-target-uri"), "record_type": kind, "refers_to_uri": fields.get("warc-refers-to-target-uri"),
        "payload_digest": digest.removeprefix("sha1:") if digest else None, "segment": _number(fields.get("warc-segment-number")), "total": _number(fields.get("warc-segment-total-length")),
    }
    row["origin"] = fields.get("warc-segment-origin-id") if kind == "continuation" else row["record_id"] if row["segment"] is not None else None
    if row["segment"] is not None:
        return row | {"payload": block}
    return row if kind == "revisit" else _decoded(row, block, payloads)


def _read(payloads: bool):
    """Mapper of (file, start of the split, piece) in the archive's order to rows."""

    def records(pieces: Iterator[tuple[str, int, bytes]]) -> Iterator[dict | None]:
        file, held, header, length, lost = None, bytearray(), None, 0, False

        def left() -> Iterator[dict]:
            if header is not None or held.strip():
                yield dict.fromkeys(NAMES) | {"error": f"record cut off at the end of {file}"}

        for name, start, piece in pieces:
            if name != file:
                yield from left()
                file, header, held, lost = name, None, bytearray(), False
                if start:
                    raise ValueError(f"{name} is read in parts: compress it, or raise spark.sql.files.maxPartitionBytes above its size")
            held += piece
            held += END
            while True:
                if header is None:
                    at = next((i for i, c in enumerate(held) if c not in b"\r\n"), len(held))
                    del held[:at]
                    end = held.find(END)
                    if end < 0:
                        break
                    header = bytes(held[:end])
                    del held[: end + 4]
                    found = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?=\r\n|$)", header, re.I) if header.startswith(b"WARC/") else None
                    if not found:  # pass over what follows, up to a record that begins with a piece
                        if not lost:
                            yield dict.fromkeys(NAMES) | {"error": f"no record where one should begin in {file}"}
                        header, lost = None, True
                        continue
                    length, lost = int(found[1]), False  # a stretch without records is told once
                if len(held) < length + len(END):
                    break
                if held[length : length + len(END)] == END:
                    yield _parsed(header, bytes(held[:length]), payloads)
                    del held[:length]
                else:  # the next record is sought in what was taken for its content
                    yield dict.fromkeys(NAMES) | {"error": f"record longer or shorter than it says in {file}"}
                    lost = True
                header = None
        yield from left()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((f.as_py(), s.as_py(), p.as_py()) for b in batches for f, s, p in zip(*b.columns))
        held, size = [], 0
        for row in records(pieces):
            if row:
                held.append(row)
                size += len(row["payload"] or b"") + 500
                if size >= BATCH_BYTES:
                    yield _rows(held)
                    held, size = [], 0
        if held:
            yield _rows(held)

    return run


def _joined(payloads: bool):
    """Mapper of segments, those of an origin together in order, to a row for each origin."""

    def whole(parts: list[dict]) -> dict:
        head = parts[0]
        row = head | {"segment": None, "total": None, "payload": None}
        numbers = [x["segment"] for x in parts]
        block = b"".join(x["payload"] for x in parts)
        if head["record_type"] == "continuation":
            return row | {"record_id": head["origin"], "record_type": "response", "error": "the origin is missing"}
        if numbers != [*range(1, len(parts) + 1)] or parts[-1]["total"] is None:
            return row | {"error": "segments are missing or repeated"}
        if parts[-1]["total"] != len(block):
            return row | {"error": "segments differ from their total length"}
        return _decoded(row, block, payloads)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if held and held[0]["origin"] != row["origin"]:
                    yield _rows([whole(held)])
                    held = []
                held.append(row)
        if held:
            yield _rows([whole(held)])

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each response or revisit in the archives under path: RECORD without the segments' columns.

    payload_bytes and payload_digest are of the decoded payload; a revisit has the digest that it states and no bytes
    (``resolved`` finds them). Segments are joined by their origin and checked against the total length, payloads against
    their digest; a damaged or incomplete record has an ``error`` and the stream goes on with the next. payloads=False leaves
    the payload null. An archive must be compressed, or fit a partition.
    """
    pieces = spark.read.text(path, lineSep=BLANK).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))
    rows = written(pieces.mapInArrow(_read(payloads), RECORD), "records")
    parts = rows.where("segment is not null").repartition("origin").sortWithinPartitions("origin", "segment", "record_id").mapInArrow(_joined(payloads), RECORD)
    return rows.where("segment is null").union(parts).drop("origin", "segment", "total")


def resolved(records: DataFrame) -> DataFrame:
    """records with refers_to long (the page that answers a revisit, else null) and that page's payload_bytes.

    Of several responses of one digest the smallest page answers. A revisit of none has an error. Payloads stay with responses.
    """
    rows = written(records.drop("payload"), "pages")
    revisits, others = rows.where("record_type = 'revisit'"), rows.where("record_type is null or record_type <> 'revisit'")
    asked = small(written(revisits.select(F.col("payload_digest").alias("digest")).distinct(), "asked"))
    answers = others.where("error is null").join(asked, F.col("payload_digest") == F.col("digest"), "leftsemi")
    answers = answers.groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("answered"))
    found = revisits.join(small(written(answers, "answers")), F.col("payload_digest") == F.col("digest"), "left")
    lost = F.when(F.col("answered").isNull(), F.lit("no response of this digest"))
    found = found.withColumn("payload_bytes", F.col("answered")).withColumn("error", F.coalesce("error", lost)).select(*rows.columns, "refers_to")
    return others.withColumn("refers_to", F.lit(None).cast("long")).union(found)


#: Base 32 of the digest: five hex digits are four letters. Rows that share the smallest id are responses all.
SQL = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first_id FROM rows GROUP BY h)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM rows JOIN firsts USING (h)
"""
