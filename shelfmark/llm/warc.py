"""WARC archives of page captures: written as request, response or revisit, and metadata records, read
back, and assembled to one nested row for each capture through their concurrent-to identifiers.

Archives are written by Spark's own text writer: a record ends with two line ends, which is the
writer's line separator, so every part file is a WARC file in one gzip stream. They are read as
binary files and parsed record by record by their content lengths. Part files hold a bounded number of
records, by which a task's memory is bounded.

Of pages with equal payloads of at least ``LEAST`` bytes the one with the smallest id is stored, the
others revisit it. Equality is that of SHA-256 and length, so html is never a join key and moves at
most once: rows are told what they are by their digest.

Defined results: null html is an empty payload. A null id is larger than all others; pages equal in id
and payload are the same capture, stored each time. Null urls are written as ``about:blank``. An
empty table writes an archive without records and reads back as an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

LEAST = 100  # bytes; smaller payloads are always stored
PART_BYTES = 32 << 20  # html in a part file, on average
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_id string, record_type string, concurrent_to string, target_uri string, refers_to string,"
    " payload_digest string, http string, fields string, payload binary"
)


def urn(*parts: Column) -> Column:
    """A record id made from values."""
    h = F.md5(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]).cast("binary"))
    groups = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def record(kind: str, record_id: Column, uri: Column, headers: list[Column], content: str, block: Column) -> Column:
    """The text of a record without the two line ends that close it."""
    lines = [
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        *headers,
        F.lit(f"Content-Type: {content}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def captures(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages with their digest and, for revisits, the id and url of the page that is stored."""
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long = F.octet_length("html") >= LEAST
    first = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "url")).alias("first")
    groups = rows.filter(long).groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")
    # only groups of several pages are joined; as a table their size is known, so few do not move html
    joined = rows.join(cut(groups.select("digest", "first")), "digest", "left")
    other = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    return joined.select("id", "url", "html", "digest", F.when(other, F.col("first")).alias("first"))


def records(rows: DataFrame) -> DataFrame:
    """The records of captures as text, three for each."""
    uri = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\r\n]+", " ")
    path = F.regexp_replace(uri, r"^[a-z]+://[^/]*", "")
    host = F.regexp_extract(uri, r"^[a-z]+://([^/]*)", 1)
    own = urn(F.lit("capture"), F.col("id"), F.col("url"), F.col("digest"))
    stored = urn(F.lit("capture"), F.col("first.id"), F.col("first.url"), F.col("digest"))
    beside = F.concat(F.lit("WARC-Concurrent-To: "), own)
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    head = F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8{END}")
    http = "application/http;msgtype="
    again = [digest, F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), stored)]
    answer = F.when(
        F.col("first").isNull(), record("response", own, uri, [digest], f"{http}response", F.concat(head, F.col("html")))
    ).otherwise(record("revisit", own, uri, again, f"{http}response", head))
    asked = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    request = record("request", urn(F.lit("request"), own), uri, [beside], f"{http}request", asked)
    fields = F.coalesce(F.concat(F.lit("page_id: "), F.col("id").cast("string")), F.lit(""))
    metadata = record("metadata", urn(F.lit("metadata"), own), uri, [beside], "application/warc-fields", fields)
    return rows.select(F.explode(F.array(request, answer, metadata)).alias("value"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write the captures of ``pages`` as WARC files below ``folder``."""
    size = pages.agg(F.avg(F.octet_length(F.col(f"`{html}`").cast("string")))).first()[0] or 0.0
    most = 3 * max(1, int(PART_BYTES / max(1.0, size)))
    writer = records(captures(pages, id_col, url, html)).write.option("lineSep", END).option("maxRecordsPerFile", most)
    writer.option("compression", "gzip").text(folder)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC stream."""
    held = bytearray()
    ended = False

    def have(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            chunk = next(chunks, None)
            ended = chunk is None
            held.extend(chunk or b"")
        return len(held) >= n

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0 and have(len(held) + 1):
            pass
        if at < 0:
            return
        lines = bytes(held[:at]).decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        pairs = (x.split(":", 1) for x in lines[1:] if ":" in x)
        headers = {k.strip().lower(): v.strip() for k, v in pairs}
        length = int(headers.get("content-length", "0"))
        if not lines[0].startswith("WARC/") or not have(at + 4 + length):
            raise ValueError("a WARC record is damaged or cut off")
        yield headers, bytes(held[at + 4 : at + 4 + length])
        have(at + 8 + length)
        del held[: at + 8 + length]


def unpacked(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, or of a plain file, a piece at a time."""
    left = memoryview(content)
    packed = content[:2] == b"\x1f\x8b"
    while packed and left:
        machine, at = zlib.decompressobj(31), 0
        while not machine.eof and (machine.unconsumed_tail or at < len(left)):
            piece = machine.unconsumed_tail
            if not piece:
                piece, at = left[at : at + step], at + min(step, len(left) - at)
            yield machine.decompress(piece, 16 * step)
        yield machine.flush()
        left = left[at - len(machine.unused_data) :] if machine.eof else left[:0]
    for at in range(0, len(left), step):
        yield bytes(left[at : at + step])


def fields_of(headers: dict[str, str], block: bytes) -> dict:
    """A row of ``RECORD``."""
    kind = headers.get("warc-type")
    http, payload, fields = None, None, None
    if kind in ("request", "response", "revisit"):
        head, _, rest = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
        payload = rest if kind == "response" else None
    else:
        fields = block.decode("utf-8", "replace")
    return {
        "record_id": headers.get("warc-record-id"),
        "record_type": kind,
        "concurrent_to": headers.get("warc-concurrent-to"),
        "target_uri": headers.get("warc-target-uri"),
        "refers_to": headers.get("warc-refers-to"),
        "payload_digest": headers.get("warc-payload-digest"),
        "http": http,
        "fields": fields,
        "payload": payload,
    }


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives below ``folder``; the payload's digest is checked."""
    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("content")
    names = [x.strip().split()[0] for x in RECORD.split(",")]
    schema = pa.schema([(n, pa.binary() if n == "payload" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse(unpacked(content.as_py())):
                    row = fields_of(headers, block)
                    if row["payload"] is not None and row["payload_digest"]:
                        if f"sha256:{hashlib.sha256(row['payload']).hexdigest()}" != row["payload_digest"]:
                            raise ValueError(f"payload of {row['record_id']} does not have its digest")
                    rows.append(row)
                    size += len(block) + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row for each capture: ``response`` (or revisit) with its ``request`` and ``metadata``.

    Requests and metadata name the record they belong to; those that are repeated are the same record.
    """
    answers = found.filter("record_type in ('response', 'revisit')")
    answers = answers.select("record_id", F.struct(*[c for c in found.columns]).alias("response"))

    def beside(kind: str) -> DataFrame:
        of_kind = found.filter(F.col("record_type") == kind)
        one = F.min(F.struct("record_id", "target_uri", "http", "fields")).alias(kind)
        return of_kind.groupBy(F.col("concurrent_to").alias("record_id")).agg(one)

    return answers.join(beside("request"), "record_id", "left").join(beside("metadata"), "record_id", "left")


def field(metadata: Column, name: str) -> Column:
    """The value of a line ``name: value`` of a metadata record; null without one."""
    value = F.regexp_extract(metadata, rf"(?:^|\r\n){name}: ([^\r]*)", 1)
    return F.when(value != "", value)


def summary(found: DataFrame) -> DataFrame:
    """One row for each capture: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to``. Of a revisit the last one and the length are those of the record that it refers to; null
    where the archives do not hold that."""
    told = F.col("response.payload_digest")
    sized = found.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    captured = assemble(sized.drop("payload")).select(  # payloads do not move
        "record_id",
        F.col("response.refers_to").alias("target"),
        field(F.col("metadata.fields"), "page_id").cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.regexp_replace(told, "^sha256:", "").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
    )
    captured = cut(captured)
    revisit = F.col("record_type") == "revisit"
    asked = captured.filter(revisit).select(F.col("target").alias("record_id")).distinct()
    held = captured.filter(~revisit).select("record_id", "page_id", "payload_bytes").join(asked, "record_id", "left_semi")
    held = held.groupBy(F.col("record_id").alias("target")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("bytes"))
    return captured.join(held, "target", "left").select(
        "page_id",
        F.when(revisit, F.col("bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
    )


ORACLE = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, p.payload_digest,
    case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
    case when first is null or page_id is not distinct from first then null else first end as refers_to
from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 100
"""
