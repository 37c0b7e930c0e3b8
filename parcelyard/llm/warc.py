"""WARC archives: writing, reading, and revisit records for equal payloads.

An archive is a folder of gzip files, each a chain of WARC/1.1 records. Spark's
text writer lays a record down per row and ends it with the two empty lines that
the format asks for; its commit protocol makes a lost executor harmless. Files
are read back record by record by their Content-Length, so that nothing in a
payload can be taken for a record's begin.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.llm.store import new_folder, stored

# Records of a file hold about so many bytes before compression.
FILE_BYTES = 32 << 20
# Revisits of up to so many bytes go to the payloads; beyond, payloads are shuffled to them.
MAX_BROADCAST_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADERS = (
    "record_id string, record_type string, page_id string, uri string, date string, "
    "refers_to_id string, payload_digest string, payload_bytes long"
)


def payload_digest(payload: Column) -> Column:
    """SHA-1 of the bytes in upper-case base32, without a prefix."""
    digits = F.sha1(payload.cast("binary"))

    def chars(group: int) -> list[Column]:
        # Five hexadecimal digits are four base32 digits.
        v = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        at = [F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1 for s in (15, 10, 5, 0)]
        return [F.substring(F.lit(_BASE32), i, F.lit(1)) for i in at]

    return F.concat(*[c for group in range(8) for c in chars(group)])


def _one_line(text: Column) -> Column:
    """A header's value: line ends would begin another header."""
    return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record(headers: list[tuple[str, Column]], http: Column, payload: Column) -> Column:
    """The text of a record; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), _one_line(value.cast("string"))) for name, value in headers]
    length = F.octet_length(http) + F.octet_length(payload)
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), length))
    return F.concat(head, F.lit(_END), http, payload)


def _http(payload_bytes: Column) -> Column:
    return F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        payload_bytes.cast("string"),
        F.lit(_END),
    )


def _write(records: DataFrame, folder: str, per_file: int) -> None:
    writer = records.select("value").write.option("lineSep", _END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", per_file).text(folder)


def write_pages(pages: DataFrame, folder: str, date: str = DATE) -> None:
    """A response record per row of ``pages`` (``page_id``, ``url``, ``html``).

    The payload is the html's bytes, none for a null; a null url gives a record
    without a target. Ids of records are new for every row, repeated rows
    included.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    stats = rows.agg(F.avg(F.octet_length("payload"))).first()[0]
    number = F.md5(F.concat(F.lit(folder), F.monotonically_increasing_id().cast("string")))
    uuid = F.regexp_replace(number, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    headers = [
        ("WARC-Type", F.lit("response")),
        ("WARC-Record-ID", uuid),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("X-Page-Id", F.col("page_id")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), payload_digest(F.col("payload")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    text = _record(headers, _http(F.octet_length("payload")), F.col("payload"))
    _write(rows.select(text.alias("value")), folder, _per_file(stats))


def _per_file(mean_bytes: float | None) -> int:
    return max(1, int(FILE_BYTES / ((mean_bytes or 0) + 500)))


def parse(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record."""
    while True:
        line = file.readline()
        while line in (b"\r\n", b"\n"):
            line = file.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := file.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = file.read(size)
        if len(block) != size:
            raise ValueError("a record ends before its length")
        yield headers, block


def _row(headers: dict[str, str], block: bytes) -> tuple[list, bytes]:
    payload = block
    if "msgtype=response" in headers.get("content-type", ""):
        payload = block.partition(b"\r\n\r\n")[2]
    digest: str | None = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    size: int | None = len(payload)
    if headers["warc-type"] == "revisit":  # its payload is elsewhere
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        size = None
    elif (named := headers.get("warc-payload-digest")) and named != f"sha1:{digest}":
        raise ValueError(f"payload of {headers.get('warc-record-id')} does not fit its digest")
    found = [headers.get(x) for x in ("warc-record-id", "warc-type", "x-page-id", "warc-target-uri", "warc-date", "warc-refers-to")]
    return [*found, digest, size], payload


def read_archive(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of an archive: ``HEADERS``, and ``payload`` on request.

    Digest and size are those of the payload read, which must fit the record's
    own digest; a revisit has the digest it names and a null size.
    """
    schema = HEADERS + ", payload binary" * payloads
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as file:
                    for headers, block in parse(file):
                        row, payload = _row(headers, block)
                        rows.append([*row, payload] if payloads else row)
                        held += 200 + len(payload) * payloads
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.where("length > 0").select("content").mapInArrow(run, schema)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Per response its ``record_id`` and the original's ``to_id``, ``to_page``, ``to_uri``, ``to_date``.

    Originals have nulls there. Records with equal payloads of at least
    ``min_bytes`` bytes revisit the one with the smallest page id (as a number,
    if it is one; then as text, a missing one last), then the smallest record id.
    """
    headers = headers.where("record_type <> 'revisit'")
    page = F.col("page_id")
    rank = F.struct(
        page.isNull().alias("_none"),
        page.try_cast("decimal(38,0)").isNull().alias("_text"),
        page.try_cast("decimal(38,0)").alias("_number"),
        "page_id",
        F.col("record_id").alias("id"),
        "uri",
        "date",
    )
    long = headers.where(F.col("payload_bytes") >= min_bytes)
    # Only headers move. One row per digest and task after the partial minimum; the
    # third key, always 0, has both sides shuffled, so a hot digest can be split.
    zero = F.pmod(F.xxhash64("payload_digest"), F.lit(1))
    keys = ["payload_digest", "payload_bytes", "_z"]
    first = long.groupBy("payload_digest", "payload_bytes").agg(F.min(rank).alias("first"))
    both = headers.withColumn("_z", zero).join(first.withColumn("_z", zero), keys, "left")
    again = F.col("first.id") != F.col("record_id")
    return both.select(
        "record_id",
        *[F.when(again, F.col(f"first.{c}")).alias(f"to_{name}")
          for c, name in (("id", "id"), ("page_id", "page"), ("uri", "uri"), ("date", "date"))],
    )


def write_deduplicated(spark: SparkSession, source: str, folder: str, min_bytes: int = 0) -> None:
    """The archive ``source`` with revisit records in place of repeated payloads.

    All records get new headers; a revisit names its original's id, target and
    date and holds the HTTP head only.
    """
    known = stored(read_archive(spark, source), "headers")
    found = stored(resolve(known, min_bytes).where("to_id IS NOT NULL"), "revisits")
    mean = known.agg(F.avg("payload_bytes")).first()[0]
    held = F.octet_length(F.concat_ws("", *found.columns)) + 100
    if (found.agg(F.sum(held)).first()[0] or 0) <= MAX_BROADCAST_BYTES:
        found = F.broadcast(found)
    rows = read_archive(spark, source, payloads=True).join(found, "record_id", "left")
    # Revisits of the source stay what they are.
    rows = rows.withColumn("to_id", F.coalesce("to_id", "refers_to_id"))
    revisit = F.col("to_id").isNotNull()
    payload = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    headers = [
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Date", F.col("date")),
        ("WARC-Target-URI", F.col("uri")),
        ("X-Page-Id", F.col("page_id")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        ("WARC-Refers-To", F.col("to_id")),
        ("WARC-Refers-To-Target-URI", F.when(revisit, F.col("to_uri"))),
        ("WARC-Refers-To-Date", F.when(revisit, F.col("to_date"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    text = _record(headers, _http(F.coalesce("payload_bytes", F.lit(0))), payload)
    _write(rows.select(text.alias("value")), folder, _per_file(mean))


def resolved(records: DataFrame) -> DataFrame:
    """The records of a deduplicated archive with every revisit's size and original.

    Adds ``refers_to``, the original's page id.
    """
    answer = records.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("refers_to_id"),
        F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("_bytes"),
        F.col("payload_digest").alias("_digest"),
    )
    both = records.join(answer, "refers_to_id", "left")
    return both.select(
        "record_id", "record_type", "page_id", "uri",
        F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        F.coalesce("_digest", "payload_digest").alias("payload_digest"),
        "refers_to",
    )


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as an archive, deduplicate it, and return what is read back.

    One row per row of ``pages``: ``page_id`` in its own type, ``payload_bytes``,
    ``payload_digest``, ``record_type`` and ``refers_to``. Both archives stay in
    the shared folder. A null html has an empty payload; a null page id stays
    null, and repeated rows revisit the first of them; an empty table gives an
    empty result. Other columns of ``pages`` take no part.
    """
    spark = pages.sparkSession
    raw, slim = new_folder(spark, "warc"), new_folder(spark, "warc-dedup")
    write_pages(pages.select("page_id", "url", "html"), raw)
    write_deduplicated(spark, raw, slim, min_bytes)
    found = resolved(stored(read_archive(spark, slim), "records"))
    kind = pages.schema["page_id"].dataType
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
