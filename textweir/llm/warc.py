"""WARC: archives of request, response (or revisit) and metadata records, written, read back and assembled by Spark.

A record is text: its header, a blank line and its block, so Spark's text writer with the line separator CR LF CR LF, which
ends every WARC record, writes archives, each a single gzip member. Reading takes whole archives (of a bounded number of
bytes each), with one member or one for each record, and parses them by Content-Length. The records of a capture are joined
through WARC-Concurrent-To, in whichever direction the links run and however many a record has.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textweir.llm.shared import components, prepared, shared_dir, stored, table

LEAST_BYTES = 1000
#: Records in one archive at most.
ARCHIVE_RECORDS = 6000
#: Payloads of up to SMALL_BYTES are written ARCHIVE_RECORDS records to an archive, those of up to STEP times that a STEP-th of it, and so on.
SMALL_BYTES, STEP, CLASSES = 100_000, 8, 4

NS = "urn:page:"


def _size_class(size: Column) -> Column:
    """0 for payloads of up to SMALL_BYTES, one more for each further factor of STEP."""
    return sum((F.when(size > SMALL_BYTES * STEP**k, 1).otherwise(0) for k in range(CLASSES)), F.lit(0))


def _pages(pages: DataFrame, least: int, null_ids: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pages with payload_bytes, digest, size class and `no` (null for a page_id that stands once), the owners of repeated payloads, and the pages without payloads.

    The last is a table that one pass over the pages makes; what is settled on ids and digests reads it alone.
    """
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    given = given.withColumn("payload_bytes", F.octet_length("html")).withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("class", _size_class(F.col("payload_bytes")))
    known = given.where("page_id is not null")
    light = stored(given.select("page_id", "payload_bytes", "digest", "class"), "light")
    repeated = stored(light.where("page_id is not null").groupBy("page_id").count().where("count > 1").select("page_id"), "repeated")
    named = known.withColumn("no", F.lit(None).cast("string"))
    if not repeated.isEmpty():
        number = F.row_number().over(Window.partitionBy("page_id", "digest", "payload_bytes").orderBy("url"))
        again = known.join(repeated, "page_id", "left_semi").withColumn("no", F.concat("digest", F.lit("."), number.cast("string")))
        named = named.join(repeated, "page_id", "left_anti").unionByName(again)
    if null_ids:
        named = named.unionByName(given.where("page_id is null").withColumn("no", F.concat(F.col("class").cast("string"), F.lit("."), F.monotonically_increasing_id().cast("string"))))
    owners = light.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1 and owner is not null").drop("n")
    owners = owners.join(repeated.select(F.col("page_id").alias("owner"), F.lit(True).alias("owner_repeated")), "owner", "left")
    return named, owners.withColumn("owner_no", F.when(F.col("owner_repeated"), F.concat("digest", F.lit(".1")))).drop("owner_repeated"), light


def records(pages: DataFrame, least: int = LEAST_BYTES, null_ids: bool = False, date: str | None = None) -> DataFrame:
    """(page_id, url, html) -> one `value` per record: the request, the response or revisit, and the metadata of each page.

    Of pages with equal payloads of at least `least` bytes, that with the largest page_id is written as a response and
    the others as revisits that refer to it; payloads are compared by SHA-1 and length. A null html is an empty payload, a null url an empty
    target. Each row has records of its own: where a page_id stands more than once, their ids also have the digest and a
    number. Pages with a null page_id are passed over, or with null_ids written under ids of their own; those whose
    payload belongs to another page are revisits without WARC-Refers-To. date: WARC-Date, the present time if not given.
    Other columns are ignored, whatever their names; an empty table gives no record. A page needs a few times its bytes.
    """
    return _records(*_pages(pages, least, null_ids), least, date)


def _records(named: DataFrame, owners: DataFrame, light: DataFrame, least: int, date: str | None) -> DataFrame:
    # Which pages revisit another is settled on ids; payloads, most of which are alike perhaps, are dealt by page.
    payload = ["digest", "payload_bytes"]
    known = named.where("page_id is not null")
    revisits = light.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", *payload).join(owners, payload).where("owner <> page_id").distinct()
    rows = known.join(revisits, ["page_id", *payload], "left").unionByName(named.where("page_id is null").join(owners, payload, "left"))
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    again = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    refers = again & F.col("page_id").isNotNull()
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    target = F.regexp_replace("url", r"[\r\n]", "")
    name = lambda kind, page="page_id", no="no": F.concat(F.lit(f"<{NS}{kind}:"), F.coalesce(F.col(page).cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("."), no), F.lit("")), F.lit(">"))

    def record(kind: Column, own: str, content: str, block: Column, more: Column | None = None) -> Column:
        head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), name(own), F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: {content}\r\nWARC-Target-URI: "), target, F.lit("\r\n"))
        return F.concat(head, more if more is not None else F.lit(""), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)

    main = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n"), F.when(refers, F.concat(F.lit("WARC-Refers-To: "), name("response", "owner", "owner_no"), F.lit("\r\n"))).otherwise(""), F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(""))
    linked = F.concat(F.lit("WARC-Concurrent-To: "), name("response"), F.lit("\r\n"))
    request = record(F.lit("request"), "request", "application/http; msgtype=request", F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\n\r\n")), linked)
    response = record(F.when(again, F.lit("revisit")).otherwise("response"), "response", "application/http; msgtype=response", F.when(again, http).otherwise(F.concat(http, "html")), main)
    metadata = record(F.lit("metadata"), "metadata", "application/warc-fields", F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit("\r\n")), linked)
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, null_ids: bool = False, date: str | None = None) -> str:
    """Writes gzipped archives under path, of at most ARCHIVE_RECORDS records.

    Pages of each size class are written apart, larger ones fewer at a time, so that an archive holds about
    ARCHIVE_RECORDS / 3 * SMALL_BYTES bytes of payload, or one page.
    """
    named, owners, light = _pages(pages, least, null_ids)
    owners = stored(owners, "owners")
    found = sorted(r[0] for r in light.select("class").distinct().collect())
    for k, c in enumerate(found or [0]):
        most = 3 * max(1, ARCHIVE_RECORDS // 3 // STEP**c)
        out = _records(named.where(F.col("class") == c), owners, light.where(F.col("class") == c), least, date).write.mode("append" if k else "errorifexists")
        out.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
    return path


RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, target string, payload_bytes long, payload_digest string, payload binary"
_NAMES = [column.split(" ")[0] for column in RECORD.split(", ")]
_TYPES = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())


def _hex(digest: str | None) -> str | None:
    """A digest header's value as lower-case hex; SHA-1 may be in base 32."""
    if digest is None:
        return None
    kind, _, value = digest.rpartition(":")
    return base64.b32decode(value.upper()).hex() if kind.lower() in ("sha1", "") and len(value) == 32 else value.lower()


class _Unzipped(io.RawIOBase):
    """The bytes of a gzip file up to where it is damaged; what is wrong there, if anything, is in `damage`."""

    damage: Exception | None = None

    def __init__(self, archive: bytes):
        self._file = gzip.GzipFile(fileobj=io.BytesIO(archive))

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        try:
            data = self._file.read1(len(buffer))
        except (EOFError, OSError, zlib.error) as e:
            self.damage, data = e, b""
        buffer[: len(data)] = data
        return len(data)


def parse(archive: bytes, with_payload: bool = True) -> Iterator[tuple]:
    """The records of one archive, with as many gzip members as it has.

    A response's payload length and digest are taken from its payload, a revisit's from its header (null if absent). The
    record's WARC-Concurrent-To may stand several times; of other repeated fields the last one counts. Damage raises one of
    DAMAGE once the records before it are given out.
    """
    unzipped = _Unzipped(archive)
    stream = io.BufferedReader(unzipped)
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        head: dict[str, str] = {}
        beside: list[str] = []
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
            if k.strip().lower() == "warc-concurrent-to":
                beside.append(v.strip())
        block = stream.read(int(head["content-length"]))
        if len(block) < int(head["content-length"]):
            raise EOFError("the archive ends within a record")
        kind, payload, size, digest = head["warc-type"], None, None, None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        elif kind == "revisit":
            size, digest = int(head["x-payload-length"]) if "x-payload-length" in head else None, _hex(head.get("warc-payload-digest"))
        yield head["warc-record-id"], kind, beside, head.get("warc-refers-to"), head.get("warc-target-uri"), size, digest, payload if with_payload else None
    if unzipped.damage:
        raise unzipped.damage


#: What a truncated or altered archive raises.
DAMAGE = (EOFError, OSError, zlib.error, ValueError, KeyError)


def _parsed(batches: Iterator[pa.RecordBatch], with_payload: bool, keep: bool) -> Iterator[pa.RecordBatch]:
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
    for batch in batches:
        for path, archive in zip(batch.column(0), batch.column(1), strict=True):
            rows: list[tuple] = []
            try:
                for row in parse(archive.as_py(), with_payload):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield made(rows)
                        rows = []
            except DAMAGE as e:
                if not keep:
                    raise ValueError(f"{path}: {e!r}") from e
                rows.append((None, "damaged", [], None, path.as_py(), None, None, None))
            if rows:
                yield made(rows)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, keep_damaged: bool = False) -> DataFrame:
    """The records of the archives under path.

    An archive that is cut off, no gzip or not made of records with a type, an id and a length ends the job with its
    name. With keep_damaged its records before the damage are returned, and one more of type `damaged` that has the
    archive's path as its target and no id.
    """
    prepared(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(lambda x: _parsed(x, with_payload, keep_damaged), RECORD)


def _captures(rows: DataFrame) -> DataFrame:
    """The records with the id that stands for their capture.

    A record tied to just one other, and that nothing is tied to, goes where that one goes. In plain archives these are
    all that have links; only what is left has its components searched.
    """
    links = rows.select("record_id", F.explode("concurrent_to").alias("beside"))
    ends = links.select(F.col("record_id").alias("node"), "beside", F.lit(False).alias("met")).union(links.select("beside", F.lit(None).cast("string"), F.lit(True)))
    sums = ends.groupBy("node").agg(F.min("beside").alias("least"), F.max("beside").alias("most"), F.max("met").alias("met"))
    knots = stored(sums.where("least is not null and (met or least < most)").select(F.col("node").alias("record_id")), "knots")
    beside = F.get("concurrent_to", F.lit(0))
    if knots.isEmpty():
        return rows.withColumn("capture", F.coalesce(beside, "record_id"))
    tied = stored(components(links.join(knots, "record_id", "left_semi"), "record_id", "beside"), "tied")
    own = tied.select(F.col("node").alias("record_id"), F.col("component").alias("own"))
    other = tied.select(F.col("node").alias("beside"), F.col("component").alias("other"))
    return rows.withColumn("beside", beside).join(own, "record_id", "left").join(other, "beside", "left").withColumn("capture", F.coalesce("own", "other", "beside", "record_id"))


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, response, request, metadata (null where the archive has none).

    Records that WARC-Concurrent-To ties, over any number of steps and in any direction, make a capture; a record that
    nothing is tied to is one of its own. Of several records of one kind the one with the largest id is kept. page_id is
    null for ids that write_archives() did not give. Records of damaged archives are passed over where they have no id. The
    rows are read twice.
    """
    record = F.struct(*_NAMES)
    first = lambda *kinds: F.max_by(F.when(F.col("type").isin(*kinds), record), F.when(F.col("type").isin(*kinds), F.col("record_id")))
    grouped = _captures(rows.where("record_id is not null")).groupBy("capture").agg(first("response", "revisit").alias("response"), first("request").alias("request"), first("metadata").alias("metadata"))
    return grouped.select(page_of(F.coalesce("response.record_id", "request.record_id", "capture")).alias("page_id"), "response", "request", "metadata")


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r":(-?\d+)(?:\.[0-9a-f]+\.\d+)?>$", 1).try_cast("long")


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", null_ids=True)
    found = assemble(stored(read_archives(spark, path, with_payload=False), "records"))
    return found.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), page_of(F.col("response.refers_to")).alias("refers_to"), F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"))


OP8_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, payload_bytes, max(page_id) AS o FROM p WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN o.o IS NULL OR o.o = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN o.o <> page_id THEN o.o END AS refers_to, true AS has_request, true AS has_metadata
FROM p LEFT JOIN o USING (payload_digest, payload_bytes)
"""
