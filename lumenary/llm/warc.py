"""WARC archives: writing, reading, and resolution of revisit records."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_batches, small, table_path, written

CRLF = "\r\n"
#: Payloads from this size on can be revisited.
LEAST_BYTES = 100
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def token_of(name: str) -> str:
    """An archive's own token: the first header of each of its records, by which Spark's reader splits files."""
    return hashlib.sha256(name.encode()).hexdigest()[:32]


def _delimiter(token: str) -> str:
    return f"{CRLF}{CRLF}WARC/1.1{CRLF}WARC-Archive-Token: {token}{CRLF}"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_digest and payload_bytes of pages: all that is shuffled to find equal payloads."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", F.sha2(payload.cast("binary"), 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def originals(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """payload_digest, original (the least page_id) and its url, of payloads that occur twice or more. Counts merge on the map
    side."""
    heads = headers(pages).where(F.col("payload_bytes") >= least)
    found = heads.groupBy("payload_digest").agg(F.count("*").alias("_n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("_o"))
    return found.where("_n > 1 AND _o IS NOT NULL").select("payload_digest", F.col("_o.page_id").alias("original"), F.col("_o.url").alias("_original_url"))


def _header(name: str, value) -> F.Column:
    """A header line, without line ends in its value; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", "%0D%0A"), F.lit(CRLF)), F.lit(""))


def records(pages: DataFrame, repeated: DataFrame, token: str, date: str) -> DataFrame:
    """Each page's record with fresh headers, as one text: a response, or a revisit of the equal payload of least page_id, as
    ``repeated`` (the rows of ``originals``) names it.

    The repeated digests are broadcast only after they were counted; beyond the bound the pages are shuffled by digest, and
    as both sides come straight from a shuffle, Spark can split a hot digest.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    tagged = pages.select("page_id", "url", payload.alias("_payload")).withColumn("payload_digest", F.sha2(F.col("_payload").cast("binary"), 256))
    joined = tagged.join(small(repeated), "payload_digest", "left")
    revisit = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    size = F.octet_length("_payload")
    http = F.concat(F.lit(f"{HTTP}{CRLF}Content-Length: "), size, F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_payload")))
    of = lambda value: F.when(revisit, value)
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Archive-Token: {token}{CRLF}"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Profile", of(F.lit(PROFILE))),
        _header("WARC-Refers-To-Target-URI", of(F.col("_original_url"))),
        _header("WARC-Refers-To-Date", of(F.lit(date))),
        _header("WARC-Page", F.col("page_id")),
        _header("WARC-Refers-To-Page", of(F.col("original"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("WARC-Payload-Length", size),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block)),
        F.lit(CRLF),
    )
    return joined.select(F.concat(head, block).alias("value"))


def write_archive(pages: DataFrame, path: str, date: str | None = None, least: int = LEAST_BYTES) -> str:
    """Write the records of ``pages`` (page_id, url, html) as WARC files under ``path``; returns the archive's token. Each record
    has an id of its own, repeated rows included, and the given date, or that of the writing."""
    token = token_of(path)
    repeated = written(originals(pages, least), "originals")
    records(pages, repeated, token, date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")).write.option("lineSep", CRLF * 2).text(path)
    discard(repeated)
    return token


def read_archive(spark: SparkSession, path: str, token: str) -> DataFrame:
    """Records of an archive that ``write_archive`` wrote: page_id, record_type, url, refers_to, payload_digest,
    payload_length, and payload (binary; null of a revisit). A record whose length differs from its Content-Length fails.

    Files are split at the archive's token, which no payload can hold, so a file of any size is read by many tasks.
    """
    lines = spark.read.option("lineSep", _delimiter(token)).text(path).where("value <> ''")
    first = f"WARC/1.1{CRLF}WARC-Archive-Token: {token}{CRLF}"
    value = F.when(F.col("value").startswith(first), F.expr(f"substring(value, {len(first) + 1})")).otherwise(F.col("value"))
    cut = lines.select(value.alias("_v")).withColumn("_head", F.substring_index("_v", CRLF * 2, 1))
    field = lambda name: F.nullif(F.regexp_extract("_head", rf"(?:^|\n){name}: ([^\r\n]*)", 1), F.lit(""))
    body = F.expr("substring(cast(_v as binary), octet_length(_head) + 5)")
    length = field("Content-Length").cast("int")
    out = cut.withColumn("_body", body).withColumnRenamed("_body", "_block").withColumn("_n", length)
    # The last record of a file still has its closing line ends.
    whole = F.expr("CASE WHEN octet_length(_block) = _n + 4 THEN substring(_block, 1, _n) WHEN octet_length(_block) = _n THEN _block ELSE raise_error('a record is cut short') END")
    parsed = out.withColumn("_block", whole).withColumn("_http", F.expr(r"octet_length(substring_index(cast(_block as string), '\r\n\r\n', 1)) + 4"))
    kind = field("WARC-Type")
    return parsed.select(
        field("WARC-Page").try_cast("long").alias("page_id"),
        kind.alias("record_type"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Refers-To-Page").try_cast("long").alias("refers_to"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        field("WARC-Payload-Length").cast("long").alias("payload_length"),
        F.when(kind == "response", F.expr("substring(_block, _http + 1)")).alias("payload"),
    )


def _members(data: bytes) -> bytes:
    return gzip.GzipFile(fileobj=io.BytesIO(data)).read() if data[:2] == b"\x1f\x8b" else data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in small letters) and block of each record of a WARC file, plain or compressed record by record. Records
    that break off raise ValueError."""
    data, at = _members(data), 0
    while at < len(data):
        if data[at : at + 2] == CRLF.encode():
            at += 2
            continue
        stop = data.find(CRLF.encode() * 2, at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("no record begins where one is due")
        lines = data[at:stop].decode("utf-8", "replace").split(CRLF)[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin, n = stop + 4, int(fields["content-length"])
        if begin + n > len(data):
            raise ValueError("a record is cut short")
        yield fields, data[begin : begin + n]
        at = begin + n


FOREIGN = "record_id string, record_type string, url string, date string, refers_to_url string, payload_digest string, payload binary"


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of any WARC files: record_id, record_type, url, date, refers_to_url, payload_digest as
    declared, and payload (of HTTP responses the body; null of a revisit). A file is read by one task."""

    def step(batch):
        for data in batch.column(0).to_pylist():
            rows = []
            for f, block in parse(data):
                kind = f.get("warc-type")
                if kind not in ("response", "revisit"):
                    continue
                body = block.partition(CRLF.encode() * 2)[2] if f.get("content-type", "").startswith("application/http") else block
                rows.append((f.get("warc-record-id"), kind, f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-refers-to-target-uri"), f.get("warc-payload-digest"), body if kind == "response" else None))
            kinds = [pa.string()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in FOREIGN.split(", ")])

    return map_batches(spark.read.format("binaryFile").load(path).select("content"), FOREIGN, lambda: step)


def resolve_any(archive: DataFrame) -> DataFrame:
    """Revisits of ``read_any``'s records joined to the original responses of their declared digest: record_id, record_type, url,
    payload_digest and payload, from the response of least date and id. Headers meet first; only payloads that a revisit asks
    for are shuffled again. A revisit without an original keeps a null payload."""
    revisits = archive.where("record_type = 'revisit'").select("record_id", "record_type", "url", "payload_digest")
    originals_ = archive.where("record_type = 'response' AND payload_digest IS NOT NULL").groupBy("payload_digest").agg(F.min(F.struct("date", "record_id")).alias("o"))
    wanted = revisits.join(written(originals_.select("payload_digest", "o.record_id").withColumnRenamed("record_id", "_original"), "originals"), "payload_digest", "left")
    needed = written(wanted.select("_original").where("_original IS NOT NULL").distinct(), "needed")
    payloads = archive.where("record_type = 'response'").join(small(needed), F.col("record_id") == F.col("_original"), "left_semi").select(F.col("record_id").alias("_original"), "payload")
    found = wanted.join(payloads, "_original", "left").select("record_id", "record_type", "url", "payload_digest", "payload")
    return archive.where("record_type = 'response'").select("record_id", "record_type", "url", "payload_digest", "payload").unionByName(found)


def resolve(archive: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """One row a record, revisits joined to their original responses by payload digest: page_id, payload_bytes and
    payload_digest of the full payload as it was read back, record_type and refers_to. Only headers are shuffled. A
    revisit whose original isn't in the archive keeps what its own headers say, with a null refers_to."""
    responses = archive.where("record_type = 'response'").select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    # Written, so that both sides of the join come straight from a shuffle and Spark can split a hot digest.
    known = written(responses.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("_original"), F.min("payload_bytes").alias("_bytes")), "known")
    revisits = archive.where("record_type = 'revisit'").select("page_id", "payload_digest", "payload_length").join(known, "payload_digest", "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", F.coalesce("_bytes", "payload_length").alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), F.col("_original").alias("refers_to"))
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a fresh archive in the shared folder, read it back and resolve it.

    Null html is an empty payload, a null url leaves its header out, a null page_id reads back as null (and is a revisit
    where an equal payload has an id). Records have ids of their own whatever the page_id. Repeated rows with the least page_id are all responses. Empty tables give no rows;
    other columns are left out.
    """
    spark = pages.sparkSession
    path = table_path(spark, "warc")
    token = write_archive(pages, path)
    return resolve(read_archive(spark, path, token))
