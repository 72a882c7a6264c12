"""Content-addressed web archive: payload bytes once, record headers apart, records rebuilt by joins.

``headers`` keeps the exact header block of every WARC record and the digest of its payload; ``payloads`` keeps the
bytes of each distinct payload under its SHA-256, whatever the number of records.  A record is its header block, the
payload (for responses) and two line ends, so joining both tables by digest gives every record back byte for byte.
Digests are verified twice: when equal SHA-256 values meet, SHA-1 and length must agree as well; when payloads are
read, their digests are computed anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.session import materialize

#: The base32 alphabet and the header lines of a record.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Records that one copy of a payload serves when records are rebuilt; a payload of more is sent as often as needed.
SERVED = 256


def base32(hex_digest: Column, digits: int = 40) -> Column:
    """Base32 of a digest given in hexadecimal; ``digits`` is a multiple of five."""
    chars = []
    for start in range(0, digits, 5):
        twenty = F.conv(F.substring(hex_digest, start + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(BASE32), F.shiftright(twenty, shift).bitwiseAND(31) + 1, F.lit(1))
                  for shift in (15, 10, 5, 0)]
    return F.concat(*chars)


@dataclass
class Archive:
    """Both tables of an archive: ``headers`` (page_id, sha256, header, copy) and ``payloads`` (sha256, sha1, payload, copies).

    ``copies`` is how often a payload is sent when records are rebuilt, ``copy`` which of these serves the record.
    """

    headers: DataFrame
    payloads: DataFrame


#: The profile of a revisit to an equal payload, and the type of the payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTENT_TYPE = "text/html; charset=utf-8"


def _header(page: Column, url: Column, kind: Column, first: Column, sha1: Column, length: Column, date: str) -> Column:
    """The record's header block, up to and with the empty line before its content."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    block = F.when(kind == "response", length).otherwise(F.lit(0))
    return F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", kind), line("WARC-Date", F.lit(date)),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))),
        F.when(url.isNotNull(), line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", "%0A"))).otherwise(""),
        F.when(kind == "revisit", line("WARC-Refers-To", F.concat(
            F.lit("<urn:page:"), F.coalesce(first.cast("string"), F.lit("none")), F.lit(">")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        line("WARC-Payload-Length", length.cast("string")),
        F.when(kind == "revisit", line("WARC-Profile", F.lit(PROFILE))).otherwise(line("Content-Type", F.lit(CONTENT_TYPE))),
        line("Content-Length", block.cast("string")), F.lit(CRLF)).cast("binary")


def _copies(n_records: Column) -> Column:
    return F.ceil(n_records / SERVED)


def write_archive(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Archive one record per row; of records with equal payloads the smallest id holds it, the others revisit it.

    Payloads shorter than ``least`` bytes are responses in every record.  A null payload is empty, a null id sorts
    last, a null URL leaves its line out (line ends in a URL become %0A).  Rows that repeat the id of the holder are
    responses too; their payload is still kept once.  ``date`` is the capture time of all records (the rows have none).  An empty table gives an empty archive.  Other columns are left out.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    seen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("hex"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"))
    kept = (seen.groupBy("sha256").agg(
        F.min("page_id").alias("first"), F.min("hex").alias("hex"), F.min("payload_bytes").alias("payload_bytes"),
        _copies(F.count("*")).alias("copies"), F.assert_true((F.min("hex") == F.max("hex")) & (F.min("payload_bytes") == F.max("payload_bytes")),
                      "payloads that differ share a SHA-256").alias("same"))
        .where("same is null").withColumn("payload_digest", base32(F.col("hex"))))
    records = materialize(seen.select("page_id", "url", "sha256").join(kept.drop("hex", "same"), "sha256").withColumn(
        "record_type", F.when((F.col("payload_bytes") < least) | F.col("page_id").eqNullSafe(F.col("first")), "response")
        .otherwise("revisit")), "warc-records")
    headers = records.select("page_id", "sha256", _header(
        F.col("page_id"), F.col("url"), F.col("record_type"), F.col("first"), F.col("payload_digest"),
        F.col("payload_bytes"), date).alias("header"), F.pmod(F.monotonically_increasing_id(), F.col("copies")).alias("copy"))
    # one copy of each payload leaves a map task, whatever the number of records that share it
    stored = (pages.select(F.sha2(payload, 256).alias("sha256"), payload.alias("payload")).groupBy("sha256")
              .agg(F.first("payload").alias("payload"), _copies(F.count("*")).alias("copies"))
              .withColumn("sha1", F.sha1("payload")))
    return Archive(materialize(headers, "warc-headers"), materialize(stored, "warc-payloads"))


def _parsed(archive: Archive) -> DataFrame:
    """The fields of all header blocks."""
    text = F.col("header").cast("string")
    field = lambda name, what: F.regexp_extract(text, rf"\n{name}: {what}\r\n", 1)
    page = lambda name: field(name, "<urn:page:(-?[0-9]*)[a-z]*>").try_cast("long")
    return archive.headers.select(
        "sha256", "header", "copy", page("WARC-Record-ID").alias("page_id"), field("WARC-Type", "([a-z]+)").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"), field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})").alias("payload_digest"),
        field("WARC-Payload-Length", "([0-9]+)").cast("long").alias("payload_bytes"))


def _sound() -> Column:
    """Whether a stored payload has the digests under which it is kept."""
    return (F.sha2("payload", 256) == F.col("sha256")) & (F.sha1("payload") == F.col("sha1"))


def _agreeing(joined: DataFrame) -> DataFrame:
    """The rows, each with a sound payload of the length and digest that its header block names, or an error."""
    right = F.coalesce(F.col("sound") & (F.col("stored_bytes") == F.col("payload_bytes"))
                       & (F.col("stored_digest") == F.col("payload_digest")), F.lit(False))
    return joined.where(F.assert_true(right, "a record's payload is missing or damaged").isNull())


def read_records(archive: Archive) -> DataFrame:
    """All records of an archive: page_id, header, payload_bytes, payload_digest, record_type, refers_to, sha256.

    Fields are parsed from the header blocks.  A payload whose digest is not its key, or a record whose payload is
    missing or of another digest or length, ends the job with an error.
    """
    checked = archive.payloads.select(
        "sha256", F.octet_length("payload").cast("long").alias("stored_bytes"), base32(F.col("sha1")).alias("stored_digest"),
        _sound().alias("sound"))
    return _agreeing(_parsed(archive).join(checked, "sha256", "left")).select(
        "page_id", "header", "payload_bytes", "payload_digest", "record_type", "refers_to", "sha256")


def rebuild(archive: Archive) -> DataFrame:
    """The original records: page_id, record (bytes), payload, payload_bytes, payload_digest, record_type, refers_to.

    The payload of a response is cut out of its rebuilt record, that of a revisit is what the response it refers to
    holds; length and digest are computed from it for every record.  A payload that many records share is sent several
    times, so that no task has all of them.  What :func:`read_records` refuses ends this job as well.
    """
    sent = archive.payloads.select("sha256", F.col("payload").alias("stored"), _sound().alias("sound"),
                                   F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    # headers are the small side: payloads stream past them without being sorted
    joined = _parsed(archive).hint("shuffle_hash").join(sent, ["sha256", "copy"], "left")
    end = F.lit(f"{CRLF}{CRLF}".encode())
    response = F.col("record_type") == "response"
    rebuilt = joined.withColumn("record", F.concat("header", F.when(response, F.col("stored")).otherwise(F.lit(b"")), end))
    start = F.octet_length("header")
    payload = F.when(response, F.substring("record", start + 1, F.octet_length("record") - start - 4)).otherwise(F.col("stored"))
    found = rebuilt.withColumn("payload", payload).withColumn("hex", F.sha1("payload")).withColumns({
        "stored_bytes": F.octet_length("payload").cast("long"), "stored_digest": base32(F.col("hex"))})
    return _agreeing(found).select("page_id", "record", "payload", F.col("stored_bytes").alias("payload_bytes"),
                                   F.col("stored_digest").alias("payload_digest"), "record_type", "refers_to")


def archive_at(spark: SparkSession, path: str) -> Archive:
    """An archive stored with :func:`save`."""
    return Archive(spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads"))


def save(archive: Archive, path: str) -> None:
    archive.headers.write.parquet(f"{path}/headers")
    archive.payloads.write.parquet(f"{path}/payloads")
