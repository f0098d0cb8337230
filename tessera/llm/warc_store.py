"""A content-addressed web archive.

``write_archive`` makes two tables below one folder: ``payloads`` holds every
different payload once, under its SHA-256; ``records`` holds the exact WARC and
HTTP header bytes of every record, with the digest they refer to.
``read_records`` joins them again into whole WARC records, whose payloads are
digested anew as they are read. Payloads are shuffled once, when one of equal
ones is picked by its row; headers never carry them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import staged

#: What every record says besides its own facts.
WARC_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
RECORD_URI = "urn:x-page:"
#: Payloads below this size are never revisits.
LEAST_BYTES = 100


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _record_id(page: Column) -> Column:
    """The URI of a page's record; what it holds besides the fixed part is the page's id."""
    return F.concat(F.lit("<" + RECORD_URI), F.url_encode(F.coalesce(page.cast("string"), F.lit(""))), F.lit(">"))


def _on_one_line(url: Column) -> Column:
    """A url as it stands in a header: line ends are percent-encoded, the rest is as it was."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _http(length: Column) -> Column:
    return _lines("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: ", length.cast("string"), CRLF + CRLF)


def headers(rows: DataFrame) -> DataFrame:
    """``rows`` (page_id, url, digest, length, refers_to) with record_type, warc_header and http_header."""
    again = F.col("refers_to").isNotNull()
    http = F.encode(_http(F.col("length")), "UTF-8")
    block = F.length(http) + F.when(again, F.lit(0)).otherwise(F.col("length"))
    head = _lines(
        "WARC/1.1" + CRLF + "WARC-Type: ", F.when(again, F.lit("revisit")).otherwise("response"),
        CRLF + "WARC-Record-ID: ", _record_id(F.col("page_id")),
        CRLF + "WARC-Date: " + WARC_DATE + CRLF + "WARC-Target-URI: ", _on_one_line(F.coalesce("url", F.lit(""))),
        CRLF + "WARC-Payload-Digest: sha256:", F.col("digest"),
        F.when(again, _lines(CRLF + "WARC-Profile: " + PROFILE + CRLF + "WARC-Refers-To: ", _record_id(F.col("refers_to")))).otherwise(""),
        CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: ", block.cast("string"), CRLF + CRLF,
    )
    return rows.select("page_id", "digest", "length", "refers_to", F.when(again, F.lit("revisit")).otherwise("response").alias("record_type"), F.encode(head, "UTF-8").alias("warc_header"), http.alias("http_header"))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Write the pages' records below ``folder``.

    Of the records whose payloads of at least ``least_bytes`` are equal, the
    one with the smallest id is the response and the others revisit it.

    Defined results: a null body is an empty payload; a null url is an empty
    one; rows with a null id are written, as responses that nothing refers to;
    rows that repeat an id are records of their own, and those that repeat the
    smallest id are all responses; an empty string as an id is read back as
    null; an empty table gives empty tables.
    """
    body = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8")
    facts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.sha2(body, 256).alias("digest"), F.length(body).cast("long").alias("length"))
    # written, so that the join has a shuffle of its own on both sides and the rows of a very common payload can be split
    first = staged(facts.groupBy("digest").agg(F.min("page_id").alias("first")), "warc-first")
    joined = facts.join(first.hint("merge"), "digest")
    revisits = (F.col("length") >= least_bytes) & (F.col("page_id") != F.col("first"))
    headers(joined.withColumn("refers_to", F.when(revisits, F.col("first")))).write.mode("overwrite").parquet(f"{folder}/records")
    # a payload's one row is found by digest and first id: copies spread by their ids, and rows that repeat both meet where
    # the join put them, so that each payload is shuffled once
    held = pages.select(F.sha2(body, 256).alias("digest"), F.col(id_col).alias("id"), body.alias("payload"))
    spread = lambda i: F.xxhash64("digest", i).alias("spread")
    kept = held.select("digest", spread("id"), "payload").join(first.select("digest", spread("first")).hint("merge"), ["digest", "spread"])
    once = kept.groupBy("digest", "spread").agg(F.first("payload").alias("payload"))
    once.select("digest", "payload").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/payloads")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """digest, payload and verified (whether the stored bytes have that digest)."""
    return spark.read.parquet(f"{folder}/payloads").withColumn("verified", F.sha2("payload", 256) == F.col("digest"))


def _stated(head: Column, name: str) -> Column:
    """What a header line of the WARC header says, null if it isn't there."""
    said = F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)
    return F.when(said != "", said)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type
    and refers_to. All are read from the record's stored header bytes and from
    its payload, which is digested and measured anew; a payload that is lost,
    or that isn't what the headers say, is an error. Bytes of payloads aren't
    shuffled: only what they are is."""
    stored = spark.read.parquet(f"{folder}/payloads").select("digest", F.sha2("payload", 256).alias("found"), F.length("payload").cast("long").alias("size"))
    records = spark.read.parquet(f"{folder}/records")
    id_type = records.schema["page_id"].dataType
    read = records.join(stored, "digest", "left").select("*", F.decode("warc_header", "UTF-8").alias("head"), F.decode("http_header", "UTF-8").alias("http"))
    number = lambda name: F.regexp_extract(_stated(F.col("head"), name), rf"^<{RECORD_URI}(.*)>$", 1)
    page = lambda name: F.url_decode(F.when(number(name) != "", number(name))).cast(id_type)
    again = _stated(F.col("head"), "WARC-Type") == "revisit"
    block = F.length("http_header") + F.when(again, F.lit(0)).otherwise(F.col("size"))
    fine = (
        (F.concat(F.lit("sha256:"), "found") == _stated(F.col("head"), "WARC-Payload-Digest"))
        & (F.col("size").cast("string") == _stated(F.col("http"), "Content-Length"))
        & (block.cast("string") == _stated(F.col("head"), "Content-Length"))
    )
    broken = F.raise_error(F.concat(F.lit("payload lost or changed: "), F.col("digest")))
    return read.select(
        page("WARC-Record-ID").alias("page_id"), F.when(fine, F.col("size")).otherwise(broken.cast("long")).alias("payload_bytes"), F.col("found").alias("payload_digest"),
        _stated(F.col("head"), "WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record (all bytes of the WARC record) and payload (that of the
    response, for revisits too). A payload that is lost or isn't what its
    digest says is an error."""
    records = spark.read.parquet(f"{folder}/records")
    whole = records.join(read_payloads(spark, folder), "digest", "left")
    payload = F.when(F.col("verified"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload lost or changed: "), F.col("digest"))).cast("binary"))
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return whole.select("page_id", payload.alias("payload"), F.concat("warc_header", "http_header", body, F.lit((CRLF * 2).encode())).alias("record")).select("page_id", "record", "payload")


#: Rows of op6.
ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
