"""Content-addressed WARC archive (operator 9).

An archive is two tables in the shared folder: ``payloads``, every distinct payload once under its SHA-256, and
``headers``, each record's exact header bytes with the digest it points to. A record is its header, its block (the
payload for a response; none for a revisit) and two line ends; ``records`` puts them together again by a join, after
checking each payload against its digest once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import id_and, written

#: Equal payloads below this size are all kept as responses.
LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """The two written tables: headers (header binary, digest) and payloads (digest, payload)."""

    headers: DataFrame
    payloads: DataFrame


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Write a record for each page: a response, or a revisit of the smallest page_id with the same payload of 100 bytes or more.

    Null html is an empty payload. Rows without page_id are never referred to; if no row of a payload has one, all
    are responses. Repeated page_ids give a record each. A null url has no target line; line ends in a url are
    percent-coded. An empty table gives an empty archive. Other columns are not looked at.
    """
    rows = id_and(pages, key, url, html).select(
        F.col(key).alias("page_id"),
        F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A").alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    payloads = written(rows.groupBy("digest").agg(F.first("payload").alias("payload")), "warc-payloads")
    # only digests that more rows than one share need a look at each other
    thin = rows.select("page_id", "url", "digest", F.octet_length("payload").alias("bytes"))
    owners = thin.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = thin.join(owners, "digest", "left")
    again = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        F.coalesce(_line("WARC-Target-URI", F.col("url")), F.lit("")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(_line("WARC-Refers-To", _urn(F.col("owner"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(again, 0).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
    )
    headers = written(met.select(F.encode(header, "UTF-8").alias("header"), "digest"), "warc-headers")
    return Archive(headers, payloads)


def verified(archive: Archive) -> DataFrame:
    """The payloads with their length, each checked against the digest it is stored under."""
    whole = F.sha2("payload", 256) == F.col("digest")
    bad = F.concat(F.lit("payload does not match its digest "), F.col("digest"))
    return archive.payloads.select(F.when(whole, F.col("digest")).otherwise(F.raise_error(bad)).alias("digest"), "payload", F.octet_length("payload").cast("long").alias("bytes"))


def records(archive: Archive) -> DataFrame:
    """(record, payload, digest): the original records' bytes, and the full payload each stands for."""
    met = archive.headers.join(verified(archive), "digest")
    revisit = field("WARC-Type") == "revisit"
    block = F.when(revisit, F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return met.select(F.concat("header", block, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"), "payload", "digest")


def field(name: str, of: str = "header") -> Column:
    """A header field's value; null if the header has no such line."""
    found = F.regexp_extract(F.decode(F.col(of), "UTF-8"), f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def read_archive(archive: Archive) -> DataFrame:
    """Each record as its header tells it, with the length and digest of the full payload that was stored for it.

    Returns page_id, url, payload_bytes, payload_digest, record_type and refers_to. Fails if a payload is not what
    its digest says, or a response's length not what its header says.
    """
    facts = verified(archive).select("digest", "bytes")
    told = archive.headers.select(
        page_of(field("WARC-Record-ID")).alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        page_of(field("WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1).alias("digest"),
        field("Content-Length").cast("long").alias("length"),
    )
    met = told.join(facts, "digest")
    right = F.col("length") == F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("bytes"))
    return met.select("page_id", "url", F.when(right, F.col("bytes")).otherwise(F.raise_error(F.lit("a record's length is not its header's"))).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Every page of ``pages``, written to an archive and read back from it."""
    archive = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, CAST(coalesce(html, '') AS VARCHAR) AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
o AS (SELECT payload_digest, min(page_id) AS owner FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> owner THEN owner END AS refers_to
FROM d JOIN o USING (payload_digest)
"""
