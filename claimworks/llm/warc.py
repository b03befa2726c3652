"""WARC archives with revisit resolution.

Headers come first: every page's payload digest and length, shuffled by digest, name the least page_id of each digest, and the
other pages of the digest become revisits of it. The list of revisits is written to the shared folder; its size is then known
and Spark's own limit decides whether it is broadcast to the pages or both are shuffled. Pages are written as one record each,
a response with its payload or a revisit with fresh headers only, by Spark's text writer, so a lost task's file is written
again and never left half done. Reading takes archives as whole files of a bounded size and walks their records by
Content-Length, whatever the payloads hold.

Defined results: null html is an empty payload; payloads of fewer than least bytes are all responses; where several rows have
the least page_id of a digest, all of them are responses; rows without page_id come after all others; null urls are empty
ones; repeated rows give a record each; an empty table gives empty archives; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimworks.llm import _tables
from claimworks.llm._lineage import shared_folder

#: Bytes of payload that an archive holds, about.
ARCHIVE = 8 << 20
DATE = "1970-01-01T00:00:00Z"
#: Fixed by the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"


def base32(hex40) -> F.Column:
    """Upper-case base32 of a column with 40 hexadecimal digits: 40 bits, ten digits, at a time."""
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(pages: DataFrame) -> DataFrame:
    """page_id, digest, bytes of every payload."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select("page_id", base32(F.sha1(payload)).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))


def revisits(heads: DataFrame, least: int = 0) -> DataFrame:
    """page_id, digest, refers_to of the pages that repeat another's payload; heads: as headers() gives them."""
    heads = heads.where(F.col("bytes") >= least)
    first = heads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return heads.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def _id(page) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """value: each page's record without the empty lines that end it."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ").alias("url"), html.alias("html"), base32(F.sha1(html.cast("binary"))).alias("digest"))
    r = repeated.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")
    pages = pages.join(r, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(_END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    extra = F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _id(F.col("refers_to")), F.lit("\r\n"))).otherwise(F.lit(""))
    value = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), _id(F.col("page_id")), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"), extra, F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block,
    )
    return pages.select(value.alias("value"))


def write(pages: DataFrame, folder: str, *, least: int = 0) -> None:
    """Writes the pages' archives into a new folder."""
    spark = pages.sparkSession
    heads = headers(pages)
    index = f"{folder}.revisits"
    revisits(heads, least).write.parquet(index)
    size = heads.agg(F.avg("bytes")).first()[0] or 0
    per_file = max(1, int(ARCHIVE / (size + 500)))
    records(pages, spark.read.parquet(index)).write.option("lineSep", _END).option("maxRecordsPerFile", per_file).text(folder)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:end].decode().split("\r\n")
        if not re.match(r"WARC/\d", first):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(head["content-length"])
        yield head, archive[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in revisits) of every record."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                out = []
                for head, block in parse(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)[1])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    full = head["warc-type"] == "response"
                    if full and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{head['warc-record-id']}: the payload is not what its headers say")
                    out.append((_page(head["warc-record-id"]), head["warc-target-uri"], size, digest, head["warc-type"], _page(head.get("warc-refers-to")), payload if full else None))
                if out:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types.types)], schema=types)

    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(_tables.read(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_warc": op9_warc}
ORACLE = {
    "op9_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS x FROM pages),
v AS (SELECT page_id, n, list_transform(generate_series(0, 7), lambda i: CAST('0x' || substr(x, 5 * i + 1, 5) AS BIGINT)) AS v FROM p),
d AS (SELECT page_id, n, array_to_string(list_transform(v, lambda y: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((y >> b) & 31) + 1, 1)), '')), '') AS digest FROM v),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS least FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM f
"""
}
