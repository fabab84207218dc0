"""Content-addressed WARC archive.

``write_archive`` stores every distinct payload once, under its SHA-256, and
keeps the exact header of every record in a second table.  Rows of one digest
are compared by length and by a second, independent hash before one of them
stands for all; a mismatch raises.  Of equal payloads of at least ``min_bytes``
the record with the smallest id is the response and the others revisit it.

``read_contents`` recomputes each stored payload's digests and raises if one
differs from its address.  ``read_records`` joins headers with the checked
contents; ``restore`` joins them with the bytes and gives every original record
back: header, blank line, block, blank line.

Payloads move once, combined on the map side first, so a payload that a third of
all pages share leaves a task once.  The joins are on narrow rows, and adaptive
execution splits a digest that most records share.

Defined cases: a null payload counts as empty.  A null id comes after all others
and is written as ``~``; ids of any type are percent-encoded in headers.  Of rows equal in id, URL and payload the first is
the response, the others revisit it.  A null URL leaves out its header line;
line ends in a URL are percent-encoded.  An empty table gives empty archives.
Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.session import scratch_path

MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"   # pages carry no date
# Fixed values of the formats.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of bytes in upper-case base32: 20 bits, five hex digits, are four letters."""
    digest = F.sha1(payload)
    letters = []
    for at in range(1, 41, 5):
        bits = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _checked(ok: Column, message: str, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def _line(name: str, value) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def record_name(page: Column, time: Column) -> Column:
    """``<urn:page:ID>``, with ``:n`` behind the id of a repeated row; a null id is ``~``, which no encoded id holds."""
    return F.concat(F.lit(f"<{NAME}"), F.coalesce(F.url_encode(page.cast("string")), F.lit("~")),
                    F.when(time > 1, F.concat(F.lit(":"), time)).otherwise(F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, id_col: str = "page_id",
                  url_col: str = "url", payload_col: str = "html") -> None:
    """Write ``path/contents`` (sha256, payload) and ``path/records`` (sha256, header)."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"),
                        F.sha2(payload, 256).alias("sha256"), payload.alias("payload"))
    check = F.xxhash64("payload")
    contents = rows.groupBy("sha256").agg(F.first("payload").alias("payload"), F.min(check).alias("a"), F.max(check).alias("b"),
                                          F.min(F.octet_length("payload")).alias("m"), F.max(F.octet_length("payload")).alias("n"))
    same = (F.col("a") == F.col("b")) & (F.col("m") == F.col("n"))
    (contents.select(_checked(same, "two payloads have one SHA-256", F.col("sha256")).alias("sha256"), "payload")
     .write.option("compression", "zstd").parquet(f"{path}/contents"))

    narrow = (rows.select("page", "url", "sha256", F.octet_length("payload").cast("long").alias("bytes"),
                          base32_sha1(F.col("payload")).alias("sha1"))
              .groupBy("page", "url", "sha256", "bytes", "sha1").agg(F.count(F.lit(1)).cast("int").alias("times")))
    order = F.struct(F.col("page").isNull().alias("none"), "page", F.col("url").isNull().alias("nowhere"), "url")
    first = narrow.groupBy("sha256").agg(F.min(order).alias("first")).select(F.col("sha256"), "first.page", "first.url")
    first = first.select("sha256", F.col("page").alias("first_page"), F.col("url").alias("first_url"))
    each = narrow.join(first, "sha256").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    own = F.col("page").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("time") == 1)
    response = own | (F.col("bytes") < min_bytes)
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _line("WARC-Record-ID", record_name(F.col("page"), F.col("time"))), _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", uri), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(~response, record_name(F.col("first_page"), F.lit(1)))),
        _line("WARC-Profile", F.when(~response, F.lit(REVISIT_PROFILE))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(response, F.col("bytes")).otherwise(F.lit(0)).cast("string")))
    each.select("sha256", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, payload, bytes, sha1) of every stored payload, recomputed from its bytes."""
    stored = spark.read.parquet(f"{path}/contents")
    sound = F.sha2("payload", 256) == F.col("sha256")
    return stored.select(_checked(sound, "a stored payload does not match its address", F.col("sha256")).alias("sha256"),
                         "payload", F.octet_length("payload").cast("long").alias("bytes"),
                         base32_sha1(F.col("payload")).alias("sha1"))


def field(name: str) -> Column:
    """The value of a header line, null if there is none."""
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def page_of(name: Column, id_type="long") -> Column:
    """The id in a record's name, as ``id_type``."""
    found = F.regexp_extract(name, rf"^<{NAME}([^:>]*)", 1)
    return F.when(found != "~", F.url_decode(found)).cast(id_type)


def read_records(spark: SparkSession, path: str, id_type="long") -> DataFrame:
    """One row per record: header, its fields, and size and digest of its checked payload.

    Headers hold ids as text; ``id_type`` is the type that they had.
    """
    records = spark.read.parquet(f"{path}/records")
    known = read_contents(spark, path).select("sha256", "bytes", "sha1")
    return records.join(known, "sha256").select(
        page_of(field("WARC-Record-ID"), id_type).alias("page_id"), field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("url"), page_of(field("WARC-Refers-To"), id_type).alias("refers_to"),
        F.col("bytes").alias("payload_bytes"),
        _checked(field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1")),
                 "a header's digest does not match its payload", F.col("sha1")).alias("payload_digest"), "header")


def restore(spark: SparkSession, path: str, id_type="long") -> DataFrame:
    """(page_id, record, payload): the exact bytes of every record, and the payload that it stands for."""
    joined = spark.read.parquet(f"{path}/records").join(read_contents(spark, path), "sha256")
    end = F.lit("\r\n").cast("binary")
    block = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return joined.select(page_of(field("WARC-Record-ID"), id_type).alias("page_id"),
                         F.concat(F.col("header").cast("binary"), end, block, end, end).alias("record"), "payload")


def archive(pages: DataFrame, **how) -> DataFrame:
    """Write the archive to the shared folder and read its records back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path, **how)
    return read_records(pages.sparkSession, path, pages.schema[how.get("id_col", "page_id")].dataType)
