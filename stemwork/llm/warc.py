"""Content-addressed web archive: payload bytes once by digest, exact record headers apart.

An archive is two Parquet tables in one folder. `payloads` holds each distinct payload once under its
SHA-256; `records` holds each record's header block byte for byte, its place, and the key of its payload.
A record's original bytes are header block, payload and the two line ends, which a join brings together.
Keys are verified when an archive is written (equal keys must have equal SHA-1 and length) and when it is
read (the digest of the stored bytes is computed anew).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import shared_dir

#: RFC 4648 alphabet of base32. Fixed values.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a hex digest of 40 digits, by groups of 20 bits."""
    letters = []
    for g in range(8):
        bits = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _header(kind: Column) -> Column:
    """A WARC/1.1 header block up to and with its blank line; null fields are left out."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.col("rid").cast("string")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, urn(F.concat_ws(":", F.coalesce(F.col("w_id").cast("string"), F.lit("null")), F.col("w_rid").cast("string"))))),
        line("X-Payload-Length", F.col("n").cast("string")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes one record per row of pages (page_id, url, html; other columns are not read).

    Payload is html in UTF-8, null as empty. Of equal payloads of at least min_bytes, the row with the
    largest page_id is the response and the others revisit it; of repeated rows with that page_id one is.
    Null page_ids are smaller than any. Shorter payloads are all responses. A record's id is its page_id and the
    number of its row, so repeated page_ids have records of their own.
    """
    raw = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), raw.alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    # row numbers are made once and kept, so that a second reading of the pages can't change them
    heads = rows.select("page_id", "url", "key", F.length("payload").cast("long").alias("n"), base32_of_hex(F.sha1("payload")).alias("sha1"), F.monotonically_increasing_id().alias("rid"))
    heads.write.parquet(f"{path}/heads")
    heads = pages.sparkSession.read.schema(heads.schema).parquet(f"{path}/heads")
    top = F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "rid")).alias("w")
    same = F.when((F.min("sha1") == F.max("sha1")) & (F.min("n") == F.max("n")), F.col("w_key")).otherwise(F.raise_error(F.concat(F.lit("two payloads under one digest: "), F.col("w_key"))))
    winners = heads.withColumnRenamed("key", "w_key").groupBy("w_key").agg(top, same.alias("checked")).select(F.col("checked").alias("w_key"), F.col("w.page_id").alias("w_id"), F.col("w.rid").alias("w_rid"))
    # any of equal payloads will do, so payloads move once: each task sends one of its copies
    rows.select("key", "payload").dropDuplicates(["key"]).write.parquet(f"{path}/payloads")
    kind = F.when((F.col("n") >= min_bytes) & (F.col("rid") != F.col("w_rid")), F.lit("revisit")).otherwise(F.lit("response"))
    records = heads.join(winners, F.col("key") == F.col("w_key"))
    records.select("rid", F.encode(_header(kind), "UTF-8").alias("header"), "key").write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """rid, header (exact bytes), key, payload (of the content, for revisits too), payload_bytes, record (the record's bytes).

    Fails where stored bytes don't have the digest they are stored under. Digest and length are taken of the stored bytes
    before the join, so that payloads move only where they or the records are asked for.
    """
    found = F.when(F.sha2("payload", 256) == F.col("p_key"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("p_key"))))
    payloads = spark.read.parquet(f"{path}/payloads").withColumnRenamed("key", "p_key").select("p_key", found.alias("payload"), F.length(found).cast("long").alias("payload_bytes"))
    joined = spark.read.parquet(f"{path}/records").join(payloads, F.col("key") == F.col("p_key")).drop("p_key")
    ends = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    revisit = field("WARC-Type") == "revisit"
    return joined.withColumn("record", F.when(revisit, F.concat("header", ends)).otherwise(F.concat("header", "payload", ends)))


def field(name: str) -> Column:
    """A field of the header block, null if absent."""
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), rf"(?md)^{name}: ([^\r\n]*)\r$", 1), F.lit(""))


def fields(archive: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to as parsed from the header blocks."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):\d+>$", 1).try_cast("long")
    return archive.select(
        number(field("WARC-Record-ID")).alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        "payload_bytes",
        F.regexp_extract(field("WARC-Payload-Digest"), r"^sha1:(\w+)$", 1).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        number(field("WARC-Refers-To")).alias("refers_to"),
    )


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes an archive of pages to the shared folder and reads its records back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/stemwork/archive-{uuid.uuid4().hex}"
    write_archive(pages, path, min_bytes)
    return read_archive(spark, path)
