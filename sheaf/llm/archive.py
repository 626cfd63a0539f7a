"""Content-addressed WARC archive.

Payload bytes are stored once, by their verified SHA-256, apart from the exact header blocks of
the records; joining the two by digest gives the original records back byte for byte.  A
response is its header block and the payload; a revisit has no block of its own and names the
response that it refers to and the payload's digest and length.

``payloads``: digest, payload, bucketed by digest.  ``headers``: page_id, digest, header (the
record's header block with its blank line), alone (a response with a long payload), buckets
(their number).  Both are Parquet tables; as payloads lie in buckets, a join reads them where
they are and moves only the headers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import group_value, shared_dir

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Parts into which the headers of one digest are dealt for the join with its payload.
SALTS = 32
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
END = f"{CRLF}{CRLF}"


def record_uri(page_id, *more):
    """A record id that depends on the page alone (and ``more`` where it has no id), so a retried task writes the same."""
    named = F.coalesce(page_id.cast("string"), F.concat_ws(" ", F.lit("none"), *more))
    h = F.md5(named.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]), F.lit(">"))


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Write the two tables of ``pages`` (page_id, url, html) below ``folder``.

    Of the records with equal payloads of at least ``least_bytes`` the one with the smallest
    page_id is the response and the others are revisits of it.  A null html is an empty
    payload.  Null page_ids come last, and their records are named by url and digest; rows that
    share the smallest page_id and the payload are all responses.  An empty table gives empty
    tables.  A payload of any length that a row can hold is stored whole; other columns are
    left out.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    records = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"))
    spark = pages.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal digests carry equal bytes: any row's payload is the group's
    once = records.select(F.sha2("payload", 256).alias("digest"), "payload").groupBy("digest").agg(F.first("payload").alias("payload"))
    table = f"sheaf_payloads_{uuid.uuid4().hex}"
    once.write.format("parquet").option("path", f"{folder}/payloads").bucketBy(buckets, "digest").saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay: they are outside the warehouse
    light = records.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    long = F.col("size") >= least_bytes
    # short payloads are responses whatever else there is, so they meet no one in a join
    first = group_value(light.where(long), "digest", ("page_id", "url"), F.min("page_id"), F.min, "first_id")
    placed = first.unionByName(light.where(~long).withColumn("first_id", F.lit(None).cast("long")))
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_uri(F.col("page_id"), F.col("url"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        # a line feed in a URL would end the header line
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]+", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_uri(F.col("first_id"))), line("X-Refers-To-Page", F.col("first_id").cast("string")), line("X-Payload-Length", F.col("size").cast("string")))).otherwise(""),
        F.when(revisit, "").otherwise(line("Content-Type", F.lit("text/html; charset=utf-8"))),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("size").cast("string"))),
        F.lit(CRLF),
    )
    placed.select("page_id", "digest", (long & ~revisit).alias("alone"), F.lit(buckets).alias("buckets"), header.alias("header")).write.parquet(f"{folder}/headers")


def verified(spark, folder: str) -> DataFrame:
    """digest, payload, checked: the stored payloads and whether their bytes have their digest."""
    head = spark.read.parquet(f"{folder}/headers").select("buckets").first()
    buckets = head["buckets"] if head else 1
    table, place = f"sheaf_payloads_{uuid.uuid4().hex}", f"{folder}/payloads".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} (digest STRING, payload BINARY) USING parquet CLUSTERED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}'")
    stored = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return stored.withColumn("checked", F.sha2("payload", 256) == F.col("digest"))


def reconstruct(spark, folder: str) -> DataFrame:
    """page_id, digest, payload_bytes, checked, record: header block, payload (responses) and the two closing line ends, as bytes.

    A response with a long payload is the only one with its digest, so it meets its payload
    directly.  Revisits and short payloads may have one digest in very many pages: they are
    dealt under several salts, each of which meets one copy of what the store says.
    """
    stored = verified(spark, folder).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    heads = spark.read.parquet(f"{folder}/headers")
    single = heads.where("alone").join(stored, "digest", "left").select("page_id", "digest", "header", "payload_bytes", "checked", "payload")
    many = heads.where("not alone").withColumn("salt", F.pmod(F.xxhash64("page_id", "header"), F.lit(SALTS)))
    revisit = F.col("header").startswith(f"WARC/1.1{CRLF}WARC-Type: revisit{CRLF}")
    said = many.groupBy("digest", "salt").agg(F.min(revisit).alias("bare")).join(stored, "digest", "left").select("digest", "salt", "payload_bytes", "checked", F.when(~F.col("bare"), F.col("payload")).alias("payload"))
    rest = many.join(said, ["digest", "salt"], "left").select("page_id", "digest", "header", "payload_bytes", "checked", F.when(~revisit, F.col("payload")).alias("payload"))
    none = F.lit("").cast("binary")
    record = F.concat(F.col("header").cast("binary"), F.when(revisit, none).otherwise(F.coalesce("payload", none)), F.lit(END).cast("binary"))
    return single.unionByName(rest).select("page_id", "digest", "payload_bytes", F.coalesce("checked", F.lit(False)).alias("checked"), record.alias("record"))


def parse(records: DataFrame) -> DataFrame:
    """Add head, block, kind, named, said_bytes and refers_to, read from the bytes of ``record`` alone."""
    # one character a byte, so places are places of bytes; the first blank line ends the head
    at = F.locate(END, F.expr("decode(record, 'ISO-8859-1')"))
    records = records.withColumn("at", at)
    head = F.expr("cast(substring(record, 1, at + 1) as string)")
    block = F.expr("CASE WHEN at > 0 THEN substring(record, at + 4, octet_length(record) - at - 7) END")

    def field(name: str):
        found = F.regexp_extract("head", f"\\n{name}: ([^\\r\\n]*)", 1)
        return F.when(found != "", found)

    parsed = records.withColumn("head", head).withColumn("block", block).drop("at")
    return parsed.withColumns(
        {
            "kind": field("WARC-Type"),
            "named": F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", ""),
            "block_bytes": field("Content-Length").cast("long"),
            "said_bytes": F.coalesce(field("X-Payload-Length"), field("Content-Length")).cast("long"),
            "refers_to": field("X-Refers-To-Page").cast("long"),
        }
    )


def read(spark, folder: str) -> DataFrame:
    """The records as read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Every record is rebuilt as bytes and parsed.  A response's length and digest are those of
    the bytes in its block, a revisit's those of the stored payload that it names; a record
    whose payload is missing, fails its digest or contradicts its header ends the query.
    """
    records = parse(reconstruct(spark, folder))
    response = F.col("kind") == "response"
    digest = F.when(response, F.sha2("block", 256)).otherwise(F.col("digest"))
    size = F.when(response, F.octet_length("block").cast("long")).otherwise(F.col("payload_bytes"))
    fine = F.col("checked") & (digest == F.col("named")) & (size == F.col("said_bytes")) & (F.octet_length("block") == F.col("block_bytes"))
    broken = F.raise_error(F.concat(F.lit("archive record is broken: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    return records.select("page_id", F.when(F.coalesce(fine, F.lit(False)), size).otherwise(broken.cast("long")).alias("payload_bytes"), digest.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op8(spark, sf_dir: str) -> DataFrame:
    """Contract query: all pages archived and read back."""
    folder = shared_dir(spark)
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(spark, folder)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, min(page_id) AS first_id FROM r WHERE payload_bytes >= 100 GROUP BY 1)
SELECT r.page_id, CAST(r.payload_bytes AS BIGINT) AS payload_bytes, r.payload_digest,
       CASE WHEN m.first_id <> r.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.first_id <> r.page_id THEN m.first_id END AS refers_to
FROM r LEFT JOIN m ON r.payload_digest = m.payload_digest
"""
