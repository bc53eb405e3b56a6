"""WARC archives with revisit records for repeated payloads.

Only headers are compared: payloads of one digest meet as counts and a largest id. A record is then
written once, as a response with its payload or as a revisit that names its response. Archives are
written and read by Spark's text source, byte for byte: the version line and the field that names the
archive's warcinfo record, which is new with every writing, stand before every record and cannot occur
in a payload, so they part the records on reading, in splits of any size.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchsieve.llm.common import written
from patchsieve.session import new_folder

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_BYTES = 1_000
_END = "\r\n"


def _urn(*parts: Column | str) -> Column:
    """A record id of the given parts."""
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) if isinstance(p, Column) else F.lit(p) for p in parts)))
    cut = [h.substr(a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def _lines(*fields: tuple[str, Column | str | None]) -> Column:
    """Header lines of the fields that are not null, each with its line end."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), v if isinstance(v, Column) else F.lit(v), F.lit(_END)), F.lit("")) for name, v in fields))


def _start(key: str) -> str:
    return f"WARC/1.1{_END}WARC-Warcinfo-ID: <urn:uuid:{key}>{_END}"


def write_archives(pages: DataFrame, least_bytes: int = LEAST_BYTES, compression: str = "gzip") -> tuple[str, str]:
    """Write one record per row of `pages` (page_id, url, html); gives the folder and the archive's key.

    Of the rows with one payload of at least `least_bytes` the largest page_id is the response and the
    others revisit it; smaller payloads are all responses. With compression "none" the files are plain.
    """
    spark, key = pages.sparkSession, str(uuid.uuid4())
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), body.alias("body"), F.sha1(body.cast("binary")).alias("digest"),
        F.octet_length(body).cast("long").alias("size"),
        # a line end in a url would end its header
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")), F.lit("urn:page:")),
                                          "\r", "%0D"), "\n", "%0A").alias("uri"))
    repeated = (
        rows.where(F.col("size") >= least_bytes).groupBy("digest")
        .agg(F.max(F.struct("page_id", "uri")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
        .select("digest", F.col("first.page_id").alias("first_id"), F.col("first.uri").alias("first_uri"))
    )
    # a written table has a known size: Spark broadcasts it or shuffles, as that allows
    repeated = written(repeated, "repeated-payloads")
    known = rows.join(repeated, "digest", "left").withColumn(
        "revisit", F.coalesce((F.col("size") >= least_bytes) & F.col("first_uri").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False)))
    revisit = F.col("revisit")
    first = _urn(key, "response", F.col("first_id"), F.col("digest"))
    record_id = F.when(revisit, _urn(key, "revisit", F.col("page_id"), F.col("digest"), F.monotonically_increasing_id())).otherwise(
        _urn(key, "response", F.col("page_id"), F.col("digest")))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}"), _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("size").cast("string"))), F.lit(_END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    head = _lines(
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", angle(record_id)), ("WARC-Date", now), ("WARC-Target-URI", F.col("uri")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))), ("WARC-Refers-To", F.when(revisit, angle(first))),
        ("WARC-Refers-To-Target-URI", F.when(revisit, F.col("first_uri"))), ("WARC-Refers-To-Date", F.when(revisit, F.lit(now))),
        ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", F.col("page_id").cast("string")),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    records = known.select(F.concat(F.lit(_start(key)), head, F.lit(_END), block, F.lit(_END)).alias("value"))
    about = f"software: patchsieve{_END}format: WARC File Format 1.1{_END}"
    info = (f"WARC/1.1{_END}WARC-Type: warcinfo{_END}WARC-Record-ID: <urn:uuid:{key}>{_END}WARC-Date: {now}{_END}"
            f"Content-Type: application/warc-fields{_END}Content-Length: {len(about)}{_END}{_END}{about}{_END}")
    path = new_folder(spark, "archives")
    records.unionAll(spark.range(0, 1, 1, 1).select(F.lit(info).alias("value"))).write.option("lineSep", _END).option("compression", compression).text(path)
    return path, key


def read_archives(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(record_id, type, page_id, uri, refers, stated_digest, payload binary) of all records written under a key."""
    raw = spark.read.option("lineSep", _start(key)).text(path).where(F.col("value").startswith("WARC-Type: "))
    head = F.substring_index(F.col("value"), _END * 2, 1)
    field = lambda name: F.regexp_extract(F.concat(F.lit(_END), F.col("head")), f"\r\n{name}: ([^\r\n]*)", 1)
    parts = raw.withColumn("head", head)
    block = F.expr("substring(cast(value AS BINARY), octet_length(head) + 5, cast(length AS INT))")
    parts = parts.withColumn("length", field("Content-Length")).withColumn("block", block)
    # the HTTP header ends at its first empty line
    http = F.substring_index(F.col("block").cast("string"), _END * 2, 1)
    payload = F.expr("substring(block, octet_length(http) + 5)")
    return parts.withColumn("http", http).select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("type"), F.nullif(field("X-Page-Id"), F.lit("")).cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("uri"), field("WARC-Refers-To").alias("refers"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"), payload.alias("payload"))


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) per record, revisits joined to their responses.

    Size and digest are those of the payload as read, for a revisit those of its response; intact says
    whether the digest is the one that the record states. A revisit without its response has no size.
    """
    heads = written(records.select(
        "record_id", "type", "page_id", "refers", "stated_digest",
        F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest")), "record-heads")
    answers = heads.where("type = 'response'")
    one = answers.groupBy(F.col("record_id").alias("refers")).agg(
        F.max("page_id").alias("first_id"), F.max("size").alias("first_size"), F.max("digest").alias("first_digest"))
    again = heads.where("type = 'revisit'").drop("size", "digest").join(one, "refers", "left")
    out = answers.select("page_id", "size", "digest", "type", F.lit(None).cast("long").alias("refers_to"), "stated_digest").unionAll(
        again.select("page_id", "first_size", "first_digest", "type", "first_id", "stated_digest"))
    return out.select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to",
        F.coalesce(F.col("digest") == F.col("stated_digest"), F.lit(False)).alias("intact"))


def archived(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write archives of `pages`, read them back and resolve their revisits; one row per page.

    A null html is an empty payload. Rows that share the largest page_id of a payload are all responses;
    a null page_id is below every other. An empty table gives no rows.
    """
    path, key = write_archives(pages, least_bytes)
    return resolved(read_archives(pages.sparkSession, path, key))
