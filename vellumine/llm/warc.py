"""Content-addressed archive of WARC records.

An archive is two tables: payloads holds the bytes of each distinct payload once, under its SHA-256; headers holds the exact header
bytes of every record (WARC header and HTTP head) with the key of its payload. Records are rebuilt by joining the two;
on reading, each stored payload is hashed again and must give its key, each rebuilt record must be as long as its header says, and
the payload cut from a rebuilt response must give the digest in the header. A payload that many records share is sent to a task for every SPLIT of them.

Of records whose payloads are equal and have LEAST bytes at least, the one with the largest page_id is the response and the
others are revisits that refer to it; smaller payloads are responses always (and still stored once).

Cases: null html is an empty payload; a null url gives no target header; line ends in a url are percent-coded. Rows that repeat the largest
page_id are all responses. A null page_id counts as least and its header has no page id. Payloads of any length are one value of a row. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.joins import beside, dealt
from vellumine.plans.scratch import Scratch

LEAST = 0
#: Records of one payload that one task rebuilds.
SPLIT = 500
DATE = "2024-01-01T00:00:00Z"
#: The base32 alphabet, and the profile of a revisit by equal digest.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    payloads: DataFrame  # key, holder, copies, payload
    headers: DataFrame  # key, part (of those that rebuild this payload's records), header


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits, which are five hexadecimal digits, give four letters."""
    digits = F.sha1(payload)
    parts = []
    for i in range(8):
        bits = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substr(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*parts)


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("record "), F.coalesce(page_id.cast("string"), F.lit("none"))))
    parts = (F.substring(h, lo, n) for lo, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(date: str) -> Column:
    """The bytes before the payload. Columns: page_id, url, key, payload_bytes, digest, holder, revisit."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    maybe = lambda name, value, when: F.when(when & value.isNotNull(), line(name, value)).otherwise("")
    always, revisit = F.lit(True), F.col("revisit")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        maybe("WARC-Target-URI", uri, always),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        maybe("WARC-Profile", F.lit(PROFILE), revisit),
        maybe("WARC-Refers-To", record_id(F.col("holder")), revisit),
        maybe("X-Page-ID", F.col("page_id").cast("string"), always),
        maybe("X-Refers-To-Page-ID", F.col("holder").cast("string"), revisit),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.octet_length(head) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))).cast("string")),
        F.lit("\r\n"),
        head,
    )
    return text.cast("binary")


def write_archive(spark: SparkSession, pages: DataFrame, scratch: Scratch | None = None, date: str = DATE, least: int = LEAST) -> Archive:
    """Two passes over pages: one aggregates payloads by digest (copies meet before the shuffle), one makes the headers without moving payloads."""
    scratch = scratch or Scratch(spark, "warc")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("key", F.sha2("payload", 256))
    payloads = scratch.write(rows.groupBy("key").agg(F.max("page_id").alias("holder"), F.count("*").alias("copies"), F.max("payload").alias("payload")), "payloads")
    slim = rows.select("page_id", "url", "key", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("digest"))
    # payloads of many records are few: their records are told which task's copy they meet
    hot = payloads.where(F.col("copies") > SPLIT).select("key", F.ceil(F.col("copies") / SPLIT).alias("parts"))
    slim = beside(slim, hot, "key", hot.count()).withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1).cast("long"))))
    known = slim.join(payloads.select("key", "holder", dealt(F.ceil(F.col("copies") / SPLIT)).alias("part")), ["key", "part"])
    known = known.withColumn("revisit", (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("holder")))
    headers = scratch.write(known.select("key", "part", _header(date).alias("header")), "headers")
    return Archive(payloads, headers)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.decode("header", "utf-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def read_archive(archive: Archive) -> DataFrame:
    """page_id, record (its exact bytes, as it stands in a WARC file), payload, payload_bytes, payload_digest, record_type, refers_to, header of each record.
    Fails on a payload that is not what its key says and on a record that is not what its header says."""
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col("key")))
    sound = F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(fail("payload does not match its key ").cast("binary"))
    stored = archive.payloads.select("key", sound.alias("payload"), dealt(F.ceil(F.col("copies") / SPLIT)).alias("part"))
    said = archive.headers.select("key", "part", "header", _field("X-Page-ID").cast("long").alias("page_id"), _field("WARC-Type").alias("record_type"), _field("X-Refers-To-Page-ID").cast("long").alias("refers_to"), _field("WARC-Payload-Digest").alias("said"))
    head = F.regexp_extract(F.decode("header", "utf-8"), r"(?s)^(.*?\r\n\r\n)", 1)
    said = said.withColumn("head_bytes", F.octet_length(head)).withColumn("block_bytes", F.regexp_extract(head, r"\r\nContent-Length: (\d+)\r\n", 1).cast("long"))
    is_response = F.col("record_type") == "response"
    both = said.join(stored, ["key", "part"]).withColumn("record", F.concat("header", F.when(is_response, F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n")))
    # of a response, the payload is cut from the rebuilt record
    length = F.octet_length("record") - F.octet_length("header") - 4
    whole = F.octet_length("record") == F.col("head_bytes") + F.col("block_bytes") + 4
    cut = F.when(~whole, fail("a record's length is not its header's ").cast("binary")).when(is_response, F.substr("record", F.octet_length("header") + 1, length)).otherwise(F.col("payload"))
    both = both.select("page_id", "record", cut.alias("payload"), "record_type", "refers_to", "header", "said", "key")
    both = both.withColumn("digest", base32_sha1(F.col("payload")))
    agreed = F.when(F.col("said") == F.concat(F.lit("sha1:"), F.col("digest")), F.col("digest")).otherwise(fail("a header's digest is not that of the payload "))
    return both.select("page_id", "record", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), agreed.alias("payload_digest"), "record_type", "refers_to", "header")


def records(archive: Archive) -> DataFrame:
    """page_id and the exact bytes of each record as it stands in a WARC file."""
    return read_archive(archive).select("page_id", "record")


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines)
        n = int(fields["Content-Length"])
        if rest[n : n + 4] != b"\r\n\r\n":
            raise ValueError("record has another length than its header says")
        out.append((fields, rest[:n]))
        data = rest[n + 4 :]
    return out
