"""WARC archives: written by Spark's text writer, read back with boundary-chain verification.

A payload may itself hold the magic of a record. A reading task therefore first finds candidates: each place with the magic
and a whole header, however long, and the place where its successor would begin. Pointer jumping from the start of each file
then keeps the candidates on the chain; magic inside payloads is never reached. A chain that does not end with its file fails
the job, so that no record is lost silently.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, written

END = "\r\n\r\n"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([^\r\n]*)", re.IGNORECASE)
#: Payloads from so many bytes on are stored once.
REVISIT_BYTES = 100
#: So many repeated payloads, of about 100 bytes each, are broadcast at most; beyond, pages meet them in a shuffle.
BROADCAST_ROWS = 50_000
#: An archive has at most so many bytes, or one record: one task reads it.
FILE_BYTES = 64_000_000
#: Records up to so many bytes are written together, then those up to the next bound: each archive of a class takes as many
#: records as fit at the class's bound. Beyond the last bound a record has an archive of its own.
SIZES = (6_400, 64_000, 640_000, 6_400_000)
#: A record's headers but for its url and ids are shorter.
HEAD_BYTES = 800
# The profile of revisits by equal payload, and the date of every record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    """A header line; none if the value is null. Control characters in it become spaces."""
    return F.coalesce(F.concat(F.lit(name + ": "), F.regexp_replace(value, r"[\x00-\x1F\x7F]", " "), F.lit("\r\n")), F.lit(""))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """A record for each page. Of equal payloads of at least 100 bytes, those of the least id are responses and the others
    revisits without a payload. A null payload is empty; a null id is the least only of payloads that have no other.
    """
    rows = pages.select(F.col(key).cast("string").alias("id"), F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html"))
    repeated = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("key").cast("string").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    repeated = written(repeated.select("digest", "first"), "repeated")
    rows = rows.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, F.lit("HTTP/1.1 200 OK" + END)).otherwise(http)
    size = F.octet_length(block) + F.when(revisit, 0).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce("id", F.lit("")), F.lit(">"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), "first", F.lit(">"))))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head, block, F.when(revisit, "").otherwise(F.col("html")))
    most = F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0)) + 2 * F.coalesce(F.octet_length("id"), F.lit(0)) + HEAD_BYTES
    present = rows.agg(*[F.max(_class(most, i).cast("int")) for i in range(len(SIZES) + 1)]).first()
    for i in [i for i, found in enumerate(present) if found] or [0]:
        of = rows.where(_class(most, i)).select(record.alias("value"))
        of.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", records_per_file(i)).text(path)


def _class(size: Column, i: int) -> Column:
    """Whether a record is of the size class."""
    over = size > (SIZES[i - 1] if i else -1)
    return over & (size <= SIZES[i]) if i < len(SIZES) else over


def records_per_file(i: int) -> int:
    """How many records of a size class an archive takes."""
    return max(1, FILE_BYTES // SIZES[i]) if i < len(SIZES) else 1


def _field(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"\r\n" + name + rb":[ \t]*([^\r\n]*)", head, re.IGNORECASE)
    return m[1].strip() if m else None


def candidates(content: bytes) -> Iterator[tuple[int, int, int]]:
    """(offset, the successor's offset, end of the header) of each place that could be a record. Places that share a header's
    end also share the search for it and for the length: the time is linear in the content."""
    end, length = -1, None
    for m in MAGIC.finditer(content):
        if end < m.start():
            end = content.find(b"\r\n\r\n", m.start())
            if end < 0:
                return
            length = LENGTH.search(content, m.start(), end)
        elif length and length.start() < m.start():
            length = LENGTH.search(content, m.start(), end)
        size = length[1].strip() if length else b""
        if size.isdigit():
            after = end + 4 + int(size)
            if content[after : after + 4] == b"\r\n\r\n":
                yield m.start(), after + 4, end


def reached(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which of the ascending offsets the chain from offset 0 reaches; the jumps double each round."""
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    at = np.where((at < n) & (offsets[np.minimum(at, n - 1)] == successors), at, n)
    jump, on = np.append(at, n), np.append(offsets == 0, False)
    for _ in range(n.bit_length()):
        on[jump[on]] = True
        on[n] = False
        jump = jump[jump]
    return on[:n]


def chain(content: bytes, name: str = "") -> np.ndarray:
    """The candidates, a row (offset, successor, end of the header) each, on the chain from offset 0 to the end of ``content``."""
    found = np.array(list(candidates(content)), np.int64).reshape(-1, 3)
    found = found[reached(found[:, 0], found[:, 1])]
    end = int(found[-1, 1]) if len(found) else 0
    if end != len(content):
        raise ValueError(f"{name}: the chain of records ends at {end}, the archive at {len(content)}")
    return found


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(archive, offset, record_type, record_id, uri, refers_to, payload_bytes, payload_digest[, payload]) of the records on
    the chain of each archive. For revisits, digest as the record says, no payload and no bytes; for others both as found
    in the payload, which must agree with the record's digest. Fails if the records do not fill an archive to its end.
    """
    schema = "archive string, offset long, record_type string, record_id string, uri string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * payloads

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for offset, after, end in chain(content, archive).tolist():
                    head, start = content[offset:end], end + 4
                    named = {k: (v or b"").decode("utf-8", "replace") or None for k, v in ((k, _field(head, k)) for k in (b"WARC-Type", b"WARC-Record-ID", b"WARC-Target-URI", b"WARC-Refers-To", b"WARC-Payload-Digest"))}
                    told = (named[b"WARC-Payload-Digest"] or "").removeprefix("sha256:") or None
                    body = content.find(b"\r\n\r\n", start, after - 4)
                    payload, size, digest = None, None, told
                    if named[b"WARC-Type"] != "revisit":
                        payload = content[body + 4 if body >= 0 else start : after - 4]
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    rows.append((archive, offset, named[b"WARC-Type"], named[b"WARC-Record-ID"], named[b"WARC-Target-URI"], named[b"WARC-Refers-To"], size, digest, payload)[: 8 + payloads])
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")
    return files.mapInPandas(scan, schema)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives of ``pages``.

    Writes the archives to the shared folder. Digest and size are those of the full payload, for revisits of the record
    that they refer to. Rows that share both an id and a payload are all responses. Empty table: no rows.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, key, url, html)
    kind = pages.schema[key].dataType.simpleString()
    id_ = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    records = read(spark, path, payloads=False).select(id_("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_("refers_to").alias("refers_to"))
    records = written(records, "records")
    full = records.where("record_type != 'revisit'").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("bytes")).withColumnsRenamed({"page_id": "refers_to"})
    named = records.where("record_type = 'revisit'").join(full, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("bytes")).select(*records.columns)
    return records.where("record_type != 'revisit'").unionByName(named)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


QUERIES = {"op8_warc": op8_warc}
ORACLE = {
    "op8_warc": """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f"""
}
