"""WARC archives: writing, reading, and resolution of repeated payloads into revisit records."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch
from .common import id_type, lean, new_folder, ship, stash

#: Fixed values of the format: its version line, and the profile of revisits that are found by payload digest.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What ends a header and, twice, a record.
LINE = "\r\n"
#: What stands before a response's payload, and the length of it without the number.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Salts over which the rows of one digest are dealt where they are joined.
SALTS = 16


def _single_line(c: Column) -> Column:
    """A header value: control characters, which would end the header, are percent-coded blanks; null is empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\\x00-\\x1F\\x7F]", "%20")


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """(id_col, payload_bytes long, payload_digest string, record_type string, refers_to), a row for each row of pages.

    Of rows with equal payloads (UTF-8; null is empty) of least_bytes and more, the one with the least id is a response
    and the others revisit it; smaller payloads are all responses. Only headers (id, size, SHA-256) are shuffled, by
    digest: counts are taken before the shuffle, and the rows of a digest are dealt over SALTS tasks where they meet
    their response, so that one payload may make up a third of all rows. A null id is never the least, and is a response
    only if no other row has the payload; of repeated rows of the least id all are responses.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    headers = pages.select(F.col(id_col).alias("id"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(F.encode(payload, "utf-8"), 256).alias("payload_digest"))
    headers = stash(headers, "headers")
    large = headers.where(F.col("payload_bytes") >= least_bytes)
    groups = large.groupBy("payload_digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    spread = groups.select("payload_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = headers.withColumn("salt", F.when(F.col("payload_bytes") >= least_bytes, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")))
    met = salted.join(spread, ["payload_digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return met.select(
        F.col("id").alias(id_col),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record_text(id_col: Column, uri: Column, payload: Column, size: Column, digest: Column, kind: Column, refers: Column, date: str) -> Column:
    """A whole record but for the two line ends behind it: a response's block is an HTTP message, a revisit's is empty. Ids
    are in the header too, percent-coded, so that a reader needs no index and no id can end a header."""

    def name(c: Column) -> Column:
        return F.when(c.isNull(), "<urn:x-page>").otherwise(F.concat(F.lit("<urn:x-page:"), F.url_encode(c.cast("string")), F.lit(">")))

    message = F.concat(F.lit(HTTP), size.cast("string"), F.lit(LINE * 2))

    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), name(id_col)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: "), name(refers), F.lit(f"{LINE}WARC-Profile: {REVISIT_PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit("0")).otherwise((F.length(message) + size).cast("string"))),
    ]
    return F.concat(F.concat_ws(LINE, *lines), F.lit(LINE * 2), F.when(kind == "revisit", F.lit("")).otherwise(F.concat(message, payload)))


#: Classes of payload sizes: the most bytes of one, and each is written to files of its own.
CLASSES = (1 << 16, 1 << 20, 1 << 24, 1 << 62)


def write_archives(pages: DataFrame, resolved: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = 1 << 26, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes one record for each row of pages to gzip archives in folder, by Spark's own writer, so that any store
    that Spark writes to will do.

    A record ends with two line ends, which the writer puts behind each row. Payloads of a size class go to files of their
    own, with as many records as fill file_bytes if all are of the greatest size, so that a file has file_bytes of payload at
    most, or one record. Rows of pages and of resolved meet by id (null ids too) and digest.
    """
    rows = pages.select(F.col(id_col).alias("id"), _single_line(F.col(url_col)).alias("uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    # The digest tells rows of one id apart; of equal rows any stands for the others.
    decided = resolved.select(F.col(id_col).alias("rid"), F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("digest"), F.col("record_type").alias("kind"), F.col("refers_to").alias("refers")).dropDuplicates(["rid", "digest"])
    rows = rows.withColumn("own", F.sha2(F.encode("payload", "utf-8"), 256))
    text = record_text(F.col("id"), F.col("uri"), F.col("payload"), F.col("size"), F.col("digest"), F.col("kind"), F.col("refers"), date)
    of = sum(((F.col("payload_bytes") > most).cast("int") for most in CLASSES[:-1]), F.lit(0))
    there = sorted(r[0] for r in resolved.select(of.alias("c")).distinct().collect())  # a few classes
    for c in there or [0]:
        low = CLASSES[c - 1] if c else -1
        mine, told = rows.where(F.octet_length("payload").between(low + 1, CLASSES[c])), decided.where(F.col("size").between(low + 1, CLASSES[c]))
        joined = mine.join(told, F.col("id").eqNullSafe(F.col("rid")) & (F.col("own") == F.col("digest")))
        out = joined.select(text.alias("value")).write.mode("append").option("lineSep", LINE * 2).option("compression", "gzip")
        out.option("maxRecordsPerFile", max(1, file_bytes // CLASSES[c])).text(folder)


class MalformedArchive(ValueError):
    """A record that is not as the format has it, or whose payload does not have its digest."""


def _plain(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """What raw holds, a piece at a time: one or several gzip members, or plain bytes."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    rest = memoryview(raw)
    while len(rest):
        member = zlib.decompressobj(31)
        while not member.eof:
            if not len(rest):
                raise MalformedArchive("an archive is cut off")
            fed = rest[:step]
            try:
                yield member.decompress(fed)
            except zlib.error as e:
                raise MalformedArchive(str(e)) from e
            rest = rest[len(fed) - len(member.unused_data) :]


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record; blocks are taken by their length, whatever is in
    them. raw may be one or several gzip members, or plain; one record of it is held at a time."""
    pieces = _plain(raw)
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while held or more():
        if not held:
            continue
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                raise MalformedArchive("no record where one must be")
        if not held.startswith(b"WARC/1."):
            raise MalformedArchive("no record where one must be")
        head = {}
        for line in held[:end].decode("utf-8").split(LINE)[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise MalformedArchive("a header without a colon")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        after = end + 4 + size + 4
        while len(held) < after:
            if not more():
                raise MalformedArchive("a record does not end where it must")
        if held[after - 4 : after] != b"\r\n\r\n":
            raise MalformedArchive("a record does not end where it must")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[:after]
        yield head, block


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    """The payload of a record's block: behind the header of an HTTP message, if it is one."""
    if not head.get("content-type", "").startswith("application/http") or not block:
        return block
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise MalformedArchive("a message without an end of its header")
    return block[end + 4 :]


def read_archives(spark: SparkSession, folder: str, id_kind: str = "bigint") -> DataFrame:
    """(id, uri, record_type, refers_to, stored_bytes long, payload_digest string, payload binary) of each record in the
    archives of folder; payloads that are stored are verified against their digests."""
    ship(spark)

    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["id", "uri", "record_type", "refers_to", "stored_bytes", "payload_digest", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows: list[tuple] = []
                size = 0
                for head, block in parse_records(batch.column(0)[i].as_py()):
                    digest, kind = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
                    payload = payload_of(head, block)
                    if kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                        raise MalformedArchive("a payload does not have its digest")
                    rows.append((_page(head["warc-record-id"]), head["warc-target-uri"], kind, _page(head.get("warc-refers-to", "<urn:x-page>")), len(payload), digest, None if kind == "revisit" else payload))
                    size += len(payload)
                    if size >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    found = files.mapInArrow(lean(run), "id string, uri string, record_type string, refers_to string, stored_bytes bigint, payload_digest string, payload binary")
    return found.withColumns({c: F.col(c).cast(id_kind) for c in ("id", "refers_to")})


def _page(name: str) -> str | None:
    found = name.removeprefix("<urn:x-page").removesuffix(">")
    return unquote_plus(found[1:]) if found.startswith(":") else None


def deduplicate_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, folder: str | None = None) -> DataFrame:
    """Writes pages as archives in which repeated payloads are revisit records, reads them back and resolves them.

    Returns (id_col, payload_bytes long, payload_digest string, record_type string, refers_to), a row for each row of
    pages; sizes of revisits are those of the responses that they refer to, by a join of the records read. Null payloads
    and urls are empty. Ids are of any type that text brings back, with any characters. Archives are in folder, a new one in
    the shared folder if not given. Very long payloads are files of their own. Empty input writes no record and gives no
    rows; repeated rows are repeated records; other columns are ignored.
    """
    spark = pages.sparkSession
    ship(spark)
    kind = id_type(pages, id_col)
    folder = folder or new_folder(spark, "warc")
    with Scratch(spark):
        write_archives(pages, resolve_revisits(pages, id_col, payload_col, least_bytes), folder, id_col, url_col, payload_col)
    records = stash(read_archives(spark, folder, kind).drop("payload", "uri"), "records")
    original = records.where("record_type = 'response'").join(records.where("record_type = 'revisit'").select(F.col("refers_to").alias("id")).distinct(), "id", "left_semi").groupBy("id", "payload_digest").agg(F.max("stored_bytes").alias("full"))
    spread = original.select(F.col("id").alias("refers_to"), "payload_digest", "full", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    revisits = records.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(spread, ["refers_to", "payload_digest", "salt"])
    columns = [F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("record_type = 'response'").withColumnRenamed("stored_bytes", "payload_bytes").select(*columns).unionByName(revisits.withColumnRenamed("full", "payload_bytes").select(*columns))


#: The same result as deduplicate_archives in DuckDB's SQL.
REVISIT_SQL = """
WITH h AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM h
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
