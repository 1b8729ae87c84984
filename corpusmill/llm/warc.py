"""WARC archives: write pages as records, find equal payloads by digest, write revisit records.

Spark's text writer makes the files: a record is its header lines, an empty
line and the payload, and the writer's line separator is the two line ends
that close a record.  So the archives come about under Spark's commit protocol
(a lost executor leaves no half of a file) and in any store that Spark can
write.  Spark's text reader streams them back with the same separator; a task
joins the pieces again and cuts records by Content-Length, so a payload may hold
anything and no more than one record is held, however large the file.

Payloads stay where they are: headers alone are shuffled by digest, revisit
records are written from headers, and responses are the records of the first
archive that are no revisits.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.workdir import discard, materialize, new_path

END = "\r\n\r\n"
MIN_PAYLOAD = 100
#: A fixed date: the same input gives the same archive.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS_A_FILE = 20_000

_FIELDS = {
    "page_id": ("X-Page-Id", pa.int64()),
    "uri": ("WARC-Target-URI", pa.string()),
    "record_type": ("WARC-Type", pa.string()),
    "payload_digest": ("WARC-Payload-Digest", pa.string()),
    "payload_bytes": ("X-Payload-Length", pa.int64()),
    "refers_to": ("X-Refers-To-Page-Id", pa.int64()),
    "record_id": ("WARC-Record-ID", pa.string()),
}
_SCHEMA = "page_id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, record_id string"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; control characters and blanks are percent-encoded away."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))


def _clean_uri(uri: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(uri, r"[\r\n]", "%0A"), r"[\x00-\x20]", "%20")


def _uuid(key: Column) -> Column:
    h = F.md5(key.cast("string"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_records(records: DataFrame, path: str) -> None:
    """records: page_id, uri, record_type, payload_digest (bare hex), payload_bytes, refers_to, record_id, refers_to_record, block (string)."""
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("uri")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Refers-To", F.col("refers_to_record")),
        _line("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(PROFILE))),
        _line("X-Page-Id", F.col("page_id")),
        _line("X-Payload-Length", F.col("payload_bytes")),
        _line("X-Refers-To-Page-Id", F.col("refers_to")),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(END),
        F.col("block"),
    )
    records.select(head.alias("value")).write.options(lineSep=END, compression="gzip", maxRecordsPerFile=ROWS_A_FILE).text(path)


def parse(chunks):
    """Yield (header dict, block bytes) of the records of a WARC file given as byte chunks."""
    held, more = bytearray(), iter(chunks)

    def until(done) -> bool:
        while not done():
            chunk = next(more, None)
            if chunk is None:
                return False
            held.extend(chunk)
        return True

    end = END.encode()
    while True:
        while held[:2] == b"\r\n" or (len(held) < 2 and until(lambda: len(held) >= 2)):
            if held[:2] != b"\r\n":
                break
            del held[:2]
        if not until(lambda: end in held):
            if held:
                raise ValueError("a WARC record is cut short")
            return
        at = held.index(end)
        lines = held[:at].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(line.split(": ", 1) for line in lines[1:])
        length, at = int(head["Content-Length"]), at + len(end)
        if not until(lambda: len(held) >= at + length + len(end)) or held[at + length : at + length + len(end)] != end:
            raise ValueError("a WARC record is cut short")
        yield head, bytes(held[at : at + length])
        del held[: at + length + len(end)]


def _rows(with_block: bool):
    names = [*_FIELDS, *(["block"] if with_block else [])]
    kinds = {**{k: v[1] for k, v in _FIELDS.items()}, "block": pa.string()}

    def batch(rows):
        return pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in names], names)

    def run(batches):
        pieces = (piece + END.encode() for lines in batches for piece in lines.column(0).cast(pa.binary()).to_pylist())
        rows, size = [], 0
        for head, block in parse(pieces):
            row = {k: head.get(h) for k, (h, _) in _FIELDS.items()}
            for k in ("page_id", "payload_bytes", "refers_to"):
                row[k] = None if row[k] is None else int(row[k])
            row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha256:") or None
            if row["payload_digest"] is None:  # a fresh archive: measure the payload
                row |= {"payload_digest": hashlib.sha256(block).hexdigest(), "payload_bytes": len(block)}
            if with_block:
                row["block"] = block.decode("utf-8")
            rows.append(row)
            size += len(block) if with_block else 200
            if size > 4 << 20 or len(rows) >= 5000:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def read_archive(spark: SparkSession, path: str, with_block: bool = False) -> DataFrame:
    """The records of all gzip files of an archive: headers, with digest and length of the payload, and on demand the block."""
    lines = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path)
    return lines.mapInArrow(_rows(with_block), _SCHEMA + (", block string" if with_block else ""))


def archive_pages(pages: DataFrame, path: str) -> None:
    """Write every page (page_id, url, html) as a response record; null html is an empty payload."""
    write_records(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            _clean_uri(F.col("url")).alias("uri"),
            F.lit("response").alias("record_type"),
            F.lit(None).cast("string").alias("payload_digest"),
            F.lit(None).cast("long").alias("payload_bytes"),
            F.lit(None).cast("long").alias("refers_to"),
            F.lit(None).cast("string").alias("refers_to_record"),
            _uuid(F.concat_ws("/", "page_id", F.monotonically_increasing_id(), "url")).alias("record_id"),
            F.coalesce("html", F.lit("")).alias("block"),
        ),
        path,
    )


def resolve(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """record_id, refers_to, refers_to_record for the records that repeat an earlier one's payload.

    headers: page_id, payload_digest, payload_bytes, record_id, written to the
    shared folder.  Headers alone are shuffled.  Originals are the smallest
    (page_id, record_id) of each digest, found with partial aggregation; the
    join back is a plain one, whose hot digests Spark can split.
    """
    long_ones = headers.filter(F.col("payload_bytes") >= min_payload)
    key = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id")
    first = long_ones.groupBy("payload_digest").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    return long_ones.join(first, "payload_digest").filter("record_id != first.record_id").select("record_id", F.col("first.page_id").alias("refers_to"), F.col("first.record_id").alias("refers_to_record"))


def deduplicate(spark: SparkSession, source: str, target: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Rewrite an archive: records whose payload an earlier page has become revisit records with fresh headers and no block."""
    headers = materialize(read_archive(spark, source).select("page_id", "uri", "payload_digest", "payload_bytes", "record_id"), "headers")
    # written first: of a table whose size is known Spark sees whether it can be broadcast, which spares the payloads a shuffle
    repeats = materialize(resolve(headers, min_payload), "repeats")
    none = lambda kind: F.lit(None).cast(kind)
    responses = read_archive(spark, source, with_block=True).join(repeats.select("record_id"), "record_id", "left_anti")
    responses = responses.withColumns({"record_type": F.lit("response"), "refers_to": none("long"), "refers_to_record": none("string")})
    revisits = headers.join(repeats, "record_id").withColumns({"record_type": F.lit("revisit"), "block": F.lit("")})
    write_records(responses.unionByName(revisits), target)
    discard(headers, repeats)


def warc_round_trip(pages: DataFrame, folder: str | None = None, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Archive pages, write the deduplicated archive and return what its headers say.

    One row per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to, uri.  Of equal payloads of min_payload bytes or more the one
    with the smallest page_id is the response; rows repeated under one page_id
    have one response among them; a page with a null page_id is an original
    only if no other page has its payload.  Null html is an empty payload,
    null urls leave the target out, other columns are ignored, an empty table
    gives empty archives.  folder: where raw/ and unique/ go (default: the
    shared folder).
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    archive_pages(pages, f"{folder}/raw")
    deduplicate(spark, f"{folder}/raw", f"{folder}/unique", min_payload)
    return read_archive(spark, f"{folder}/unique").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")
