"""WARC archives (operator 3): written as text records, read back by boundary-chain verification."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, materialise, small_batches

MAGIC = b"WARC/1.0\r\n"
#: Bytes of the payloads of one archive, at most, or one record: a task holds an archive several times over while it reads.
FILE_BYTES = 1 << 25
#: Records of one archive, at most: the first of these that keeps to FILE_BYTES were all its payloads as long as the row's.
FILE_RECORDS = (250, 62, 15, 3, 1)
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: A block of an archive whose record starts are looked for at once.
BLOCK = 1 << 20


def write_warc(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> None:
    """One record per row, in files of at most FILE_RECORDS[0] records, fewer where payloads are so long that they might pass FILE_BYTES.

    Long payloads go to archives of their own, by length, so that a few of them leave the others' archives as they are;
    `pages` is read once more for each such length that it has, and has to have the same rows each time.
    Of equal payloads of REVISIT_BYTES or more, the row with the largest id holds the payload and the others are revisits
    that name it. A null payload is empty, a null url leaves its header out, and of rows with one id each is written; rows
    with a null id are responses without a page header. Other columns are left out.
    """
    payload = F.coalesce(F.col(payload_column), F.lit(""))
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), payload.alias("payload")).withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    # first the few digests that come twice or more: texts never move for this
    twice = rows.filter((F.col("bytes") >= REVISIT_BYTES) & F.col("id").isNotNull()).groupBy("digest", "bytes").agg(F.max("id").alias("holder"), F.count("*").alias("c")).filter("c > 1").drop("c")
    twice = materialise(twice, "twice")
    most = F.coalesce(*(F.when(F.col("bytes") <= FILE_BYTES // n, F.lit(n)) for n in FILE_RECORDS), F.lit(1))
    found = {FILE_RECORDS[0], *rows.agg(F.collect_set(most)).first()[0]}
    twice = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice.hint("merge")
    joined = rows.join(twice, ["digest", "bytes"], "left").withColumn("refers", F.when(F.col("holder") != F.col("id"), F.col("holder")))
    line = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))
    body = F.when(F.col("refers").isNull(), F.col("payload")).otherwise(F.lit(""))
    record = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(F.col("refers").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers").cast("string"), F.lit(">"))),
        line("WARC-Profile", F.when(F.col("refers").isNotNull(), F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
        F.lit("\r\n"),
    )  # the sink's line end is the second of the two that close a record
    for k, each in enumerate(sorted(found)):
        # revisits hold no payload, so they are short whatever they refer to
        own = (most == each) & F.col("refers").isNull() if each < FILE_RECORDS[0] else (most == each) | F.col("refers").isNotNull()
        joined.filter(own).select(record.alias("value")).write.mode("append" if k else "error").option("lineSep", "\r\n").option("maxRecordsPerFile", each).text(path)


#: Header lines; numbers of at most 18 digits, so that whatever a page imitates fits in 64 bits.
_FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*$")
_NUMBER, _PAGE = re.compile(rb"\d{1,18}"), re.compile(rb"<urn:page:(-?\d{1,19})>")


def fields_of(head: bytes) -> dict[bytes, bytes]:
    """The header fields by lower-case name, the first of equal names; lines that are no field are passed over."""
    found: dict[bytes, bytes] = {}
    for line in head.split(b"\r\n"):
        if m := _FIELD.match(line):
            found.setdefault(m[1].lower(), m[2])
    return found


def number_of(raw: bytes | None) -> int | None:
    return int(raw) if raw is not None and _NUMBER.fullmatch(raw) else None


def page_of(raw: bytes | None) -> int | None:
    m = _PAGE.fullmatch(raw) if raw is not None else None
    return int(m[1]) if m and -(2**63) <= int(m[1]) < 2**63 else None


def candidates(content: bytes, start: int, stop: int) -> Iterator[tuple[int, int, dict[bytes, bytes], int, int]]:
    """(offset, successor, fields, body from, body to) of every place in [start, stop) that reads like a record.

    That is the magic at the file's start or after a blank line, a header that a blank line ends, and a sound length. As
    a header ends at its first blank line, no two headers overlap, and a page full of magics costs no more than others.
    The successor is -1 where the length leads past the end or not to the blank lines that close a record.
    """
    at = content.find(MAGIC, start)
    while 0 <= at < stop:
        if at == 0 or content[at - 4 : at] == b"\r\n\r\n":
            end = content.find(b"\r\n\r\n", at)
            fields = fields_of(content[at + len(MAGIC) : end]) if end >= 0 else {}
            if (length := number_of(fields.get(b"content-length"))) is not None:
                body = end + 4
                close = body + length
                good = content[close : close + 4] == b"\r\n\r\n"
                yield at, close + 4 if good else -1, fields, body, min(close, len(content))
        at = content.find(MAGIC, at + 1)


def reachable(offsets, successors, size: int):
    """Which offsets the chain from 0 meets, by pointer jumping: each round doubles the stretch that is known."""
    import numpy as np

    order = np.argsort(offsets)
    place = np.append(offsets[order], size)  # the last place is the file's end, which leads to itself
    jump = np.searchsorted(place, np.append(successors[order], size)).clip(max=order.size)
    jump[:-1][place[jump[:-1]] != successors[order]] = order.size
    met = np.zeros(place.size, bool)
    met[0] = place[0] == 0
    while True:
        new = met.copy()
        new[jump[met]] = True
        if (new == met).all():
            break
        met, jump = new, jump[jump]
    out = np.zeros(offsets.size, bool)
    out[order] = met[:-1]
    return out


SCHEMA = "file string, size long, offset long, successor long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, body_bytes long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below a path: SCHEMA's columns.

    Tasks emit each place that reads like a record with its successor; then each file's chain is followed from its
    start by pointer jumping, and places inside payloads, which no record leads to, fall out. payload_bytes and
    payload_digest are measured on the bytes of responses, and taken from the header of revisits. Only these few numbers
    of a record are shuffled.

    A payload is hashed only where a task has come to it from record to record, so look-alikes inside a payload cost no
    more than their own bytes; they are emitted without digest, and pointer jumping is what rejects them. A record that
    its own length does not close ends its file's chain and is left out. Malformed fields give null: an id that is no 64-bit number, a length that is none or of over 18 digits (then the place is no
    record), a revisit without a sound length or digest. Without archives the result is empty.
    """
    small_batches(spark)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content, due = content.as_py(), 0  # due: where the next record of the chain begins; -1 once it is broken
                for start in range(0, max(1, len(content)), BLOCK):
                    rows = []
                    for at, successor, fields, a, b in candidates(content, start, start + BLOCK):
                        kind = fields.get(b"warc-type", b"").decode("latin-1")
                        n, digest = b - a, None
                        if kind == "revisit":
                            n = number_of(fields.get(b"warc-payload-length"))
                            digest = fields.get(b"warc-payload-digest", b"").decode("latin-1").rpartition(":")[2] or None
                        elif at == due and successor > 0:
                            digest = hashlib.sha1(memoryview(content)[a:b]).hexdigest()
                        if at == due:
                            due = successor
                        rows.append((file, len(content), at, successor, page_of(fields.get(b"warc-record-id")), kind, page_of(fields.get(b"warc-refers-to")), n, digest, b - a))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def follow(batches: pa.Table) -> pa.Table:
        import numpy as np

        offsets, successors = (np.asarray(batches.column(c)).astype(np.int64) for c in ("offset", "successor"))
        return batches.filter(pa.array(reachable(offsets, successors, batches.column("size")[0].as_py()) & (successors > 0)))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(scan, SCHEMA).groupBy("file").applyInArrow(follow, SCHEMA)
