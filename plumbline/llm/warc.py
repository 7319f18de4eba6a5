"""WARC archives with revisit records.

Only headers (id, URL, payload digest, payload length) are shuffled by digest.
The record with the largest id of equal payloads is the response; the others
join it and become revisits, which are written from the headers alone: fresh
headers that refer to the response, and no payload. Responses are written where
their payload is read. A row finds out that it is a revisit by a bit filter of
fixed size over all revisits: rows that miss it are responses. Of those that hit
it, the rows that are responses all the same are known from the headers, and
pass a second filter made of them; the few rows that pass both meet the list of
these responses in a join. So payloads move for false hits only, and filters
that are too full for their corpus cost a shuffle and no record.

Archives are written by Spark's own text writer and commit protocol - a record
is one "line" and the blank lines that end a WARC record are the line separator
- so any Hadoop file system serves and a lost executor's tasks are run again.
Records are written by classes of size, each with a number of records per file
that keeps a file near a gigabyte at most (one record longer than that stands
alone); reading parses whole archive files.

A null payload is an empty one. Records with a null id are responses and
nothing refers to them. Rows that repeat the largest id of their payload are all
responses. An empty table gives no archives and no rows. A null URL has no
header; line breaks in URLs are percent-encoded. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._io import stored

#: Bytes of payload up to which a class of records goes, and its records per archive file: a gigabyte of payload at most.
CLASSES = ((1 << 16, 1 << 14), (1 << 22, 1 << 8), (1 << 28, 1 << 2), (None, 1))
#: Bits of a filter (16 MB), whatever the size of the corpus.
FILTER_BITS = 1 << 27
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: 10 hex digits (40 bits) make 8 characters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _uri(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _bit(seed: int) -> Column:
    """The bit of a filter that stands for (id, digest), from 1 on."""
    return F.pmod(F.xxhash64(F.lit(seed), "id", "digest"), F.lit(FILTER_BITS)) + 1


def _filter(keys: DataFrame, seed: int, name: str) -> DataFrame:
    """(name_at, name): the filter of all (id, digest) in pieces of 4 kB; so many of them that 16 MB are broadcast at most."""
    bits = keys.select(_bit(seed).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias(f"{name}_at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias(name))
    return F.broadcast(bits)


def _tested(rows: DataFrame, keys: DataFrame, seed: int, name: str) -> DataFrame:
    """rows with a boolean column: whether (id, digest) hits the filter of keys; false for null ids."""
    joined = rows.withColumn("bit", _bit(seed)).join(_filter(keys, seed, f"{name}_bits"), F.bitmap_bucket_number("bit") == F.col(f"{name}_bits_at"), "left")
    place = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring(F.col(f"{name}_bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.col("id").isNotNull() & (F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1)
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("bit", f"{name}_bits", f"{name}_bits_at")


def resolved(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Responses (id, url, payload, bytes, digest), revisits (id, url, bytes, digest, of, of_url), and (bytes) of every row."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload").cast("binary"))})
    every = stored(rows.select("id", "url", "bytes", "digest"), "headers")
    heads = every.filter((F.col("bytes") >= min_bytes) & F.col("id").isNotNull())
    originals = heads.groupBy("digest", "bytes").agg(F.max("id").alias("of"), F.max_by("url", "id").alias("of_url"), F.count("*").alias("n"))
    # Only payloads that repeat; stored, since a join straight on the aggregate's partitions could not split a hot digest.
    originals = stored(originals.filter("n > 1").drop("n"), "originals")
    revisits = stored(heads.join(originals, ["digest", "bytes"]).filter("id < of").select("id", "url", "bytes", "digest", "of", "of_url"), "revisits")
    known = revisits.select("id", "digest")
    others = _tested(heads.select("id", "digest"), known, 1, "likely").filter("likely").join(known, ["id", "digest"], "left_anti")
    others = stored(others.select("id", "digest").distinct(), "false-hits")
    tested = _tested(_tested(rows, known, 1, "likely"), others, 2, "doubtful")
    there = tested.filter("NOT likely").drop("likely", "doubtful")
    moved = tested.filter("likely AND doubtful").drop("likely", "doubtful").join(others, ["id", "digest"], "left_semi")
    columns = ["id", "url", "payload", "bytes", "digest"]
    return there.select(columns).union(moved.select(columns)), revisits, every.select("bytes")


def _record(rows: DataFrame, date: str, revisit: bool) -> DataFrame:
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = http if revisit else F.concat(http, F.col("payload"))
    refers = [_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _urn(F.col("of"))), _line("WARC-Refers-To-Target-URI", _uri(F.col("of_url")))] if revisit else []
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.lit("revisit" if revisit else "response")),
        _line("WARC-Record-ID", _urn(F.col("id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _uri(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        *refers,
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit("\r\n"), block).alias("record"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Writes the archives of pages below path: one record per row, revisits resolved among payloads of min_bytes at least."""
    responses, revisits, sizes = resolved(pages, min_bytes, id_col, url_col, payload_col)
    least = 0
    for most, per_file in CLASSES:
        own = F.col("bytes") >= least if most is None else F.col("bytes").between(least, most - 1)
        least = most
        if sizes.filter(own).isEmpty():  # the headers know, so no class costs a read of the payloads for nothing
            continue
        records = _record(responses.filter(own), date, False).union(_record(revisits.filter(own), date, True))
        records.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)
    if sizes.isEmpty():
        _record(responses, date, False).write.text(path)
    return path


def parse(data: bytes) -> Iterator[tuple]:
    """(id, url, record_type, digest in the header, payload length, refers_to, payload) of each record; a broken archive raises ValueError."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.1\r\n", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(re.findall(r"([^:\r\n]+): ([^\r\n]*)", data[at:end].decode()))
        start = end + 4
        stop = start + int(head["Content-Length"])
        http = data.index(b"\r\n\r\n", start) + 4
        length = int(re.search(rb"Content-Length: (\d+)", data[start:http])[1])
        urn = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", head.get(name, ""))) else None
        if stop > len(data) or data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} has no end")
        yield urn("WARC-Record-ID"), head.get("WARC-Target-URI"), head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), length, urn("WARC-Refers-To"), data[http:stop]
        at = stop + 4


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to and, if asked for, payload) of every record.

    A response's digest is computed anew from its payload and has to be the
    header's; the reader raises ValueError otherwise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                out: list[list] = [[] for _ in range(7)]
                for i, url, kind, digest, length, refers, payload in parse(data.as_py()):
                    if kind == "response" and (digest != base64.b32encode(hashlib.sha1(payload).digest()).decode() or length != len(payload)):
                        raise ValueError(f"record {i} does not hold the payload of its header")
                    for col, value in zip(out, (i, url, kind, digest, length, refers, payload if payloads else None), strict=True):
                        col.append(value)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    out = files.select("content").mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")
    return out if payloads else out.drop("payload")


def resolve(archive: DataFrame) -> DataFrame:
    """read()'s rows with each revisit's payload taken from the response it refers to."""
    original = archive.filter("record_type = 'response' AND page_id IS NOT NULL").select(F.col("page_id").alias("_of"), F.col("payload_digest").alias("_digest"), F.col("payload").alias("_payload")).dropDuplicates(["_of", "_digest"])
    joined = archive.join(original, (F.col("refers_to") == F.col("_of")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.withColumn("payload", F.when(F.col("record_type") == "revisit", F.col("_payload")).otherwise(F.col("payload"))).drop("_of", "_digest", "_payload")
