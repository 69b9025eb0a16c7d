"""WARC archives: written as whole-file gzip, then normalised to one gzip member per record.

Spark's text writer makes the first form: a file is one gzip stream of records. The normaliser
reads each such stream once, from front to back, and writes every record as a member of its own
with a side-car index of offsets, from which a record is read without the ones before it.
"""

import gzip
import hashlib
import re
import uuid
import zlib
from datetime import datetime, timezone
from posixpath import basename

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.storage import new_path, stage

LEAST_REVISIT = 100  # Bytes; equal payloads shorter than this are all kept as responses.
FILE_ROWS = 20_000  # Records in a file of the first form, at most.
CHUNK = 1 << 20  # Bytes inflated at a time.
LEVEL = 4  # Of the members' compression.
INDEX = "file string, offset long, length long, record_id string, record_type string"
_CRLF = "\r\n"
_BREAK = b"\r\n\r\n"
_SIZE = re.compile(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$")


def page_records(
    pages: DataFrame, id="page_id", url="url", html="html", least=LEAST_REVISIT, date=None
) -> DataFrame:
    """One WARC record per row, as a string: record. ``date`` (ISO, UTC) is the records'; now without it.

    Of records with equal payloads of at least ``least`` bytes, the one with the least id is the
    response and the others are revisits, which carry the payload's digest and length but not
    the payload. Rows equal in id and payload are responses alike. A null payload is empty, a
    null id never the least where another is not null, a null url left out; an id that is no whole
    number is read as null. Payloads of any length are whole. An empty table gives no record; other
    columns are ignored, whatever their names. The first copies are a stored table, so that Spark
    can split the rows of a payload of many copies.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(id).try_cast("long").alias("id"),
        F.regexp_replace(F.col(url), r"[\r\n]+", " ").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    first = (
        rows.where(F.col("bytes") >= least)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "first")
    )
    marked = rows.join(stage(first, "first-copies"), "digest", "left")
    again = (F.col("bytes") >= least) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">"))
    headers = F.concat_ws(
        _CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.when(
            again,
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ),
        # How long the payload is that a revisit stands for.
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.concat(
            F.lit("Content-Length: "), F.when(again, "0").otherwise(F.col("bytes").cast("string"))
        ),
    )
    body = F.when(again, "").otherwise(F.col("payload"))
    return marked.select(F.concat(headers, F.lit(2 * _CRLF), body).alias("record"))


def write_monolithic(records: DataFrame, path, file_rows=FILE_ROWS):
    """Write ``record`` strings as files that each are one gzip stream of WARC records."""
    (
        records.select("record")
        .write.option("compression", "gzip")
        .option("lineSep", 2 * _CRLF)
        .option("maxRecordsPerFile", file_rows)
        .text(path)
    )


def _inflated(file):
    """The stream's bytes in chunks, over all its gzip members."""
    engine, fed = zlib.decompressobj(31), False
    while data := file.read(CHUNK):
        while data:
            out = engine.decompress(data, CHUNK)
            if out:
                yield out
            if engine.eof:
                data = engine.unused_data.lstrip(b"\0")
                engine, fed = zlib.decompressobj(31), False
            else:
                fed, data = True, engine.unconsumed_tail
    if fed:
        raise ValueError("the gzip stream ends early")


def read_records(chunks):
    """(header, block) of each record of a stream of uncompressed WARC bytes.

    Holds one record and one chunk at a time. Raises on a record without a length or cut short.
    """
    buffer, chunks = bytearray(), iter(chunks)

    def fill():
        more = next(chunks, None)
        if more is None:
            return False
        buffer.extend(more)
        return True

    while True:
        while buffer[:2] == b"\r\n" or len(buffer) < 2:
            if len(buffer) >= 2:
                del buffer[:2]
            elif not fill():
                if buffer:
                    raise ValueError("bytes after the last record")
                return
        start = 0
        while (end := buffer.find(_BREAK, start)) < 0:
            start = max(0, len(buffer) - 3)
            if not fill():
                raise ValueError("a record's header is cut short")
        header = bytes(buffer[:end])
        size = _SIZE.search(header)
        if not size or not header.startswith(b"WARC/"):
            raise ValueError("not a WARC record header")
        del buffer[: end + 4]
        length = int(size[1])
        while len(buffer) < length:
            if not fill():
                raise ValueError("a record's block is cut short")
        block = bytes(buffer[:length])
        del buffer[:length]
        yield header, block


def header_fields(header: bytes):
    """Named fields of a record header, names in lower case."""
    lines = header.decode("utf-8").split(_CRLF)[1:]
    pairs = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _open(path):
    """File system and path of a place that Spark names; a bare path is local."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def normalise(spark: SparkSession, source, target) -> DataFrame:
    """Rewrite each gzip file under ``source`` to ``target``; returns the index of all records.

    Columns: file, offset, length, record_id, record_type. Each file becomes ``*.warc.gz``, with
    the same index for its own records beside it. A task streams its file, so a file's size does
    not bound it. An attempt writes under names of its own and only finished files enter the
    index, so lost or repeated tasks leave nothing that is read. A stream that ends early or
    holds other than records is an error.
    """
    paths = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.gz")
        .load(source)
        .select("path")
    )
    names = ["offset", "length", "record_id", "record_type"]

    def rewrite(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                place, inner = _open(path)
                stem = f"{target.rstrip('/')}/{basename(inner).split('.')[0]}-{uuid.uuid4().hex}"
                out, written = _open(f"{stem}.warc.gz")
                out.create_dir(written.rsplit("/", 1)[0], recursive=True)
                rows, offset = [], 0
                with place.open_input_stream(inner, compression=None) as file, out.open_output_stream(
                    written, compression=None
                ) as to:
                    for header, block in read_records(_inflated(file)):
                        member = gzip.compress(header + _BREAK + block + _BREAK, LEVEL, mtime=0)
                        to.write(member)
                        fields = header_fields(header)
                        rows.append(
                            (offset, len(member), fields.get("warc-record-id"), fields.get("warc-type"))
                        )
                        offset += len(member)
                columns = [pa.array(c) for c in zip(*rows)] if rows else [pa.array([])] * 4
                index = pa.table(
                    [
                        columns[0].cast(pa.int64()),
                        columns[1].cast(pa.int64()),
                        columns[2].cast(pa.string()),
                        columns[3].cast(pa.string()),
                    ],
                    names=names,
                )
                pq.write_table(index, _open(f"{stem}.index.parquet")[1], filesystem=out)
                for part in index.to_batches():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{stem}.warc.gz"] * part.num_rows, pa.string()), *part.columns],
                        ["file", *names],
                    )

    index = paths.mapInArrow(rewrite, INDEX)
    at = new_path(spark, "warc-index")
    index.write.parquet(at)
    return spark.read.parquet(at)


def read_archive(index: DataFrame) -> DataFrame:
    """Each indexed record, read at its offset: record_id, record_type, payload_bytes,
    payload_digest, refers_to, payload.

    Bytes and digest are of the full payload: computed from it, and compared with the header,
    where the record holds it; those of the header for a revisit, whose payload is null.
    """

    def read(batches):
        for batch in batches:
            rows = []
            files = {}
            for row in batch.to_pylist():
                if row["file"] not in files:
                    if len(files) > 8:
                        files.popitem()[1].close()
                    place, inner = _open(row["file"])
                    files[row["file"]] = place.open_input_file(inner)
                data = files[row["file"]].read_at(row["length"], row["offset"])
                ((header, block),) = read_records([gzip.decompress(data)])
                fields = header_fields(header)
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                size, again = int(fields["x-payload-length"]), fields["warc-type"] == "revisit"
                if not again and (hashlib.sha256(block).hexdigest() != digest or len(block) != size):
                    raise ValueError(f"damaged record {fields['warc-record-id']}")
                rows.append(
                    {
                        "record_id": fields["warc-record-id"],
                        "record_type": fields["warc-type"],
                        "payload_bytes": size,
                        "payload_digest": digest,
                        "refers_to": fields.get("warc-refers-to"),
                        "payload": None if again else block,
                    }
                )
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows = []
            for file in files.values():
                file.close()
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = pa.schema(
        [
            ("record_id", pa.string()),
            ("record_type", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("refers_to", pa.string()),
            ("payload", pa.binary()),
        ]
    )
    return index.mapInArrow(
        read,
        "record_id string, record_type string, payload_bytes long, payload_digest string, "
        "refers_to string, payload binary",
    )


def page_number(record_id):
    """The page's id in a record's id; null for the record of a null id."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def archive_pages(pages: DataFrame, id="page_id", url="url", html="html", least=LEAST_REVISIT) -> DataFrame:
    """Write pages to archives in the shared folder, normalise these, and return the index.

    Nulls, empty and long payloads, repeated rows and clashing columns: as ``page_records``. An empty
    table gives an empty index.
    """
    spark = pages.sparkSession
    whole, parts = new_path(spark, "warc-whole"), new_path(spark, "warc")
    write_monolithic(page_records(pages, id, url, html, least), whole)
    return normalise(spark, whole, parts)
