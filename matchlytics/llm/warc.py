"""WARC archives: index first, then coalesced byte-range reads of the selected records.

Writing: payloads meet by digest, so that all but the smallest key of equal payloads become revisit records. Each
task streams its records into archives of its own (one gzip member per record, so that every record can be read
by itself) and yields an index row per record: archive, offset, length, address, digest. The name of an archive
has the id of the task attempt in it; the index is written once as a table, and only archives that it names
count. A task that is run again leaves an unnamed file behind and no wrong row.

Reading: selected index rows are sorted by archive and offset; records whose gap is at most `gap` bytes are read by
one request of at most `most` bytes. One task reads one stretch of an archive at a time.

Archives go through pyarrow's file systems to the shared folder: local and network mounts, s3, gs, hdfs.

Null html is an empty payload; a null address is an empty one; rows that share payload and smallest key are
all responses; a null key is never referred to as long as the payload has another.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_table, new_folder

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Names of records are derived from their keys, so that a task that runs again writes the same bytes.
NAMES = uuid.UUID("7d0c6f3e-2f7e-5d0b-9c55-0a6a4d6f2f11")
INDEX = ("page_id long, record_type string, refers_to long, url string, archive string, offset long, length long, "
         "payload_digest string, payload_bytes long")
RECORD = "page_id long, record_type string, refers_to long, payload binary, payload_digest string, header_digest string"


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(text: str) -> str:
    """A header value on one line: what isn't visible ASCII is percent-encoded."""
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], text.encode("utf-8", "surrogatepass")).decode()


def record(kind: str, key: str, date: str, url: str, digest: str, payload: bytes, refers: str | None, page: int | None) -> bytes:
    """One uncompressed record: a response with its payload, or a revisit with the head of the response alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if kind == "response" else head
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMES, key)}>"), ("WARC-Date", date),
              ("WARC-Target-URI", _field(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(NAMES, refers)}>"), ("X-Refers-To-Page-Id", refers)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def archive_writer(folder: str, date: str, archive_bytes: int, level: int):
    """Function for mapInPandas: writes the rows as records and yields their index rows."""
    def write(frames):
        task = TaskContext.get()
        system, root = _file_system(folder)
        out = name = None
        number = at = 0
        for frame in frames:
            rows = []
            for page, url, html, refers in zip(frame["page_id"], frame["url"], frame["html"], frame["refers_to"], strict=True):
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                payload = b"" if html is None else html.encode("utf-8", "surrogatepass")
                url, digest = url or "", digest_of(payload)
                kind = "response" if refers is None else "revisit"
                data = gzip.compress(record(kind, str(page), date, url, digest, payload, None if refers is None else str(refers), page), level, mtime=0)
                if out is not None and at and at + len(data) > archive_bytes:
                    out.close()
                    out, number = None, number + 1
                if out is None:
                    name, at = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                rows.append((page, kind, refers, url, name, at, len(data), digest, len(payload)))
                at += len(data)
            out_frame = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
            yield out_frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        if out is not None:
            out.close()
    return write


def with_referrals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Adds refers_to: the smallest page_id with the same payload of at least `min_bytes`, null for that page itself."""
    rows = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("_sum"), F.octet_length(F.coalesce("html", F.lit(""))).alias("_n"))
    first = rows.filter(F.col("_n") >= min_bytes).groupBy("_sum").agg(F.min("page_id").alias("_first")).filter(F.col("_first").isNotNull())
    first = first.withColumnRenamed("_sum", "_key")
    out = rows.join(first, rows["_sum"] == first["_key"], "left")
    return out.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 1 << 30, level: int = 4) -> DataFrame:
    """Writes a record per row of (page_id, url, html) under `folder` and gives the index, kept as a table."""
    _make_folder(pages.sparkSession, folder)
    rows = with_referrals(pages, min_bytes)
    return kept_table(rows.mapInPandas(archive_writer(folder, date, archive_bytes, level), INDEX), "warc-index")


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def runs(offsets, lengths, *, gap: int, most: int):
    """Slices of sorted records that one read covers: close to one another and not longer than `most` in all."""
    start = 0
    for k in range(1, len(offsets) + 1):
        if k == len(offsets) or offsets[k] - (offsets[k - 1] + lengths[k - 1]) > gap or offsets[k] + lengths[k] - offsets[start] > most:
            yield start, k
            start = k


def range_reader(folder: str, gap: int, most: int):
    """Function for mapInPandas over index rows sorted by archive and offset: reads them and yields the records."""
    def read(frames):
        system, root = _file_system(folder)
        source = name = None
        for frame in frames:
            for archive, part in frame.groupby("archive", sort=False):
                if archive != name:
                    if source is not None:
                        source.close()
                    source, name = system.open_input_file(f"{root}/{archive}"), archive
                offsets, lengths = part["offset"].tolist(), part["length"].tolist()
                for a, b in runs(offsets, lengths, gap=gap, most=most):
                    data = memoryview(source.read_at(offsets[b - 1] + lengths[b - 1] - offsets[a], offsets[a]))
                    rows = []
                    for k in range(a, b):
                        at = offsets[k] - offsets[a]
                        fields, payload = parsed(gzip.decompress(data[at : at + lengths[k]]))
                        page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                        rows.append((None if page is None else int(page), fields["WARC-Type"], None if refers is None else int(refers), payload, digest_of(payload), fields["WARC-Payload-Digest"].removeprefix("sha1:")))
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if source is not None:
            source.close()
    return read


def read_records(index: DataFrame, folder: str, *, gap: int = 1 << 16, most: int = 8 << 20, stretch: int = 16 << 20) -> DataFrame:
    """The records of the index rows. An archive is dealt out in stretches, so that no task reads a whole large one."""
    rows = index.select("archive", "offset", "length", F.floor(F.col("offset") / stretch).alias("_part"))
    # a number of its own: by the bytes of the index rows all stretches would be merged into one task
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // stretch))
    rows = rows.repartition(tasks, "archive", "_part").sortWithinPartitions("archive", "offset").drop("_part")
    return rows.mapInPandas(range_reader(folder, gap, most), RECORD)


def round_trip(pages: DataFrame, *, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes all pages, reads all records back, and gives each page's payload size and digest as read.

    A revisit holds no payload; its size and digest are those read from the response it refers to.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    index = write_archives(pages, folder, min_bytes=min_bytes)
    records = read_records(index, folder).select("page_id", "record_type", "refers_to", "header_digest", F.length("payload").cast("long").alias("bytes"), F.col("payload_digest").alias("digest"))
    records = kept_table(records, "warc-records")
    own = records.filter("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    revisits = records.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "header_digest")
    wanted = revisits.select(F.col("refers_to").alias("_page"), F.col("header_digest").alias("_sum")).distinct()
    sources = records.filter("record_type = 'response'").join(wanted, (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_sum"))).select("_page", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest")).distinct()
    resolved = revisits.join(sources, (F.col("refers_to") == F.col("_page")) & (F.col("header_digest") == F.col("payload_digest")), "left")
    return own.unionByName(resolved.select(*own.columns))
