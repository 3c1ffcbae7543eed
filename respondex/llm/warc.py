"""WARC archives: written with one gzip member per record, read record after record.

A reader holds one record at a time: it inflates member after member, frames the block by
its content length and checks both digests. Archives lie in a folder that all executors
reach; writers name their files anew on each attempt, and only those that a finished write
has listed are read, so a lost or repeated task leaves nothing that counts.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respondex.llm.shared import written
from respondex.session import scratch_path

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
LEVEL = 4
CHUNK = 1 << 20
_NAME = "urn:respondex:page:"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _file_system(folder: str):
    from pyarrow import fs

    if "://" in folder or folder.startswith("/"):
        return fs.FileSystem.from_uri(folder)
    # Hadoop writes local paths with one slash: file:/tmp/x
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def record(kind: str, name: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member. A revisit has the headers only, and names its response."""
    block = HTTP if kind == "revisit" else HTTP + payload
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{_NAME}{name}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{_NAME}{refers_to}>"}
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items())
    squeeze = zlib.compressobj(LEVEL, wbits=31)
    return (
        squeeze.compress(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n")
        + squeeze.flush()
    )


def inflated(stream) -> Iterator[bytes]:
    """Bytes of a stream of gzip members, a chunk at a time. Raises on a cut member."""
    member, rest, fresh = zlib.decompressobj(31), b"", True
    while True:
        data = rest or stream.read(CHUNK)
        if data:
            fresh = False
        out = member.decompress(data, CHUNK)  # without data: what it still holds back
        if out:
            yield out
        if member.eof:
            rest, member, fresh = member.unused_data, zlib.decompressobj(31), True
            continue
        rest = member.unconsumed_tail
        if not data and not out:
            if not fresh:
                raise ValueError("an archive ends inside a gzip member")
            return


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, digests verified."""
    chunks, held = inflated(stream), bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        if not fill(1):
            return
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(seen - 3, 0))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("an archive ends inside a record's header")
        first, *lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        fields = {}
        for line in lines:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        del held[: end + 4]
        if not fill(length + 4) or held[length : length + 4] != b"\r\n\r\n":
            raise ValueError(f"{fields.get('warc-record-id')}: the block isn't {length} bytes long")
        block = bytes(held[:length])
        del held[: length + 4]
        verify(fields, block)
        yield fields, block


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def verify(fields: dict[str, str], block: bytes) -> None:
    for name, data in (("warc-block-digest", block), ("warc-payload-digest", None)):
        if name not in fields or (data is None and fields["warc-type"] == "revisit"):
            continue
        found = digest(block if data is not None else payload_of(block))
        if fields[name] != f"sha1:{found}":
            raise ValueError(f"{fields.get('warc-record-id')}: {name} is {found}")


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    markup: str = "html",
    least_bytes: int = 0,
) -> DataFrame:
    """path, n_records of the archives written into ``folder``, one per task.

    Of rows whose payloads are equal and have ``least_bytes`` or more, that with the largest
    id is a response and the others revisit it; rows with this same id are all responses,
    and so are all rows of a group without any id. The repeated payloads' digests are a
    written table, which Spark broadcasts if the table is small and else joins by digest.
    """
    payload = F.encode(F.coalesce(F.col(f"`{markup}`"), F.lit("")), "utf-8")
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("sha1"),
    )
    twice = written(
        rows.where(F.length("payload") >= least_bytes)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("sha1", "first"),
        "warc-repeated",
    )
    revisit = ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    marked = (
        rows.join(twice, "sha1", "left")
        .select(
            F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("name"),
            "url",
            "payload",
            F.when(revisit, F.col("first").cast("string")).alias("refers_to"),
        )
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, count = None, 0
        for batch in batches:
            for name, address, data, first in zip(*batch.columns):
                if stream is None:
                    system, base = _file_system(folder)
                    system.create_dir(base, recursive=True)
                    file = f"{uuid.uuid4().hex}.warc.gz"
                    stream = system.open_output_stream(f"{base}/{file}", compression=None)
                first = first.as_py()
                kind = "response" if first is None else "revisit"
                stream.write(record(kind, name.as_py(), address.as_py(), data.as_py(), first))
                count += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{file}"], "n_records": pa.array([count], pa.int64())}
            )

    return written(marked.mapInArrow(task, "path string, n_records bigint"), "warc-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """name, url, record_type, payload_bytes, payload_digest, refers_to, payload of all records.

    ``archives`` has a ``path`` column. A file is read by one task; the files are dealt
    evenly. A record that is cut, wrongly framed or doesn't match a digest fails the job.
    A revisit's payload is null; its length and digest are those of its response.
    """
    n = max(archives.count(), 1)
    schema = (
        "name string, url string, record_type string, payload_bytes bigint, "
        "payload_digest string, refers_to string, payload binary"
    )

    names = T.StructType.fromDDL(schema).fieldNames()

    def rows(path: str) -> Iterator[tuple]:
        folder, _, file = path.rpartition("/")
        system, base = _file_system(folder)
        with system.open_input_stream(f"{base}/{file}", compression=None) as stream:
            for fields, block in records(stream):
                kind = fields["warc-type"]
                data = None if kind == "revisit" else payload_of(block)
                size = fields.get("x-payload-length") if data is None else len(data)
                yield (
                    fields["warc-record-id"].strip("<>").removeprefix(_NAME),
                    fields.get("warc-target-uri"),
                    kind,
                    None if size is None else int(size),
                    fields["warc-payload-digest"].removeprefix("sha1:"),
                    fields.get("warc-refers-to", "").strip("<>").removeprefix(_NAME) or None,
                    data,
                )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()]

        def batch_of(part: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(x, k) for x, k in zip(zip(*part), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        part, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    part.append(row)
                    held += len(row[-1] or b"")
                    if held > 8 * CHUNK or len(part) >= 4096:
                        yield batch_of(part)
                        part, held = [], 0
        if part:
            yield batch_of(part)

    return archives.select("path").repartition(n).mapInArrow(task, schema)


def archived(pages: DataFrame, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back.

    One row per input row, repeats included. Null and empty texts are empty payloads, equal
    to one another. Other columns are not looked at. An empty table writes no archive and
    gives an empty result.
    """
    kind = pages.schema[options.get("page_id", "page_id")].dataType
    folder = scratch_path(pages.sparkSession, "warc")
    back = read_archives(write_archives(pages, folder, **options))
    return back.select(
        F.when(F.col("name") != "", F.col("name")).cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
