"""WARC archives of pages, compressed record by record with a shared Zstandard dictionary.

An archive begins with a skippable frame that holds the dictionary (as the WARC Zstandard convention has it), and every
record after it is a frame of its own, so records can be read one by one.  Of records with equal payloads, one is a
response and the others are revisits of it.

Archives are written by the tasks into the shared folder, each under a temporary name that is renamed when it is
complete, and named by partition: a task that runs again writes the same archive again.  They are read back as streams.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.arrow import SLICE, bounded_batches
from tidewatch.llm.store import new_path, staged

#: Bytes of a payload from which equal ones become revisits.
REVISIT = 1000
#: Size of the dictionary; records and bytes of records that it is trained on, at most (whole records, the least by hash of the id).
DICTIONARY, TRAINED, TRAINED_BYTES = 64 << 10, 1500, 8 << 20
LEVEL = 3
# Fixed values of the formats: the skippable frame's and an ordinary frame's magic numbers, the record version, line ends.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION, END = b"WARC/1.1", b"\r\n"
#: All records bear one date, so that equal input gives equal archives.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(headers: list[tuple[str, str]], body: bytes) -> bytes:
    lines = [VERSION, *[f"{k}: {v}".encode("utf-8", "surrogatepass").replace(b"\r", b"%0D").replace(b"\n", b"%0A") for k, v in headers], f"Content-Length: {len(body)}".encode()]
    return END.join(lines) + END * 2 + body + END * 2


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(END * 2)
    version, *lines = head.split(END)
    if version != VERSION:
        raise ValueError(f"not a record: {version[:20]!r}")
    headers = dict(x.decode("utf-8", "surrogatepass").split(": ", 1) for x in lines)
    return headers, rest[: int(headers["Content-Length"])]


def page_record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is None:
        return record([*headers, ("Content-Type", "text/html; charset=utf-8")], payload)
    return record([*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Payload-Length", str(len(payload)))], b"")


def info(part: int) -> bytes:
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:part:{part}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


class Writer:
    """Appends records to a binary stream; the dictionary, if any, goes first."""

    def __init__(self, out: BinaryIO, dictionary: bytes):
        self.out = out
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)

    def write(self, data: bytes) -> None:
        self.out.write(self.compressor.compress(data))


def records(source: BinaryIO) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    size = 1 << 20
    data = source.read(8)
    shared = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        packed = source.read(struct.unpack("<I", data[4:])[0])
        shared = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed))
        data = b""
    while True:
        if not data and not (data := source.read(size)):
            return
        frame = zstandard.ZstdDecompressor(dict_data=shared).decompressobj() if shared else zstandard.ZstdDecompressor().decompressobj()
        out = []
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                break
            if not (data := source.read(size)):
                raise ValueError("the archive ends within a record")
        data = frame.unused_data
        yield b"".join(out)


def trained(pages: DataFrame) -> bytes:
    """A dictionary trained on a bounded sample of the records, drawn by hash of the id; where these are too few or too alike
    for the trainer, their own bytes are the dictionary.  What it holds only moves sizes, never contents."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    turn = F.xxhash64("page_id")
    some = pages.where(F.col("page_id").isNotNull()).select("page_id", turn.alias("turn"), size.alias("size")).where(F.col("size") <= TRAINED_BYTES)
    room, ids = TRAINED_BYTES, []
    for r in some.orderBy("turn", "page_id", "size").limit(TRAINED).collect():  # three numbers a row, of a bounded sample
        if r["size"] <= room:
            room -= r["size"]
            ids.append(r["page_id"])
    rows = pages.where(F.col("page_id").isin(ids) & (size <= TRAINED_BYTES)).groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect() if ids else []
    samples = [page_record(r.page_id, "", (r.html or "").encode("utf-8", "surrogatepass"), "", None) for r in rows] + [info(0)]
    try:
        return zstandard.train_dictionary(max(256, min(DICTIONARY, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_archives(pages: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write ``pages`` (page_id, url, html, digest, refers_to), an archive per partition -> ``path, records, bytes``."""
    bounded_batches(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():06d}.warc.zst"
        n = 0
        temporary = f"{name}.{task.taskAttemptId()}.tmp"
        with fs.open_output_stream(temporary, compression=None) as out:
            writer = Writer(out, dictionary)
            writer.write(info(task.partitionId()))
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    for row in zip(*[c.to_pylist() for c in batch.slice(at, SLICE).columns], strict=True):
                        page_id, url, html, digest, refers_to = row
                        writer.write(page_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to))
                        n += 1
        fs.move(temporary, name)
        yield pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [fs.get_file_info(name).size]})

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, records long, bytes long")


def read_archives(archives: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """The page records of ``archives`` (path): ``page_id, url, payload, payload_bytes, payload_digest, record_type,
    refers_to``.  A response's digest is computed from the payload as read; a revisit has the one that it names."""

    def number(urn: str) -> int | None:
        text = urn.removeprefix("<urn:page:").removesuffix(">")
        return None if text == "None" else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(folder)
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(path, compression=None) as source:
                    for data in records(source):
                        headers, body = parsed(data)
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        named = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(body).hexdigest() != named:
                            raise ValueError(f"{path}: the payload of {headers['WARC-Record-ID']} is damaged")
                        size = len(body) if kind == "response" else int(headers["WARC-Payload-Length"])
                        to = number(headers["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], body, size, named, kind, to))
                        if len(rows) == SLICE:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select("path").mapInArrow(run, schema)


def decided(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``digest`` (SHA-1 of the payload) and ``refers_to`` (null for responses).

    Equality is by length and SHA-256.  Only payloads that come more than once are looked up, by an equi-join that
    adaptive execution may split.  Rows repeated under the response's own id are responses, too.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    equal = F.sha2(payload, 256)
    long = F.length(payload) >= REVISIT
    groups = pages.where(long).groupBy(equal.alias("same")).agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    groups = staged(groups.select("same", "keep"), "copies")
    rows = pages.withColumn("digest", F.sha1(payload)).withColumn("equal", equal)
    joined = rows.join(groups, rows["equal"] == groups["same"], "left")
    refers = F.when(~F.col("keep").eqNullSafe(F.col("page_id")), F.col("keep"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def archived(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a record, then read the archives back: the columns of :func:`read_archives`.

    ``folder`` is where the archives go and stay (default: a new one in the shared folder).  A null html is an empty
    payload; a null url an empty one; a null id is written as none and never referred to unless no other id has the
    payload, in which case all copies are responses.  Payloads are written whole, however long.  Of equal payloads under
    one largest id all rows are responses.  Other columns are ignored, whatever their names; an empty table gives an empty
    result.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    folder = folder or new_path(spark, "warc")
    dictionary = trained(rows)
    written = staged(write_archives(decided(rows), folder, dictionary), "archives")
    written = written.where("records > 0").select("path")
    return read_archives(written.repartition(max(1, written.count())), folder)  # an archive a task
