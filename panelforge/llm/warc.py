"""WARC archives of pages through chunk tables.

Writing: equal payloads are found on (digest, length) rows alone; each task streams its records into one .warc.gz file, a gzip
member a record, the payload going through the compressor in chunks. Reading: an archive is a stream of rows (record identifier,
chunk number, bytes), no chunk over CHUNK bytes; each row carries the bytes and the digest of its record up to and with it, so no
record is ever held whole and the last chunk of a record tells its digest, whatever the order of rows.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import files
from panelforge.session import materialize, partitions, scratch, ship

CHUNK = 256 << 10
SALTS = 32
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:panelforge:warc")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TARGETS = 100_000  # repeated payloads whose targets are broadcast (some 10 MB); more are joined
CHUNKS = (
    "archive string, record long, record_id string, refers_to_id string, page_id long, record_type string, refers_to long, payload_bytes long, "
    "stated_digest string, chunk int, last boolean, bytes_so_far long, digest_so_far string, data binary"
)


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """The same for rows equal in all three; archive and record number tell such rows apart."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest} {url}')}>"


def duplicates(pages: DataFrame, least_bytes: int) -> DataFrame:
    """pages (id, url, payload) with digest, payload_bytes, refers_to and target_url: the largest id of the same payload, null for itself.

    Only payloads that occur twice come back to the pages: broadcast once their number is known to be at most TARGETS, so that
    payloads stay where they were read. More are joined, that side repeated for each salt, so a payload that a third of all
    pages share is dealt over SALTS tasks.
    """
    keyed = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    same = keyed.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes").agg(F.max(F.struct("id", "url")).alias("target"), F.count("*").alias("n")).where("n > 1")
    same = materialize(same.select("digest", "payload_bytes", F.col("target.id").alias("target"), F.col("target.url").alias("target_url")), "targets")
    if same.count() <= TARGETS:
        out = keyed.join(F.broadcast(same), ["digest", "payload_bytes"], "left")
    else:
        same = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = keyed.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
        out = salted.join(same, ["digest", "payload_bytes", "salt"], "left")
    other = F.col("id") != F.col("target")
    return out.select("id", "url", "payload", "digest", "payload_bytes", F.when(other, F.col("target")).alias("refers_to"), F.when(other, F.col("target_url")).alias("target_url"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, date: datetime.datetime | None = None) -> DataFrame:
    """Writes a record per row and returns the manifest (path, records).

    Of records with equal payloads of at least `least_bytes` bytes the one with the largest id is a response and the others
    revisit it; rows that share this id too, and rows without an id, are responses. A null payload is empty, a null
    url leaves the target header out. Extra columns are ignored. An empty table writes no archive.
    """
    spark = ship(pages.sparkSession)
    stamp = (date or datetime.datetime(2024, 1, 1)).strftime("%Y-%m-%dT%H:%M:%SZ")
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))

    def head(row: dict, revisit: bool, block: int) -> bytes:
        digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
        url = None if row["url"] is None else "".join(c if c.isprintable() and c != " " else "%20" for c in row["url"])
        fields = [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", record_id(row["id"], row["url"], row["digest"])),
            ("WARC-Date", stamp),
            ("WARC-Target-URI", url),
            ("X-Page-ID", row["id"]),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("X-Payload-Length", row["payload_bytes"]),
            ("WARC-Profile", REVISIT if revisit else None),
            ("WARC-Refers-To", record_id(row["refers_to"], row["target_url"], row["digest"]) if revisit else None),
            ("X-Refers-To-Page-ID", row["refers_to"] if revisit else None),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", block),
        ]
        return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in fields if v is not None], "\r\n"]).encode()

    def archive(batches):
        out, path, n = None, None, 0
        for batch in batches:
            payloads = batch.column("payload").cast(pa.large_binary())
            rows = batch.select(["id", "url", "digest", "payload_bytes", "refers_to", "target_url"]).to_pylist()
            for row, payload in zip(rows, payloads, strict=True):
                if out is None:
                    path = files.fresh(folder, ".warc.gz")
                    out = files.create(path)
                revisit = row["refers_to"] is not None
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                out.write(pack.compress(head(row, revisit, len(http) + (0 if revisit else row["payload_bytes"])) + http))
                if not revisit and row["payload_bytes"]:
                    view = memoryview(payload.as_buffer())
                    for a in range(0, len(view), CHUNK):
                        out.write(pack.compress(view[a : a + CHUNK]))
                out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    manifest = duplicates(source, least_bytes).mapInArrow(archive, "path string, records long")
    path = f"{folder.rstrip('/')}/manifest"
    manifest.write.parquet(path)
    return spark.read.schema("path string, records long").parquet(path)


class Inflated:
    """The bytes of a file of gzip members, read a little at a time."""

    def __init__(self, uri: str):
        self.raw, self.held, self.member, self.buffer, self.ended = files.open_stream(uri), b"", None, bytearray(), False

    def fill(self, n: int) -> None:
        while len(self.buffer) < n and not self.ended:
            if not self.held:
                self.held = self.raw.read(64 << 10)
                if not self.held:
                    self.ended = True
                    return
            if self.member is None:
                self.member = zlib.decompressobj(31)
            self.buffer += self.member.decompress(self.held, CHUNK)
            if self.member.eof:
                self.held, self.member = self.member.unused_data, None
            else:
                self.held = self.member.unconsumed_tail

    def line(self) -> bytes:
        size = 4096
        while True:
            self.fill(size)
            at = self.buffer.find(b"\n")
            if at >= 0 or self.ended:
                at = len(self.buffer) if at < 0 else at + 1
                return self.take(at)
            size = max(2 * size, len(self.buffer) + 1)

    def take(self, n: int) -> bytes:
        self.fill(n)
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(uri: str) -> Iterator[tuple]:
    """Chunk rows of an archive, in order; a record without payload has one empty chunk."""
    stream, record = Inflated(uri), -1

    def header() -> dict[str, str]:
        out = {}
        while line := stream.line().strip():
            name, _, value = line.decode().partition(":")
            out[name.strip().lower()] = value.strip()
        return out

    while True:
        start = stream.line()
        if not start:
            return
        if not start.strip():
            continue
        if not start.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record in {uri}")
        warc = header()
        left = int(warc["content-length"])
        status = stream.line()
        left -= len(status)
        while True:
            line = stream.line()
            left -= len(line)
            if not line.strip():
                break
        page, target = warc.get("x-page-id"), warc.get("x-refers-to-page-id")
        digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
        record += 1
        ids = warc["warc-record-id"], warc.get("warc-refers-to"), int(page) if page else None
        fixed = (uri, record, *ids, warc["warc-type"], int(target) if target else None, int(warc["x-payload-length"]), digest)
        number, state, size = 0, hashlib.sha1(), 0
        while True:
            data = stream.take(min(left, CHUNK))
            left -= len(data)
            size += len(data)
            state.update(data)
            yield (*fixed, number, left == 0, size, state.hexdigest(), data)
            number += 1
            if not left:
                break


def read_chunks(manifest: DataFrame) -> DataFrame:
    """The chunk table of all archives of a manifest."""
    spark = ship(manifest.sparkSession)
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in CHUNKS.split(", ")]
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def read(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for row in records(path):
                    rows.append(row)
                    size += len(row[-1])
                    if size >= 4 << 20 or len(rows) >= 1000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return manifest.select("path").repartition(partitions(spark)).mapInArrow(read, CHUNKS)


def digests(chunks: DataFrame) -> DataFrame:
    """A row a record from the chunk table: page_id, payload_bytes, payload_digest (SHA-1, hex), record_type, refers_to.

    The digest of a response is that of its chunks, as its last one carries it, and must equal the one that the archive states,
    else the query fails; a revisit has the stated digest and length of the payload it repeats.
    """
    whole = (F.col("record_type") != "response") | ((F.col("digest_so_far") == F.col("stated_digest")) & (F.col("bytes_so_far") == F.col("payload_bytes")))
    checked = F.when(whole, F.col("stated_digest")).otherwise(F.raise_error(F.concat(F.lit("a damaged record: "), "record_id")))
    return chunks.where("last").select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def store(pages: DataFrame, **columns) -> DataFrame:
    """write() into a new shared folder."""
    return write(pages, scratch(pages.sparkSession, "warc"), **columns)
