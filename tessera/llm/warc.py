"""WARC archives: written as one gzip stream a file, then normalised to a member a record with a sidecar offset index.

Each archive is the work of one task and its content depends on its rows alone, so a task run again writes the same
files: it fills a name of its own attempt and moves it into place. Archives live under a folder that all executors share.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import materialize, new_path, text_batches

DATE = "1970-01-01T00:00:00Z"  # records carry no clock time, so that archives are reproducible
CHUNK = 1 << 20
GZIP = 31  # zlib's window bits for gzip framing


def record_bytes(rec_type: str, uri: str, payload: bytes, n_payload: int, digest: str, extra: dict[str, str]) -> bytes:
    name = uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([rec_type, uri, digest, extra], sort_keys=True))
    head = {"WARC-Type": rec_type, "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}",
            "X-Payload-Length": str(n_payload), "Content-Type": "text/html; charset=utf-8"} | extra | {"Content-Length": str(len(payload))}
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    return b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in head.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a stream of inflated bytes, holding one record at a time."""
    held = bytearray()
    chunks = iter(chunks)

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(chunks, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not fill(looked + 1):
                raise ValueError("the archive ends inside a record's headers")
        head = parse_head(bytes(held[:end]))
        size = end + 4 + int(head["Content-Length"]) + 4
        if not fill(size):
            raise ValueError("the archive ends inside a record")
        yield head, bytes(held[:size])
        del held[:size]


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or many, a chunk at a time. A file cut before a member's trailer is an error."""
    z, raw, begun = zlib.decompressobj(GZIP), stream.read(CHUNK), False
    while raw:
        begun = True
        if piece := z.decompress(raw, CHUNK):
            yield piece
        raw = z.unconsumed_tail
        if z.eof:
            raw, z, begun = z.unused_data, zlib.decompressobj(GZIP), False
        raw = raw or stream.read(CHUNK)
    if begun:
        raise ValueError("the archive ends inside a gzip member")


class _Writer:
    """A file that appears under its name when whole."""

    def __init__(self, path: str):
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)

    def done(self) -> None:
        """Where another attempt was first and the store doesn't replace files, that one stays: both wrote the same bytes."""
        self.out.close()
        try:
            self.fs.move(self.part, self.path)
        except OSError:
            if self.fs.get_file_info(self.path).type != fs.FileType.File:
                raise
            self.fs.delete_file(self.part)


def write_monolithic(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """(path, n_records): each partition's rows (page_id, url, payload, digest, refers_to) as one gzip stream in one file.

    A null payload is empty, a null url an empty target, a null page_id an empty header; rows with refers_to are revisits
    without payload. Equal rows make equal records; a partition without rows writes no file; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path, out, n = f"{folder}/whole-{TaskContext.get().partitionId():06d}.warc.gz", None, 0
        for batch in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, z = _Writer(path), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                body, extra = payload or b"", {"X-Page-ID": "" if page is None else str(page)}
                if refers is not None:
                    extra |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": str(refers)}
                rec = record_bytes("response" if refers is None else "revisit", url or "", body if refers is None else b"", len(body), digest, extra)
                out.out.write(z.compress(rec))
                n += 1
        if out is not None:
            out.out.write(z.flush())
            out.done()
            yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    return pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, n_records long")


def normalise(archives: DataFrame, level: int = 6) -> DataFrame:
    """(path, index_path, n_records): each archive of column path rewritten with a gzip member a record, and its index.

    The whole-file stream is inflated once, in chunks. The index is a JSON line a record: offset, length, type, id.
    Archives that already have a member a record come out the same. An archive cut short, or not of WARC records, fails the
    job; one without records gives empty files; a path that repeats is written once more, to the same bytes. A record may be
    as large as a task's memory. No rows give no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(source)
                to = source.replace("/whole-", "/members-")
                if to == source:
                    to = source.removesuffix(".warc.gz") + ".members.warc.gz"
                out, index, at, n = _Writer(to), _Writer(f"{to}.idx"), 0, 0
                with store.open_input_stream(inner, compression=None) as stream:
                    for head, rec in records(inflated(stream)):
                        z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        member = z.compress(rec) + z.flush()
                        out.out.write(member)
                        index.out.write((json.dumps({"offset": at, "length": len(member), "type": head["WARC-Type"], "id": head["WARC-Record-ID"]}) + "\n").encode())
                        at, n = at + len(member), n + 1
                out.done()
                index.done()
                yield pa.record_batch([pa.array([to]), pa.array([f"{to}.idx"]), pa.array([n], pa.int64())], ["path", "index_path", "n_records"])

    return archives.select("path").mapInArrow(run, "path string, index_path string, n_records long")


READ_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_members(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of normalised archives (path, index_path), each read at its offset of the index.

    A stored payload must have the length and SHA-1 that its headers give, or the job fails. payloads=False leaves them out.
    Revisits have no payload; an empty page header is a null page_id; paths that repeat are read each time; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], fields)

        for batch in batches:
            for path, index_path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = fs.FileSystem.from_uri(path)
                _, inner_index = fs.FileSystem.from_uri(index_path)
                with store.open_input_file(inner) as data, store.open_input_stream(inner_index, compression=None) as index:
                    entries = [json.loads(line) for line in index.read().splitlines()]
                    rows, size = [], 0
                    for e in entries:
                        data.seek(e["offset"])
                        rec = zlib.decompress(data.read(e["length"]), GZIP)
                        end = rec.index(b"\r\n\r\n")
                        head, body = parse_head(rec[:end]), rec[end + 4 : -4]
                        n, digest, kind = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        if head["WARC-Record-ID"] != e["id"] or kind == "response" and (len(body) != n or hashlib.sha1(body).hexdigest() != digest):
                            raise ValueError(f"{path}: the record at {e['offset']} is damaged")
                        refers, page = head.get("X-Refers-To-Page-ID"), head.get("X-Page-ID")
                        rows.append((int(page) if page else None, head["WARC-Target-URI"], body if payloads and kind == "response" else None, n, digest, kind, int(refers) if refers else None))
                        size += len(body) if payloads else 0
                        if size > 8 * CHUNK or len(rows) >= 5000:
                            yield packed(rows)
                            rows, size = [], 0
                    if rows:
                        yield packed(rows)

    return archives.select("path", "index_path").mapInArrow(run, READ_SCHEMA)


def with_revisits(pages: DataFrame, min_bytes: int = 1000, salts: int = 32) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is set where a page with an equal payload has a larger id.

    The winners come from partial maxima; only digests that occur more than once are joined back, salted by page id, so
    one payload that fills a third of the table spreads over `salts` tasks.
    """
    own = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    own = own.withColumn("digest", F.sha1("payload")).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)))
    large = F.length("payload") >= min_bytes
    best = own.where(large).groupBy("digest").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1 and best is not null")
    best = best.select("digest", "best", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    joined = own.join(materialize(best, "revisits"), ["digest", "salt"], "left")
    refers = F.when(large & (F.col("page_id").isNull() | (F.col("page_id") < F.col("best"))), F.col("best"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def warc_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 1000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from the normalised archives.

    A null html is an empty payload; a null url an empty target; a null page_id stays null (and revisits any page of equal
    payload that has an id). Rows that repeat the largest page_id of a payload are all responses. Other columns aren't
    read. Archives are as large as the partitions of pages.
    """
    spark = pages.sparkSession
    text_batches(spark)
    folder = folder or new_path(spark, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    if folder.startswith("file:/") and not folder.startswith("file:///"):
        folder = "file://" + folder.removeprefix("file:")
    whole = materialize(write_monolithic(with_revisits(pages, min_bytes), folder), "warc-written")
    spread = max(1, whole.count())
    members = materialize(normalise(whole.repartition(spread, "path")), "warc-members")
    return read_members(members.repartition(spread, "path"), payloads=False).drop("payload", "url")
