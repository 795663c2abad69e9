"""Operator 5, WARC: monolithic gzip archives normalised to one gzip member per record, with a sidecar offset index.

Each task writes its pages as WARC/1.1 records into archives compressed as one gzip stream for the whole file
(as many crawls are delivered). The normaliser inflates such a stream once, in chunks, cuts it into records,
rewrites each as a gzip member of its own and lists offset and length of every member in a sidecar index, so
that any record can be read alone. Reading takes the sidecar, fetches each record by its range, tests the digest of every payload
and returns what the records say.

Of pages with equal payloads that with the smallest page_id is a response, the others are revisit records
that refer to it and carry no payload, only its length and digest.

Files are written with names unique to the task attempt into the shared folder; only those listed in the
written tables of archives by attempts that ended well count, so lost executors and repeated tasks leave no trace in results.

Defined cases: a null html counts as the empty payload; a null page_id sorts first among equals; repeated rows (same id and html) are one
response and revisits of it; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import materialise, shared_dir, small

#: Bytes of records, before compression, after which a task starts another archive.
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 20
# The record layout of WARC/1.1.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> bytes:
    return b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")).encode()


def build_record(page_id, url: str | None, payload: bytes | None, refers_to=None, revisit: bool = False, size: int | None = None, digest: str | None = None) -> bytes:
    """A response with its payload, or a revisit, for which the payload's size and digest are enough."""
    size, digest = (len(payload), digest_of(payload)) if size is None else (size, digest)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    uri = "".join((url or "").split()).encode("utf-8", "surrogatepass") or b"urn:x-none"
    head = [
        b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _record_id(page_id), b"WARC-Date: " + DATE, b"WARC-Target-URI: " + uri,
        b"WARC-Payload-Digest: sha1:" + digest.encode(), b"WARC-X-Page: " + json.dumps(page_id).encode(),
    ]
    if revisit:
        head += [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: " + _record_id(refers_to), b"WARC-X-Refers-To-Page: " + json.dumps(refers_to).encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return VERSION + b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.split(b"\r\n")
    if lines[0] + b"\r\n" != VERSION:
        raise ValueError("not a WARC/1.1 record")
    return {k.strip().decode().lower(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b":") for x in lines[1:] if x)}


def split_records(chunks):
    """Whole records from an iterable of inflated chunks; holds one record and one chunk at a time."""
    held, need = bytearray(), None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                need = at + 4 + int(parse_head(bytes(held[:at]))["content-length"]) + 4
            if len(held) < need:
                break
            record = bytes(held[:need])
            if record[-4:] != b"\r\n\r\n":
                raise ValueError("record is not closed")
            del held[:need]
            need = None
            yield record
    if held:
        raise ValueError("archive is cut short")


def inflate(stream, chunk: int = CHUNK):
    """Inflated chunks of a gzip stream, whatever its number of members; checksums are tested by zlib."""
    z = zlib.decompressobj(31)
    while data := stream.read(chunk):
        while data:
            if z.eof:
                z = zlib.decompressobj(31)
            out = z.decompress(data, 4 * chunk)
            if out:
                yield out
            data = z.unconsumed_tail or (z.unused_data if z.eof else b"")
    if out := z.flush():
        yield out
    if not z.eof:
        raise ValueError("gzip stream is cut short")


def member(record: bytes, level: int = 6) -> bytes:
    return gzip.compress(record, level, mtime=0)


def _store(folder: str):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    return files, path


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages as ``decide`` gives them as monolithic archives; one row (path, records) for each."""

    def run(batches):
        import pyarrow as pa

        files, path = _store(folder)
        out = sink = z = None
        done, n, size = [], 0, 0

        def close():
            sink.write(z.flush())
            sink.close()
            done.append((out, n))

        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                for page_id, url, html, payload_bytes, sha1, refers_to, revisit in zip(*(c.to_pylist() for c in batch.slice(a, 200).columns)):
                    if sink is None:
                        out = f"{path}/mono-{uuid.uuid4().hex}.warc.gz"
                        sink, z, n, size = files.open_output_stream(out, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                    payload = None if revisit else (html or "").encode("utf-8", "surrogatepass")
                    record = build_record(page_id, url, payload, refers_to, revisit, payload_bytes, base64.b32encode(sha1).decode())
                    sink.write(z.compress(record))
                    n, size = n + 1, size + len(record)
                    if size >= ARCHIVE_BYTES:
                        close()
                        sink = None
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    columns = ["page_id", "url", "html", "payload_bytes", "sha1", "refers_to", "revisit"]
    return materialise(pages.select(columns).mapInArrow(run, "path string, records long"), "archives")


def _sidecar(path: str) -> str:
    return path.removesuffix(".gz") + ".idx"


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with a member for each record and a sidecar index of offsets and lengths beside it; a row (path, records) for each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for source, records in zip(*(c.to_pylist() for c in batch.columns)):
                files, path = _store(folder)
                out, at, index = f"{path}/norm-{uuid.uuid4().hex}.warc.gz", 0, []
                with files.open_input_stream(source, compression=None) as stream, files.open_output_stream(out, compression=None) as sink:
                    for record in split_records(inflate(stream)):
                        data = member(record)
                        sink.write(data)
                        index.append((at, len(data)))
                        at += len(data)
                if len(index) != records:
                    raise ValueError(f"{source} holds {len(index)} records, not {records}")
                with files.open_output_stream(_sidecar(out), compression=None) as side:
                    side.write("".join(f"{o}\t{n}\n" for o, n in index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([out]), pa.array([len(index)], pa.int64())], names=["path", "records"])

    spread = archives.repartition(max(1, archives.count()))
    return materialise(spread.mapInArrow(run, "path string, records long"), "normalised", whole_partitions=True)


def read_records(archives: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """Reads each record of normalised archives (path, records) by the range that the sidecar gives and tests its payload's digest."""
    whole = id_type in ("bigint", "int", "smallint", "tinyint")

    def run(batches):
        import pyarrow as pa

        files, _ = _store(folder)
        kind = pa.int64() if whole else pa.string()
        types = [kind, pa.int64(), pa.string(), pa.string(), kind, pa.string(), pa.int64(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"]
        for path, records in ((p, n) for batch in batches for p, n in zip(*(c.to_pylist() for c in batch.columns))):
            with files.open_input_stream(_sidecar(path), compression=None) as side:
                ranges = [tuple(map(int, line.split())) for line in side.read().decode().splitlines()]
            if len(ranges) != records:
                raise ValueError(f"the index of {path} is damaged")
            with files.open_input_file(path) as opened:
                for a in range(0, len(ranges), 1000):
                    rows = []
                    for offset, length in ranges[a : a + 1000]:
                        record = gzip.decompress(opened.read_at(length, offset))
                        at = record.index(b"\r\n\r\n")
                        head = parse_head(record[:at])
                        block = record[at + 4 : at + 4 + int(head["content-length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).partition(b":")[2])
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        revisit = head["warc-type"] == "revisit"
                        if not revisit and (len(payload) != size or digest_of(payload) != digest):
                            raise ValueError(f"damaged record at {offset} of {path}")
                        rows.append((json.loads(head["warc-x-page"]), size, digest, head["warc-type"], json.loads(head["warc-x-refers-to-page"]) if revisit else None, path, offset, length))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    sql = "bigint" if whole else "string"
    spread = archives.repartition(max(1, archives.count()))
    return spread.mapInArrow(run, f"page_id {sql}, payload_bytes long, payload_digest string, record_type string, refers_to {sql}, archive string, offset long, length long")


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null for revisits), payload_bytes, sha1, refers_to, revisit: payloads of at least ``min_bytes`` that a
    smaller page_id has too are revisits.

    First only digests are shuffled, counted before the exchange. Digests that occur more than once are then joined to the pages:
    broadcast while they are few, else both sides meet in a shuffle, which Spark splits where one digest is hot.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.length(body).cast("long").alias("payload_bytes"), F.unhex(F.sha1(body)).alias("sha1"))
    again = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "url")).alias("first"))
    again = materialise(again.filter("n > 1").select("sha1", "first.page_id", "first.url"), "repeated")
    known = again.select("sha1", F.col("page_id").alias("_id"), F.col("url").alias("_url"), F.lit(True).alias("_again"))
    joined = rows.join(small(known), "sha1", "left")
    first = F.coalesce("_again", F.lit(False)) & F.col("page_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url"))
    joined = joined.withColumn("_first", first)
    joined = joined.withColumn("revisit", F.coalesce("_again", F.lit(False)) & ~F.col("_first")).withColumn("html", F.when(~F.col("revisit"), F.col("html")))
    columns = ["page_id", "url", "html", "payload_bytes", "sha1", F.when(F.col("revisit"), F.col("_id")).alias("refers_to"), "revisit"]
    # Rows that repeat whole: one stays the response. They are counted where they lie before they meet, and written as so many rows.
    same = joined.filter("_first").groupBy("sha1", "page_id", "url").agg(F.count("*").alias("n"))
    twins = materialise(same.filter("n > 1").select("sha1", "page_id", "url", "n"), "twins")
    if not twins.limit(1).count():
        return joined.select(columns)
    one = joined.filter("_first").groupBy("sha1", "page_id", "url").agg(F.any_value("html").alias("html"), F.any_value("payload_bytes").alias("payload_bytes"), F.any_value("_id").alias("_id"))
    copies = twins.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("n").cast("int")))).repartition("n")
    size = rows.select("sha1", "payload_bytes").join(small(twins.select("sha1").distinct()), "sha1", "left_semi").groupBy("sha1").agg(F.any_value("payload_bytes").alias("payload_bytes"))
    copies = copies.join(small(materialise(size, "sizes")), "sha1")
    revisits = copies.select("page_id", "url", F.lit(None).cast("string").alias("html"), "payload_bytes", "sha1", F.col("page_id").alias("refers_to"), F.lit(True).alias("revisit"))
    responses = one.select("page_id", "url", "html", "payload_bytes", "sha1", F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to"), F.lit(False).alias("revisit"))
    return joined.filter("not _first").select(columns).unionByName(responses).unionByName(revisits)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = shared_dir(spark)
    archives = normalise_archives(write_archives(decide(pages), f"{folder}/mono"), f"{folder}/norm")
    return read_records(archives, f"{folder}/norm").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length")
