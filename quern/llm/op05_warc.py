"""WARC records in ZIP-packaged web archives, written and read by range.

An archive is a ZIP file whose members are stored, not deflated: archive/data.warc.gz, a gzip member for each record,
and indexes/index.cdx, a line for each record with its offset and length inside the data member. The reader parses the
end of central directory, the ZIP64 one where there is one, and the central directory; it finds the members' places from
their local headers, and then reads single records by their byte range. Nothing is extracted or read whole.

Archives lie below the session's shared folder and are opened with pyarrow's file systems, so a folder can be file://,
hdfs:// or an object store. Each task writes archives of its own name; only those that the committed manifest names
count, so a task that is run again leaves an orphan file and no repeated record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import K1, K2, cut, lookup, repeated_rows, row_keys, work_folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Fixed values of the ZIP format: signatures of its headers, and the marks of a field that ZIP64 holds instead.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL16, FULL32, ZIP64_EXTRA = 0xFFFF, 0xFFFFFFFF, 0x0001

ARCHIVE_BYTES = 256 << 20
CHUNK_BYTES = 8 << 20
MANIFEST = "archive string, n_records long, n_bytes long"
RECORDS = "record_id string, target_uri string, record_type string, payload_digest string, refers_to string, payload_bytes long, payload binary"


def record_types(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records of rows (K1, K2, key, uri, digest as hex, n: payload bytes): those with record_type, refers_to and copies.

    Of rows with equal payloads of at least min_bytes, one with the largest key (nulls least) is the response and all
    others revisit it; smaller payloads are all responses. Rows of equal keys are one row here, as often as copies says. One
    payload may have any share of the rows: the table of payloads is gathered with partial sums, and hot ones are broadcast.
    """
    best = F.max(F.struct(F.col("key").isNotNull().alias("some"), "key", K1, K2)).alias("best")
    owners = rows.groupBy("digest").agg(best, F.count("*").alias("copies"))
    found = lookup(rows, owners, ["digest"], ["best"], "copies", rows.count())
    deduped, own = F.col("n") >= min_bytes, (F.col(f"best.{K1}") == F.col(K1)) & (F.col(f"best.{K2}") == F.col(K2))
    kinds = found.select(*rows.columns, deduped.alias("__d"), own.alias("__own"), F.col("best.key").alias("refers_to"))
    named = kinds.groupBy(*rows.columns, "__d", "__own", "refers_to").agg(F.count("*").alias("copies"))
    response = named.filter("__own or not __d").withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast(rows.schema["key"].dataType), "copies": F.when(F.col("__d"), 1).otherwise(F.col("copies"))})
    revisit = named.withColumn("copies", F.when(F.col("__own"), F.col("copies") - 1).otherwise(F.col("copies"))).filter("__d and copies > 0").withColumn("record_type", F.lit("revisit"))
    return response.unionByName(revisit).drop("__d", "__own")


def base32_digest(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_bytes(record_id: str | None, uri: str, kind: str, digest: str, refers_to: str | None, payload: bytes, size: int | None = None) -> bytes:
    """A WARC/1.1 record. A revisit holds the HTTP header alone, whose Content-Length is the full payload's: size, where no payload is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id or ''}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(uri.split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to or ''}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The inverse of record_bytes, for one record's uncompressed bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    named = lambda k: (fields[k][len("<urn:page:") : -1] or None) if k in fields else None
    kind = fields["warc-type"]
    return {
        "record_id": named("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "record_type": kind,
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "refers_to": named("warc-refers-to"),
        "payload_bytes": int(_fields(http)["content-length"]), "payload": None if kind == "revisit" else payload,
    }


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class ZipWriter:
    """Stored members, one after the other, to a stream. Sizes are put right in the central directory, with ZIP64 fields."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.members.append([name.encode(), self.at, 0, 0])
        name_bytes = name.encode()
        # bit 3: size and checksum come after the data, as 64-bit values because of the ZIP64 field
        extra = struct.pack("<HHQQ", ZIP64_EXTRA, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 8, 0, 0, 33, 0, FULL32, FULL32, len(name_bytes), len(extra)) + name_bytes + extra)

    def write(self, data: bytes) -> int:
        """Where the data begins inside the member."""
        import zlib

        m = self.members[-1]
        at, m[2], m[3] = m[2], m[2] + len(data), zlib.crc32(data, m[3])
        self._put(data)
        return at

    def end(self) -> None:
        _, _, n, crc = self.members[-1]
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, n, n))

    def close(self) -> None:
        start = self.at
        for name, at, n, crc in self.members:
            extra = struct.pack("<HHQQQ", ZIP64_EXTRA, 24, n, n, at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 8, 0, 0, 33, crc, FULL32, FULL32, len(name), len(extra), 0, 0, 0, 0, FULL32) + name + extra)
        size, end64 = self.at - start, self.at
        k = len(self.members)
        self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, k, k, size, start))
        self._put(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, min(k, FULL16), min(k, FULL16), min(size, FULL32), FULL32, 0))


def zip_members(read, size: int) -> dict[str, tuple[int, int]]:
    """name -> (offset, length) of the stored members. read(offset, length) gives bytes.

    Only the tail, the directories and the members' local headers are read. A comment after the end record is
    allowed. A member that isn't stored is an error.
    """
    tail_at = max(0, size - 22 - FULL16 - 20)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == count or FULL32 in (length, start):
        signature, _, end64, _ = struct.unpack("<IIQI", read(tail_at + at - 20, 20))
        if signature != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        signature, *_, count, length, start = struct.unpack("<IQHHIIQQQQ", read(end64, 56))
        if signature != END64:
            raise ValueError("no ZIP64 end of central directory")
    directory, out, p = read(start, length), {}, 0
    for _ in range(count):
        signature, _, _, _, method, _, _, _, packed, n, ln, lx, lc, _, _, _, at = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, p)
        if signature != CENTRAL:
            raise ValueError("broken central directory")
        name, extra = directory[p + 46 : p + 46 + ln].decode(), directory[p + 46 + ln : p + 46 + ln + lx]
        n, packed, at = _wide(extra, n, packed, at)
        if method or n != packed:
            raise ValueError(f"{name} is not stored")
        ln2, lx2 = struct.unpack("<HH", read(at + 26, 4))
        out[name] = (at + 30 + ln2 + lx2, n)
        p += 46 + ln + lx + lc
    return out


def _wide(extra: bytes, *values: int) -> list[int]:
    """values, those that are full replaced by the ZIP64 field's, which has just them, in this order."""
    out, p = list(values), 0
    while p + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, p)
        if tag == ZIP64_EXTRA:
            rest = iter(struct.unpack_from(f"<{n // 8}Q", extra, p + 4))
            return [next(rest) if v == FULL32 else v for v in out]
        p += 4 + n
    return out


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write records (record_id, target_uri, record_type, digest as hex, refers_to, size, payload binary); the manifest comes back.

    A task begins a new archive when one has archive_bytes. Null uris and payloads are written as empty ones; size is
    the payload's, also where a revisit comes without it. A null id is written as an empty one and read as null.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = name = None
        done, lines, records_ = [], [], 0

        def close():
            if out:
                zipped.end()
                zipped.begin(INDEX)
                zipped.write("".join(lines).encode())
                zipped.end()
                zipped.close()
                out.close()
                done.append((name, records_, zipped.at))

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if out is None or zipped.at >= archive_bytes:
                    close()
                    name = f"{uuid.uuid4().hex}.wacz"
                    out, lines, records_ = store.open_output_stream(f"{root}/{name}"), [], 0
                    zipped = ZipWriter(out)
                    zipped.begin(DATA)
                raw = record_bytes(r["record_id"], r["target_uri"] or "", r["record_type"], base32_digest(r["digest"]), r["refers_to"], r["payload"] or b"", r["size"])
                packed = gzip.compress(raw, 3, mtime=0)
                at, records_ = zipped.write(packed), records_ + 1
                lines.append(f"{at} {len(packed)}\n")
        close()
        yield pa.RecordBatch.from_pydict({"archive": [x[0] for x in done], "n_records": [x[1] for x in done], "n_bytes": [x[2] for x in done]}, pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return cut(records.mapInArrow(task, MANIFEST))


def read_archives(manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The records of the manifest's archives. Indexes are split into ranges of about chunk_bytes, dealt over all tasks.

    A response whose payload does not have its digest is an error.
    """

    def ranges(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as f:
                    places = zip_members(lambda at, n, f=f: f.read_at(n, at), f.size())
                    data, (at, n) = places[DATA][0], places[INDEX]
                    lines = [tuple(map(int, x.split())) for x in f.read_at(n, at).decode().splitlines()]
                rows, held = [], 0
                for i, (_, length) in enumerate(lines):
                    if not rows or held >= chunk_bytes:
                        rows.append([])
                        held = 0
                    rows[-1].append(i)
                    held += length
                yield pa.RecordBatch.from_pydict({"archive": [name] * len(rows), "offsets": [[data + lines[i][0] for i in x] for x in rows], "lengths": [[lines[i][1] for i in x] for x in rows]}, pa.schema([("archive", pa.string()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]))

    def records(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    rows = []
                    for at, n in zip(offsets, lengths, strict=True):
                        r = parse_record(gzip.decompress(f.read_at(n, at)))
                        if r["payload"] is not None and base32_digest(hashlib.sha1(r["payload"]).hexdigest()) != r["payload_digest"]:
                            raise ValueError(f"record {r['record_id']} of {name} is damaged")
                        rows.append(r)
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([(k, pa.string()) for k in ("record_id", "target_uri", "record_type", "payload_digest", "refers_to")] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
    parts = max(manifest.sparkSession.sparkContext.defaultParallelism, int(manifest.agg(F.sum("n_bytes")).first()[0] or 0) // chunk_bytes)
    chunks = manifest.select("archive").mapInArrow(ranges, "archive string, offsets array<long>, lengths array<long>")
    return chunks.repartition(parts, "archive", F.get("offsets", F.lit(0))).mapInArrow(records, RECORDS)


def package_pages(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html; further columns are left out) as records; the manifest comes back.

    A record for each row. A null html is an empty payload, a null url an empty one. Of equal payloads the response is one
    with the largest page_id; a page_id may be null (the least) or there several times: rows that share it are told apart
    by url and html, and of wholly equal rows one counts as the first. Only responses take their payload along.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns(row_keys(rows))
    small = cut(rows.select(K1, K2, F.col("page_id").alias("key"), F.col("url").alias("uri"), F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")))
    kinds = cut(record_types(small, min_bytes))
    columns = [F.col("key").cast("string").alias("record_id"), F.col("uri").alias("target_uri"), "record_type", "digest", F.col("refers_to").cast("string").alias("refers_to"), F.col("n").alias("size")]
    bodies = rows.groupBy(K1, K2).agg(F.first("payload").alias("payload"))
    responses = kinds.filter("record_type = 'response'").join(bodies.hint("merge"), [K1, K2])
    revisits = kinds.filter("record_type = 'revisit'").withColumn("payload", F.lit(None).cast("binary"))
    spread = repeated_rows(responses.unionByName(revisits).select(K1, K2, *columns, "payload", "copies"), "copies")
    return write_archives(spread.drop(K1, K2), folder)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    manifest = package_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    records = read_archives(manifest, folder)
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS owner FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * CAST(i % 4 AS BIGINT))) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM m
"""
