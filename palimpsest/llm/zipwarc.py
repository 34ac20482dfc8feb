"""Web archives packaged in ZIP files, written and read without extraction.

A package holds archive/data.warc.gz (records, each compressed on its own) and indexes/index.cdxj (a line
for each record: key, place, length), both stored uncompressed. The reader takes the end record, the ZIP64
records where they are present, the central directory and the member's local header by range reads, then the index, then
the records that are asked for.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textkit import looked_up, materialise, shared_folder, sized
from palimpsest.llm.idstore import publish

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(key) -> str:
    return f"<urn:palimpsest:page:{'' if key is None else key}>"


def record(key, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that names the record with an equal one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join((url or "").split())), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case, and the payload behind the block's HTTP header."""
    if not data.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    end = data.index(b"\r\n\r\n")
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = data[end + 4 : end + 4 + int(fields["content-length"])]
    _, gap, payload = block.partition(b"\r\n\r\n")
    return fields, payload if gap else block


def page_of(identifier: str) -> int | None:
    tail = identifier.strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


class ZipReader:
    """Members of a ZIP file by range reads; read(offset, length) and size are all it needs of a file."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 65557)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of a central directory")
        count, length, offset = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, offset):
            locator = read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, length, offset = struct.unpack_from("<QQQ", end64, 32)
        self.members = self._directory(read(offset, length), count)

    @staticmethod
    def _directory(data: bytes, count: int) -> dict[str, dict]:
        out, at = {}, 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a damaged central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, size, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while e + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # 64-bit values, of those fields only that are full here
                    wide = list(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    if size == 0xFFFFFFFF:
                        size = wide.pop(0)
                    if packed == 0xFFFFFFFF:
                        packed = wide.pop(0)
                    if header == 0xFFFFFFFF:
                        header = wide.pop(0)
                e += 4 + n
            out[name] = {"method": method, "size": size, "packed": packed, "header": header}
            at += 46 + n_name + n_extra + n_note
        return out

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        member = self.members[name]
        if member["method"] != 0:
            raise ValueError("the member is not stored")
        head = self.read(member["header"], 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("a damaged local header")
        return member["header"] + 30 + sum(struct.unpack_from("<HH", head, 26))

    def range(self, name: str, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.members[name]["size"]:
            raise ValueError("beyond the member")
        return self.read(self.start(name) + offset, length)


def write_packages(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", payload: str = "html", package_bytes: int = 256 << 20) -> DataFrame:
    """Writes one record for each row, in packages under root, and returns path (below root) and number of records of each.

    payload is a string column; null counts as empty. Of rows with equal payloads those with the largest key are responses, the others
    revisit it; null keys are less than all others, and of payloads with null keys only all rows are responses. Columns other than these three
    aren't read. A payload that a third of all rows have is counted by an aggregation that
    combines before its shuffle, and its rows are dealt out to several tasks. An empty table gives no package.
    """
    source = pages.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("payload"))
    source = source.withColumn("digest", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    largest = materialise(source.groupBy("digest").agg(F.count("*").alias("c"), F.max("key").alias("last")), "digests")
    rows = looked_up(source, largest, "digest", ["key", "url"]).select("key", "url", "payload", "last")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        made: list[tuple[str, int]] = []
        feed = ((k, u, p, last) for b in batches for k, u, p, last in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held = next(feed, None)
        while held is not None:
            lines: list[str] = []

            def write(out):
                nonlocal held
                with zipfile.ZipFile(_Forward(out), "w", zipfile.ZIP_STORED, allowZip64=True) as package:
                    with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
                        at = 0
                        while held is not None and at < package_bytes:
                            k, u, p, last = held
                            revisit = k != last
                            packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                            data = packer.compress(record(k, u, p.encode(), last, revisit)) + packer.flush()
                            member.write(data)
                            lines.append(json.dumps({"key": k, "type": "revisit" if revisit else "response", "offset": at, "length": len(data)}))
                            at += len(data)
                            held = next(feed, None)
                    package.writestr(zipfile.ZipInfo(INDEX), "\n".join(lines))

            name = f"part-{part:05d}-{len(made):04d}.wacz"
            publish(root, name, write)
            made.append((name, len(lines)))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made])], names=["path", "records"])

    return materialise(rows.mapInArrow(run, "path string, records bigint"), "packages")


class _Forward:
    """A stream that can be written and told, not sought."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


def _opened(root: str, path: str) -> tuple[ZipReader, object]:
    files, base = pafs.FileSystem.from_uri(root)
    source = files.open_input_file(f"{base}/{path}")
    return ZipReader(lambda at, n: source.read_at(n, at), source.size()), source


def read_packages(packages: DataFrame, root: str, run_records: int = 2000, run_bytes: int = 8 << 20) -> DataFrame:
    """Every record of the packages (column path): page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to.

    The indexes are read first; their records are shared out in runs of neighbours of at most so many records and packed bytes (or one record), and
    each run is one range read; of what it unpacks to, a task holds run_bytes and one record. A
    response whose payload doesn't have its digest and length raises an error.
    """
    spark = packages.sparkSession

    def runs(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader, source = _opened(root, path)
                data = reader.range(INDEX, 0, reader.members[INDEX]["size"])
                lines = [json.loads(x) for x in data.decode().split("\n") if x]
                source.close()
                low = 0
                while low < len(lines):
                    high, total = low + 1, lines[low]["length"]
                    while high < len(lines) and high - low < run_records and total + lines[high]["length"] <= run_bytes:
                        total += lines[high]["length"]
                        high += 1
                    part, low = lines[low:high], high
                    sizes = [x["length"] for x in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([part[0]["offset"]]), pa.array([sizes], pa.list_(pa.int64()))], names=["path", "offset", "lengths"]
                    )

    def records(batches):
        for batch in batches:
            for path, offset, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader, source = _opened(root, path)
                data, at, held = reader.range(DATA, offset, sum(lengths)), 0, 0
                rows: list[tuple] = []
                for n in lengths:
                    fields, payload = parse_record(zlib.decompress(data[at : at + n], 31))
                    at += n
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    size = int(fields["x-payload-length"])
                    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"a damaged payload in {path}")
                    first = kind == "response"
                    rows.append((page_of(fields["warc-record-id"]), fields["warc-target-uri"], kind, payload.decode() if first else None, size, digest, None if first else page_of(fields["warc-refers-to"])))
                    held += len(payload)
                    if held >= run_bytes:
                        yield table(rows)
                        rows, held = [], 0
                source.close()
                if rows:
                    yield table(rows)

    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    listed = packages.select("path").repartition(sized(spark)).mapInArrow(runs, "path string, offset bigint, lengths array<bigint>")
    schema = "page_id bigint, url string, record_type string, payload string, payload_bytes bigint, payload_digest string, refers_to bigint"
    return listed.repartition(sized(spark)).mapInArrow(records, schema)


def new_root(spark) -> str:
    return shared_folder(spark, "warc")
