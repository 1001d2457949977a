"""WARC records in ZIP packages, written and read without extraction.

A package is a ZIP file with stored (uncompressed) members: archive/*.warc.gz, in which each record is a gzip member of its own,
and indexes/index.cdxj with a line for each record (key, offset and length in its archive member). The reader fetches the end of the file, parses the end-of-central-directory
record (the ZIP64 one where a field is saturated), the central directory and the local headers, and so finds where a
stored member's bytes lie in the package. With the index it then fetches ranges of records.

Payloads are html in UTF-8 (null: empty). Of pages with equal payloads of at least min_revisit bytes, the one with
the largest page_id is a response and the others are revisits that refer to it; smaller payloads are all
responses. Rows that repeat a page_id are written and returned each (of equal payloads, rows with the largest
page_id are all responses). Rows without a page_id are records, too; they rank lowest. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow, tune

#: Bytes of records that one range request fetches (a longer record is fetched alone).
RANGE = 4 << 20
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Package:
    """Random access to the stored members of a ZIP file that can only be read by ranges."""

    def __init__(self, source, size: int) -> None:  # noqa: ANN001  anything with read_at(nbytes, offset)
        self.read_at = lambda at, n: source.read_at(n, at)
        self.size = size
        self.members = {name: (at, n, method) for name, at, n, method in self._directory()}

    def _directory(self) -> Iterator[tuple[str, int, int, int]]:
        tail_at = max(0, self.size - 65_557)
        tail = bytes(self.read_at(tail_at, self.size - tail_at))
        end = tail.rfind(_END)
        while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(_END, 0, end)  # the signature can also stand in the comment
        if end < 0:
            raise ValueError("no end of central directory")
        count, size, start = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = bytes(self.read_at(tail_at + end - 20, 20))
            if locator[:4] != _LOCATOR:
                raise ValueError("no ZIP64 locator")
            end64 = bytes(self.read_at(struct.unpack_from("<Q", locator, 8)[0], 56))
            if end64[:4] != _END64:
                raise ValueError("no ZIP64 end of central directory")
            count, size, start = struct.unpack_from("<QQQ", end64, 32)
        raw, p = bytes(self.read_at(start, size)), 0
        for _ in range(count):
            if raw[p : p + 4] != _ENTRY:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, p + 8)
            packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, p + 20)
            at = struct.unpack_from("<I", raw, p + 42)[0]
            name = raw[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, q = raw[p + 46 + n_name : p + 46 + n_name + n_extra], 0
            while q + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, q)
                if tag == 1:  # 64-bit values, only for the fields that are saturated, in this order
                    wide, r = extra[q + 4 : q + 4 + n], 0
                    if plain == 0xFFFFFFFF:
                        plain, r = struct.unpack_from("<Q", wide, r)[0], r + 8
                    if packed == 0xFFFFFFFF:
                        packed, r = struct.unpack_from("<Q", wide, r)[0], r + 8
                    if at == 0xFFFFFFFF:
                        at = struct.unpack_from("<Q", wide, r)[0]
                q += 4 + n
            yield name, at, packed, method
            p += 46 + n_name + n_extra + n_note

    def place(self, name: str) -> tuple[int, int]:
        """Where in the package a stored member's bytes begin, and how many they are."""
        at, n, method = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        head = bytes(self.read_at(at, 30))
        if head[:4] != _LOCAL:
            raise ValueError("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return at + 30 + n_name + n_extra, n

    def member(self, name: str) -> bytes:
        return bytes(self.read_at(*self.place(name)))


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, url: str, page_id: int | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has no block."""
    block = payload if kind == "response" else b""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}").urn
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []
    head += [f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    names = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(names["Content-Length"])]
    if names["WARC-Type"] == "response" and "sha1:" + digest32(block) != names["WARC-Payload-Digest"]:
        raise ValueError("payload digest doesn't match")
    return names, block


def decided(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """page_id, url, html and record_type, refers_to."""
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(data, 256).alias("same"), F.length(data).cast("long").alias("size"))
    best = rows.groupBy("same").agg(F.max("page_id").alias("best"), F.count("*").alias("copies")).where("copies > 1").select("same", "best")
    again = (F.col("size") >= min_revisit) & F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    kind = F.when(again, "revisit").otherwise("response")
    return rows.join(best, "same", "left").select("page_id", "url", "html", kind.alias("record_type"), F.when(again, F.col("best")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes packages (one a task, under a name of its own, so a task that runs again does no harm) into folder.

    pages: decided(). Returns package, size of each package, lazily: materialise it, as each run writes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        where, at = opened(folder)
        where.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        index: list[str] = []
        with where.open_output_stream(f"{at}/{name}", compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as pack:
            with pack.open("archive/data.warc.gz", "w", force_zip64=True) as f:
                offset = 0
                for batch in batches:
                    for page, url, html, kind, ref in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                        payload = (html or "").encode()
                        url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                        digest = digest32(payload)
                        raw = gzip.compress(record(kind, url, page, payload, digest, ref), 3, mtime=0)
                        index.append(f"{page} {json.dumps({'url': url, 'digest': digest, 'offset': offset, 'length': len(raw), 'filename': 'data.warc.gz'})}\n")
                        f.write(raw)
                        offset += len(raw)
            if index:
                pack.writestr("indexes/index.cdxj", "".join(index))
        if index:
            info = where.get_file_info(f"{at}/{name}")
            yield {"package": [f"{folder}/{name}"], "size": [info.size]}
        else:
            where.delete_file(f"{at}/{name}")

    return arrow(pages.select("page_id", "url", "html", "record_type", "refers_to"), run, "package string, size long", pa.schema([("package", pa.string()), ("size", pa.int64())]))


def located(packages: DataFrame) -> DataFrame:
    """Ranges of whole records: package, start, starts (each record's offset in the range), size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, at = opened(uri)
                with where.open_input_file(at) as f:
                    pack = Package(f, size)
                    base = {m: pack.place(m)[0] for m in pack.members if m.startswith("archive/")}
                    rows: list[tuple[int, int]] = []
                    for line in pack.member("indexes/index.cdxj").decode().split("\n")[:-1]:
                        x = json.loads(line.split(" ", 1)[1])
                        rows.append((base["archive/" + x["filename"]] + x["offset"], x["length"]))
                out: dict[str, list] = {"package": [], "start": [], "starts": [], "size": []}
                for start, n in sorted(rows):
                    if out["size"] and start == out["start"][-1] + out["size"][-1] and out["size"][-1] + n <= RANGE:
                        out["starts"][-1].append(start - out["start"][-1])
                        out["size"][-1] += n
                    else:
                        for k, v in zip(out, (uri, start, [0], n), strict=True):
                            out[k].append(v)
                yield out

    types = pa.schema([("package", pa.string()), ("start", pa.int64()), ("starts", pa.list_(pa.int64())), ("size", pa.int64())])
    return arrow(packages, run, "package string, start long, starts array<long>, size long", types)


def read(packages: DataFrame) -> DataFrame:
    """Every record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null in revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for uri, start, starts, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                where, at = opened(uri)
                with where.open_input_file(at) as f:
                    raw = f.read_at(size, start)
                out: dict[str, list] = {k.name: [] for k in types}
                for a, b in zip(starts, [*starts[1:], size], strict=True):
                    head, block = parsed(gzip.decompress(raw[a:b]))
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    row = (number("X-Page-ID"), number("X-Payload-Length"), head["WARC-Payload-Digest"][5:], head["WARC-Type"], number("X-Refers-To-Page"), head["WARC-Target-URI"], block if head["WARC-Type"] == "response" else None)
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                yield out

    types = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
    ranges = located(packages)
    ranges = ranges.repartition(max(1, int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return arrow(ranges, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary", types)


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Writes pages to packages in the shared folder and reads every record back."""
    scratch = Scratch(spark, "warc")
    tune(spark)
    return read(scratch.table(write(decided(pages, min_revisit), f"{scratch.root}/packages"), "manifest"))
