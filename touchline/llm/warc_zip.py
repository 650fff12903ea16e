"""WARC archives packaged in ZIP files: a writer, and a reader that never extracts.

Writing: each task packs its pages into ZIP files of a bounded size in the shared folder. A file holds
``archive/data.warc.gz``, stored, in which every record is a gzip member of its own, and
``indexes/index.cdxj``, stored, with the place of each record. A file gets a name that no other attempt of
its task uses; the table of files lists those of the attempts that Spark has committed.

Reading: a task finds the end-of-directory record in the last bytes of a file, or the ZIP64 one it points to,
reads the central directory, and from the index makes a row for each block of neighbouring records. The blocks
are dealt out evenly; each is read by one range request and its records are parsed one by one.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import shared_path, shuffle_partitions, stored

#: Payload bytes after which a task begins another file, and bytes of records that are read together.
FILE_BYTES = 64 << 20
BLOCK_BYTES = 2 << 20
#: A comment of a ZIP file has 65,535 bytes at most, its end record 22, the ZIP64 locator before it 20.
_TAIL = 65_535 + 22 + 20
DATA_NAME, INDEX_NAME = "archive/data.warc.gz", "indexes/index.cdxj"
_URN = "urn:page:"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit without the payload where ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>"]
    if url is not None:
        # Line ends and per cent signs in an address are written as escapes.
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _pack(data: bytes) -> bytes:
    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gz.compress(data) + gz.flush()


def write_zip(path: str, records: Iterator[tuple[str, bytes]]) -> tuple[int, int]:
    """Write one ZIP file of (id, packed record) at a URI; returns the numbers of records and of bytes."""
    store, at = fs.FileSystem.from_uri(path)
    index, offset = [], 0
    with store.open_output_stream(at) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        with package.open(DATA_NAME, "w", force_zip64=True) as data:
            for key, packed in records:
                data.write(packed)
                index.append(f"{key} {json.dumps({'offset': offset, 'length': len(packed)})}\n")
                offset += len(packed)
        package.writestr(INDEX_NAME, "".join(index))
    return len(index), offset


def write_archives(pages: DataFrame, directory: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` and return the table of files: path, records, bytes.

    The payload is the text in UTF-8; null counts as empty. Of rows with equal payloads of ``least_bytes``
    or more, those with the smallest id become responses and the others revisits of it; rows without an id
    are always responses. Rows that repeat an id and a payload are one page given twice and share their
    kind. A null address has no header. An empty table gives no files; other columns are ignored. ``directory`` is
    a URI that driver and executors share.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.coalesce(text_col, F.lit("")).alias("text"))
    keyed = rows.where((F.octet_length("text") >= least_bytes) & F.col("id").isNotNull()).select("id", F.sha2("text", 256).alias("s"))
    first = keyed.groupBy("s").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("s", "first")
    revisits = stored(keyed.join(first, "s").where("id <> first").distinct(), "revisits")
    # One id may stand on different texts, so the text's digest is part of the key.
    joined = rows.withColumn("s", F.sha2("text", 256)).join(revisits, ["id", "s"], "left").select("id", "url", F.col("text").cast("binary").alias("payload"), "first")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(directory)
        store.create_dir(at, recursive=True)
        rows = (row for batch in batches for row in zip(*(batch.column(k) for k in range(4))))
        following = next(rows, None)

        def some() -> Iterator[tuple[str, bytes]]:
            nonlocal following
            size = 0
            while following is not None and size < FILE_BYTES:
                page_id, url, payload, refers_to = (x.as_py() for x in following)
                size += len(payload)
                yield f"{'' if page_id is None else page_id}", _pack(_record(page_id, url, payload, refers_to))
                following = next(rows, None)

        while following is not None:
            path = f"{directory}/{uuid.uuid4().hex}.wacz"
            records, size = write_zip(path, some())
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

    return stored(joined.mapInArrow(written, "path string, records bigint, bytes bigint"), "archives")


@dataclass
class Member:
    """A stored member: its name and where its bytes are."""

    name: str
    offset: int
    size: int


def _zip64(extra: bytes, values: list[int], unset: list[int]) -> list[int]:
    """``values`` with those that equal their ``unset`` mark replaced from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body, k = extra[at + 4 : at + 4 + size], 0
            out = []
            for value, mark in zip(values, unset):
                if value == mark:
                    value = int.from_bytes(body[k : k + 8], "little")
                    k += 8
                out.append(value)
            return out
        at += 4 + size
    return values


def members(source: pa.NativeFile) -> list[Member]:
    """The stored members of an open ZIP file, from its central directory. Raises ValueError if it has none
    or holds a compressed member."""
    length = source.size()
    tail_at = max(0, length - _TAIL)
    source.seek(tail_at)
    tail = source.read(length - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end-of-directory record: not a ZIP file, or cut off")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    if (count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF) and end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":
        source.seek(struct.unpack_from("<Q", tail, end - 12)[0])
        wide = source.read(56)
        if wide[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end-of-directory record where its locator points")
        count, size, at = struct.unpack_from("<QQQ", wide, 32)
    source.seek(at)
    directory, found, k = source.read(size), [], 0
    for _ in range(count):
        if directory[k : k + 4] != b"PK\1\2":
            raise ValueError("a broken central directory")
        method = struct.unpack_from("<H", directory, k + 10)[0]
        packed, full = struct.unpack_from("<II", directory, k + 20)
        n, m, c = struct.unpack_from("<HHH", directory, k + 28)
        head = struct.unpack_from("<I", directory, k + 42)[0]
        name = directory[k + 46 : k + 46 + n].decode("utf-8", "replace")
        full, packed, head = _zip64(directory[k + 46 + n : k + 46 + n + m], [full, packed, head], [0xFFFFFFFF] * 3)
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        source.seek(head)
        local = source.read(30)
        found.append(Member(name, head + 30 + sum(struct.unpack_from("<HH", local, 26)), packed))
        k += 46 + n + m + c
    return found


def _blocks(path: str) -> Iterator[tuple[int, list[int]]]:
    """(offset in the file, lengths of the records from there on) of each block of an archive."""
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as source:
        by_name = {m.name: m for m in members(source)}
        data, index = by_name[DATA_NAME], by_name[INDEX_NAME]
        source.seek(index.offset)
        left, rest = index.size, b""
        begin, lengths, size = data.offset, [], 0
        while left:
            chunk = source.read(min(left, 1 << 20))
            if not chunk:
                raise ValueError(f"{path}: the index is cut off")
            left -= len(chunk)
            *lines, rest = (rest + chunk).split(b"\n")
            for line in lines:
                place = json.loads(line[line.index(b" ") + 1 :])
                if data.offset + place["offset"] != begin + size or size >= BLOCK_BYTES:
                    if lengths:
                        yield begin, lengths
                    begin, lengths, size = data.offset + place["offset"], [], 0
                lengths.append(place["length"])
                size += place["length"]
        if lengths:
            yield begin, lengths


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    length = int(headers["content-length"])
    if len(rest) < length:
        raise ValueError("a WARC record is cut off")
    return headers, rest[:length]


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of ``archives`` (path: URIs of ZIP files): page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, payload (binary, null for revisits).

    The size and digest of a revisit are those of the payload it stands for. A response whose payload does
    not have the digest or size it states fails the read. The table of files may be empty.
    """
    spark = archives.sparkSession

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for offset, lengths in _blocks(path):
                    yield pa.RecordBatch.from_pydict({"path": [path], "offset": [offset], "lengths": pa.array([lengths], pa.list_(pa.int64()))})

    def ids(text: str | None) -> int | None:
        found = (text or "").strip("<>").removeprefix(_URN)
        return int(found) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path, offset, lengths in zip(*(batch.column(k).to_pylist() for k in range(3))):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as source:
                    source.seek(offset)
                    raw = memoryview(source.read(sum(lengths)))
                rows, size, start = [], 0, 0
                for length in lengths:
                    headers, block = parse_record(zlib.decompress(raw[start : start + length], 31))
                    start += length
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    whole = headers["warc-type"] == "response"
                    if whole and (len(payload) != stated or sha1_base32(payload) != digest):
                        raise ValueError(f"{path}: the payload of {headers['warc-record-id']} does not have its digest")
                    url = headers.get("warc-target-uri")
                    url = url and re.sub(r"%([01][0-9A-F]|2[05]|7F)", lambda m: chr(int(m[1], 16)), url)
                    rows.append((ids(headers["warc-record-id"]), url, headers["warc-type"], ids(headers.get("warc-refers-to")), stated, digest, payload if whole else None))
                    size += len(payload)
                    if size >= BLOCK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    blocks = archives.select("path").repartition(shuffle_partitions(spark)).mapInArrow(located, "path string, offset bigint, lengths array<bigint>")
    dealt = blocks.repartition(2 * shuffle_partitions(spark))
    return dealt.mapInArrow(read, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, shared_path(pages.sparkSession, "warc"), id_col, url_col, text_col))
