"""WARC records in ZIP packages: writing, and reading by range without extraction.

A package is a ZIP archive whose members are stored, not compressed: archives under ``archive/`` hold
records one after another, indexes under ``indexes/`` a line for each record with its archive, offset and
length. The reader fetches the end of the package, follows the ZIP64 locator where there is one,
parses the central directory and the indexes, and then asks for the ranges it needs through
``fetch(offset, size)``. Packages are files of any size, opened by path; what is read of them are those
ranges, in tasks dealt by place. Where a store can't be opened by path, packages of up to 2 GB travel as
rows with a binary column, as the binaryFile source gives them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

Fetch = Callable[[int, int], bytes]
DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC/1.1 record. A revisit carries no payload, only the digest and size of the full one."""
    name = lambda i: "" if i is None else f"urn:page:{i}"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name(page_id)}>", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if url is not None:
        # What a header line cannot hold is kept beside the address.
        plain = quote(url, safe="".join(map(chr, range(33, 127)))) if re.search(r"[\x00-\x20\x7f]", url) else url
        head.append(f"WARC-Target-URI: {plain}")
        if plain != url:
            head.append("X-Target-URI-UTF8: " + base64.b64encode(url.encode("utf-8", "surrogatepass")).decode())
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(refers_to)}>"]
    body = payload if kind == "response" else b""
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name (and ``version``), and the block."""
    head, _, rest = bytes(raw).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {"version": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size + 4 or rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("truncated WARC record")
    return fields, rest[:size]


def package(records: list[bytes], zip64: bool = False) -> bytes:
    """A ZIP package of records with their index; zip64 forces the large format for any size."""
    out = io.BytesIO()
    _write(out, records, zip64)
    made = out.getvalue()
    return _as_zip64(made) if zip64 else made


def _write(out, records: Iterator[bytes] | list[bytes], zip64: bool) -> None:
    """A package written as its records come; only the index is held."""
    at, lines = 0, []
    member = lambda name: zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(member(DATA), "w", force_zip64=zip64) as f:
            for r in records:
                f.write(r)
                lines.append(f"- {len(lines)} " + json.dumps({"filename": DATA.rpartition("/")[2], "offset": at, "length": len(r)}) + "\n")
                at += len(r)
        with z.open(member(INDEX), "w", force_zip64=zip64) as f:
            for line in lines:
                f.write(line.encode())


def _as_zip64(made: bytes) -> bytes:
    """The same package with a ZIP64 end record and locator, and a classic end record that defers to them."""
    at = made.rindex(b"PK\x05\x06")
    _, _, _, _, n, size, offset, _ = struct.unpack("<4s4H2LH", made[at : at + 22])
    end64 = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, offset)
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, at, 1)
    return made[:at] + end64 + locator + struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def directory(fetch: Fetch, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a package by name: (offset of the local header, stored size, method)."""
    tail_at = max(0, size - 22 - 65535)
    tail = fetch(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, offset = struct.unpack("<10xH2L2x", tail[at : at + 22])
    if (n == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF) and tail_at + at >= 20:
        sign, end64 = struct.unpack("<4s4xQ4x", fetch(tail_at + at - 20, 20))
        if sign == b"PK\x06\x07":
            sign, n, length, offset = struct.unpack("<4s28xQQQ", fetch(end64, 56))
            if sign != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator points to no end record")
    raw, found, p = fetch(offset, length), {}, 0
    for _ in range(n):
        sign, method, packed, full, n_name, n_extra, n_note, local = struct.unpack("<4s6xH8xLL3H8xL", raw[p : p + 46])
        if sign != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        name, extra = raw[p + 46 : p + 46 + n_name].decode(), raw[p + 46 + n_name : p + 46 + n_name + n_extra]
        q = 0
        while q + 4 <= len(extra):
            kind, width = struct.unpack("<HH", extra[q : q + 4])
            if kind == 1:  # the ZIP64 field holds, in this order, only what overflowed
                big = iter(struct.unpack(f"<{width // 8}Q", extra[q + 4 : q + 4 + width // 8 * 8]))
                full = next(big) if full == 0xFFFFFFFF else full
                packed = next(big) if packed == 0xFFFFFFFF else packed
                local = next(big) if local == 0xFFFFFFFF else local
            q += 4 + width
        found[name] = (local, packed, method)
        p += 46 + n_name + n_extra + n_note
    return found


def stored_range(fetch: Fetch, member: tuple[int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes lie: (offset, size). A compressed member can't be read by range."""
    local, size, method = member
    if method != 0:
        raise ValueError(f"member is compressed (method {method})")
    sign, n_name, n_extra = struct.unpack("<4s22xHH", fetch(local, 30))
    if sign != b"PK\x03\x04":
        raise ValueError("damaged local header")
    return local + 30 + n_name + n_extra, size


def _walk(fetch: Fetch, base: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of an archive without an index, from their headers alone."""
    at = 0
    while at < size:
        head, step = b"", 2048
        while b"\r\n\r\n" not in head:
            if len(head) >= size - at:
                raise ValueError("truncated WARC record")
            head, step = fetch(base + at, min(step, size - at)), 2 * step
        header = head.partition(b"\r\n\r\n")[0]
        found = re.search(rb"(?im)^content-length:\s*(\d+)", header)
        if not header.startswith(b"WARC/") or not found:
            raise ValueError("not a WARC record")
        length = len(header) + 8 + int(found[1])
        yield at, length
        at += length


def record_ranges(fetch: Fetch, size: int) -> Iterator[tuple[str, int, int]]:
    """(archive, offset in the package, length) of every record: by the indexes, and by its headers for an archive that none names.

    An index line ends in JSON with offset, length and filename; without a filename it means the only archive.
    """
    members = directory(fetch, size)
    archives = {name: stored_range(fetch, m) for name, m in members.items() if name.startswith("archive/") and not name.endswith("/")}
    by_file = {name.rpartition("/")[2]: name for name in archives}
    seen = set()
    for name in (n for n in members if n.startswith("indexes/") and not n.endswith("/")):
        index_at, index_size = stored_range(fetch, members[name])
        for line in fetch(index_at, index_size).decode().splitlines():
            if "{" not in line:
                continue
            entry = json.loads(line[line.index("{") :])
            archive = by_file.get(str(entry.get("filename", "")).rpartition("/")[2]) or (next(iter(archives)) if len(archives) == 1 and "filename" not in entry else None)
            if archive is None:
                raise ValueError(f"the index names no archive of the package: {line!r}")
            base, length = archives[archive]
            offset, n = int(entry["offset"]), int(entry["length"])
            if offset + n > length:
                raise ValueError("the index points beyond its archive")
            seen.add(archive)
            yield archive, base + offset, n
    for archive, (base, length) in archives.items():
        if archive not in seen:
            if archive.endswith(".gz"):
                raise ValueError(f"{archive} is compressed and has no index")
            yield from ((archive, base + at, n) for at, n in _walk(fetch, base, length))


def _record_at(fetch: Fetch, archive: str, at: int, n: int) -> bytes:
    raw = fetch(at, n)
    return gzip.decompress(raw) if archive.endswith(".gz") else raw


def read_package(fetch: Fetch, size: int) -> Iterator[bytes]:
    """The records of every archive in a package, each fetched by its own range."""
    for r in record_ranges(fetch, size):
        yield _record_at(fetch, *r)


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest and refers_to (null: a response).

    A null html is an empty payload. Of rows with one payload of at least least_bytes bytes, those
    with the smallest page_id are responses and the rest refer to it; rows without page_id come last.
    Only digests that stand in several rows are joined back, and sums are made before the shuffle.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    again = df.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    again = scratch.keep(again.where("n > 1").drop("n"), "payloads")
    return df.join(again, "payload_digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id")


def write_packages(pages: DataFrame, target_bytes: int = 8 << 20) -> DataFrame:
    """Packages (content binary) of about target_bytes each from with_revisits(), for stores that tasks can't open by path. No pages: none."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for r in (r for b in batches for r in _records_of(b)):
            held.append(r)
            size += len(r)
            if size >= target_bytes:
                yield pd.DataFrame({"content": [package(held)]})
                held, size = [], 0
        if held:
            yield pd.DataFrame({"content": [package(held)]})

    return pages.select(*_columns()).mapInPandas(pack, "content binary")


class _Stream:
    """Only what a ZIP writer needs of an output stream that can't seek."""

    def __init__(self, out):
        self.write, self.flush = out.write, out.flush


def write_files(pages: DataFrame, folder: str, target_bytes: int = 64 << 20) -> DataFrame:
    """(path, size) of packages of about target_bytes, written into a folder that all tasks reach, from with_revisits().

    Records go out as they come, so a payload of any length that a row can hold will do. A task that is run again
    writes files of other names; those of lost attempts are not listed. No pages: no packages.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        left = (r for b in batches for r in _records_of(b))
        for first in left:
            path, size = f"{base}/{uuid.uuid4().hex}.wacz", 0

            def some(first=first):
                nonlocal size
                size = len(first)
                yield first
                while size < target_bytes and (r := next(left, None)) is not None:
                    size += len(r)
                    yield r

            with fs.open_output_stream(path) as out:
                _write(_Stream(out), some(), True)
            yield pd.DataFrame({"path": [f"{folder}/{path.rpartition('/')[2]}"], "size": [fs.get_file_info(path).size]})

    return pages.select(*_columns()).mapInPandas(write, "path string, size long")


def _columns() -> list:
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]
    # Null ids come as floats in pandas: as text they keep every digit.
    return [F.col(c).cast("string") if c in ("page_id", "refers_to") else F.col(c) for c in columns]


def _records_of(b: pd.DataFrame) -> Iterator[bytes]:
    whole = lambda x: None if pd.isna(x) else int(x)
    for page_id, url, payload, n, digest, refers_to in zip(b.page_id, b.url, b.payload, b.payload_bytes, b.payload_digest, b.refers_to):
        refers_to = whole(refers_to)
        yield record("response" if refers_to is None else "revisit", whole(page_id), url, digest, n, refers_to, payload)


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _row(raw: bytes, payloads: bool) -> tuple:
    """RECORDS of one record. A response's digest and size are those of its block and must agree with the header; a revisit's come from its header."""
    named = lambda x: int(x[10:-1]) if x and len(x) > 2 else None
    h, block = parse_record(raw)
    digest, size = h["warc-payload-digest"].removeprefix("sha256:"), int(h["x-payload-length"])
    if h["warc-type"] == "response" and (size != len(block) or digest != hashlib.sha256(block).hexdigest()):
        raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
    kept = h.get("x-target-uri-utf8")
    url = base64.b64decode(kept).decode("utf-8", "surrogatepass") if kept else h.get("warc-target-uri")
    return named(h["warc-record-id"]), url, size, digest, h["warc-type"], named(h.get("warc-refers-to")), block if payloads else None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in RECORDS.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})


#: Bytes of records that are handed on at once.
_AT_ONCE = 4 << 20


def read_files(packages: DataFrame, payloads: bool = True, stretch: int = 32 << 20) -> DataFrame:
    """A row (RECORDS) for each record of packages (path, size); other columns are ignored.

    One pass reads directories and indexes, and lists ranges; a second fetches them, dealt by stretches of a
    package, so that a package of any size is read by many tasks. A null path has no records.
    """

    def opened(path: str):
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        return fs.open_input_file(at)

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b.path.dropna():
                with opened(path) as f:
                    found = list(record_ranges(lambda o, n, f=f: f.read_at(n, o), f.size()))
                if found:
                    yield pd.DataFrame([(path, *r) for r in found], columns=["path", "archive", "at", "n"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, f, rows, size = None, None, [], 0
        for b in batches:
            for p, archive, at, n in zip(b.path, b.archive, b["at"], b.n):
                if p != path:
                    if f is not None:
                        f.close()
                    path, f = p, opened(p)
                rows.append(_row(_record_at(lambda o, m: f.read_at(m, o), archive, int(at), int(n)), payloads))
                size += int(n)
                if size >= _AT_ONCE:
                    yield _frame(rows)
                    rows, size = [], 0
        if f is not None:
            f.close()
        if rows:
            yield _frame(rows)

    found = packages.select("path").mapInPandas(ranges, "path string, archive string, at long, n long")
    dealt = found.repartition("path", F.floor(F.col("at") / stretch)).sortWithinPartitions("path", "at")
    return dealt.mapInPandas(read, RECORDS)


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """A row (RECORDS) for each record of packages with a binary column ``content``; other columns are ignored. A null content has no records."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b.content:
                if content is None:
                    continue
                view = memoryview(content)
                rows = [_row(raw, payloads) for raw in read_package(lambda o, n, view=view: bytes(view[o : o + n]), len(view))]
                if rows:
                    yield _frame(rows)

    return packages.select("content").mapInPandas(read, RECORDS)
