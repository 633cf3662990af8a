"""WARC records in ZIP packages: written by Spark tasks, read back by range without extraction.

A package is a ZIP archive with stored (uncompressed) members: archives of WARC records
under archive/, each record a gzip member of its own or plain, and indexes under indexes/,
with a line for each record: its key, its stamp, and where in which archive it lies. A
reader takes the end-of-central-directory record from the tail (and the ZIP64 one where
numbers do not fit), the central directory for the members, the index members for the
records, and then each record by its byte range. Packages of other writers are read too:
several archives, gzipped indexes, lines in JSON or in the older columns by letter, and
records with ids, digests and lengths of other forms, or without.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.session import cut, new_folder
from sparkloom.sources.scratch import qualified

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Package size at which a task begins another one.
PACKAGE_BYTES = 64 << 20
#: Index lines that one reading task takes.
RANGE_RECORDS = 2048
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF
#: URI schemes of packages' folders, and the file systems that open them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
#: Identical payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000


def store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of a plain path. A scheme that cannot be opened is an error, never a local path."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", path)
    if scheme is None:
        return fs.LocalFileSystem(), path
    name = SCHEMES.get(scheme[1].lower())
    if name is None:
        raise ValueError(f"no file system for {scheme[1]}:")
    if name == "file":
        return fs.LocalFileSystem(), "/" + path[len(scheme[0]) :].lstrip("/")
    return fs.FileSystem.from_uri(name + path[len(scheme[1]) :])


# ---------------------------------------------------------------- writing


class Package:
    """A ZIP archive written front to back: add records, then close."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.lines, self.zip64 = out, 0, [], [], zip64
        self._begin(DATA)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _begin(self, name: str) -> None:
        """A local header whose sizes follow the data (flag bit 3), as they are not known yet."""
        self.member = {"name": name.encode(), "at": self.at, "crc": 0, "size": 0}
        self._write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 1 << 3, 0, 0, 0x21, 0, 0, 0, len(name), 0) + name.encode())
        self.member["data"] = self.at

    def _add(self, data: bytes) -> None:
        self.member["crc"] = zlib.crc32(data, self.member["crc"])
        self.member["size"] += len(data)
        self._write(data)

    def _end(self) -> None:
        m = self.member
        wide = "<IIQQ" if self.zip64 or m["size"] > _MAX32 else "<IIII"
        self._write(struct.pack(wide, 0x08074B50, m["crc"], m["size"], m["size"]))
        self.members.append(m)

    def record(self, key: str, record: bytes, kind: str) -> None:
        data = gzip.compress(record, 6, mtime=0)
        place = {"offset": self.member["size"], "length": len(data), "filename": DATA.partition("/")[2], "type": kind}
        self.lines.append(f"{key} 19700101000000 {json.dumps(place)}")
        self._add(data)

    @property
    def size(self) -> int:
        return self.at

    def close(self) -> None:
        self._end()
        self._begin(INDEX)
        self._add("".join(x + "\n" for x in sorted(self.lines)).encode("utf-8", "surrogatepass"))
        self._end()
        start = self.at
        for m in self.members:
            wide = self.zip64 or max(m["size"], m["at"]) > _MAX32
            extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["at"]) if wide else b""
            size, at = (_MAX32, _MAX32) if wide else (m["size"], m["at"])
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 1 << 3, 0, 0, 0x21, m["crc"], size, size, len(m["name"]), len(extra), 0, 0, 0, 0, at) + m["name"] + extra)
        length, n = self.at - start, len(self.members)
        if self.zip64 or max(start, length) > _MAX32:
            end64 = self.at
            self._write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, length, start))
            self._write(struct.pack("<IIQI", 0x07064B50, 0, end64, 1))
            start, length, n = _MAX32, _MAX32, _MAX16
        self._write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, length, start, 0))


def index_key(url: str | None) -> str:
    """A URL with its host's parts in reverse, as indexes are sorted: com,example)/path."""
    parts = re.match(r"(?:[A-Za-z][\w+.-]*://)?(?:www\.)?([^/?#:]*)(?::\d+)?([^#]*)", "".join(c for c in (url or "") if c > " "))
    host, path = parts.groups()
    return f"{','.join(reversed(host.lower().split('.')))}){(path or '/').replace('{', '%7B')}"


def warc_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit of the record of page refers_to, whose payload it leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    target = "".join(c for c in (url or "") if c >= " ")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


# ---------------------------------------------------------------- reading


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Values of a central directory entry, those of all ones taken from its ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body, k = extra[at + 4 : at + 4 + size], 0
            out = []
            for v in values:
                if v == _MAX32:
                    v = struct.unpack_from("<Q", body, k)[0]
                    k += 8
                out.append(v)
            return out
        at += 4 + size
    return values


def members(source, crcs: dict[str, int] | None = None) -> dict[str, tuple[int, int]]:
    """Where the data of each stored member begins, and its length; their checksums go into crcs."""
    size = source.size()
    tail = min(size, 22 + _MAX16)
    source.seek(size - tail)
    data = source.read(tail)
    at = data.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(data) or at + 22 + struct.unpack_from("<H", data, at + 20)[0] != len(data)):
        at = data.rfind(b"PK\x05\x06", 0, at)  # such bytes inside a comment
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", data, at + 10)
    if n == _MAX16 or _MAX32 in (length, start):
        source.seek(size - tail + at - 20)
        mark, _, where, _ = struct.unpack("<IIQI", source.read(20))
        if mark != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        source.seek(where)
        n, length, start = struct.unpack_from("<QQQ", source.read(56), 32)
    source.seek(start)
    data, at, out = source.read(length), 0, {}
    for _ in range(n):
        sig, _, _, _, how, _, _, crc, packed, plain, n_name, n_extra, n_note, _, _, _, local = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
        if sig != 0x02014B50:
            raise ValueError("broken central directory")
        name = data[at + 46 : at + 46 + n_name].decode()
        plain, packed, local = _wide(data[at + 46 + n_name : at + 46 + n_name + n_extra], [plain, packed, local])
        at += 46 + n_name + n_extra + n_note
        if how != 0:
            continue  # only stored members can be read by range
        source.seek(local)
        head = struct.unpack("<IHHHHHIIIHH", source.read(30))
        if head[0] != 0x04034B50:
            raise ValueError(f"no local header of {name}")
        if crcs is not None:
            crcs[name] = crc
        out[name] = (local + 30 + head[9] + head[10], packed)
    return out


def _inflated(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def index_lines(index: bytes) -> list[tuple[str | None, int, int | None]]:
    """(archive, offset, length) of each record in an index, plain or gzipped; archive and length are None where a line does not have them.

    Lines are `key stamp {json}`, `{json}`, or columns named by letters in a line ` CDX ...`
    (V the offset, S the length, g the archive). Lines that begin with ! are remarks.
    """
    out, letters = [], None
    for line in _inflated(index).decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if not line.strip() or line.startswith("!"):
            continue
        if line.lstrip().startswith("CDX "):
            letters = line.split()[1:]
        elif "{" in line:
            x = json.loads(line[line.index("{") :])
            out.append((x.get("filename"), int(x["offset"]), int(x["length"]) if x.get("length") not in (None, "", "-") else None))
        elif letters:
            x = dict(zip(letters, line.split()))
            out.append((x.get("g") if x.get("g") != "-" else None, int(x["V"]), int(x["S"]) if x.get("S", "-") != "-" else None))
        else:
            raise ValueError(f"an index line of unknown form: {line[:80]}")
    return out


def ranges(where: dict[str, tuple[int, int]], indexes: list[bytes]) -> list[tuple[int, int]]:
    """Byte ranges of all records in a package. A record without a length ends where the next one of its archive begins."""
    archives = {n.partition("/")[2]: place for n, place in where.items() if n.startswith("archive/") and not n.endswith("/")}
    lines: dict[str, dict[int, int | None]] = {}
    for name, offset, length in (x for index in indexes for x in index_lines(index)):
        if name is None and len(archives) == 1:
            name = next(iter(archives))
        own = next((n for n in (name, (name or "").removeprefix("archive/"), (name or "").rpartition("/")[2]) if n in archives), None)
        if own is None:
            raise ValueError(f"an index names archive {name}, which the package does not store")
        if not 0 <= offset < archives[own][1]:
            raise ValueError(f"an index names byte {offset} of {own}, which has {archives[own][1]}")
        lines.setdefault(own, {})[offset] = length
    out = []
    for own in sorted(lines):
        start, size = archives[own]
        offsets = sorted(lines[own])
        out += [(start + a, lines[own][a] or b - a) for a, b in zip(offsets, [*offsets[1:], size])]
    return out


def _digest(label: str | None) -> str | None:
    """A SHA-1 as hex, from base 32 or hex; None for others."""
    kind, _, value = (label or "").partition(":")
    if kind.strip().lower() not in ("sha1", "sha-1"):
        return None
    value = value.strip()
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else None


def _headers(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().decode("utf-8", "replace").lower(): v.strip().decode("utf-8", "replace") for k, colon, v in (x.partition(b":") for x in lines) if colon}


def parse_record(data: bytes) -> dict:
    """Headers and payload of a WARC record, gzipped or plain.

    Of HTTP records the payload is what follows the HTTP headers, of others the block. Ids
    of the form <urn:page:7> are page_ids; all are kept as text. A digest that is no SHA-1
    or missing is taken from the payload, null for a revisit.
    """
    raw = _inflated(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = _headers(head.split(b"\r\n")[1:])
    block = rest[: int(headers["content-length"])] if headers.get("content-length", "").isdigit() else rest.removesuffix(b"\r\n\r\n")
    payload, length = block, None
    if headers.get("content-type", "").lower().startswith("application/http") or block[:5] == b"HTTP/":
        http, _, payload = block.partition(b"\r\n\r\n")
        size = _headers(http.split(b"\r\n")[1:]).get("content-length", "")
        length = int(size) if size.isdigit() else None
    kind = headers.get("warc-type", "")
    page = lambda x: int(found[1]) if (found := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    own, sha1 = (headers.get("warc-record-id") or "").startswith("<urn:page:"), _digest(headers.get("warc-payload-digest"))
    there = kind != "revisit"
    return {
        "page_id": page(headers.get("warc-record-id")),
        "url": headers.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": page(headers.get("warc-refers-to")),
        "payload_bytes": length if not there or (own and length is not None) else len(payload),
        "payload_digest": sha1 or (hashlib.sha1(payload).hexdigest() if there else None),
        "payload": payload if there else None,
        "record_id": headers.get("warc-record-id"),
        "refers_to_id": headers.get("warc-refers-to"),
        "stamp": headers.get("warc-date"),
        "own": own,
    }


# ---------------------------------------------------------------- Spark jobs


def _write(folder: str):
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        system.create_dir(root, recursive=True)
        package, path = None, None

        def done():
            package.close()
            package.out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(package.lines)], pa.int64())], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if package is None:
                    name = f"{uuid.uuid4().hex}.wacz"  # a repeated task writes another file, which nothing refers to
                    path, package = f"{folder}/{name}", Package(system.open_output_stream(f"{root}/{name}"))
                payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                package.record(index_key(r["url"]), warc_record(r["page_id"], r["url"], payload, r["digest"], r["refers_to"]), "response" if r["refers_to"] is None else "revisit")
                if package.size >= PACKAGE_BYTES:
                    yield done()
                    package = None
        if package is not None:
            yield done()

    return run


def _locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges of the index lines of each package, RANGE_RECORDS records at a time."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, at = store(path)
            with system.open_input_file(at) as source:
                where, indexes = members(source, crcs := {}), []
                for name in sorted(n for n in where if re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", n)):
                    source.seek(where[name][0])
                    index = source.read(where[name][1])
                    if zlib.crc32(index) != crcs[name]:
                        raise ValueError(f"{name} of {path} is damaged")
                    indexes.append(index)
            if not indexes:
                raise ValueError(f"{path} stores no index")
            found = ranges(where, indexes)
            offsets, lengths = zip(*found) if found else ((), ())
            for k in range(0, len(offsets), RANGE_RECORDS):
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([offsets[k : k + RANGE_RECORDS]], pa.list_(pa.int64())), pa.array([lengths[k : k + RANGE_RECORDS]], pa.list_(pa.int64()))], names=["path", "offsets", "lengths"])


def _read(with_payload: bool):
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("stamp", pa.string())]
    schema = pa.schema(fields + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offsets, lengths in zip(*[batch.column(c).to_pylist() for c in ("path", "offsets", "lengths")]):
                system, at = store(path)
                rows, held = [], 0
                with system.open_input_file(at) as source:
                    for offset, length in zip(offsets, lengths):
                        source.seek(offset)
                        r = parse_record(source.read(length))
                        if r["payload"] is not None and r["own"]:
                            if len(r["payload"]) != r["payload_bytes"] or hashlib.sha1(r["payload"]).hexdigest() != r["payload_digest"]:
                                raise ValueError(f"record at {offset} of {path} is damaged")
                        rows.append({k: r[k] for k in schema.names})
                        held += len(r["payload"] or b"") if with_payload else 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a WARC record for each row of pages (page_id, url, html) into packages under folder; returns (path, records).

    The payload is the html in UTF-8, null counting as empty. Of records with equal
    payloads of at least REVISIT_BYTES bytes, those with the largest page_id are
    responses and the others revisits of it; smaller ones are all responses. Rows
    that share the largest page_id are all responses, and so is a row without a
    page_id, unless one with a page_id has its payload. Repeated rows give repeated
    records; further columns are ignored; an empty table gives no packages.
    """
    folder = qualified(pages.sparkSession, folder)  # without a scheme it lies on Spark's default file system
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    large = F.octet_length("html") >= REVISIT_BYTES
    last = own.where(large).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("digest", "last")
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")
    return cut(own.join(last, "digest", "left").select("page_id", "url", "html", "digest", refers).mapInArrow(_write(folder), "path string, records long"))


def read_packages(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the packages in column path: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, record_id, refers_to_id, stamp[, payload]); a revisit has no payload of its own.

    Every response that this module wrote is held against its length and digest. Records of
    other writers come as they are: page_id and refers_to are null, their ids are in
    record_id and refers_to_id.
    """
    ranges = packages.select("path").mapInArrow(_locate, "path string, offsets array<long>, lengths array<long>")
    spread = max(1, packages.sparkSession.sparkContext.defaultParallelism)
    columns = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, record_id string, refers_to_id string, stamp string" + ", payload binary" * with_payload
    return ranges.repartition(spread * 4).mapInArrow(_read(with_payload), columns)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages to packages in the shared folder and reads all records back."""
    return read_packages(write_packages(pages, new_folder(spark, "warc")))
