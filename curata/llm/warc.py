"""WARC archives packaged as ZIP files: written, located by their directories and read by byte ranges.

A package holds ``archive/data.warc.gz`` (one gzip member for each record) and ``indexes/index.cdxj`` (a line
for each record with its offset and length), both stored without compression by ZIP, so a record is
one byte range of the package. Reading parses the end of the package, its ZIP64 end where there is one, and the central
directory; finds the stored members; reads the index in ranges; and fetches records in ranges of neighbours.
Nothing is extracted. An archive member that no index names is walked once from its start.

A payload of at least ``least`` bytes that several pages share is written once, as the response of the smallest page id;
the others are revisits that refer to it. Files are opened by URI through Arrow's file systems, so the folder must be
shared. A task that runs again leaves packages that no table names; readers follow the table of packages.

Defined results: a null html is an empty payload; a null url has no target; a null page id is greater than
any other, and of equal rows one is the response; an empty table gives no packages and no records; a package or
record that can't be read gives a row with ``error``; further columns are not carried.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
import zlib
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST = 100
#: Compressed bytes of a package at which the next one begins.
PACKAGE = 64 << 20
#: Bytes of one read: of an index, of a central directory, of neighbouring records.
RANGE = 8 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters that a target URI keeps; one with others is also given whole, as JSON.
KEPT = "!#$%&'()*+,-./:;=?@[]_~"
NONE32 = 0xFFFFFFFF


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or absolute path (s3a is read as s3)."""
    return pafs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


class Source:
    """Byte ranges of one file."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    @classmethod
    def of(cls, uri: str) -> Source:
        fs, path = opened(uri)
        file = fs.open_input_file(path)
        return cls(file, file.size())

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        got = self.file.read(size)
        if len(got) != size:
            raise ValueError(f"{size} bytes wanted at {at}, {len(got)} there")
        return got


class Member(NamedTuple):
    name: str
    method: int
    start: int  # of its data
    size: int


def directory(source: Source) -> tuple[int, int, int]:
    """Position and size of the central directory, and what all recorded offsets fall short of real ones
    (bytes before the package, as self-extracting ones have)."""
    tail = source.read(max(0, source.size - 65557), min(source.size, 65557))
    k = tail.rfind(b"PK\x05\x06")
    while k >= 0 and (len(tail) - k < 22 or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
        k = tail.rfind(b"PK\x05\x06", 0, k)
    if k < 0:
        raise ValueError("no end of a central directory")
    end = source.size - len(tail) + k
    size, start = struct.unpack_from("<II", tail, k + 12)
    # a ZIP64 end counts wherever its locator stands, whatever the fields of the plain end say
    if end >= 76 and (mark := source.read(end - 20, 20)).startswith(b"PK\x06\x07"):
        for at in (struct.unpack_from("<Q", mark, 8)[0], end - 76):  # the second with bytes before the package
            big = source.read(at, 56) if at + 76 <= end else b""
            if big.startswith(b"PK\x06\x06"):
                size, start = struct.unpack_from("<QQ", big, 40)
                end = at
                break
        else:
            raise ValueError("no ZIP64 end of the central directory")
    elif NONE32 in (size, start):
        raise ValueError("no locator of a ZIP64 end")
    if size > end:
        raise ValueError("central directory before the file's start")
    return end - size, size, end - size - start


def members(source: Source):
    """All members of a package, from its central directory (read a range at a time)."""
    at, left, shift = directory(source)
    held = b""
    while left or held:
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28)):
            if not left:
                if held:
                    raise ValueError("central directory cut short")
                return
            n = min(RANGE, left)
            held, at, left = held + source.read(at, n), at + n, left - n
        if not held.startswith(b"PK\x01\x02"):
            raise ValueError("not an entry of a central directory")
        flags, method = struct.unpack_from("<HH", held, 8)
        packed, size, n, m, c = struct.unpack_from("<IIHHH", held, 20)
        start = struct.unpack_from("<I", held, 42)[0]
        name = held[46:46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, held = held[46 + n:46 + n + m], held[46 + n + m + c:]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: the values that did not fit, in this order
                wide = list(struct.unpack_from(f"<{min(length, 24) // 8}Q", extra, 4))
                size = wide.pop(0) if size == NONE32 else size
                packed = wide.pop(0) if packed == NONE32 else packed
                start = wide.pop(0) if start == NONE32 else start
            extra = extra[4 + length:]
        local = source.read(start + shift, 30)
        if not local.startswith(b"PK\x03\x04"):
            raise ValueError(f"no local header of {name}")
        yield Member(name, method, start + shift + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)


def record(kind: str, record_id: str, url: str | None, digest: str, size: int, payload: bytes, refers: str | None) -> bytes:
    """One WARC record as a gzip member; a revisit has the HTTP headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=KEPT)}")
        if quote(url, safe=KEPT) != url:
            head.append(f"Curata-Url: {json.dumps(url)}")
    if refers is not None:
        head += [f"WARC-Refers-To: <{refers}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def parsed(packed: bytes) -> dict:
    """A record's fields and payload (None for a revisit) from its gzip member."""
    z = zlib.decompressobj(31)
    raw = z.decompress(packed) + z.flush()
    if not z.eof or not raw.startswith(b"WARC/"):
        raise ValueError("not a whole WARC record")
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[:int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [x.partition(":")[2] for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:")]
    url = json.loads(named["curata-url"]) if "curata-url" in named else named.get("warc-target-uri")
    strip = lambda x: x[1:-1] if x else None
    return {"type": named["warc-type"], "record_id": strip(named.get("warc-record-id")), "url": url, "refers_to": strip(named.get("warc-refers-to")),
            "digest": named.get("warc-payload-digest", "").removeprefix("sha256:"), "bytes": int(sizes[0]) if sizes else None,
            "payload": payload if named["warc-type"] != "revisit" else None}


def package(records: list[tuple[str, str, bytes]]) -> bytes:
    """A package of records (url key, digest, gzip member)."""
    lines, at = [], 0
    for key, digest, packed in records:
        where = {"digest": f"sha256:{digest}", "filename": ARCHIVE.rpartition("/")[2], "length": len(packed), "mime": "text/html", "offset": at, "status": "200"}
        lines.append(f"{key} 19700101000000 {json.dumps(where)}\n")
        at += len(packed)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(ARCHIVE, b"".join(p for _, _, p in records))
        z.writestr(INDEX, "".join(sorted(lines)))
        z.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE}, {"path": INDEX}]}))
    return out.getvalue()


def _writer(folder: str, most: int):
    """(row, page_id, url, digest, bytes, payload, first_row, first_page) to one row for each package written."""

    def text(v):
        return "" if v is None else quote(str(v), safe="")

    def run(batches):
        fs, path = opened(folder)
        fs.create_dir(path, recursive=True)

        def put(held):
            name = f"pages-{uuid.uuid4().hex}.zip"
            data = package(held)
            with fs.open_output_stream(f"{path}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pylist([{"package": f"{folder}/{name}", "records": len(held), "bytes": len(data)}])

        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: payloads are not copied together
                row, page, url, digest, n, payload, first_row, first_page = (batch.column(c)[k].as_py() for c in range(8))
                again = first_row is not None and first_row != row
                packed = record("revisit" if again else "response", f"urn:page:{text(page)}:{row}", url, digest, n, payload, f"urn:page:{text(first_page)}:{first_row}" if again else None)
                held.append((quote(url or "", safe=KEPT) or "-", digest, packed))
                size += len(packed)
                if size >= most:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    return run


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST,
          most: int = PACKAGE) -> DataFrame:
    """Write one record for each page into packages under ``folder``; the table of packages (package, records, bytes)."""
    C.ship(pages.sparkSession)
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = C.materialise(rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")}))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("s")
    shared = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(first, F.count("*").alias("n")).filter("n > 1")
    shared = C.materialise(shared.select("digest", F.col("s.row").alias("first_row"), F.col("s.page_id").alias("first_page")))
    typed = C.attach(rows, shared, ["digest"], "row")
    again = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    typed = typed.select("row", "page_id", "url", "digest", "bytes", F.when(~again, F.col("payload")).alias("payload"), "first_row", "first_page")
    return C.materialise(typed.mapInArrow(_writer(folder, most), "package string, records long, bytes long"))


def _directories(batches):
    """(package) to its members; a package that can't be read gives a row with error."""
    for batch in batches:
        for name in batch.column(0).to_pylist():
            try:
                found = [{"package": name, "member": m.name, "method": m.method, "start": m.start, "size": m.size, "error": None} for m in members(Source.of(name))]
            except Exception as e:  # noqa: BLE001 - whatever is wrong with one package is that package's row
                found = [{"package": name, "member": None, "method": None, "start": None, "size": None, "error": f"{type(e).__name__}: {e}"}]
            yield pa.RecordBatch.from_pylist(found, pa.schema([("package", pa.string()), ("member", pa.string()), ("method", pa.int32()), ("start", pa.int64()), ("size", pa.int64()), ("error", pa.string())]))


def _lines(source: Source, start: int, size: int, low: int, high: int) -> list[bytes]:
    """Lines of an index member that begin at ``low`` to ``high`` of it."""
    at, high = max(low - 1, 0), min(high, size)
    held = source.read(start + at, high - at)
    if low:
        k = held.find(b"\n")
        if k < 0 or at + k + 1 >= high:
            return []
        held, at = held[k + 1:], at + k + 1
    end = at + len(held)
    while end < size and not held.endswith(b"\n"):
        more = source.read(start + end, min(65536, size - end))
        k = more.find(b"\n")
        held, end = held + (more if k < 0 else more[:k + 1]), size if k >= 0 else end + len(more)
    return held.splitlines()


def _index(batches):
    """(package, start, size, low) to the places that lines of an index name: package, member, offset, length."""
    for batch in batches:
        out = []
        for name, start, size, low in zip(*(batch.column(k).to_pylist() for k in range(4))):
            try:
                for line in _lines(Source.of(name), start, size, low, low + RANGE):
                    if line.strip():
                        where = json.loads(line[line.index(b"{"):])
                        out.append({"package": name, "member": f"archive/{where['filename']}", "offset": int(where["offset"]), "length": int(where["length"]), "error": None})
            except Exception as e:  # noqa: BLE001
                out.append({"package": name, "member": None, "offset": None, "length": None, "error": f"index: {type(e).__name__}: {e}"})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("package", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("error", pa.string())]))


def boundaries(source: Source, start: int, size: int):
    """(offset, length) of each gzip member of a stored member, read from its start."""
    z, begin, at, held = zlib.decompressobj(31), 0, 0, b""
    while at < size or held:
        if not held:
            n = min(1 << 20, size - at)
            held, at = source.read(start + at, n), at + n
        z.decompress(held)
        held = z.unused_data if z.eof else b""
        if z.eof:
            here = at - len(held)
            yield begin, here - begin
            z, begin = zlib.decompressobj(31), here
    if begin != size:
        raise ValueError("archive cut short")


def _walk(batches):
    for batch in batches:
        out = []
        for name, start, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
            try:
                for offset, length in boundaries(Source.of(name), start, size):
                    out.append({"package": name, "at": start + offset, "length": length, "error": None})
            except Exception as e:  # noqa: BLE001
                out.append({"package": name, "at": None, "length": None, "error": f"archive: {type(e).__name__}: {e}"})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("package", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("error", pa.string())]))


_FIELDS = [("package", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()),
           ("bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())]


def _fetch(batches):
    """Sorted (package, at, length) to parsed records; neighbours are read as one range."""
    schema = pa.schema(_FIELDS)
    source, name = None, None
    for batch in batches:
        places = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
        i = 0
        while i < len(places):
            j, (own, low, length) = i, places[i]
            high = low + length
            while j + 1 < len(places) and places[j + 1][0] == own and high <= places[j + 1][1] <= high + 4096 and places[j + 1][1] + places[j + 1][2] - low <= RANGE:
                j += 1
                high = places[j][1] + places[j][2]
            out = []
            try:
                if own != name:
                    source, name = Source.of(own), own
                data, failed = source.read(low, high - low), None
            except Exception as e:  # noqa: BLE001
                data, failed, name = b"", f"{type(e).__name__}: {e}", None
            for _, at, length in places[i:j + 1]:
                row = {"package": own, "error": failed}
                if not failed:
                    try:
                        row |= parsed(data[at - low:at - low + length])
                    except Exception as e:  # noqa: BLE001
                        row["error"] = f"record at {at}: {type(e).__name__}: {e}"
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)
            i = j + 1


def locate(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (package, at, length) of all records, and (package, error) of what can't be read."""
    C.ship(packages.sparkSession)
    found = packages.select("package").repartition("package").mapInArrow(
        _directories, "package string, member string, method int, start long, size long, error string")
    found = C.materialise(found)
    stored = found.filter("method = 0 AND size > 0")
    archives = stored.filter(F.col("member").startswith("archive/"))
    parts = stored.filter(F.col("member").startswith("indexes/") & F.col("member").rlike(r"\.cdxj?$"))
    parts = parts.select("package", "start", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(RANGE).cast("long"))).alias("low"))
    named = parts.repartition("package", "low").mapInArrow(_index, "package string, member string, offset long, length long, error string")
    named = C.materialise(named)
    places = C.attach(named.filter("error IS NULL"), archives.select("package", "member", "start"), ["package", "member"], "offset")
    places = C.materialise(places.select("package", (F.col("start") + F.col("offset")).alias("at"), "length", F.when(F.col("start").isNull(), F.concat(F.lit("no stored member "), "member")).alias("error")).distinct())
    alone = archives.join(named.select("package", "member").distinct(), ["package", "member"], "left_anti").select("package", "start", "size")
    walked = C.materialise(alone.repartition("package", "start").mapInArrow(_walk, "package string, at long, length long, error string"))
    packed = found.filter(F.col("member").startswith("archive/") & (F.col("method") != 0)).select("package", F.concat(F.lit("compressed by ZIP: "), "member").alias("error"))
    errors = packed
    for t in (found, named, places, walked):
        errors = errors.unionAll(t.filter(F.col("error").isNotNull()).select("package", "error"))
    good = lambda t: t.filter(F.col("error").isNull()).select("package", "at", "length")
    return good(places).unionAll(good(walked)), errors


def read(packages: DataFrame) -> DataFrame:
    """All records of ``packages`` (column package, a URI each): record_id, type, url, refers_to, digest, bytes, payload, error."""
    places, errors = locate(packages)
    places = places.repartition("package", (F.col("at") / (4 * RANGE)).cast("long")).sortWithinPartitions("package", "at")
    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    records = places.mapInArrow(_fetch, ", ".join(f"{c} {kinds[k]}" for c, k in _FIELDS))
    lost = errors.select("package", *[F.lit(None).cast(kinds[k]).alias(c) for c, k in _FIELDS[1:-1]], "error")
    return records.unionAll(lost)


def page_of(record_id):
    """The page id (text) that a record id carries; null where it has none."""
    part = F.split(record_id, ":")
    return F.when(F.size(part) == 4, F.nullif(F.url_decode(F.element_at(part, 3)), F.lit("")))


def op12_warc(spark, sf_dir: str) -> DataFrame:
    packages = write(C.read(spark, sf_dir, "pages"), f"{C.new_path(spark)}/warc")
    got = read(packages)
    whole = F.col("type") == "response"
    return got.select(
        page_of(F.col("record_id")).cast("long").alias("page_id"), F.when(whole, F.octet_length("payload")).otherwise(F.col("bytes")).cast("long").alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"),
        page_of(F.col("refers_to")).cast("long").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS b FROM pages),
r AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS f FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST))
SELECT page_id, b::BIGINT AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN b >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= 100 AND k > 1 THEN f END AS refers_to FROM r
"""
