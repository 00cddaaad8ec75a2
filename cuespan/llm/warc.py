"""WARC archives: records are written, segmented and chunk-framed, and put together again.

Writing: one record for each page, its HTTP block in chunked transfer framing. A block over SEGMENT
bytes is cut: the first part stays in the record (segment 1), the rest go to continuation records that
name the origin; the last one states the total length. Pages with equal payloads of DEDUP bytes or
more become revisits of the one with the largest id. Record ids follow from page id, digest and segment,
so that a task that runs again writes the same. Each record is a gzip member of its own, so that readers can seek to it.
A task writes files of about FILE_BYTES as a Spark data source, which commits them and keeps an index of members at
about every SPLIT bytes.

Reading: files may have any number of gzip members, such as one for each record, or none. A read makes a partition of each
range that the index of its folder names, so that a large archive is many tasks' work, and of other files one
each. A range is read once, piece by piece, as a stream of records by Content-Length; a task holds a record and a
piece at a time. Whole records are decoded where they are; only segments move: equal ones are counted, then grouped by origin identifier,
ordered by segment number, checked for gaps and against the total length, and decoded. A page's segments are
its own bytes, so no group outgrows its page. Records of other kinds (requests, metadata) are passed over;
without a payload digest there is nothing to check, and a revisit's page is known from its private header or
else is null. The table from payload digest to response is broadcast while small; beyond that a shuffle
join in which frequent payloads are dealt apart.

Defined cases: null html is an empty payload; short payloads are never revisits; rows repeated with
the largest id are all responses; a null page_id takes part and is never the largest unless alone;
columns of any names may stand beside; a very long page is segments, which meet again in one row; a record with missing segments or a wrong length raises an error;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from ..sources.files import File, FilesReader, FilesWriter, Range, Written, file_system
from .common import lookup, parts, shared_dir, stored, table

DEDUP, SEGMENT, CHUNK, FILE_BYTES, PIECE = 1000, 65_536, 8_192, 1 << 30, 1 << 20
BLANK = b"\r\n\r\n"
ROW = "page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, target_uri string"
SEGMENTS = "origin string, k int, total bigint, head string, block binary"


def _cuts(block: bytes, size: int) -> list[bytes]:
    """Parts of about size bytes that don't part a UTF-8 character."""
    out, at = [], 0
    while at < len(block):
        end = min(at + size, len(block))
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end += 1
        out.append(block[at:end])
        at = end
    return out or [b""]


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in _cuts(payload, size) if c]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunk-framed body; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + n


def record_id(page_id, digest: str, segment: int = 1) -> str:
    """The same for the same page, payload and segment."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{segment}')}>"


def records(page_id, url: str | None, html: str | None, refers_to, length: int, digest: str, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page, each without the blank line that ends it."""
    me = record_id(page_id, digest)
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [f"WARC-Target-URI: {re.sub('[\r\n ]', '', url or '')}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{b32}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    if refers_to is not None:
        own = [b"\r\n".join([*http, b"Content-Length: %d" % length]) + BLANK]
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    else:
        own = _cuts(b"\r\n".join([*http, b"Transfer-Encoding: chunked"]) + BLANK + chunked((html or "").encode()), segment)
    total, out = sum(map(len, own)), []
    for k, part in enumerate(own, 1):
        kind = "continuation" if k > 1 else "revisit" if refers_to is not None else "response"
        lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, k)}", *head]
        lines += ["Content-Type: application/http; msgtype=response"] if k == 1 else []
        if len(own) > 1:
            lines.append(f"WARC-Segment-Number: {k}")
            lines += [f"WARC-Segment-Origin-ID: {me}"] if k > 1 else []
            lines += [f"WARC-Segment-Total-Length: {total}"] if k == len(own) else []
        out.append("\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(part)}"]).encode() + BLANK + part)
    return out


def inflated(data: bytes, size: int = PIECE):
    """unpacked() of a whole file."""
    return unpacked((data[k : k + size] for k in range(0, len(data), size)), size)


def unpacked(pieces, size: int = PIECE):
    """The content of a packed stream piece by piece, member after member; of a plain one its pieces."""
    pieces = iter(pieces)
    data = next(pieces, b"")
    if data[:2] != b"\x1f\x8b":
        yield data
        yield from pieces
        return
    while True:
        while len(data) < 2 and (more := next(pieces, b"")):
            data += more
        if data[:2] != b"\x1f\x8b":  # the end, or what a file is filled up with
            return
        member = zlib.decompressobj(31)
        while not member.eof:
            data = data or next(pieces, b"")
            if not data:
                raise ValueError("cut member")
            yield member.decompress(data, size)
            data = member.unconsumed_tail
        data = member.unused_data


def parse(pieces):
    """(headers, block) of each record of a stream of bytes; blank lines between records may be more or fewer."""
    pieces = iter(pieces)
    buf = bytearray()

    def fill() -> bool:
        more = next(pieces, None)
        buf.extend(more or b"")
        return more is not None

    while True:
        while not buf.strip(b"\r\n"):
            buf.clear()
            if not fill():
                return
        skip = len(buf) - len(buf.lstrip(b"\r\n"))
        del buf[:skip]
        seen = 0
        while (end := buf.find(BLANK, seen)) < 0:
            seen = max(0, len(buf) - 3)
            if not fill():
                raise ValueError("cut record")
        first, *lines = buf[:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no record here")
        h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(h["content-length"])
        while len(buf) < end + 4 + n:
            if not fill():
                raise ValueError("cut record")
        yield h, bytes(buf[end + 4 : end + 4 + n])
        del buf[: end + 4 + n]


def _decoded(h: dict, block: bytes) -> tuple | None:
    """A row of ROW for a whole record; None for kinds that hold no payload of a page."""
    if h.get("warc-type") not in ("response", "revisit"):
        return None
    head, _, body = block.partition(BLANK)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    said = h.get("warc-payload-digest", "")
    digest = base64.b32decode(said.removeprefix("sha1:")).hex() if said.startswith("sha1:") and len(said) == 37 else None
    number = lambda x: int(x) if x else None
    page, uri = number(h.get("x-page-id")), h.get("warc-target-uri")
    if h["warc-type"] == "revisit":
        return page, "revisit", number(fields.get(b"content-length")), digest, number(h.get("x-refers-to-page")), uri
    payload = dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    own = hashlib.sha1(payload).hexdigest()
    if digest not in (None, own):
        raise ValueError("payload differs from its digest")
    return page, "response", len(payload), own, None, uri


class RecordsWriter(FilesWriter):
    """Writes rows (record binary), each as a gzip member."""

    def write(self, iterator) -> Written:
        files, out, at = [], None, 0
        places: list[tuple[int]] = []

        def close() -> None:
            nonlocal out, at, places
            out.close()
            files.append(File(name, at, self.ranges(places, lambda a, b: ())))
            out, at, places = None, 0, []

        for b in iterator:
            for record in b.column(0).to_pylist():
                if out is None:
                    name, out = self.create("warc.gz", len(files))
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record) + packer.compress(BLANK) + packer.flush()
                places.append((at,))
                out.write(member)
                at += len(member)
                if at >= FILE_BYTES:
                    close()
        if out is not None:
            close()
        return Written(files)


class RecordsReader(FilesReader):
    """Rows of ROW and SEGMENTS."""

    def read(self, partition: Range):
        if not partition.file:
            return
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.file) as f:
            f.seek(partition.at)
            left = (f.size() if partition.to is None else partition.to) - partition.at

            def pieces():
                nonlocal left
                while left > 0 and (piece := f.read(min(PIECE, left))):
                    left -= len(piece)
                    yield piece

            held, size = [], 0
            for row in _rows(unpacked(pieces())):
                held.append(row)
                size += len(row[-1] or b"") + 200
                if size > PIECE:
                    yield _columns(held)
                    held, size = [], 0
            if held:
                yield _columns(held)


class WarcSource(DataSource):
    """Format "warc": write rows (record binary), read ROW and SEGMENTS."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return f"{ROW}, {SEGMENTS}"

    def reader(self, schema) -> RecordsReader:
        return RecordsReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RecordsWriter:
        return RecordsWriter(dict(self.options), overwrite)


NAMES = [x.split()[0] for x in f"{ROW}, {SEGMENTS}".split(", ")]


def _columns(rows: list[tuple], n: int = len(NAMES)):
    import pyarrow as pa

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types[:n])], NAMES[:n])


def _rows(pieces):
    """A row of ROW and SEGMENTS for each record of a stream that is of use."""
    for h, block in parse(pieces):
        if "warc-segment-number" in h:
            head = "\r\n".join(f"{k}: {v}" for k, v in h.items())
            total = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
            yield *[None] * 6, h.get("warc-segment-origin-id", h["warc-record-id"]), int(h["warc-segment-number"]), total, head, block
        elif row := _decoded(h, block):
            yield *row, *[None] * 5


def write(pages: DataFrame, path: str, segment: int = SEGMENT, page_id="page_id", url="url", html="html") -> None:
    """Write pages as WARC files under path."""
    import pyarrow as pa

    p = pages.select(pages[f"`{page_id}`"].cast("bigint").alias("page_id"), pages[f"`{url}`"].cast("string").alias("url"), pages[f"`{html}`"].alias("html"))
    body = F.coalesce("html", F.lit(""))
    p = p.select("*", F.octet_length(body).cast("bigint").alias("n"), F.sha1(body.cast("binary")).alias("d"))
    same = p.where(F.col("n") >= DEDUP).groupBy("d", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("c")).where("c > 1")
    p = lookup(p, same, ["d", "n"], "c")
    p = p.withColumn("last", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")))

    def run(batches):
        for b in parts(batches, 64, text="html"):
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([x for r in rows for x in records(r["page_id"], r["url"], r["html"], r["last"], r["n"], r["d"], segment)], pa.binary())], ["record"])

    pages.sparkSession.dataSource.register(WarcSource)
    out = p.select("page_id", "url", "html", "last", "n", "d").mapInArrow(run, "record binary")
    out.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the WARC files under path, as ROW."""
    import pyarrow as pa

    def joined(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                own = r["segments"]
                block = b"".join(x["block"] for x in own)
                if [x["k"] for x in own] != [*range(1, len(own) + 1)] or own[-1]["total"] != len(block) or len({x["c"] for x in own}) > 1:
                    raise ValueError(f"segments missing of {r['origin']}")
                row = _decoded(dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in own[0]["head"].split("\r\n")), block)
                rows += [(*row, own[0]["c"])] if row else []
            out = _columns([r[:6] for r in rows], 6)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([r[6] for r in rows], pa.int64())], [*NAMES[:6], "c"])

    spark.dataSource.register(WarcSource)
    found = stored(spark.read.format("warc").load(path), "records")
    # rows that repeat have the same records: one of each goes on, with their number
    own = found.where("origin is not null").groupBy("origin", "k", "total").agg(F.first("head").alias("head"), F.first("block").alias("block"), F.count("*").alias("c"))
    own = own.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("k", "total", "head", "block", "c"))).alias("segments"))
    again = own.mapInArrow(joined, f"{ROW}, c bigint").select(*NAMES[:6], F.explode(F.sequence(F.lit(1).cast("bigint"), "c")).alias("_")).drop("_")
    return found.where("origin is null").select(*NAMES[:6]).unionByName(again)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc"
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, coalesce(html, '') as h from pages),
q as (select *, max(page_id) over (partition by h) as last from p)
select page_id, cast(n as bigint) as payload_bytes, sha1(h) as payload_digest, case when n >= 1000 and last <> page_id then 'revisit' else 'response' end as record_type, case when n >= 1000 and last <> page_id then last end as refers_to from q"""
