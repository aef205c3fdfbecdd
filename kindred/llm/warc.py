"""WARC archives: a native writer with payload revisits, and a salvage reader.

The writer makes WARC/1.1 records with Spark expressions, closes each in a gzip member of
its own and hands them to Spark's text writer, so it reaches any store Spark writes to.
The reader checks every record (version line, lengths, terminator, block digest); after a
failed check it looks for the next valid member or version line, goes on from there and
logs the bytes of the file it passed over.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, fresh_path, staged

#: The record terminator, and the line end inside headers.
END, NL = "\r\n\r\n", "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"
_EMPTY = gzip.compress(b"", mtime=0)
#: Most bytes one gzip member may open to before the reader counts it as damaged.
MAX_OPENED = 1 << 30


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1: five hex digits at a time become four base32 digits."""
    h = F.sha1(data)
    quads = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def classified(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with payload, payload_bytes, payload_digest and the page they refer to (null: a response).

    A null html is an empty payload. Of equal payloads of at least ``min_bytes``, the largest
    page_id is the response. Only digests held by two pages or more are joined back; a
    digest of many pages is joined in parts by adaptive execution.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))
    heads = p.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = p.join(staged(heads, "heads"), "payload_digest", "left")  # ids and digests only; small beside the pages
    refers = F.when((F.col("payload_bytes") >= min_bytes) & F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def record(date: str = "2000-01-01T00:00:00Z") -> Column:
    """The text of one record, without its terminator."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), s("payload_bytes"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "")
    return F.concat(
        F.lit(f"WARC/1.1{NL}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{NL}WARC-Record-ID: <urn:page:"), s("page_id"), F.lit(">"),
        F.lit(f"{NL}WARC-Date: {date}{NL}WARC-Target-URI: "), uri,
        F.lit(f"{NL}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(f"{NL}WARC-Block-Digest: sha1:"), base32_sha1(block.cast("binary")),
        F.when(revisit, F.concat(F.lit(f"{NL}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{NL}WARC-Refers-To: <urn:page:"), s("refers_to"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{NL}Content-Type: application/http; msgtype=response{NL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END),
        block,
    )


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member of one record, without its last byte, which is zero.

    That byte is the top of the record's length; from 16 MiB on, where it need not be zero, an
    empty member follows and gives the zero.
    """
    z = gzip.compress(record, level, mtime=0)
    return z[:-1] if z[-1] == 0 else z + _EMPTY[:-1]


def write(classed: DataFrame, path: str, records_per_file: int = 2000, compression: str = "gzip", level: int = 6) -> None:
    """Archives of at most ``records_per_file`` records; ``compression`` none or gzip, a member for each record.

    The zero that ends every member is the text writer's line separator, so Spark's own
    writer (and its commit protocol) puts binary archives in any store.
    """
    records = classed.select(F.concat(record(), F.lit(END)).alias("value"))
    out = records.write
    if compression == "gzip":

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for lo in range(0, b.num_rows, 64):
                    part = b.column(0).slice(lo, 64).cast(pa.binary()).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([member(r, level) for r in part], pa.binary())], names=["value"])

        out = records.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00")
    else:
        out = classed.select(record().alias("value")).write.option("lineSep", END)
    out.option("compression", "none").option("maxRecordsPerFile", records_per_file).text(path)


def salvage(data: bytes) -> Iterator[tuple[str, dict | None, bytes, int, int]]:
    """("record" or "salvaged", headers, block, first, end) and ("gap", None, b"", first, end), in bytes of the file.

    Gzip input is opened member by member; after a member that fails the next one that
    opens is looked for. Records that open in a member that fails its own check are salvaged
    ones: their blocks match their digests, their headers have none. A gap is what lies
    between the bytes of records. Where a member holds several records, their places inside
    it are known to the step that opened them.
    """
    if data[:3] != _MAGIC:
        yield from _records(data)
        return
    at = lost = 0  # bytes before ``lost`` are accounted for
    while at < len(data):
        if not data.startswith(_MAGIC, at):
            nxt = data.find(_MAGIC, at + 1)
            at = len(data) if nxt < 0 else nxt
            continue
        opened, marks, end, ok = _open(data, at)
        sizes, places = [m[0] for m in marks], [m[1] for m in marks]
        before = lambda k: places[bisect_right(sizes, k) - 1]  # noqa: E731  opened byte to a place at or before it
        after = lambda k: end if k == len(opened) else places[bisect_left(sizes, k)]
        for kind, headers, block, lo, hi in _records(opened):
            if kind == "record":
                first, last = (at if lo == 0 else max(lost, before(lo))), after(hi)
                if lost < first:
                    yield "gap", None, b"", lost, first
                yield kind if ok else "salvaged", headers, block, first, last
                lost = last
        if ok:
            if not opened and lost == at:  # an empty member
                lost = end
            at = end
            continue
        at = data.find(_MAGIC, max(at + 1, min(lost, end)))
        while at >= 0 and not _opens(data, at):
            at = data.find(_MAGIC, at + 1)
        at = len(data) if at < 0 else at
    if lost < len(data):
        yield "gap", None, b"", lost, len(data)


def _open(data: bytes, at: int) -> tuple[bytes, list[tuple[int, int]], int, bool]:
    """(opened bytes, (opened bytes so far, place in the file) by step, end, whether all was well) of the member at ``at``.

    The window moves over the file, nothing is copied; at a fault the steps get finer
    until the last byte that still opens.
    """
    z, out, place, step, view = zlib.decompressobj(31), bytearray(), at, 65536, memoryview(data)
    marks = [(0, at)]
    while not z.eof:
        if place >= len(data) or len(out) > MAX_OPENED:
            return bytes(out), marks, place, False
        saved = z.copy()
        try:
            got = z.decompress(view[place : place + step], MAX_OPENED)
        except zlib.error:
            if step == 1:
                return bytes(out), marks, place, False
            z, step = saved, step // 16
            continue
        place = min(len(data), place + step)
        out += got
        marks.append((len(out), place))
    return bytes(out), marks, place - len(z.unused_data), True


def _opens(data: bytes, at: int) -> bool:
    try:
        return bool(zlib.decompressobj(31).decompress(memoryview(data)[at : at + 65536], 64))
    except zlib.error:
        return False


def _records(data: bytes) -> Iterator[tuple]:
    at = gap = 0
    while at < len(data):
        got = _record(data, at)
        if got is None:
            m = _VERSION.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        headers, block, end = got
        if gap < at:
            yield "gap", None, b"", gap, at
        yield "record", headers, block, at, end
        at = gap = end
    if gap < len(data):
        yield "gap", None, b"", gap, len(data)


def _record(data: bytes, at: int):
    """(headers, block, end) of the record at ``at``, None if a check fails."""
    m = _VERSION.match(data, at)
    stop = data.find(b"\r\n\r\n", at) if m else -1
    if stop < 0:
        return None
    headers = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        k, sep, v = line.partition(b":")
        if not sep:
            return None
        headers[k.strip().decode("latin-1").lower()] = v.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not size.isdigit():
        return None
    lo = stop + 4
    hi = lo + int(size)
    if data[hi : hi + 4] != b"\r\n\r\n":
        return None
    block, want = data[lo:hi], headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and base64.b32encode(hashlib.sha1(block).digest()).decode() != want[5:]:
        return None
    return headers, block, hi + 4


def read(spark, path: str) -> DataFrame:
    """Records and gaps of all archives below ``path``.

    file, kind (record, salvaged or gap), first and end byte, record_type, page, payload_bytes,
    payload_digest, refers_to and payload (null for revisits and gaps). A file is read whole by one
    task; the writer bounds the records in it.
    """

    def run(batches):
        import pyarrow as pa

        names = ["file", "kind", "first", "end", "record_type", "page", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for i in range(b.num_rows):
                file, rows = b.column(0)[i].as_py(), []
                for kind, h, block, lo, hi in salvage(b.column(1)[i].as_py() or b""):
                    row = [file, kind, lo, hi] + [None] * 6
                    if kind != "gap":
                        head, _, body = block.partition(b"\r\n\r\n")
                        size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                        page = re.fullmatch(r"<urn:page:(.*)>", h.get("warc-record-id", ""))
                        ref = re.fullmatch(r"<urn:page:(.*)>", h.get("warc-refers-to", ""))
                        whole = h.get("warc-type") != "revisit"
                        digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else h.get("warc-payload-digest", "")[5:]
                        row[4:] = [h.get("warc-type"), page and page[1], len(body) if whole else size and int(size[1]), digest, ref and ref[1], body if whole else None]
                    rows.append(row)
                    if len(rows) == 256:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, kind string, first long, end long, record_type string, page string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write every page, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Raises if the archives do not give back every row as a sound record. Rows that repeat a page_id have a
    record each; null ids and urls are written as such; an empty table gives no rows. Other
    columns take no part. Archives at a ``path`` that is given stay, others are deleted.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType
    where = path or fresh_path(spark, "warc")
    write(classified(pages), where)
    as_id = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind)
    back = staged(read(spark, where).select("kind", as_id("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to")), "read-back")
    if path is None:
        drop_path(spark, where)
    ids = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("page_id"))).first()
    if ids(back.filter("kind = 'record'")) != ids(pages) or back.filter("kind <> 'record'").limit(1).count():
        raise RuntimeError("the archives do not give back every page")
    return back.drop("kind")
