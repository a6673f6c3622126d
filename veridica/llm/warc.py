"""WARC archives: a writer, and a reader that splits gzip archives into byte ranges.

Every record is a gzip member of its own. A reading task scans its byte range for the gzip
magic, validates each candidate by decoding its first bytes (they must begin a WARC record),
and owns the records that start inside its range; it reads past the range's end only for the
last record's rest and the head of the member after it.

Damage is an error, never a lost record: a member that begins a record but cannot be decoded, an
archive whose size is not the manifest's, and a record that no other member follows directly (nor
the end of the archive), or that does not begin the archive.

Equality of payloads is by SHA-256 and length; of equal payloads of at least min_payload bytes
the page with the largest id is written as response, the others as revisit records that name it.

Defined results: null html is an empty payload; a null url is left out of the header; rows that
repeat page and payload are each written, all of the largest page_id as response; a null page_id
is written without a page number and comes back null; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridica.llm.common import materialize, shared_path

MAGIC = b"\x1f\x8b\x08"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary, archive string, position bigint"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with one WARC/1.1 record. A url with control characters is escaped, and a header says so."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = _HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", "WARC-Date: 2000-01-01T00:00:00Z"]
    head.append(f"WARC-Record-ID: {_record_id('revisit', page_id, url) if revisit else _record_id(page_id, digest)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None and any(c < " " or c == "\x7f" for c in url):
        head += [f"WARC-Target-URI: {url.encode('unicode_escape').decode()}", "WARC-Target-URI-Escape: backslash"]
    elif url is not None:
        head.append(f"WARC-Target-URI: {url}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def parse(record: bytes) -> dict:
    """The fields of one record; raises ValueError where its payload doesn't fit its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(":", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k: v.removeprefix(" ") for k, v in fields.items()}
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().rpartition("Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a record's payload doesn't fit its digest")
    number = lambda k: int(fields[k]) if fields.get(k, "None") != "None" else None
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number("WARC-Page-ID"), "url": url.encode().decode("unicode_escape") if "WARC-Target-URI-Escape" in fields else url, "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To-Page"), "payload_digest": digest, "payload_bytes": size, "payload": payload if response else None,
    }


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0  # a new attempt writes a new file
        system, local = _open(path)
        system.create_dir(local.rsplit("/", 1)[0])
        with system.open_output_stream(local, compression=None) as out:
            for batch in batches:
                for page_id, url, html, refers_to, revisit in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                    data = member(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), revisit.as_py())
                    out.write(data)
                    size, n = size + len(data), n + 1
        if n:
            yield pa.RecordBatch.from_pydict({"archive": [path], "bytes": [size], "records": [n]})
        else:
            system.delete_file(local)

    return run


def write_archives(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Writes a gzip archive per partition to the shared folder; the manifest: archive, bytes, records.

    Only archives of tasks that succeeded are in the manifest. Payloads are grouped by digest, so
    that equal pages meet without their html.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha2(html, 256).alias("sha"), F.octet_length(html).alias("size"))
    groups = rows.where(F.col("size") >= min_payload).groupBy("sha", "size").agg(F.max("page_id").alias("chosen"), F.count("*").alias("n")).where("n > 1")
    revisit = F.coalesce((F.col("chosen").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("chosen")), F.lit(False))
    joined = rows.join(groups, ["sha", "size"], "left").select("page_id", "url", "html", F.when(revisit, F.col("chosen")).alias("refers_to"), revisit.alias("revisit"))
    root = shared_path(spark, "warc")
    return materialize(joined.mapInArrow(_write(root), "archive string, bytes bigint, records bigint"), "manifest")


def read_range(path: str, start: int, end: int, size: int | None = None, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(position, record) of every record whose member starts in [start, end); size: what the archive's size must be."""
    system, local = _open(path)
    with system.open_input_file(local) as file:
        total = file.size()
        if size is not None and total != size:
            raise ValueError(f"{path} has {total} bytes, its manifest says {size}")
        held = [0, b""]

        def fetch(at: int, n: int) -> bytes:
            n = min(n, total - at)
            if at < held[0] or at + n > held[0] + len(held[1]):
                held[:] = at, file.read_at(min(max(chunk, n), total - at), at)
            return held[1][at - held[0] : at - held[0] + n]

        def decoded(at: int, head_only: bool = False) -> tuple[bytes, int] | None:
            """(record, end of its member), or None where no record starts; each byte is decoded once and let go."""
            inflate, record, fed, step, begun = zlib.decompressobj(31), b"", at, 1 << 14, False
            parts = []
            while not inflate.eof:
                piece = fetch(fed, step)
                try:
                    if not piece:
                        raise zlib.error("cut off")
                    parts.append(inflate.decompress(piece))
                except zlib.error as error:
                    if begun:
                        raise ValueError(f"damaged record at {at} of {path}: {error}") from error
                    return None
                fed += len(piece)
                step = min(2 * step, chunk)
                if not begun:
                    record = b"".join(parts)
                    if record[:7] != b"WARC/1."[: len(record)]:
                        return None
                    begun = len(record) >= 7
                    if begun and head_only:
                        return record, fed
            return (b"".join(parts), fed - len(inflate.unused_data)) if begun else None

        at = start
        while at < min(end, total):  # the first record from start on
            window = fetch(at, min(chunk, end - at + len(MAGIC) - 1))
            found = window.find(MAGIC)
            if found < 0:
                at += max(1, len(window) - len(MAGIC) + 1)
            elif at + found >= end:
                return
            elif decoded(at + found, head_only=True):
                at += found
                break
            else:
                at += found + 1
        else:
            if start == 0 and total:
                raise ValueError(f"no record in the first {end} bytes of {path}")
            return
        if start == 0 and at:
            raise ValueError(f"{path} does not begin with a record")
        while at < min(end, total):
            got = decoded(at)
            if got is None:
                raise ValueError(f"no record follows at {at} of {path}")
            yield at, got[0]
            at = got[1]
        if at < total and decoded(at, head_only=True) is None:
            raise ValueError(f"no record follows at {at} of {path}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    for batch in batches:
        for path, start, end, size in zip(*(batch.column(c).to_pylist() for c in ("archive", "start", "end", "bytes")), strict=True):
            rows, held = [], 0
            for position, record in read_range(path, start, end, size):
                rows.append(parse(record) | {"archive": path, "position": position})
                held += len(record)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(manifest: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """Every record of the archives (archive, bytes): ranges of range_bytes are dealt to tasks evenly.

    The number of tasks is stated, as the rows of ranges are so few bytes that they would be
    coalesced into one task: a range each up to the cores there are, at most 16 ranges a task beyond.
    """
    ranges = manifest.select("archive", "bytes", F.explode(F.sequence(F.lit(0), F.greatest("bytes", F.lit(1)) - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + range_bytes)
    n = ranges.count()
    tasks = max(1, min(n, manifest.sparkSession.sparkContext.defaultParallelism), -(-n // 16))
    return ranges.repartition(tasks).mapInArrow(_read, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, min_payload: int = 0) -> DataFrame:
    return read_archives(write_archives(pages, min_payload))


#: Base 32 of the SHA-1: each of 32 digits takes five bits out of two hexadecimal digits.
ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS k, sha1(coalesce(html, '')) AS s FROM pages),
g AS (SELECT page_id, n, s || '0' AS s, max(page_id) OVER (PARTITION BY k) AS chosen FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((((instr('0123456789abcdef', substr(s, (5 * i) // 4 + 1, 1)) - 1) * 16
         + instr('0123456789abcdef', substr(s, (5 * i) // 4 + 2, 1)) - 1) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = chosen THEN NULL ELSE chosen END AS refers_to
FROM g
"""
