"""WARC archives: write records and an index, then read selected records by sorted, coalesced byte ranges.

Records are gzip members in files of the shared folder; the index has one row per record with file, offset, length, URL
and digest. Reading starts from the index: selected rows are grouped by file and stretch of file, sorted by offset, and
neighbouring ranges are fetched by one read. Payloads never pass a shuffle; what does is a digest, an id or an index row.
A task that is run again writes a new file, and the index names only files of tasks that succeeded.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filesystem, new_path, text_or_empty, written

INDEX = "file string, offset long, length long, page_id {id}, url string, digest string, record_type string"
LEAST_SHARED = 100
#: Digests of repeated payloads are broadcast up to this many rows (about 100 bytes each), else joined with salt.
BROADCAST_ROWS = 200_000
SALTS = 32
ROLL_BYTES = 1 << 30
GAP_BYTES, SPAN_BYTES, STRETCH_BYTES = 64 << 10, 8 << 20, 32 << 20


def _field(x: str) -> str:
    return x.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(x: str) -> str:
    return x.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One gzip member: a response with its payload, or a revisit that has the digest and length alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Target-URI: {_field(url)}"] if url is not None else []
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http if revisit else http + payload
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_record(member: bytes) -> dict:
    """Headers and payload of one gzip member; ValueError where it isn't a whole WARC record."""
    try:
        raw = zlib.decompress(member, 31)
    except zlib.error as e:
        raise ValueError(f"not a gzip member: {e}") from e
    head, sep, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not sep or not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = fields["warc-type"] == "revisit"
    if not revisit and len(payload) != declared:
        raise ValueError("the payload is cut off")
    page = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x is not None else None
    url = fields.get("warc-target-uri")
    return {"page_id": page(fields["warc-record-id"]), "type": fields["warc-type"], "digest": fields["warc-payload-digest"].removeprefix("sha256:"), "payload_bytes": declared, "payload": None if revisit else payload, "refers_to": page(fields.get("warc-refers-to")), "url": None if url is None else _plain(url)}


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row and return the index, itself a written table.

    Of rows with equal payloads of at least 100 bytes, those with the smallest id are responses and the others revisit
    it; smaller payloads are responses. Null payloads are empty; a null id never is the smallest unless all are null;
    null URLs leave the header out; other columns are ignored; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    first = rows.filter(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = written(first.filter("n > 1").drop("n"), "warc-shared")
    if first.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(first), "digest", "left")
    else:  # a hot digest is spread over the salts
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left").drop("salt")
    folder = new_path(spark, "warc")
    names = ["file", "offset", "length", "page_id", "url", "digest", "record_type"]
    fs, at = filesystem(folder)
    fs.create_dir(at)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        out, name, offset = None, "", 0
        for b in batches:
            index = []
            for page, url, payload, digest, first_id in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first"))):
                if out is None or offset > ROLL_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                revisit = first_id is not None and page != first_id
                data = record(page, url, payload.encode(), digest, first_id, revisit)
                out.write(data)
                index.append((f"{folder}/{name}", offset, len(data), page, url, digest, "revisit" if revisit else "response"))
                offset += len(data)
            if index:
                types = [pa.string(), pa.int64(), pa.int64(), b.schema.field("page_id").type, pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*index), types)], names=names)
        if out is not None:
            out.close()

    return written(rows.select("page_id", "url", "payload", "digest", "first").mapInArrow(write, INDEX.format(id=kind)), "warc-index")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the index rows name: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A response's length and digest are computed from the bytes read, and a digest other than the index's is an error; a
    revisit's are those it declares, its payload is null. Rows may be any selection of an index, repeated or empty.
    """
    spark = index.sparkSession
    kind = index.schema["page_id"].dataType
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    rows = index.select("file", "offset", "length", "page_id", "digest").repartition(n, "file", stretch).sortWithinPartitions("file", "offset")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    schema = f"page_id {kind.simpleString()}, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, source, fs = None, None, None
        for b in batches:
            todo = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length", "page_id", "digest"))))
            i = 0
            while i < len(todo):
                name, start = todo[i][:2]
                j, end = i, start
                while j < len(todo) and todo[j][0] == name and todo[j][1] - end <= GAP_BYTES and (j == i or todo[j][1] + todo[j][2] - start <= SPAN_BYTES):
                    end = max(end, todo[j][1] + todo[j][2])
                    j += 1
                if name != file:
                    if source is not None:
                        source.close()
                    fs, path = filesystem(name)
                    source, file = fs.open_input_file(path), name
                data, out = source.read_at(end - start, start), []
                for _, offset, length, page, digest in todo[i:j]:
                    r = parse_record(data[offset - start : offset - start + length])
                    if r["payload"] is not None:
                        r |= {"payload_bytes": len(r["payload"]), "digest": hashlib.sha256(r["payload"]).hexdigest()}
                    if r["digest"] != digest or r["page_id"] != ("" if page is None else str(page)):
                        raise ValueError(f"{name} at {offset}: not the indexed record")
                    out.append((page, r["url"], r["payload_bytes"], r["digest"], r["type"], r["refers_to"]) + ((r["payload"],) if payloads else ()))
                types = [b.schema.field("page_id").type, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), types)], names=names)
                i = j
        if source is not None:
            source.close()

    return rows.mapInArrow(read, schema).withColumn("refers_to", F.col("refers_to").cast(kind))


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages and read every record back, without the payloads."""
    return read_records(write_archives(pages), payloads=False)
