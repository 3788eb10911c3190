"""WARC archives compressed record by record with a shared Zstandard dictionary.

An archive is a leading skippable frame that holds the dictionary, then one frame per record,
so records can be read one by one. A payload of at least ``MIN_REVISIT`` bytes is stored
once: the record with the smallest page_id is the response, the others revisit it.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import file_system, new_path, written

MIN_REVISIT = 100
#: Records in the dictionary's sample, bytes taken of each, and bytes of the dictionary.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 400, 8 << 10, 64 << 10
#: A task starts another archive after so many compressed bytes.
ARCHIVE_BYTES = 32 << 20
# Magic numbers of a skippable frame with a dictionary and of a data frame.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id, url, payload: bytes | None, digest: str, size: int, refers_to, date: str) -> bytes:
    """One WARC record; a revisit (refers_to) has the HTTP header alone as its block."""
    from urllib.parse import quote

    head = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    block = HTTP + (payload or b"")
    head += [("X-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def frame_end(data, pos: int) -> int:
    """Where the Zstandard frame that starts at ``pos`` ends, from its block headers."""
    flags = data[pos + 4]
    single, kind = flags >> 5 & 1, flags >> 6
    pos += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[kind]
    while True:
        head = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return pos + 4 * (flags >> 2 & 1)


def records(data: bytes):
    """The records of an archive."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC:
        raise ValueError("the archive has no dictionary frame")
    tool, pos = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])), 8 + size
    view = memoryview(data)
    while pos < len(data):
        end = frame_end(data, pos)
        yield tool.decompress(view[pos:end])
        pos = end


def dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; of too few or too short samples, their bytes themselves."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(samples) or HTTP)[:size]


def keyed(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write every row's record; returns the committed archives (path, records, bytes).

    Tasks that are run again write new files, and only files of committed tasks are listed. All
    rows with the smallest page_id of equal payloads are responses (a null id is the largest)."""
    rows = keyed(pages)
    sample = rows.filter("size > 0").select("page_id", "digest", F.expr(f"substring(payload, 1, {SAMPLE_BYTES})").alias("part"))
    # written first: a collected limit would send every task's own top rows to the driver
    sample = written(sample.orderBy(F.xxhash64("digest", "page_id")).limit(SAMPLE_RECORDS).select("part"), "warc-sample")
    shared = dictionary([bytes(r.part) for r in sample.collect()])
    firsts = rows.filter(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    rows = rows.join(firsts.filter("n > 1").drop("n"), "digest", "left")
    refers = F.when((F.col("size") >= MIN_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    rows = rows.withColumn("refers_to", refers).select("page_id", "url", F.expr("if(refers_to is null, payload, null)").alias("payload"), "digest", "size", "refers_to")

    def write(batches):
        import uuid

        import pyarrow as pa
        import zstandard

        tool = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared))
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        out, name, done, n, size = None, "", [], 0, 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 8 + len(shared)
                    out = fs.open_output_stream(f"{top}/{name}")
                    out.write(struct.pack("<II", DICT_MAGIC, len(shared)) + shared)
                frame = tool.compress(record(*row, date))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size > ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["path", "records", "bytes"])

    return written(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-archives")


def read_archives(archives: DataFrame, id_type: str = "bigint") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of every record, from
    the archives alone; a response's digest and size are taken of the payload found."""

    def read(batches):
        import hashlib

        import pyarrow as pa

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = file_system(path)
                with fs.open_input_stream(at) as f:
                    data = f.read()
                out = []
                for raw in records(data):
                    head, payload = parsed(raw)
                    own, kind = head["WARC-Record-ID"][10:-1], head["WARC-Type"]
                    size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response":
                        if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"damaged record {own} in {path}")
                    to = head.get("WARC-Refers-To")
                    out.append((None if own == "null" else int(own), head.get("WARC-Target-URI"), size, digest, kind, int(to[10:-1]) if to else None))
                cols = list(zip(*out)) or [()] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    n = archives.count()
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select("path").repartition(max(1, n), "path").mapInArrow(read, kind)


def round_trip(pages: DataFrame) -> DataFrame:
    """The records of ``pages`` (page_id, url, html), written to archives in the shared folder and
    read back. A null html is an empty payload; a null url has no target; repeated rows have a
    record each; an empty table gives no archive and no row. Other columns are not read."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def duckdb_sql() -> str:
    return f"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
k as (select page_id, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_digest from p),
f as (select payload_digest, min(page_id) as first_id from k where payload_bytes >= {MIN_REVISIT} group by 1)
select page_id, payload_bytes, payload_digest,
       case when first_id is not null and page_id is distinct from first_id then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from first_id then first_id end as refers_to
from k left join f using (payload_digest)"""
