"""Dictionary-compressed WARC archives (.warc.zst): written by Spark tasks, one archive per task, and read back.

Each archive begins with a skippable Zstandard frame (magic 0x184D2A5D) that holds a dictionary built from its first records; every
record is a frame of its own, compressed with that dictionary, so that any record can be read by itself. Records with equal payloads are revisits of
one response. Files are opened by pyarrow's file systems, so archives may live in any store that those know, and are written under another
name first: a task that is run again, or twice at once, leaves one whole archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pandas as pd
import pyarrow.fs as fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAGIC = 0x184D2A5D
#: Bytes of the records that a dictionary is built from, at most, and its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows to be archived: page_id, url, payload, refers_to (null for responses).

    Of rows with equal payloads of at least ``least_bytes`` the one with the largest id is the response. Equal means equal SHA-256 and length. Null payloads
    are empty. Of rows that repeat the largest id all are responses; a null id is never referred to, and without any id all are responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"sha": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload")})
    rows = rows.withColumn("equal", F.struct("sha", "size")).drop("sha")
    groups = common.stage(rows.groupBy("equal").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1"), "groups")
    rows = common.spread_join(rows, groups, "equal", "n", "page_id", ["top"])
    refers = F.when((F.col("size") >= least_bytes) & ~F.col("top").eqNullSafe(F.col("page_id")), F.col("top"))
    return rows.select("page_id", "url", "payload", refers.alias("refers_to"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC/1.1 record.  A revisit has the HTTP head alone, whose Content-Length still is the payload's."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}')}>"), ("WARC-Date", date)]
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{refers_to}')}>"), ("X-Refers-To-Page-ID", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields as written by record(), with the payload (None for revisits).  A response's length and digest are those of the payload that was read; if the header differs it is an error."""
    top, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in top.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    head, _, body = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    number = lambda k: int(fields[k]) if k in fields else None
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (size != len(body) or fields["WARC-Payload-Digest"] != f"sha1:{digest(body)}"):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its header")
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": None if revisit else body}


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; where the samples are too few or too alike for training, their last bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=1024, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _open(uri: str):
    """The file system and path of a URI; pyarrow says s3 where Hadoop says s3a."""
    uri = f"s3://{uri[6:]}" if uri.startswith("s3a://") else uri
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else f"/{uri}")


def write_archives(records: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write page_id, url, payload, refers_to to archives below ``folder``; returns one row per archive: archive, records, bytes."""

    def run(batches):
        part = TaskContext.get().partitionId()
        final = f"{folder}/part-{part:06d}.warc.zst"
        system, path = _open(final)
        temp = f"{path}.{uuid.uuid4().hex}"
        waiting, held, out, compressor, done, size = [], 0, None, None, 0, 0

        def flush():
            nonlocal out, compressor, waiting, held, done, size
            if out is None:
                trained = build_dictionary([w[i : i + 8192] for w in waiting for i in range(0, len(w), 8192)])
                system.create_dir(temp.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(temp, compression=None)
                body = trained.as_bytes()
                out.write(struct.pack("<II", MAGIC, len(body)) + body)
                compressor = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
            for w in waiting:
                out.write(compressor.compress(w))
                done += 1
            waiting, held = [], 0

        for pdf in batches:
            for i, u, p, r in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["refers_to"], strict=True):
                waiting.append(record(None if pd.isna(i) else int(i), u, bytes(p), None if pd.isna(r) else int(r), date))
                held += len(waiting[-1])
                if held >= SAMPLE_BYTES:
                    flush()
        if waiting:
            flush()
        if out is not None:
            size = out.tell()
            out.close()
            system.move(temp, path)
            yield pd.DataFrame({"archive": [final], "records": [done], "bytes": [size]})

    # as strings: pandas would take longs with nulls through floats
    text = lambda c: F.col(c).cast("string").alias(c)
    return common.stage(records.select(text("page_id"), "url", "payload", text("refers_to")).mapInPandas(run, "archive string, records long, bytes long"), "manifest")


def frames(stream):
    """Records of an archive, one at a time."""
    magic, n = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    body = stream.read(n)
    kind = zstandard.DICT_TYPE_AUTO
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind))
    rest = b""
    while True:
        if not rest and not (rest := stream.read(1 << 20)):
            return
        frame, out = plain.decompressobj(), io.BytesIO()
        while not frame.eof:
            out.write(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else stream.read(1 << 20)
            if not rest and not frame.eof:
                raise EOFError("an archive ends within a record")
        yield out.getvalue()


def read_archives(manifest: DataFrame) -> DataFrame:
    """All records of the archives (column archive): RECORDS.  Archives are read as streams, by as many tasks as there are archives."""

    def run(batches):
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for pdf in batches:
            for archive in pdf["archive"]:
                system, path = _open(archive)
                with system.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for data in frames(stream):
                        rows.append(parse(data))
                        held += len(data)
                        if held > 8 << 20:
                            yield _table(rows, names)
                            rows, held = [], 0
                    if rows:
                        yield _table(rows, names)

    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n).mapInPandas(run, RECORDS)


def _table(rows: list[dict], names: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to"):
        pdf[c] = pd.array([r[c] for r in rows], dtype="Int64")
    return pdf
