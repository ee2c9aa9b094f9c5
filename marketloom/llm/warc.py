"""WARC bundles that can be read at any record: independent Zstandard frames with a seek table.

Writing: of pages with equal payloads the one with the smallest id becomes a response record, the others revisit it.
Each task writes bundles; a bundle is a sequence of Zstandard frames of whole records, followed by the seek table of the
Zstandard seekable format in a skippable frame, so any zstd tool reads the file as one stream. The index maps each
record to its bundle, frame, and offset within the frame. Bundles have names of their own for each task attempt: an
attempt that dies leaves a file that no index names, and never changes one that an index does.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import read, shared_dir

#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of addresses (RFC 4122)
INDEX = "page_id {id}, record_id string, bundle string, frame int, `offset` long, length long"


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page/{page_id}')}>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: object, url: str | None, payload: bytes, refers_to: object = None, date: str = "1970-01-01T00:00:00Z", revisit: bool = False) -> bytes:
    """One WARC/1.1 record. A revisit carries the headers of the response, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank")
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Target-URI": clean, "WARC-Date": date, "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}"}
    head |= {"X-Page-Id": "" if page_id is None else page_id} | ({"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page": "" if refers_to is None else refers_to} if revisit else {})
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed, whole) size of each frame."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, whole) of each frame of an open bundle of `size` bytes."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    at, out = 0, []
    for compressed, whole in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((at, compressed, whole))
        at += compressed
    return out


def _filesystem(at: str):
    """The file system of an address (file, hdfs, s3, gs) and the path in it."""
    from pyarrow import fs

    if at.startswith("file:/") and not at.startswith("file://"):
        at = "file://" + at.removeprefix("file:")
    return fs.FileSystem.from_uri(at)


def write_bundles(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 1 << 28) -> DataFrame:
    """Writes df under `folder` and returns the index, itself a Parquet table there: page_id, record_id, bundle, frame, offset, length.

    Payloads are UTF-8; null counts as empty. Equal payloads of fewer than min_payload bytes are not joined: all of their
    records are responses. Rows that share the smallest id of their group are all responses. Null ids come last: their
    rows revisit one that has an id, and are all responses if no row of the group has one. An empty table gives an empty
    index. Other columns are not read. `folder` must be one that all executors and the driver share.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8").alias("payload")).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    firsts = pages.where(F.octet_length("payload") >= min_payload).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Only payloads that occur more than once are looked up, under a key of its own, so that hot ones can be split.
    firsts = firsts.where("n > 1 AND first IS NOT NULL").select(F.sha1("sha").alias("k"), "first")
    typed = pages.withColumn("k", F.sha1("sha")).join(firsts, "k", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    data = f"{folder.rstrip('/')}/bundles"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        fs, path = _filesystem(data)
        fs.create_dir(path, recursive=True)
        task, z = TaskContext.get(), zstandard.ZstdCompressor(level=3)
        number, f, name, sizes, buffer, index, at = 0, None, "", [], bytearray(), [], 0

        def end_frame() -> None:
            nonlocal at
            if buffer:
                packed = z.compress(bytes(buffer))
                f.write(packed)
                sizes.append((len(packed), len(buffer)))
                at += len(packed)
                buffer.clear()

        def end_bundle() -> None:
            nonlocal f, at, sizes
            if f:
                end_frame()
                f.write(seek_table(sizes))
                f.close()
                f, at, sizes = None, 0, []

        for pdf in batches:
            for page_id, url, payload, refers_to in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["refers_to"], strict=True):
                page_id, refers_to = (None if pd.isna(x) else int(x) if isinstance(x, float) else x for x in (page_id, refers_to))
                if f is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number}.warc.zst"
                    f, number = fs.open_output_stream(f"{path}/{name}", compression=None), number + 1
                record = make_record(page_id, url, payload, refers_to, revisit=refers_to is not None)
                index.append((page_id, record_id(page_id), name, len(sizes), len(buffer), len(record)))
                buffer += record
                if len(buffer) >= frame_bytes:
                    end_frame()
                    if at >= bundle_bytes:
                        end_bundle()
            if index:
                yield pd.DataFrame(index, columns=["page_id", "record_id", "bundle", "frame", "offset", "length"]).astype({"page_id": object})
                index = []
        end_bundle()

    index = typed.mapInPandas(write, INDEX.format(id=id_type))
    index.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/index")
    return df.sparkSession.read.parquet(f"{folder.rstrip('/')}/index")


def read_records(index: DataFrame, folder: str, task_frames: int = 64) -> DataFrame:
    """Reads the records that `index` names back from the bundles, whole frames at a time:
    page_id, record_type, payload_bytes and payload_digest as stored, refers_to, payload. The digest of each response is verified.

    A row of the index that is repeated is read that often; null ids and empty payloads come back as written; a record of
    any length lies in one frame. An empty index gives no rows. The index is small beside its frames, so tasks are set by
    the number of frames: `task_frames` each, or fewer if that leaves cores idle.
    """
    id_type = index.schema["page_id"].dataType.simpleString()
    data = f"{folder.rstrip('/')}/bundles"
    n_frames = index.select("bundle", "frame").distinct().count()
    tasks = max(1, min(n_frames, max(-(-n_frames // task_frames), index.sparkSession.sparkContext.defaultParallelism)))
    frames = index.repartition(tasks, "bundle", "frame").groupBy("bundle", "frame").agg(F.collect_list(F.struct("page_id", "offset", "length")).alias("records"))  # bounded by a frame

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        fs, path = _filesystem(data)
        for pdf in batches:
            for bundle, wanted in pdf.groupby("bundle"):
                at = f"{path}/{bundle}"
                with fs.open_input_file(at) as f:
                    table = read_seek_table(f, f.size())
                    for frame, records in zip(wanted["frame"], wanted["records"], strict=True):
                        start, packed, whole = table[frame]
                        f.seek(start)
                        raw = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=whole)
                        out = []
                        for r in records:
                            head, payload = parse_record(raw[r["offset"] : r["offset"] + r["length"]])
                            digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                            if kind == "response" and sha1_base32(payload) != digest:
                                raise ValueError(f"{bundle}: {head['WARC-Record-ID']} is damaged")
                            out.append((r["page_id"], kind, len(payload) if kind == "response" else None, digest, head.get("X-Refers-To-Page"), payload))
                        yield pd.DataFrame(out, columns=["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]).astype({"page_id": object, "payload_bytes": object})

    return frames.mapInPandas(fetch, f"page_id {id_type}, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary").withColumn("refers_to", F.col("refers_to").cast(id_type))


def resolve(records: DataFrame) -> DataFrame:
    """Records with the payload sizes of revisits taken from the responses they refer to, without payloads.

    One row per record, repeated ones too; a revisit whose response is not among the records has a null size. An empty
    table gives an empty result. Payloads are not read, however long, and other columns are dropped.
    """
    key = lambda page: F.sha1(F.concat_ws(":", page.cast("string"), "payload_digest"))
    records = records.drop("payload")
    sizes = records.where("record_type = 'response'").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("size"))
    sizes = sizes.select(key(F.col("page_id")).alias("k"), "size")
    out = records.withColumn("k", key(F.coalesce("refers_to", "page_id"))).join(sizes, "k", "left")
    return out.select("page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_bundles(read(spark, sf_dir, "pages"), folder)
    return resolve(read_records(index, folder))


QUERIES = {"op7_warc": op7_warc}
ORACLE_SQL = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(s, CAST((i // 8) * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""
}
