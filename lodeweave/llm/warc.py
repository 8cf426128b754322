"""WARC archives of zstandard frames with a shared dictionary, written and read by Spark.

An archive starts with a skippable frame (0x184D2A5D) that holds the dictionary; every record is one
frame. Spark's text writer puts the bytes out, so any file system that Spark writes serves, and a
lost task leaves no half file: each row is a frame, and the line separator is an empty skippable
frame (0x184D2A50, length 0), which readers pass over. The finished files are named ``*.warc.zst``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, mapped, shared_dir, written

DICT_MAGIC, PAD_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
SEPARATOR = struct.pack("<II", PAD_MAGIC, 0)  # eight bytes below 0x80, so it is text too
DATE = "1970-01-01T00:00:00Z"
DICT_BYTES = 1 << 16  # size of the dictionary
DICT_SAMPLES, SAMPLE_CHARS = 256, 1 << 14  # pages it is trained on, and how much of each
BROADCAST_ROWS = 1 << 20  # repeated payloads whose (digest, key) rows, some 100 bytes each, are broadcast
WINDOW = 1 << 12, 1 << 20  # bytes of an archive given to the decoder at a time: at first, at most
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def dictionary_frame(data: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(data)) + data


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of at most ``DICT_BYTES``; records of made-up pages stand beside the samples, so few or no samples will do as well."""
    made = []
    for i in range(64):
        page = "".join(f"<p>{hashlib.sha1(b'%d %d' % (i, j)).hexdigest()}</p>\n<a href=\"https://www.example.org/{i}/{j}\">{j}</a>\n" for j in range(16))
        data = f"<!DOCTYPE html>\n<html><head><title>{i}</title></head><body>{page}</body></html>".encode()
        made.append(record("response", i, f"https://www.example.org/{i}", data, hashlib.sha1(data).hexdigest(), None))
    return zstandard.train_dictionary(min(DICT_BYTES, (sum(map(len, samples)) + sum(map(len, made))) // 8), samples + made).as_bytes()


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    target = re.sub(r"[\r\n]+", " ", url or "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{b32}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; raises WarcError unless version, headers, lengths and digest hold."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"header {line[:60]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError("the block is not as long as Content-Length says")
    http, sep, payload = rest[:-4].partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if not sep or not said:
        raise WarcError("no HTTP headers")
    found = {"type": fields["warc-type"], "page": fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">"), "url": fields.get("warc-target-uri", ""), "length": int(said[1]), "payload": payload, "refers": None}
    claimed = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    found["digest"] = base64.b32decode(claimed).hex() if len(claimed) == 32 else claimed
    if found["type"] == "response":
        if len(payload) != found["length"] or hashlib.sha1(payload).hexdigest() != found["digest"]:
            raise WarcError("the payload does not have its length or digest")
    elif found["type"] == "revisit":
        refers = fields.get("warc-refers-to", "")
        if payload or not refers.startswith("<urn:page:"):
            raise WarcError("a revisit has no payload and refers to a response")
        found["refers"] = refers.removeprefix("<urn:page:").removesuffix(">")
    return found


def frames(data: bytes | memoryview) -> Iterator[bytes]:
    """The records of an archive, one frame at a time, with the dictionary of its leading skippable frame.

    The decoder gets windows of the archive, so finding a frame's end copies no more than a window and
    an archive takes time in proportion to its length.
    """
    at, first, view = 0, True, memoryview(data)
    decoder = zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise WarcError("the archive ends within a frame")
        magic, length = struct.unpack_from("<II", view, at)
        if magic == DICT_MAGIC and first or 0x184D2A50 <= magic <= 0x184D2A5F and magic != DICT_MAGIC:
            if at + 8 + length > len(view):
                raise WarcError("the archive ends within a skippable frame")
            if magic == DICT_MAGIC:
                raw = bytes(view[at + 8 : at + 8 + length])
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                    raw = _frame(decoder, memoryview(raw), 0)[0]
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + length
        elif magic == FRAME_MAGIC:
            out, at = _frame(decoder, view, at)
            yield out
        else:
            raise WarcError(f"no frame starts at byte {at}")
        first = False


def _frame(decoder: zstandard.ZstdDecompressor, view: memoryview, at: int) -> tuple[bytes, int]:
    """(content of the frame that starts at ``at``, where it ends)."""
    try:
        said = zstandard.frame_content_size(view[at : at + 18])
        one, parts, window = decoder.decompressobj(), [], WINDOW[0]
        while not one.eof:
            if at >= len(view):
                raise WarcError("the archive ends within a record")
            parts.append(one.decompress(view[at : at + window]))
            at += len(view[at : at + window])
            window = min(2 * window, WINDOW[1])
    except zstandard.ZstdError as e:
        raise WarcError(str(e)) from e
    out = b"".join(parts)
    if said >= 0 and len(out) != said:
        raise WarcError("a record is not as long as its frame says")
    return out, at - len(one.unused_data)


def _files(spark, pattern: str) -> tuple:
    """(file system, statuses of the files) of a pattern, in any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, list(fs.globStatus(path) or [])


def write_archives(pages: DataFrame, key: str, url: str, html: str, path: str, shortest: int = 1000) -> None:
    """Write one record per row under ``path``, one archive per partition.

    Of rows with equal payloads of at least ``shortest`` bytes the one with the largest key is the
    response, the others revisit it. (digest, largest key) of the repeated payloads is written and
    counted: up to ``BROADCAST_ROWS`` rows go to the pages, so that no payload is shuffled; beyond that
    pages and rows meet in a sort-merge join, which moves every payload once and whose hot digests Spark
    splits. The dictionary is trained on the pages with the least hashes of their keys, so a rerun gives
    the same one, and every archive has one. A null html is an empty payload, a null url an empty target, a null key an empty record id (never
    the response of a group that has a key); two rows with equal keys and payloads are both
    responses; an empty table gives no archive.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias(P + "k"), F.col(url).alias(P + "u"), payload.alias(P + "p"), F.unhex(F.sha1(payload)).alias(P + "d"))
    groups = rows.filter(F.length(P + "p") >= shortest).groupBy(P + "d").agg(F.max(P + "k").alias(P + "r"), F.count(F.lit(1)).alias(P + "n"))
    groups = groups.filter((F.col(P + "n") > 1) & F.col(P + "r").isNotNull()).select(F.col(P + "d").alias(P + "d2"), P + "r")
    revisit = F.col(P + "r").isNotNull() & ~F.col(P + "k").eqNullSafe(F.col(P + "r")) & (F.length(P + "p") >= shortest)
    groups = written(groups, "repeats")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups.hint("merge")
    kept = rows.join(groups, F.col(P + "d") == F.col(P + "d2"), "left").select(P + "k", P + "u", P + "p", P + "d", F.when(revisit, F.col(P + "r")).alias(P + "r"))
    known = pages.filter(F.col(html).isNotNull() & F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.substring(html, 1, SAMPLE_CHARS).alias("s"))
    least = known.select("h").orderBy("h").limit(DICT_SAMPLES).agg(F.max("h")).first()[0]  # only hashes meet here, not texts
    samples = [r.s.encode() for r in known.filter(F.col("h") <= F.lit(least)).orderBy("h", "k", "s").limit(DICT_SAMPLES).collect()]
    shared = spark.sparkContext.broadcast(train_dictionary([x for x in samples if x]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw))
        opened = False
        for b in batches:
            for at in range(0, b.num_rows, 64):
                out = [] if opened else [dictionary_frame(raw)]
                opened = True
                for k, u, p, d, r in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True):
                    out.append(packer.compress(record("response" if r is None else "revisit", k, u, p, d.hex(), r)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    packed = mapped(kept, run, "frame binary")
    packed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode()).text(path)
    fs, made = _files(spark, f"{path}/part-*.txt")
    for f in made:  # a rename is a step of the name node; a reader takes either name
        name = f.getPath().toString().removesuffix(".txt") + ".warc.zst"
        fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(name))


def read_archives(path: str, spark, key_type: str = "bigint") -> DataFrame:
    """The records of the archives that a path pattern names: key, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Each archive is read by one task as one value of Spark's binary source (under 2 GB) and decoded
    record by record; what does not hold raises WarcError. No archive gives no rows; an empty record id
    is a null key; repeated records are rows of their own; a record may be as long as memory allows.
    """
    columns = "key string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                found: list[dict] = []
                size = 0
                for one in frames(memoryview(data.as_buffer())):
                    found.append(parse_record(one))
                    size += len(one)
                    if size > 1 << 23 or len(found) >= 2000:
                        yield _rows(found)
                        found, size = [], 0
                yield _rows(found)

    if _files(spark, path)[1]:
        out = mapped(spark.read.format("binaryFile").load(path).select("content"), run, columns)
    else:
        out = spark.createDataFrame([], columns)
    return out.withColumns({"key": F.when(F.col("key") != "", F.col("key").cast(key_type)), "refers_to": F.col("refers_to").cast(key_type)})


def _rows(found: list[dict]) -> pa.RecordBatch:
    cols = [("key", "page", pa.string()), ("url", "url", pa.string()), ("payload", "payload", pa.binary()), ("payload_bytes", "length", pa.int64()), ("payload_digest", "digest", pa.string()), ("record_type", "type", pa.string()), ("refers_to", "refers", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for _, k, t in cols], [n for n, _, _ in cols])


def archive_round_trip(pages: DataFrame, key: str, url: str, html: str, path: str | None = None) -> DataFrame:
    """Write the pages as archives (in the shared folder unless ``path`` says where) and read them back.

    A partition makes one archive, and a reader holds one archive at once; scan partitions are bounded
    by ``spark.sql.files.maxPartitionBytes``. Odd rows are as in ``write_archives``.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/lw-warc-{uuid.uuid4().hex}"
    write_archives(pages, key, url, html, path)
    return read_archives(path + "/part-*", spark, pages.schema[key].dataType.simpleString()).withColumnRenamed("key", key)
