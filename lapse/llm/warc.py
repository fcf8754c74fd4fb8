"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing (``write_archives``): the payloads' digests are counted, a digest that repeats gets one response
and revisits; each task packs its records into archives of about ``archive_bytes`` and trains a
dictionary on the first records of each.  An archive is one row; Spark's text sink
writes one file per row under its own commit protocol, so a lost or repeated task leaves no half
archive.  The sink ends a row with a line separator: it is an empty skippable frame, which
readers skip.

Reading (``read_archives``): any folder of such files, of this module or others.  Each file's dictionary
(stored plain or compressed) is loaded from the leading skippable frame, every other frame is one
record.  Its version line, headers, block length, frame size and digests are validated; what does
not hold is told in ``problem``, and the other records of the file are still read.
A file is read whole, so it has to fit a task's memory several times.

Defined cases: null html is an empty payload; rows that share the largest page_id of a group of
equal payloads are all responses; a null page_id is smaller than any other; a null url leaves out the
header; control characters in a url are percent-encoded; repeated rows are records with the same id;
an empty table writes no archive and reads back as an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.llm.common import bounded_join, stage
from lapse.session import scratch_path

# Fixed values of the formats.
FRAME = 0xFD2FB528                    # a Zstandard frame
DICTIONARY_FRAME = 0x184D2A5D         # the skippable frame that holds the dictionary
SKIPPABLE = (0x184D2A50, 0x184D2A5F)
EMPTY_FRAME = "P*M\x18\0\0\0\0"       # skippable frame 0x184D2A50 of no bytes
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REQUIRED = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"         # pages have no capture time: one for all, so that reruns agree

#: Payloads from this size on are written once.
LEAST = 1000
ARCHIVE_BYTES = 16 << 20
#: The dictionary is trained on the first records of an archive, so many bytes of them.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10

RECORD = ("record_id string, record_type string, target_uri string, page_id long, refers_to_id string, payload binary, "
          "payload_bytes long, payload_digest string, file string, frame long, problem string")


def _record_id(page: Column, url: Column, digest: Column) -> Column:
    h = F.sha2(F.to_json(F.struct(page.alias("p"), url.alias("u"), digest.alias("d"))), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3),
                    F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per page: page_id, url, payload (bytes), digest (SHA-1, hex), record_id and refers_to_id (null: a response)."""
    payload = F.encode(F.coalesce(F.col("`html`"), F.lit("")), "UTF-8")
    p = pages.select(F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    repeated = p.where(F.octet_length("payload") >= least).groupBy("digest").agg(
        F.count("*").alias("rows"), F.max(F.struct("page_id", "url")).alias("first")).where("rows > 1")
    repeated = stage(repeated.select("digest", "first"), "warc-repeated")
    p = bounded_join(p, repeated, ["digest"], repeated.count(), "left")
    first = _record_id(F.col("first.page_id"), F.col("first.url"), F.col("digest"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return p.select("page_id", "url", "payload", "digest", _record_id(F.col("page_id"), F.col("url"), F.col("digest")).alias("record_id"),
                    F.when(revisit, first).alias("refers_to_id"))


def _b32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def build_record(page_id, url, payload: bytes, digest: str, record_id: str, refers_to_id) -> bytes:
    """The bytes of one record.  A revisit keeps the HTTP header, which tells the payload's length, and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to_id else http + payload
    head = [("WARC-Type", "revisit" if refers_to_id else "response"), ("WARC-Record-ID", record_id), ("WARC-Date", DATE),
            ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _b32(digest)),
            ("WARC-Block-Digest", _sha1(block))]
    if url is not None:
        head.append(("WARC-Target-URI", _safe(url)))
    if refers_to_id:
        head += [("WARC-Refers-To", refers_to_id), ("WARC-Profile", SAME_PAYLOAD)]
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    """The leading frame and the dictionary trained on ``samples``; nothing where they are too few to train on."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        d = zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return b"", None
    packed = zstandard.ZstdCompressor(level=9).compress(d.as_bytes())
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed, d


def _pack(batches: Iterator[pa.RecordBatch], archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Archives (one row each) of a task's records."""
    out, size, waiting, held, comp = [], 0, [], 0, None

    def begin():
        nonlocal out, size, comp, waiting, held
        head, d = dictionary_frame(waiting)
        comp = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=True) if d else \
            zstandard.ZstdCompressor(level=3, write_checksum=True)
        out, size = [head], len(head)
        for r in waiting:
            add(r)
        waiting, held = [], 0

    def add(r):
        nonlocal size
        out.append(comp.compress(r))
        size += len(out[-1])

    def archive():
        return pa.record_batch([pa.array([b"".join(out)], pa.binary())], names=["archive"])

    for batch in batches:
        cols = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            r = build_record(*[c[i].as_py() for c in cols])
            if comp is None:
                waiting.append(r)
                held += len(r)
                if held >= SAMPLE_BYTES:
                    begin()
            else:
                add(r)
            if comp is not None and size >= archive_bytes:
                yield archive()
                out, size, comp = [], 0, None
    if waiting:
        begin()
    if comp is not None:
        yield archive()


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, least: int = LEAST) -> None:
    """Write a record per page into archives below ``path``."""
    r = records(pages, least).select("page_id", "url", "payload", "digest", "record_id", "refers_to_id")
    packed = r.mapInArrow(lambda batches: _pack(batches, archive_bytes), "archive binary")
    packed.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME) \
        .option("maxRecordsPerFile", 1).option("compression", "none").text(path)


# ---- reading ----

def frame_end(data: memoryview, at: int) -> int:
    """The end of the Zstandard frame at ``at``, from the headers of its blocks.  ValueError where it is cut off."""
    if at + 5 > len(data):
        raise ValueError("frame cut off")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    pos = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if pos + 3 > len(data):
            raise ValueError("frame cut off")
        h = data[pos] | data[pos + 1] << 8 | data[pos + 2] << 16
        kind = h >> 1 & 3
        if kind == 3:
            raise ValueError("bad block in frame")
        pos += 3 + (1 if kind == 1 else h >> 3)
        if h & 1:
            break
    pos += 4 * checksum
    if pos > len(data):
        raise ValueError("frame cut off")
    return pos


def frames(data: bytes) -> Iterator[tuple[int, str, memoryview]]:
    """(offset, kind, content) of each frame: 'dictionary' (the leading one), 'record' (with its header) or, last, 'problem'
    where the file goes on with something else.  Other skippable frames are left out."""
    view, at = memoryview(data), 0
    while at < len(view):
        if at + 8 > len(view):
            yield at, "problem", memoryview(b"frame cut off")
            return
        magic, size = struct.unpack_from("<II", view, at)
        if SKIPPABLE[0] <= magic <= SKIPPABLE[1]:
            if at + 8 + size > len(view):
                yield at, "problem", memoryview(b"skippable frame cut off")
                return
            if magic == DICTIONARY_FRAME and at == 0:
                yield at, "dictionary", view[8:8 + size]
            at += 8 + size
            continue
        if magic != FRAME:
            yield at, "problem", memoryview(b"not a frame")
            return
        try:
            end = frame_end(view, at)
        except ValueError as e:
            yield at, "problem", memoryview(str(e).encode())
            return
        yield at, "record", view[at:end]
        at = end


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("bad header line")
        out.setdefault(name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
    return out


def _length(headers: dict[str, str], of: str) -> int:
    n = headers.get("content-length", "")
    if not (n.isascii() and n.isdigit()):
        raise ValueError(f"{of} has no valid Content-Length")
    return int(n)


def _same_digest(stated: str, data: bytes) -> bool:
    """Whether ``stated`` (algorithm:value, base 32 or hex) is the digest of ``data``; unknown algorithms are not judged."""
    name, _, value = stated.partition(":")
    try:
        d = hashlib.new(name.lower(), data)
    except ValueError:
        return True
    return value.lower() in (d.hexdigest(), base64.b32encode(d.digest()).decode().lower().rstrip("="), base64.b32encode(d.digest()).decode().lower())


def _hex(stated: str | None) -> str | None:
    if not stated or not stated.lower().startswith("sha1:"):
        return None
    v = stated[5:]
    try:
        return v.lower() if len(v) == 40 else base64.b32decode(v.upper()).hex()
    except ValueError:
        return None


def parse_record(data: bytes) -> dict:
    """Fields of a record's bytes.  ``problem`` tells the first thing that does not hold."""
    r = dict.fromkeys(("record_id", "record_type", "target_uri", "page_id", "refers_to_id", "payload", "payload_bytes",
                       "payload_digest", "problem"))
    try:
        head, blank, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.split(b"\r\n")
        if version not in VERSIONS or not blank:
            raise ValueError("no WARC version line")
        h = _headers(lines)
        r["record_id"], r["record_type"], r["target_uri"] = h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri")
        r["refers_to_id"] = h.get("warc-refers-to")
        if h.get("page-id", "").lstrip("-").isdigit():
            r["page_id"] = int(h["page-id"])
        for name in REQUIRED:
            if name.lower() not in h:
                raise ValueError(f"no {name}")
        n = _length(h, "record")
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise ValueError(f"block of {len(rest) - 4} bytes, Content-Length {n}")
        block = rest[:n]
        if "warc-block-digest" in h and not _same_digest(h["warc-block-digest"], block):
            raise ValueError("block digest differs")
        payload, told = block, len(block)
        if h.get("content-type", "").startswith("application/http"):
            http, blank, payload = block.partition(b"\r\n\r\n")
            if not http.startswith(b"HTTP/") or not blank:
                raise ValueError("no HTTP header")
            told = _length(_headers(http.split(b"\r\n")[1:]), "HTTP header")
        if r["record_type"] == "revisit":
            r["payload_bytes"], r["payload_digest"] = told, _hex(h.get("warc-payload-digest"))
            if not r["refers_to_id"]:
                raise ValueError("revisit without WARC-Refers-To")
        else:
            if told != len(payload):
                raise ValueError(f"payload of {len(payload)} bytes, Content-Length {told}")
            if "warc-payload-digest" in h and not _same_digest(h["warc-payload-digest"], payload):
                raise ValueError("payload digest differs")
            r["payload"], r["payload_bytes"], r["payload_digest"] = payload, len(payload), hashlib.sha1(payload).hexdigest()
    except ValueError as e:
        r["problem"] = str(e)
    return r


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, each with ``frame``, its offset."""
    plain = zstandard.ZstdDecompressor()
    reader = plain
    for at, kind, content in frames(data):
        if kind == "dictionary":
            raw = bytes(content)
            if raw[:4] == struct.pack("<I", FRAME):
                raw = plain.decompressobj().decompress(raw)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            continue
        if kind == "problem":
            yield {**parse_record(b""), "frame": at, "problem": bytes(content).decode()}
            return
        try:
            told = zstandard.frame_content_size(content)
            record = reader.decompressobj().decompress(content)
            if told >= 0 and told != len(record):
                raise zstandard.ZstdError("frame's content size differs")
        except zstandard.ZstdError as e:
            yield {**parse_record(b""), "frame": at, "problem": f"frame: {e}"}
            continue
        yield {**parse_record(record), "frame": at}


def _unpack(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()),
                        ("refers_to_id", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("file", pa.string()), ("frame", pa.int64()), ("problem", pa.string())])
    for batch in batches:
        for i in range(batch.num_rows):
            name, held, size = batch.column(0)[i].as_py(), [], 0
            for r in read_archive(batch.column(1)[i].as_py()):
                size += len(r["payload"] or b"")
                held.append({**r, "file": name, "payload": r["payload"] if with_payload else None})
                if size >= 8 << 20 or len(held) >= 4096:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record below ``path``: record_id, record_type, target_uri, page_id, refers_to_id, payload (null for
    revisits, and for all without ``with_payload``), payload_bytes and payload_digest (SHA-1, hex) of the full payload, file, frame (offset)
    and problem (null where all holds)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: _unpack(batches, with_payload), RECORD)


def resolve(found: DataFrame) -> DataFrame:
    """``found`` (as of ``read_archives``, without payloads) with refers_to, the page_id of the response that a revisit names,
    and a problem where there is none or its digest or length differs."""
    found = stage(found, "warc-records")
    wanted = found.where("refers_to_id is not null").select(F.col("refers_to_id").alias("record_id")).distinct()
    have = found.where("record_type = 'response' and problem is null").join(wanted, "record_id", "left_semi")
    have = stage(have.groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.max("page_id").alias("refers_to"), F.first("payload_digest").alias("its_digest"), F.first("payload_bytes").alias("its_bytes"),
        F.lit(True).alias("there")), "warc-referred")
    out = bounded_join(found, have, ["refers_to_id"], have.count(), "left")
    same = F.col("payload_digest").eqNullSafe(F.col("its_digest")) & F.col("payload_bytes").eqNullSafe(F.col("its_bytes"))
    lost = F.when(F.col("refers_to_id").isNotNull() & F.col("there").isNull(), F.lit("the response referred to is not there")) \
            .when(F.col("there") & ~same, F.lit("the response referred to differs"))
    return out.withColumn("problem", F.coalesce("problem", lost)).drop("its_digest", "its_bytes", "there")


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to,
    and url and problem (null: the record is valid)."""
    spark = pages.sparkSession
    path = scratch_path(spark, f"llm-{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex[:12]}")
    write_archives(pages, path, archive_bytes)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return resolve(read_archives(spark, path, with_payload=False)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("target_uri").alias("url"), "problem")
