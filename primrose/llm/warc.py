"""WARC archives compressed by Zstandard with a dictionary per archive.

An archive is one skippable frame that holds the dictionary, then one frame
per record. Spark partitions the pages, tasks write archives, a manifest
(a table) names those of the tasks that ended well, and tasks read them back.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primrose.llm.common import kept_table, salted_left_join
from primrose.session import scratch_path, ship_package

SKIPPABLE = 0x184D2A5D  # Fixed value: magic number of the dictionary frame.
FRAME = b"\x28\xb5\x2f\xfd"  # Fixed value: magic number of a Zstandard frame.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
LEAST_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLE_RECORDS = 100
SAMPLE_BYTES = 8 << 10
READ_BYTES = 1 << 20
_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RECORDS = pa.schema(
    [
        ("record_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


class WarcError(ValueError):
    """An archive that breaks its format."""


def _uri(number: int | None) -> str:
    return f"<urn:primrose:{'null' if number is None else number}>"


def _number(uri: str) -> int | None:
    word = uri.removeprefix("<urn:primrose:").removesuffix(">")
    return None if word == "null" else int(word)


def record_bytes(
    number: int | None, url: str | None, payload: bytes, sha1: str, revisit: bool, refers_to: int | None
) -> bytes:
    """One WARC/1.1 record. A revisit has no block."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    block = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(number)}",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload; ``WarcError`` where they do not fit each other."""
    head, cut, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not cut or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"no WARC header: {raw[:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"header without a colon: {line!r}")
        fields[name.strip().lower()] = value.strip()
    try:
        length, full = int(fields["content-length"]), int(fields["x-payload-length"])
        kind, number = fields["warc-type"], _number(fields["warc-record-id"])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        sha1 = base64.b32decode(digest).hex()
    except (KeyError, ValueError) as error:
        raise WarcError(f"bad header: {error}") from error
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"{len(rest) - 4} bytes in the block, Content-Length {length}")
    payload = rest[:length]
    if kind == "response":
        if length != full or hashlib.sha1(payload).hexdigest() != sha1:
            raise WarcError("payload and digest differ")
    elif kind != "revisit" or length:
        raise WarcError(f"unknown record: {kind} of {length} bytes")
    refers = _number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
    return {
        "record_id": number,
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": refers,
        "payload_bytes": full,
        "payload_digest": sha1,
        "payload": payload if kind == "response" else None,
    }


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained on the first records of an archive; empty where they are too
    few for one (the frame then holds no dictionary)."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class _Archive:
    def __init__(self, folder: str, samples: list[bytes]):
        # A name of its own for each attempt: a repeated task leaves the file
        # of the first attempt unnamed in the manifest.
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        files, inner = fs.FileSystem.from_uri(self.path)
        files.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(inner, compression=None)
        words = _dictionary(samples)
        self.out.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
        extra = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
        self.pack = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, **extra)
        self.records, self.bytes = 0, 8 + len(words)

    def add(self, raw: bytes) -> None:
        frame = self.pack.compress(raw)
        self.out.write(frame)
        self.records += 1
        self.bytes += len(frame)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.bytes


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        archive, closed = None, []

        def flush():
            nonlocal archive, waiting
            if archive is None and waiting:
                archive = _Archive(folder, [raw[:SAMPLE_BYTES] for raw in waiting])
            for raw in waiting:
                archive.add(raw)
            waiting = []

        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                payload = row["payload"] or b""
                raw = record_bytes(
                    row["id"], row["url"], payload, row["sha1"], row["revisit"], row["refers_to"]
                )
                waiting.append(raw)
                held += len(raw)
                if len(waiting) >= SAMPLE_RECORDS or held > READ_BYTES or archive:
                    flush()
                    held = 0
                if archive and archive.bytes >= archive_bytes:
                    closed.append(archive.close())
                    archive = None
        flush()
        if archive:
            closed.append(archive.close())
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("path", "records", "bytes"), c, strict=True)) for c in closed], _MANIFEST
        )

    return write


def frames(path: str) -> Iterator[bytes]:
    """Decoded records of an archive, one frame at a time."""
    files, inner = fs.FileSystem.from_uri(path)
    with files.open_input_stream(inner, compression=None) as stream:
        head = stream.read(8)
        if len(head) < 8:
            raise WarcError("no leading frame")
        magic, size = struct.unpack("<II", head)
        if magic != SKIPPABLE:
            raise WarcError(f"leading frame is {magic:#x}, not a dictionary frame")
        words = stream.read(size)
        if len(words) != size:
            raise WarcError("dictionary is cut off")
        extra = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
        unpack = zstandard.ZstdDecompressor(**extra)
        left = stream.read(READ_BYTES)
        while left:
            if len(left) < 4:
                left += stream.read(READ_BYTES)
            if left[:4] != FRAME:
                raise WarcError(f"no frame: {left[:4]!r}")
            one, parts = unpack.decompressobj(), []
            while not one.eof:
                if not left:
                    raise WarcError("frame is cut off")
                parts.append(one.decompress(left))
                left = one.unused_data if one.eof else stream.read(READ_BYTES)
            yield b"".join(parts)
            left = left or stream.read(READ_BYTES)


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                rows, held, seen = [], 0, 0
                for raw in frames(entry["path"]):
                    row = parse_record(raw)
                    seen += 1
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    held += 300 + len(row["payload"] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _RECORDS)
                        rows, held = [], 0
                if seen != entry["records"]:
                    raise WarcError(f"{entry['path']}: {seen} records of {entry['records']}")
                yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    return read


def plan_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id, url, payload, sha1, revisit, refers_to``, one row per page.

    Equal payloads (SHA-256 and length) of at least 1,000 bytes: the record of
    the largest id is the response, the others revisit it. A digest may belong
    to any share of the rows: maxima combine before the exchange, and the join
    back is salted.
    """
    src = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b"")).alias("payload"),
    )
    same = F.when(F.octet_length("payload") >= LEAST_REVISIT, F.sha2("payload", 256))
    hashed = src.withColumn("__same", same)
    first = (
        hashed.filter(F.col("__same").isNotNull())
        .groupBy("__same")
        .agg(F.max("id").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .filter("__n > 1")
        .select("__same", "__first")
    )
    # Small payloads have no digest to meet at; their join key is null, so the
    # salt alone deals them.
    spread = F.struct("id", "url")
    joined = salted_left_join(hashed, first, ["__same"], spread, salts=64)
    revisit = F.col("__first").isNotNull() & ~F.col("id").eqNullSafe(F.col("__first"))
    return joined.select(
        "id",
        "url",
        "payload",
        F.sha1("payload").alias("sha1"),
        revisit.alias("revisit"),
        F.when(revisit, F.col("__first")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of about ``archive_bytes`` below ``folder``; returns the
    manifest ``path, records, bytes``, kept as a table in the shared folder."""
    where = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    made = records.mapInArrow(_writer(where, archive_bytes), "path string, records long, bytes long")
    return kept_table(made, "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives a manifest names, headers, lengths and digests
    checked: ``record_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload`` (null in revisits). An archive that breaks the
    format stops the job with ``WarcError``."""
    schema = (
        "record_id long, url string, record_type string, refers_to long, payload_bytes long,"
        " payload_digest string, payload binary"
    )
    # Dealt evenly over as many tasks as there are archives: a manifest is small
    # in bytes, so without a number its rows would be put into one task.
    entries = manifest.select("path", "records").repartition(max(1, manifest.count()))
    return entries.mapInArrow(_reader(with_payload), schema)


def round_trip(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    folder: str | None = None,
    with_payload: bool = False,
) -> DataFrame:
    """Writes ``pages`` as archives and reads these back.

    Null html counts as empty, null urls write no target, null ids are written
    as such; a null id refers to the largest id of its group unless all ids of
    the group are null, when all are responses. Repeated rows are records of
    their own: those with the largest id are all responses. An empty table
    gives no archive and an empty result. Line ends in a url are escaped.
    """
    ship_package(pages.sparkSession)
    where = folder or scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(plan_records(pages, id_col, url_col, html_col), where)
    return read_archives(manifest, with_payload)
