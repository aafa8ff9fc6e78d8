"""Media columns: content-addressed payloads in tar shards.

Payloads are stored losslessly as 8-bit grey PNG images, named by their digest,
in tar shards on shared storage.  Rows carry the digest and the place: shard,
offset and length.  Metadata columns are filled by range reads of the images'
headers alone, features by reading the stored bytes back.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator
from contextlib import closing

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship
from .common import scratch, stage

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk: all that a header read fetches.
HEADER_BYTES = 33
SHARD_BYTES = 256 << 20
#: Places that a task remembers; beyond it starts anew, and may store a payload again.
KNOWN_PLACES = 1 << 19


# --- the image format ---------------------------------------------------------


def payload_of(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of the image width."""
    return data + bytes(WIDTH * max(1, -(-len(data) // WIDTH)) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 9) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits for a sample, from the first ``HEADER_BYTES`` bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode_png(data: bytes) -> bytes:
    width, height, _ = read_header(data[:HEADER_BYTES])
    at, body = HEADER_BYTES, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + part):
            raise ValueError("a damaged PNG chunk")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


# --- shards -------------------------------------------------------------------


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Tar shards of one task.  Names hold the attempt, so a retried task never meets its own leftovers."""

    def __init__(self, root: str, name: str):
        self.store, self.root = open_store(root)
        self.store.create_dir(self.root, recursive=True)
        self.uri, self.name, self.count, self.out, self.at = root, name, 0, None, 0

    def put(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.out is not None and self.at > SHARD_BYTES:
            self.close()
        if self.out is None:
            self.shard = f"{self.name}-{self.count:04d}.tar"
            self.out, self.at = self.store.open_output_stream(f"{self.root}/{self.shard}"), 0
            self.count += 1
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        offset = self.at + len(head)
        pad = -len(data) % tarfile.BLOCKSIZE
        self.out.write(head + data + bytes(pad))
        self.at = offset + len(data) + pad
        return self.shard, offset, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


def store_texts(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the payload of every text and return ``(id, n_bytes, digest, shard, offset, length)``, stored.

    A task writes each different payload once (as far as ``KNOWN_PLACES`` reaches).
    Where a payload has several places, :func:`media_columns` takes the first.  Null and
    empty texts have a payload of 64 bytes 0, repeated rows stay, an empty table gives no
    rows, and other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        places: dict[bytes, tuple[str, int, int]] = {}
        with closing(ShardWriter(root, name)) as shards:
            for batch in batches:
                out: list[tuple] = []
                for text in batch.column(1):
                    data = (text.as_py() or "").encode()
                    payload = payload_of(data)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in places:
                        if len(places) >= KNOWN_PLACES:
                            places.clear()
                        places[digest] = shards.put(f"{digest.hex()}.png", encode_png(payload))
                    out.append((len(data), digest, *places[digest]))
                kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_bytes", "digest", "shard", "offset", "length"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stage(rows.mapInArrow(run, f"id {kind}, n_bytes long, digest binary, shard string, offset long, length long"), "media-rows")


def _reads(places: DataFrame, root: str, kinds: list[tuple[str, pa.DataType, str]], read) -> DataFrame:
    """Add columns to ``places(digest, shard, offset, length)`` by range reads; tasks go by shard."""
    ship(places.sparkSession)
    ordered = places.select("digest", "shard", "offset", "length").repartition(F.col("shard"), F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("shard", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        name, file = None, None
        for batch in batches:
            out = []
            for shard, offset, length in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, store.open_input_file(f"{base}/{shard}")
                out.append(read(file, offset, length))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in out], kind) for i, (_, kind, _) in enumerate(kinds))], names=[*batch.schema.names, *(k[0] for k in kinds)])
        if file is not None:
            file.close()

    schema = "digest binary, shard string, offset long, length long, " + ", ".join(f"{n} {t}" for n, _, t in kinds)
    return ordered.mapInArrow(run, schema)


def header_columns(places: DataFrame, root: str) -> DataFrame:
    """Fill ``width``, ``height`` and ``bits`` of ``places(digest, shard, offset, length)``; of each image only ``HEADER_BYTES`` bytes are read.

    Repeated places are read again, an empty table gives no rows, and other columns are left out.
    """
    kinds = [(n, pa.int64(), "long") for n in ("width", "height", "bits")]
    return _reads(places, root, kinds, lambda file, offset, length: read_header(file.read_at(HEADER_BYTES, offset)))


def feature_columns(places: DataFrame, root: str) -> DataFrame:
    """Fill the payload's and the image's digests and the features of ``places``, from the stored bytes.

    Repeated places are read again, an empty table gives no rows, and other columns are left out.
    """

    def read(file, offset: int, length: int) -> tuple:
        data = file.read_at(length, offset)
        payload = decode_png(data)
        samples = np.frombuffer(payload, np.uint8)
        stats = f"sum={int(samples.sum(dtype=np.int64))};min={samples.min()};max={samples.max()};zeros={int((samples == 0).sum())}"
        return len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-WIDTH:]), hashlib.sha256(data).digest(), stats

    kinds = [("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.binary(), "binary"), ("tail_crc32", pa.int64(), "long"), ("media_sha256", pa.binary(), "binary"), ("samples", pa.string(), "string")]
    return _reads(places, root, kinds, read)


def media_columns(docs: DataFrame, root: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text and return a row with its place, metadata and features.

    ``root`` is a folder on shared storage, by default below the session's shared
    folder.  Null and empty texts have a payload of 64 bytes 0.  Equal texts share
    one stored image and all values.  Repeated rows stay; an empty table gives no
    rows and writes no shard.
    """
    root = root or scratch(docs.sparkSession, "media")
    rows = store_texts(docs, root, id_col, text_col)
    places = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.shard", "p.offset", "p.length")
    places = stage(places, "media-places")
    heads = header_columns(places, root).select("digest", "width", "height", "bits")
    read = feature_columns(places, root).join(heads, "digest")
    read = stage(read, "media-read")
    out = rows.select("id", "n_bytes", "digest").join(read, "digest")
    hexed = {c: F.lower(F.hex(c)) for c in ("digest", "payload_sha256", "media_sha256")}
    return out.select(F.col("id").alias(id_col), *(hexed.get(c, F.col(c)).alias(c) for c in out.columns if c != "id"))
