"""Content-addressed media in tar shards.

A text's UTF-8 bytes, zero-padded to a positive multiple of 64, are the 8-bit samples of a greyscale
PNG 64 samples wide. Each task appends the images of its rows to tar shards of its own, one member
for each distinct payload, named by the payload's SHA-256, and reports digest, shard, offset and
length. The copies that several tasks stored are resolved afterwards: the smallest (shard, offset)
of a digest is where every row with that digest points. Texts themselves are never shuffled.

Metadata columns come from range reads of a member's first bytes only (signature and header chunk);
features from reading the member back and decoding its samples.

Defined results: a null text counts as empty and gives 64 zero bytes; equal texts share one member
and all values; rows that repeat an id keep one result each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_path, spread_join, stored
from .shared_files import RangeReader, new_file

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, length, type and the 13 bytes of the header chunk.
HEADER_BYTES = 8 + 4 + 4 + 13
SHARD_BYTES = 256 << 20
LEVEL = 6
_TAR_BLOCK = 512


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8")
    return data + b"\0" * (-len(data) % WIDTH or (0 if data else WIDTH)), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """Greyscale PNG of the payload's bytes, every line unfiltered."""
    lines = len(payload) // WIDTH
    raw = np.zeros((lines, WIDTH + 1), dtype=np.uint8)
    raw[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(lines, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, lines, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a member's first HEADER_BYTES bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", data[16:25])


def decode(data: bytes) -> bytes:
    width, height, depth = header(data)
    if depth != 8:
        raise ValueError("samples must have 8 bits")
    packed, at = [], 8
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not written here")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Lines, mean, deviation and entropy of the samples."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    return f"lines={len(samples) // WIDTH};mean={samples.mean():.4f};std={samples.std():.4f};entropy={float(-(share * np.log2(share)).sum()):.4f}"


class TarShards:
    """Appends members to tar files in the shared folder and tells where their bytes begin."""

    def __init__(self, folder: str):
        self.folder, self.context, self.uri, self.stream, self.at = folder, None, None, None, 0

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        if self.stream is not None and self.at + len(data) > SHARD_BYTES:
            self.close()
        if self.stream is None:
            self.context = new_file(self.folder, ".tar")
            self.uri, self.stream = self.context.__enter__()
            self.at = 0
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT if len(data) < 8 << 30 else tarfile.PAX_FORMAT)
        self.stream.write(head)
        offset = self.at + len(head)
        self.stream.write(data)
        self.stream.write(b"\0" * (-len(data) % _TAR_BLOCK))
        self.at = offset + len(data) + (-len(data) % _TAR_BLOCK)
        return self.uri, offset

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(b"\0" * (2 * _TAR_BLOCK))
            self.context.__exit__(None, None, None)
            self.stream = None


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the payloads; returns (id, n_bytes, digest, shard, offset, length), one row per input row."""
    from .common import TEXT_ROWS

    folder = fresh_path(docs.sparkSession, "media")
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, digest binary, shard string, offset long, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known = TarShards(folder), {}
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS):
                part = batch.slice(at, TEXT_ROWS)
                out: dict = {"n_bytes": [], "digest": [], "shard": [], "offset": [], "length": []}
                for text in part.column(1).to_pylist():
                    payload, n = padded(text)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in known:
                        image = encode(payload)
                        known[digest] = (*shards.add(digest.hex(), image), len(image))
                    shard, offset, length = known[digest]
                    for k, v in zip(out, (n, digest, shard, offset, length), strict=True):
                        out[k].append(v)
                if len(known) > 200_000:
                    known.clear()  # a later copy is stored again; the manifest resolves it
                types = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, type=t) for v, t in zip(out.values(), types, strict=True))], names=["id", *out])
        shards.close()

    return stored(narrow.mapInArrow(run, schema), "manifest")


def resolve(manifest: DataFrame) -> DataFrame:
    """(digest, shard, offset, length, n): one place for each payload, and how many rows have it."""
    place = F.min(F.struct("shard", "offset", "length"))
    return manifest.groupBy("digest").agg(place.alias("at"), F.count("*").alias("n")).select("digest", "at.*", "n")


def _by_place(places: DataFrame) -> DataFrame:
    """Deal members out evenly, in order of place, so that a task reads runs of few shards."""
    return places.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")


def metadata(places: DataFrame) -> DataFrame:
    """(digest, width, height, depth) from header-only range reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            found = [header(reader.read(r["shard"], r["offset"], HEADER_BYTES)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], type=pa.int64()) for i in range(3))], names=["digest", "width", "height", "depth"])
        reader.close()

    return _by_place(places).select("digest", "shard", "offset", "length").mapInArrow(run, "digest binary, width long, height long, depth long")


FEATURES = "digest binary, n long, shard string, offset long, length long, width long, height long, depth long, payload_bytes long, payload_sha binary, tail_crc32 long, media_bytes long, media_sha binary, feature string"


def features(places: DataFrame) -> DataFrame:
    """Header columns and what the stored bytes, read back and decoded, give."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                width, height, depth = header(reader.read(r["shard"], r["offset"], HEADER_BYTES))
                data = reader.read(r["shard"], r["offset"], r["length"])
                payload = decode(data)
                digest = hashlib.sha256(payload).digest()
                if digest != r["digest"]:
                    raise ValueError(f"{r['shard']} at {r['offset']} does not hold {r['digest'].hex()}")
                rows.append((digest, r["n"], r["shard"], r["offset"], r["length"], width, height, depth, len(payload), digest, zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).digest(), feature(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)
        reader.close()

    return _by_place(places).select("digest", "shard", "offset", "length", "n").mapInArrow(run, FEATURES)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every payload, read it back, and give each row the columns of its member.

    The tables of places and features are joined when the result is used, so they stay beside the shards.
    """
    manifest = store(docs, id_col, text_col)
    places = stored(resolve(manifest), "places")
    read = stored(features(places), "features")
    discard(places)
    rows = manifest.select(F.col("id").alias(id_col), "n_bytes", "digest")
    done = spread_join(rows, read, ["digest"], [id_col], manifest.count())
    lower = {c: F.lower(F.hex(old)) for c, old in (("payload_sha256", "payload_sha"), ("media_sha256", "media_sha"), ("digest", "digest"))}
    return done.withColumns(lower).drop("payload_sha", "media_sha", "met")
