"""Puffin sidecar files: writer, reader with limits, inspection.

A file is the magic, the blobs, the magic, a JSON footer, its length, flags and the magic again, as the public Puffin
format has it.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

MAGIC = b"PFA1"
MAX_FOOTER, MAX_BLOB, MAX_BLOBS = 16 * 2**20, 2 * 2**30, 65_536
#: Kinds of this library's blobs; readers take other kinds through portable.KINDS.
PREFIX = "cardlens"
HLL, BLOOM, CMS, EQUI_DEPTH, CORRELATED = (f"{PREFIX}.{k}-v1" for k in ("hll", "bloom", "count-min", "equi-depth", "correlated"))
SCHEMA_VERSION_PROPERTY, SCHEMA_VERSION = f"{PREFIX}.schema-version", "1"


class PuffinError(ValueError):
    """The file is not a Puffin file within the limits."""


@dataclass
class BlobMetadata:
    kind: str
    fields: list[int]
    snapshot_id: int
    sequence_number: int
    offset: int
    length: int
    compression_codec: str | None = None
    properties: dict[str, str] = field(default_factory=dict)

    def to_json(self) -> dict:
        out = {"type": self.kind, "fields": self.fields, "snapshot-id": self.snapshot_id, "sequence-number": self.sequence_number, "offset": self.offset, "length": self.length}
        return out | ({"compression-codec": self.compression_codec} if self.compression_codec else {}) | ({"properties": self.properties} if self.properties else {})

    @classmethod
    def from_json(cls, x: dict) -> BlobMetadata:
        try:
            out = cls(x["type"], list(x["fields"]), x.get("snapshot-id", -1), x.get("sequence-number", -1), x["offset"], x["length"], x.get("compression-codec"), dict(x.get("properties", {})))
        except (KeyError, TypeError, AttributeError) as e:
            raise PuffinError(f"blob entry: {e}") from e
        if not isinstance(out.kind, str) or not all(isinstance(v, int) for v in (*out.fields, out.snapshot_id, out.sequence_number, out.offset, out.length)) or out.offset < 0 or out.length < 0:
            raise PuffinError("blob entry of the wrong types")
        return out


class PuffinWriter:
    def __init__(self):
        self._data, self._blobs, self._properties = bytearray(MAGIC), [], {}

    def with_property(self, name: str, value: str) -> PuffinWriter:
        self._properties[name] = value
        return self

    def add_blob(self, kind: str, fields: list[int], payload: bytes, compress: bool = False, snapshot_id: int = -1, sequence_number: int = -1, properties: dict[str, str] | None = None) -> PuffinWriter:
        if len(payload) > MAX_BLOB:
            raise PuffinError("blob too large")
        if compress:
            import zstandard

            payload = zstandard.compress(payload)
        self._blobs.append(BlobMetadata(kind, fields, snapshot_id, sequence_number, len(self._data), len(payload), "zstd" if compress else None, properties or {}))
        self._data += payload
        return self

    def finish(self) -> bytes:
        footer = json.dumps({"blobs": [b.to_json() for b in self._blobs]} | ({"properties": self._properties} if self._properties else {})).encode()
        return bytes(self._data) + MAGIC + footer + struct.pack("<II", len(footer), 0) + MAGIC


def check_schema_version(version: str | None) -> None:
    if version not in (None, SCHEMA_VERSION):
        raise PuffinError(f"schema version {version!r} is not supported")


class PuffinReader:
    def __init__(self, data: bytes):
        if len(data) < 20 or data[:4] != MAGIC or data[-4:] != MAGIC:
            raise PuffinError("no Puffin magic")
        size, flags = struct.unpack_from("<II", data, len(data) - 12)
        if flags:
            raise PuffinError(f"flags {flags} are not supported")
        start = len(data) - 12 - size
        if size > MAX_FOOTER or start < 8 or data[start - 4 : start] != MAGIC:
            raise PuffinError("footer out of range")
        try:
            footer = json.loads(data[start : start + size])
            blobs, properties = footer["blobs"], footer.get("properties", {})
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise PuffinError(f"footer: {e}") from e
        if not isinstance(blobs, list) or len(blobs) > MAX_BLOBS or not isinstance(properties, dict):
            raise PuffinError("footer of the wrong shape")
        self._data, self.properties, self.blobs = data, properties, [BlobMetadata.from_json(b) for b in blobs]
        for b in self.blobs:
            if b.length > MAX_BLOB or b.offset < 4 or b.offset + b.length > start - 4:
                raise PuffinError("blob out of range")
        check_schema_version(properties.get(SCHEMA_VERSION_PROPERTY))

    def read(self, blob: BlobMetadata) -> bytes:
        raw = self._data[blob.offset : blob.offset + blob.length]
        if blob.compression_codec is None:
            return raw
        if blob.compression_codec != "zstd":
            raise PuffinError(f"codec {blob.compression_codec} is not supported")
        import zstandard

        try:
            stream = zstandard.ZstdDecompressor().stream_reader(raw)
            out = bytearray()
            while piece := stream.read(2**20):
                out += piece
                if len(out) > MAX_BLOB:
                    raise PuffinError("blob inflates beyond the limit")
        except zstandard.ZstdError as e:
            raise PuffinError(str(e)) from e
        return bytes(out)


def decoders() -> dict:
    from cardlens.operators import bloom, cms, histograms, hll

    return {HLL: hll.HllSketch, BLOOM: bloom.BloomFilter, CMS: cms.CountMin, EQUI_DEPTH: histograms.EquiDepth, CORRELATED: histograms.CorrelatedHistogram}


def inspect(data: bytes) -> dict:
    """The footer and the parameters of each blob that can be decoded."""
    reader, known, blobs = PuffinReader(data), decoders(), []
    for b in reader.blobs:
        entry = b.to_json()
        if b.kind in known:
            sketch = known[b.kind].from_bytes(reader.read(b))
            entry["sketch"] = {k: v for k, v in vars(sketch).items() if isinstance(v, (int, float))}
        blobs.append(entry)
    return {"properties": reader.properties, "blobs": blobs}


def verify(data: bytes) -> int:
    """Decodes every blob, raising for any that can't be; the number of blobs."""
    reader, known = PuffinReader(data), decoders()
    for b in reader.blobs:
        if b.kind not in known:
            raise PuffinError(f"unknown kind {b.kind}")
        known[b.kind].from_bytes(reader.read(b))
    return len(reader.blobs)


def pack(payloads: list[tuple[str, bytes]]) -> bytes:
    """A file of validated payloads, bound to no field."""
    writer, known = PuffinWriter(), decoders()
    for kind, payload in payloads:
        known[kind].from_bytes(payload)
        writer.add_blob(kind, [], payload)
    return writer.finish()
