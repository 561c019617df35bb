"""Statistics that travel in sidecars, bound to columns by field id, and how they override a table's own."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path

from . import puffin


@dataclass(frozen=True)
class ColumnStats:
    """What is known of a column; None is unknown."""

    row_count: int | None = None
    null_count: int | None = None
    distinct_count: int | None = None
    min: object = None
    max: object = None
    upper_bound_rows: int | None = None
    histogram: object = field(default=None, compare=False)


#: Kinds that become column statistics; names of other writers may be added here as they are met.
KINDS: dict[str, str] = {puffin.HLL: "hll", puffin.EQUI_DEPTH: "equi-depth"}


@dataclass(frozen=True)
class Blob:
    kind: str
    fields: tuple[int, ...]
    payload: bytes
    snapshot_id: int = -1
    sequence_number: int = -1


@dataclass
class Snapshot:
    """Blobs of one table state."""

    blobs: list[Blob]

    def for_field(self, field_id: int) -> list[Blob]:
        return [b for b in self.blobs if field_id in b.fields]

    def validate(self) -> None:
        """Supported kinds need one field id of 0 or more, each pair once; other kinds are passed over."""
        seen = set()
        for b in self.blobs:
            if b.kind in KINDS:
                if len(b.fields) != 1 or b.fields[0] < 0:
                    raise puffin.PuffinError(f"{b.kind} must name one field")
                if (b.fields[0], KINDS[b.kind]) in seen:
                    raise puffin.PuffinError(f"{b.kind} is there twice for field {b.fields[0]}")
                seen.add((b.fields[0], KINDS[b.kind]))

    def column(self, field_id: int) -> ColumnStats | None:
        self.validate()
        from cardlens.operators.histograms import EquiDepth
        from cardlens.operators.hll import HllSketch

        out = None
        for b in self.for_field(field_id):
            if KINDS.get(b.kind) == "hll":
                out = replace(out or ColumnStats(), distinct_count=HllSketch.from_bytes(b.payload).estimate())
            elif KINDS.get(b.kind) == "equi-depth":
                out = replace(out or ColumnStats(), histogram=EquiDepth.from_bytes(b.payload))
        return out


def check_snapshot(expected: tuple[int | None, int | None], blob: puffin.BlobMetadata) -> None:
    """Id and sequence are given both or not at all; a blob's -1 fits any."""
    snapshot, sequence = expected
    if (snapshot is None) != (sequence is None):
        raise ValueError("snapshot id and sequence number go together")
    if snapshot is not None and (blob.snapshot_id not in (-1, snapshot) or blob.sequence_number not in (-1, sequence)):
        raise puffin.PuffinError(f"blob of snapshot {blob.snapshot_id}, {blob.sequence_number}; expected {snapshot}, {sequence}")


def local_path(location: str) -> str:
    return location.removeprefix("file://")


def load(paths: list[str], snapshot_id: int | None = None, sequence_number: int | None = None) -> Snapshot:
    """All blobs of the sidecars, each path once, in order of their names."""
    blobs = []
    for path in sorted(set(paths)):
        reader = puffin.PuffinReader(Path(local_path(path)).read_bytes())
        for b in reader.blobs:
            check_snapshot((snapshot_id, sequence_number), b)
            blobs.append(Blob(b.kind, tuple(b.fields), reader.read(b), b.snapshot_id, b.sequence_number))
    out = Snapshot(blobs)
    out.validate()
    return out


def load_distributed(spark, folder: str):
    """name, type, fields, payload of all blobs of many sidecars, read by the executors."""
    def blobs(batches):
        import pandas as pd

        for df in batches:
            rows = [(path, b.kind, b.fields, reader.read(b)) for path, content in zip(df.path, df.content, strict=True) for reader in [puffin.PuffinReader(content)] for b in reader.blobs]
            yield pd.DataFrame(rows, columns=["path", "kind", "fields", "payload"])

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(blobs, "path string, kind string, fields array<int>, payload binary")


def discover(folder: str) -> list[str]:
    """Sidecars below a folder."""
    return sorted({str(p) for p in Path(local_path(folder)).rglob("*.puffin")})


def by_schema(snapshot: Snapshot, schema: dict[int, str]) -> dict[str, ColumnStats]:
    """Statistics for every field of the schema (id to name), empty where there are none; strict about unknown ids."""
    if any(i <= 0 for i in schema):
        raise ValueError("field ids begin at 1")
    unknown = {f for b in snapshot.blobs if b.kind in KINDS for f in b.fields} - set(schema)
    if unknown:
        raise puffin.PuffinError(f"blobs for unknown fields {sorted(unknown)}")
    return {name: snapshot.column(i) or ColumnStats() for i, name in schema.items()}


def by_schema_lenient(paths: list[str], schema: dict[int, str]) -> dict[str, ColumnStats]:
    """Empty statistics where anything is wrong: for planning without trust in the sidecars. Strict loading is the default."""
    try:
        return by_schema(load(paths), schema)
    except (OSError, ValueError):
        return {name: ColumnStats() for name in schema.values()}


def override(native: ColumnStats, given: ColumnStats) -> ColumnStats:
    """given before native, but the larger distinct count and never fewer rows than native."""
    larger = lambda a, b: max((x for x in (a, b) if x is not None), default=None)
    first = lambda a, b: b if a is None else a
    return ColumnStats(
        larger(native.row_count, given.row_count), first(given.null_count, native.null_count), larger(native.distinct_count, given.distinct_count),
        first(given.min, native.min), first(given.max, native.max), first(given.upper_bound_rows, native.upper_bound_rows), given.histogram or native.histogram,
    )


@dataclass
class StatsTable:
    """A DataFrame with statistics that planning uses in place of its own; its rows are untouched."""

    df: object
    rows: int | None
    columns: dict[str, ColumnStats]

    def with_portable(self, snapshot: Snapshot, fields: dict[int, int]) -> StatsTable:
        """fields: field id to ordinal."""
        names, out = self.df.columns, dict(self.columns)
        for field_id, ordinal in fields.items():
            if field_id <= 0 or not 0 <= ordinal < len(names):
                raise ValueError(f"field {field_id} at {ordinal} is out of range")
            if stats := snapshot.column(field_id):
                out[names[ordinal]] = override(out.get(names[ordinal], ColumnStats()), stats)
        return StatsTable(self.df, self.rows, out)
