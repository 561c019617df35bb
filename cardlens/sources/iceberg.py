"""Statistics of Iceberg tables: table metadata names the sidecars of each snapshot; both are read through Hadoop's file systems.

Only metadata is read, by the public format: no catalog and no Iceberg library. Of a table's statistics files those of its
current snapshot count; older ones are passed over. Kinds that aren't column statistics are skipped unread; a blob of
another snapshot or sequence number, or one for a field that the schema lacks, is an error.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from . import portable, puffin, shared


@dataclass(frozen=True)
class Sidecars:
    """Statistics files of a table's current snapshot; without a snapshot there are none."""

    snapshot_id: int | None
    sequence_number: int | None
    paths: tuple[str, ...]


def metadata(spark: SparkSession, table: str) -> dict:
    """The newest metadata of the table in a folder: the version in version-hint.text, else the highest one there."""
    folder = f"{table.rstrip('/')}/metadata"
    versions = {}
    for name in shared.names(spark, folder):
        if found := re.fullmatch(r"v?(\d+)(?:-[^.]+)?\.metadata\.json", name):
            versions[int(found[1])] = name
    if not versions:
        raise FileNotFoundError(f"no table metadata in {folder}")
    newest, hint = max(versions), f"{folder}/version-hint.text"
    if shared.exists(spark, hint):
        newest = int(shared.read_text(spark, hint))
    return json.loads(shared.read_text(spark, f"{folder}/{versions[newest]}"))


def sidecars(table_metadata: dict) -> Sidecars:
    """Sorted by path, each path once."""
    current = table_metadata.get("current-snapshot-id")
    snapshot = next((s for s in table_metadata.get("snapshots") or () if s["snapshot-id"] == current), None)
    if snapshot is None:
        return Sidecars(None, None, ())
    paths = {s["statistics-path"] for s in table_metadata.get("statistics") or () if s["snapshot-id"] == current}
    return Sidecars(current, snapshot.get("sequence-number", 0), tuple(sorted(paths)))


def schema(table_metadata: dict) -> dict[int, str]:
    """Field id to name of the current schema's columns."""
    current = table_metadata.get("current-schema-id")
    schemas = table_metadata.get("schemas") or [table_metadata["schema"]]
    fields = next(s for s in schemas if current is None or s.get("schema-id") == current)["fields"]
    return {f["id"]: f["name"] for f in fields}


def load(spark: SparkSession, found: Sidecars) -> portable.Snapshot:
    blobs = []
    for path in found.paths:
        reader = puffin.PuffinReader(shared.read_bytes(spark, path))
        for b in reader.blobs:
            if b.kind in portable.KINDS:
                portable.check_snapshot((found.snapshot_id, found.sequence_number), b)
                blobs.append(portable.Blob(b.kind, tuple(b.fields), reader.read(b), b.snapshot_id, b.sequence_number))
    out = portable.Snapshot(blobs)
    out.validate()
    return out


def column_stats(spark: SparkSession, table: str) -> dict[str, portable.ColumnStats]:
    """Statistics of every column of the table in a folder, by field ids; empty ones where there are none."""
    known = metadata(spark, table)
    return portable.by_schema(load(spark, sidecars(known)), schema(known))
