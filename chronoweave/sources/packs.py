"""Portable packs: JSON lines with a manifest and checksums, as a folder or an archive."""

from __future__ import annotations

import hashlib
import json
import os
import stat
import tempfile
import zipfile
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoweave.operators.identity import import_id

FORMAT, VERSION = "chronoweave-pack", 1
TABLES = ("entities", "entity_aliases", "relation_frames", "edges")
ARCHIVE_CAP = 512 * 1024 * 1024
MARKERS = ("embedding", "vector")


class PackError(ValueError):
    pass


def export_rows(df: DataFrame, embeddings: bool = False) -> DataFrame:
    """Rows as they are exported: episodes as a count, no links, embeddings only on request."""
    out = df.drop("in_link", "out_link", "source_episode_uuid")
    if "episodes" in out.columns:
        out = out.withColumn("episode_count", F.size(F.coalesce("episodes", F.array().cast("array<string>")))).withColumn("episodes_omitted", F.col("episode_count") > 0).drop("episodes")
    return out if embeddings else out.drop(*[c for c in out.columns if any(m in c.lower() for m in MARKERS)])


def write_folder(tables: dict[str, DataFrame], folder: str, group: str) -> dict:
    """Write each table as JSON lines and a manifest with counts and SHA-256 sums. Rows are streamed, one table a file."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    counts, sums = {}, {}
    for name in TABLES:
        digest, n = hashlib.sha256(), 0
        with (root / f"{name}.jsonl").open("wb") as f:
            if name in tables:
                for row in tables[name].select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
                    line = (row.j + "\n").encode()
                    f.write(line)
                    digest.update(line)
                    n += 1
        counts[name], sums[f"{name}.jsonl"] = n, digest.hexdigest()
    manifest = {"format": FORMAT, "version": VERSION, "group_id": group, "counts": counts}
    (root / "manifest.json").write_text(json.dumps(manifest, indent=1, sort_keys=True))
    (root / "checksums.json").write_text(json.dumps(sums, indent=1, sort_keys=True))
    return manifest


def validate_folder(folder: str) -> dict:
    """The manifest of a sound pack; raises PackError otherwise."""
    root = Path(folder)
    try:
        manifest, sums = (json.loads((root / n).read_text()) for n in ("manifest.json", "checksums.json"))
    except (OSError, ValueError) as e:
        raise PackError(f"manifest or checksums: {e}") from e
    if manifest.get("format") != FORMAT or manifest.get("version") != VERSION:
        raise PackError("unknown format or version")
    for name, digest in sums.items():
        if PurePosixPath(name).name != name or not name.endswith(".jsonl") or name[:-6] not in TABLES:
            raise PackError(f"checksum for a file that is no part of a pack: {name}")
        if not (root / name).is_file():
            raise PackError(f"missing file: {name}")
        have, n = hashlib.sha256(), 0
        with (root / name).open("rb") as f:
            for line in f:
                have.update(line)
                if line.strip():
                    if not isinstance(json.loads(line), dict):
                        raise PackError(f"{name}: a line is no object")
                    n += 1
        if have.hexdigest() != digest:
            raise PackError(f"checksum of {name}")
        if manifest["counts"].get(name[:-6]) != n:
            raise PackError(f"row count of {name}")
    return manifest


def write_archive(folder: str, path: str) -> None:
    """Zip a pack; the file appears under its name only when it is whole."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    os.close(handle)
    with zipfile.ZipFile(temporary, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(Path(folder).iterdir()):
            z.write(f, f.name)
    os.replace(temporary, path)


def extract_archive(path: str, folder: str) -> dict:
    """Unzip and validate; refuses unsafe names, links, repeated names and archives that unpack to too much."""
    with zipfile.ZipFile(path) as z:
        seen, size = set(), 0
        for i in z.infolist():
            p = PurePosixPath(i.filename)
            if "\\" in i.filename or p.is_absolute() or ".." in p.parts or stat.S_ISLNK(i.external_attr >> 16) or i.filename in seen:
                raise PackError(f"unsafe name: {i.filename}")
            seen.add(i.filename)
            size += i.file_size
        if size > ARCHIVE_CAP:
            raise PackError("archive too large")
        z.extractall(folder)
    return validate_folder(folder)


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON-lines table; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def remap_entities(incoming: DataFrame, existing: DataFrame, group: str) -> DataFrame:
    """``uuid`` to ``target_uuid``: the entity of that name in the group, else an id derived from group and source."""
    have = existing.where(F.col("group_id") == group).groupBy("name").agg(F.min("uuid").alias("have"))
    derived = import_id(F.concat_ws(":", F.lit("pack"), F.lit(group), F.lit("entity"), F.col("uuid")))
    return incoming.join(have, "name", "left").select("uuid", "name", F.coalesce("have", derived).alias("target_uuid"), F.col("have").isNotNull().alias("existed"))


def remap_edges(edges: DataFrame, entity_map: DataFrame, existing: DataFrame, group: str) -> DataFrame:
    """Edges with mapped ends that add to the group: those with an unmapped end or an open fact already there are left out."""
    at = lambda c: entity_map.select(F.col("uuid").alias(c), F.col("target_uuid").alias(f"new_{c}"))
    mapped = edges.join(at("subj"), "subj").join(at("obj"), "obj")
    key = F.concat_ws("::", F.lit(group), "new_subj", F.lower("pred"), "new_obj")
    keyed = mapped.withColumn("fact_key", F.when(F.col("invalid_at").isNull(), key).otherwise(F.concat_ws("::", key, F.lit("history"), "uuid")))
    return keyed.join(existing.select("fact_key").distinct(), "fact_key", "left_anti").dropDuplicates(["fact_key"]).select("fact_key", "uuid", F.col("new_subj").alias("subj"), "pred", F.col("new_obj").alias("obj"))
