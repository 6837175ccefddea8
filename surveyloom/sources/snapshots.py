"""Named snapshots: a one-row JSON manifest each, over Parquet tables kept by content and shared by all of them."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.numeric import col

# Fixed value: the newest manifest layout this code reads.
VERSION = 1
MANIFEST_SCHEMA = (
    "name string, saved_at string, version double, "
    "tables map<string, struct<columns: array<string>, rows: bigint, part: string>>, "
    "datasets array<struct<name: string, table: string>>, views array<struct<name: string, table: string>>, "
    "settings string"
)
# Where the shared tables lie; no snapshot can have this name.
_PARTS = ".parts"
_SAVE_ATTEMPTS = 3


def _folder(root: str, name: str) -> str:
    if not name or "/" in name or name.startswith("."):
        raise ValueError("a snapshot name is a plain folder name")
    return f"{root.rstrip('/')}/{name}"


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _hash_view(df: DataFrame, field: T.StructField) -> Column:
    """What is hashed of a cell: nested cells as JSON that shows nulls, everything else as it is."""
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.to_json(F.struct(col(field.name).alias("v")), {"ignoreNullFields": "false"})
    return col(field.name)


def _content(df: DataFrame) -> list[Column]:
    """Aggregates that depend on the rows but not on their order: how many, and two sums of 64-bit hashes.

    Hashing passes over nulls, so which cells are null is hashed as well.
    """
    cells = [_hash_view(df, f) for f in df.schema]
    nulls = F.concat(F.lit("|"), *[F.when(col(f.name).isNull(), "1").otherwise("0") for f in df.schema])
    lanes = [F.xxhash64(nulls, *cells), F.xxhash64(*cells[::-1], nulls, F.lit("second"))]
    return [F.count(F.lit(1)).alias("rows"),
            *[F.coalesce(F.sum(h.cast("decimal(28,0)")), F.lit(0)).cast("string").alias(f"lane{i}") for i, h in enumerate(lanes)]]


def _key(df: DataFrame, content: Mapping) -> str:
    schema = [(f.name, f.dataType.jsonValue()) for f in df.schema]
    return hashlib.sha256(json.dumps([schema, content["rows"], content["lane0"], content["lane1"]]).encode()).hexdigest()[:32]


def fingerprint(df: DataFrame) -> str:
    """Content of a table as 32 hex digits: equal for the same names, types and rows, however ordered or split.

    -0.0 counts as 0.0. One pass, with two numbers for each task.
    """
    return _key(df, df.agg(*_content(df)).first().asDict())


def _stored(spark: SparkSession, root: str, part: str) -> bool:
    fs, path = _files(spark, f"{root.rstrip('/')}/{_PARTS}/{part}/_SUCCESS")
    return bool(fs.exists(path))


def _find_part(spark: SparkSession, root: str, key: str) -> str | None:
    """A whole copy of the content, if the root has one."""
    fs, pattern = _files(spark, f"{root.rstrip('/')}/{_PARTS}/{key}/*/_SUCCESS")
    names = sorted(s.getPath().getParent().getName() for s in fs.globStatus(pattern) or [])
    return f"{key}/{names[0]}" if names else None


def _store(spark: SparkSession, root: str, df: DataFrame) -> tuple[str, int]:
    """(part, rows) of a table: the copy the root has, else one written now.

    The content is taken again while it is written, so a table that changes from
    one read to the next is filed under what was really stored.
    """
    content = df.agg(*_content(df)).first().asDict()
    key = _key(df, content)
    part = _find_part(spark, root, key)
    if part is not None:
        return part, content["rows"]
    own, seen = uuid.uuid4().hex, Observation()
    parts = f"{root.rstrip('/')}/{_PARTS}"
    df.observe(seen, *_content(df)).write.parquet(f"{parts}/{key}/{own}")
    written = seen.get
    real = _key(df, written)
    if real != key:
        fs, source = _files(spark, f"{parts}/{key}/{own}")
        _, target = _files(spark, f"{parts}/{real}/{own}")
        fs.mkdirs(target.getParent())
        fs.rename(source, target)
    return f"{real}/{own}", written["rows"]


def save_snapshot(
    spark: SparkSession, root: str, name: str, datasets: Mapping[str, DataFrame],
    views: Mapping[str, DataFrame] | None = None, settings: Mapping | None = None,
) -> DataFrame:
    """Store datasets and pinned views; equal tables are written once for all snapshots of the root.

    Every save is a generation of its own. Its manifest is written last and the
    newest one counts, so at any moment either the old or the new snapshot is
    whole; after that, tables which only the older generations used are deleted.
    Should another session delete a reused table meanwhile, it is written again.
    """
    folder = _folder(root, name)
    views = dict(views or {})
    for _ in range(_SAVE_ATTEMPTS):
        stamp = datetime.now(timezone.utc)
        generation = stamp.strftime("%Y%m%dT%H%M%S%f")
        read: dict[int, str] = {}
        tables: dict[str, dict] = {}
        for df in [*datasets.values(), *views.values()]:
            if id(df) in read:
                continue
            part, rows = _store(spark, root, df)
            key = read[id(df)] = next((k for k, t in tables.items() if t["part"] == part), f"t{len(tables)}")
            tables[key] = {"columns": df.columns, "rows": rows, "part": part}
        manifest = {
            "name": name, "saved_at": stamp.strftime("%Y-%m-%dT%H:%M:%S.%f"), "version": VERSION, "tables": tables,
            "datasets": [{"name": n, "table": read[id(d)]} for n, d in datasets.items()],
            "views": [{"name": n, "table": read[id(d)]} for n, d in views.items()],
            "settings": json.dumps(dict(settings or {})),
        }
        line = spark.createDataFrame([(json.dumps(manifest),)], "value string")
        line.coalesce(1).write.text(f"{folder}/manifest/{generation}")
        if all(_stored(spark, root, t["part"]) for t in tables.values()):
            break
    else:
        raise RuntimeError("tables of this snapshot are deleted by others as fast as they are stored")
    _drop_older(spark, root, name, generation)
    return list_snapshots(spark, root).filter(F.col("name") == name)


def _parts_of(spark: SparkSession, pattern: str) -> DataFrame:
    """(part): the shared tables that manifests refer to."""
    fs, path = _files(spark, pattern)
    if not fs.globStatus(path):
        return spark.createDataFrame([], "part string")
    read = spark.read.text(pattern).select(F.from_json("value", MANIFEST_SCHEMA).alias("m"))
    return read.select(F.explode(F.map_values("m.tables")).alias("t")).select("t.part").filter("part is not null").distinct()


def _drop_parts(spark: SparkSession, root: str, candidates: Sequence[Row]) -> None:
    """Delete those of the tables that no manifest of the root refers to; all others are left alone."""
    if not candidates:
        return
    listed = spark.createDataFrame(candidates, "part string")
    free = listed.join(_parts_of(spark, f"{root.rstrip('/')}/*/manifest/*"), "part", "left_anti").collect()
    for row in free:
        fs, path = _files(spark, f"{root.rstrip('/')}/{_PARTS}/{row['part']}")
        fs.delete(path, True)
        siblings = fs.listStatus(path.getParent())
        if not siblings:
            fs.delete(path.getParent(), False)


def _drop_older(spark: SparkSession, root: str, name: str, generation: str) -> None:
    """Delete the manifests of the generations before, then the tables only they used."""
    folder = _folder(root, name)
    before = _parts_of(spark, f"{folder}/manifest/*").collect()
    fs, path = _files(spark, f"{folder}/manifest")
    for status in fs.listStatus(path):
        if status.getPath().getName() < generation:
            fs.delete(status.getPath(), True)
    _drop_parts(spark, root, before)


def _manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """The newest manifest of every name."""
    read = spark.read.text(pattern).select(F.from_json("value", MANIFEST_SCHEMA).alias("m"))
    return read.groupBy("m.name").agg(F.max_by("m", F.col("m.saved_at")).alias("m")).select("m.*")


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Saved snapshots, newest first, with their total rows."""
    fs, path = _files(spark, f"{root.rstrip('/')}/*/manifest/*")
    if not fs.globStatus(path):
        return spark.createDataFrame([], "name string, saved_at string, version double, n_tables int, total_rows bigint")
    sizes = F.transform(F.map_values("tables"), lambda t: t["rows"])
    return (
        _manifests(spark, f"{root.rstrip('/')}/*/manifest/*")
        .select("name", "saved_at", "version", F.size("tables").alias("n_tables"),
                F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, r: a + r).alias("total_rows"))
        .orderBy(F.desc("saved_at"))
    )


def problems(manifest: Mapping | None) -> list[str]:
    """Why a manifest cannot be applied; empty when it can."""
    if not isinstance(manifest, Mapping):
        return ["not a snapshot: expected an object"]
    version = manifest.get("version")
    if isinstance(version, bool) or not isinstance(version, (int, float)) or version != version:
        return ["not a snapshot: no version number"]
    if version > VERSION:
        return [f"saved by a newer version ({version}, this one reads {VERSION})"]
    tables = {} if manifest.get("tables") is None else manifest["tables"]
    if not isinstance(tables, Mapping):
        return ["the tables section is not an object"]
    found = [f"table {k} is not well formed" for k, t in tables.items() if not _is_table(t)]
    for section in ("datasets", "views"):
        entries = [] if manifest.get(section) is None else manifest[section]
        if not isinstance(entries, Sequence) or isinstance(entries, str):
            found.append(f"the {section} section is not a list")
            continue
        for i, entry in enumerate(entries):
            if not isinstance(entry, Mapping):
                found.append(f"{section} entry {i + 1} is not an object")
            elif entry.get("table") not in tables:
                found.append(f"{section} entry {entry.get('name') or i + 1} refers to a missing table")
    return found


def _is_table(entry) -> bool:
    return (
        isinstance(entry, Mapping) and isinstance(entry.get("columns"), Sequence)
        and all(isinstance(c, str) for c in entry["columns"])
        and isinstance(entry.get("rows"), int) and entry["rows"] >= 0
        and (entry.get("part") is None or isinstance(entry["part"], str))
    )


def read_manifest(spark: SparkSession, root: str, name: str) -> dict:
    # generations are named by their time
    text = spark.read.text(f"{_folder(root, name)}/manifest/*").orderBy(F.desc("_metadata.file_path")).select("value").first()
    try:
        return json.loads(text["value"])
    except (TypeError, ValueError) as error:
        raise ValueError("the manifest is not valid JSON") from error


def load_snapshot(spark: SparkSession, root: str, name: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict]:
    """Datasets, views and settings; nothing is returned unless all of it is sound."""
    manifest = read_manifest(spark, root, name)
    found = problems(manifest)
    if found:
        raise ValueError("; ".join(found))
    folder = _folder(root, name)
    tables = {}
    for key, entry in manifest["tables"].items():
        part = entry.get("part")  # older snapshots keep their tables in their own folder
        tables[key] = spark.read.parquet(f"{folder}/{key}" if part is None else f"{root.rstrip('/')}/{_PARTS}/{part}")
        if tables[key].columns != list(entry["columns"]):
            raise ValueError(f"table {key} does not have the columns the manifest lists")
    pick = lambda section: {e["name"]: tables[e["table"]] for e in manifest.get(section) or []}
    return pick("datasets"), pick("views"), json.loads(manifest.get("settings") or "{}")


def delete_snapshot(spark: SparkSession, root: str, name: str) -> bool:
    """Delete a snapshot and those of its tables that no other snapshot uses."""
    used = _parts_of(spark, f"{_folder(root, name)}/manifest/*").collect()
    fs, path = _files(spark, _folder(root, name))
    gone = bool(fs.delete(path, True))
    _drop_parts(spark, root, used)
    return gone


def copy_snapshot(spark: SparkSession, root: str, name: str, other_root: str) -> DataFrame:
    """Export to, or import from, another root; the copy is validated on the way."""
    datasets, views, settings = load_snapshot(spark, root, name)
    return save_snapshot(spark, other_root, name, datasets, views, settings)
