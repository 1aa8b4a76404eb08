"""Versioned Parquet datasets, each version sealed by a manifest that is written last.

Layout under ``root/<dataset>/``: ``data/<id>/`` holds the files of one version and
``manifests/v000001.json`` makes it visible. The current version is the highest manifest.
All file access goes through Hadoop's file system, so any store Spark can write to works.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, types as T

from sparkbi.functions.columns import clean_nan
from sparkbi.functions.hashing import fingerprint_columns, fingerprint_text
from sparkbi.operators.profile import profile
from sparkbi.operators.query import Filter, apply_filters
from sparkbi.operators.recipe import Step, build_recipe
from sparkbi.sources.clustering import clustered, file_ranges, files_for

DATASET_NAME = re.compile(r"[\w][\w .\-]*")
MANIFEST_NAME = re.compile(r"v(\d{6})\.json")
SYNC_RECIPE = "source synchronization"


class Store:
    """The few file operations publishing needs."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._files = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def sizes(self, folder: str) -> dict[str, int]:
        if not self._files.exists(self.path(folder)):
            return {}
        return {item.getPath().getName(): item.getLen() for item in self._files.listStatus(self.path(folder))}

    def claim(self, text: str) -> bool:
        """Create an empty marker; false when somebody else already holds it."""
        self._files.mkdirs(self.path(text).getParent())
        try:
            return bool(self._files.createNewFile(self.path(text)))
        except Exception:  # the store reports an existing file as an error
            if self._files.exists(self.path(text)):
                return False
            raise

    def write(self, text: str, content: str) -> None:
        """Write beside the target, then rename, so readers never see half a file."""
        beside = self.path(text + ".tmp")
        stream = self._files.create(beside, True)
        stream.write(bytearray(content.encode("utf-8")))
        stream.close()
        if not self._files.rename(beside, self.path(text)):
            raise OSError(f"could not move {text} into place")

    def remove(self, folder: str) -> None:
        self._files.delete(self.path(folder), True)

    def read(self, text: str) -> str:
        stream = self._files.open(self.path(text))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()


def _folder(root: str, dataset: str) -> str:
    if not DATASET_NAME.fullmatch(dataset):
        raise ValueError(f"not a dataset name: {dataset!r}")
    return f"{root.rstrip('/')}/{dataset}"


def _versions(store: Store, folder: str) -> list[int]:
    found = (MANIFEST_NAME.fullmatch(name) for name in store.sizes(f"{folder}/manifests"))
    return sorted(int(match.group(1)) for match in found if match)


def fingerprint(df: DataFrame) -> str:
    """Content hash of a frame: column names and rows, whatever the row order."""
    row = df.agg(*fingerprint_columns(df)).first()
    return fingerprint_text(df.columns, row["row_count"], row["hash_a"], row["hash_b"])


def _stage(spark: SparkSession, root: str, dataset: str, df: DataFrame, cluster_by: Sequence[str] = (), files: int | None = None) -> dict[str, Any]:
    """Write the files of a version without sealing it; row count and content hash come from the same pass.

    NaN becomes null here, so filters on published data reach the scan as they are.
    """
    df = clean_nan(df)
    if cluster_by:
        df = clustered(df, cluster_by, files)
    data_id = uuid.uuid4().hex
    seen = Observation(data_id)
    df.observe(seen, *fingerprint_columns(df)).write.option("compression", "zstd").parquet(f"{_folder(root, dataset)}/data/{data_id}")
    facts = seen.get
    return {
        "version_id": data_id,
        "row_count": facts["row_count"],
        "fingerprint": fingerprint_text(df.columns, facts["row_count"], facts["hash_a"], facts["hash_b"]),
        "schema": df.schema,
        "cluster_by": list(cluster_by),
    }


def _location(folder: str, data: str, item: dict[str, Any]) -> str:
    """Where a file of a manifest lies; one that an earlier version wrote names that version's data."""
    return f"{folder}/{item.get('data', data)}/{item['path']}"


def _seal(spark, root, dataset, staged, source_type, recipe_name, steps, with_profile) -> dict[str, Any]:
    folder = _folder(root, dataset)
    store = Store(spark, root)
    data = f"data/{staged['version_id']}"
    files = staged.get("files")
    if files is None:
        files = [{"path": name, "bytes": size} for name, size in sorted(store.sizes(f"{folder}/{data}").items()) if name.endswith(".parquet")]
    by = staged["cluster_by"]
    ranges = file_ranges(spark.read.schema(staged["schema"]).parquet(f"{folder}/{data}"), by) if by else {}
    paths = [_location(folder, data, item) for item in files]
    described = profile(spark.read.schema(staged["schema"]).parquet(*paths)).toJSON().collect() if with_profile and paths else []
    manifest = {
        "dataset": dataset,
        "source_type": source_type,
        "version_id": staged["version_id"],
        "created_at": datetime.now(UTC).isoformat(),
        "row_count": staged["row_count"],
        "column_count": len(staged["schema"].fields),
        "columns": json.loads(staged["schema"].json())["fields"],
        "fingerprint": staged["fingerprint"],
        "data": data,
        "files": [item | ({"ranges": ranges[item["path"]]} if item["path"] in ranges else {}) for item in files],
        "cluster_by": by,
        "profile": [json.loads(line) for line in described],
        "recipe": {"name": recipe_name, "steps": steps},
    } | staged.get("more", {})
    number = max(_versions(store, folder), default=0) + 1
    while not store.claim(f"{folder}/manifests/v{number:06d}.claim"):
        number += 1
    manifest["version_number"] = number
    store.write(f"{folder}/manifests/v{number:06d}.json", json.dumps(manifest, ensure_ascii=False, indent=2))
    return manifest


def _write(spark, root, dataset, df, source_type, recipe_name, steps, with_profile, cluster_by=(), files=None) -> dict[str, Any]:
    return _seal(spark, root, dataset, _stage(spark, root, dataset, df, cluster_by, files), source_type, recipe_name, steps, with_profile)


def publish(
    df: DataFrame, root: str, dataset: str, source_type: str = "upload", with_profile: bool = True, cluster_by: Sequence[str] = (), files: int | None = None
) -> dict[str, Any]:
    """Publish ``df`` as version 1 of a new dataset and return its manifest.

    With ``cluster_by`` rows are placed so that every file covers small ranges of these columns, and the
    manifest keeps the ranges, by which ``read_current`` leaves files out.
    """
    spark = df.sparkSession
    if _versions(Store(spark, root), _folder(root, dataset)):
        raise ValueError(f"dataset exists already: {dataset}")
    return _write(spark, root, dataset, df, source_type, None, [], with_profile, cluster_by, files)


def publish_version(
    df: DataFrame,
    root: str,
    dataset: str,
    recipe_name: str,
    steps: Sequence[dict] = (),
    with_profile: bool = True,
    cluster_by: Sequence[str] | None = None,
    files: int | None = None,
) -> dict[str, Any]:
    """Publish ``df`` as the next version, keeping the recipe that made it, clustered as the version before unless told otherwise."""
    spark = df.sparkSession
    before = manifest(spark, root, dataset)
    if cluster_by is None:
        cluster_by = [name for name in before.get("cluster_by", []) if name in df.columns]
    return _write(spark, root, dataset, df, before["source_type"], recipe_name, list(steps), with_profile, cluster_by, files)


def manifest(spark: SparkSession, root: str, dataset: str, version: int | None = None) -> dict[str, Any]:
    """The manifest of one version, the current one by default."""
    folder, store = _folder(root, dataset), Store(spark, root)
    numbers = _versions(store, folder)
    if not numbers or (version is not None and version not in numbers):
        raise KeyError(dataset)
    return json.loads(store.read(f"{folder}/manifests/v{version or numbers[-1]:06d}.json"))


def read_current(spark: SparkSession, root: str, dataset: str, version: int | None = None, filters: Sequence[Filter] = ()) -> DataFrame:
    """A published version, refusing when a file its manifest lists is missing.

    ``filters`` are applied; in a clustered version, files whose ranges rule out any match are not opened.
    """
    sealed = manifest(spark, root, dataset, version)
    folder, store = _folder(root, dataset), Store(spark, root)
    at = {item["path"]: _location(folder, sealed["data"], item) for item in sealed["files"]}
    listed = {parent: store.sizes(parent) for parent in {path.rpartition("/")[0] for path in at.values()}}
    present = {path: listed[place.rpartition("/")[0]].get(place.rpartition("/")[2]) for path, place in at.items()}
    lost = [path for path, size in present.items() if size is None]
    if lost:
        raise FileNotFoundError(f"published files are missing: {', '.join(lost[:5])}")
    short = [item["path"] for item in sealed["files"] if present[item["path"]] != item["bytes"]]
    if short:
        raise OSError(f"published files have changed: {', '.join(short[:5])}")
    schema = T.StructType.fromJson({"type": "struct", "fields": sealed["columns"]})
    # Only what the manifest lists: a file that somebody left in the folder is no part of the version.
    wanted = files_for(spark, schema, sealed["files"], filters) if filters else [item["path"] for item in sealed["files"]]
    rows = spark.read.schema(schema).parquet(*[at[name] for name in wanted]) if wanted else spark.createDataFrame([], schema)
    return apply_filters(rows, filters)


def sync_named(df: DataFrame, root: str, dataset: str, source_type: str, with_profile: bool = True) -> dict[str, Any]:
    """Publish only when the content differs from the current version.

    The frame is evaluated once: its files are written first, sealed if their fingerprint is new
    and removed if it is not.
    """
    spark = df.sparkSession
    try:
        current = manifest(spark, root, dataset)
    except KeyError:
        return publish(df, root, dataset, source_type, with_profile)
    staged = _stage(spark, root, dataset, df, [name for name in current.get("cluster_by", []) if name in df.columns])
    if current["fingerprint"] == staged["fingerprint"]:
        Store(spark, root).remove(f"{_folder(root, dataset)}/data/{staged['version_id']}")
        return current
    return _seal(spark, root, dataset, staged, current["source_type"], SYNC_RECIPE, [], with_profile)


def run_recipe(
    spark: SparkSession, root: str, dataset: str, name: str, steps: Sequence[Step], order_by: Sequence[str] | None = None
) -> dict[str, Any]:
    """Apply a recipe to the current version and publish the result as the next one.

    Join steps name other datasets under the same root.
    """
    lookup: Callable[[str], DataFrame] = lambda other: read_current(spark, root, other)
    made = build_recipe(read_current(spark, root, dataset), steps, order_by, lookup)
    return publish_version(made, root, dataset, name, [{"operation": s.operation, "config": s.config} for s in steps])
