"""A keyed table kept as bucketed base files and change files, published by manifests.

Layout under ``path``::

    segments/<id>/_bucket=<b>/part-*.parquet   rows of one commit or compaction, with
                                               ``_version`` and ``_deleted`` (tombstone)
    _manifest/<version>.json                   the segments that make up a version

A commit writes only its own rows, into the buckets of their keys, so a batch that
touches one bucket writes one bucket. The new version exists once its manifest does:
the manifest is written under a temporary name and renamed, and readers list the
manifests, so a commit that stops halfway leaves the versions before it whole, and its
files are never read. Reading merges the segments of a version per key, the newest
version winning, and leaves out deleted keys; reading some keys prunes to their buckets.
Compaction rewrites the merged rows as one segment and drops the tombstones.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


class KeyedStore:
    """Rows keyed by ``key`` columns; ``order`` columns decide between rows of one key in one commit.

    Rows are dealt to buckets by ``bucket_by`` (default the key), columns that are equal for
    all rows of a key, such as the host of a page's URL.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        key: list[str],
        order: list[str],
        buckets: int = BUCKETS,
        bucket_by: list[str] | None = None,
    ):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self.bucket_by = bucket_by or key

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    # --- manifests

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        fs, jvm = _fs(self.spark, self.path)
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        versions = self.versions()
        if not versions:
            return {"version": 0, "segments": [], "schema": None}
        version = versions[-1] if version is None else version
        fs, jvm = _fs(self.spark, self.path)
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest/{version}.json"))
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        fs, jvm = _fs(self.spark, self.path)
        Path = jvm.org.apache.hadoop.fs.Path
        final = Path(f"{self.path}/_manifest/{manifest['version']}.json")
        temporary = Path(f"{self.path}/_manifest/.{manifest['version']}-{uuid.uuid4().hex}.tmp")
        out = fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode("utf-8")))
        finally:
            out.close()
        if not fs.rename(temporary, final):
            raise RuntimeError(f"version {manifest['version']} of {self.path} was committed by another writer")

    # --- writes

    def _segment(self, rows: DataFrame, version: int) -> tuple[str, list[int]]:
        """Write ``rows`` as a new segment; returns its id and the buckets it holds."""
        segment = f"{version}-{uuid.uuid4().hex}"
        bucketed = rows.withColumn("_version", F.lit(version)).withColumn("_bucket", self.bucket())
        bucketed.write.partitionBy("_bucket").parquet(f"{self.path}/segments/{segment}")
        written = self.spark.read.parquet(f"{self.path}/segments/{segment}")
        # One row per bucket at most: bounded by ``buckets``.
        buckets = sorted(r[0] for r in written.select("_bucket").distinct().collect())
        return segment, buckets

    def _latest_per_key(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c not in self.key]
        return rows.groupBy(*self.key).agg(
            F.max_by(F.struct(*columns), F.struct(*self.order)).alias("_r")
        ).select(*self.key, "_r.*")

    def commit(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """Put ``upserts`` (per key the greatest ``order`` wins) and delete the keys of
        ``deletes``; a key both put and deleted in one commit is deleted. Returns the version."""
        before = self.manifest()
        version = before["version"] + 1
        parts = []
        if upserts is not None:
            parts.append(self._latest_per_key(upserts).withColumn("_deleted", F.lit(False)))
        if deletes is not None:
            schema = upserts.schema if upserts is not None else self._schema(before)
            gone = deletes.select(*dict.fromkeys(self.key + self.bucket_by)).distinct().withColumn("_deleted", F.lit(True))
            for field in schema.fields:
                if field.name not in self.key and field.name not in gone.columns:
                    gone = gone.withColumn(field.name, F.lit(None).cast(field.dataType))
            parts.append(gone)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows = rows.groupBy(*self.key).agg(
            F.max_by(F.struct(*[c for c in rows.columns if c not in self.key]), F.col("_deleted")).alias("_r")
        ).select(*self.key, "_r.*")
        segment, buckets = self._segment(rows, version)
        schema = before["schema"] or rows.drop("_deleted").schema.json()
        self._publish(
            {"version": version, "schema": schema, "segments": before["segments"] + [{"id": segment, "buckets": buckets}]}
        )
        return version

    def _schema(self, manifest: dict) -> StructType:
        return StructType.fromJson(json.loads(manifest["schema"]))

    # --- reads

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The rows of ``version`` (default the latest): per key the row of the newest
        commit, deleted keys left out. With ``keys`` (the ``bucket_by`` columns) only rows
        with those values are returned, and only their buckets are read."""
        manifest = self.manifest(version)
        if not manifest["segments"]:
            raise FileNotFoundError(f"no version of {self.path}")
        schema = self._schema(manifest)
        wanted = None
        if keys is not None:
            wanted = sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())
        paths = []
        for segment in manifest["segments"]:
            held = segment["buckets"] if wanted is None else sorted(set(segment["buckets"]) & set(wanted))
            paths += [f"{self.path}/segments/{segment['id']}/_bucket={b}" for b in held]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema.add("_version", IntegerType()).add("_deleted", BooleanType())).parquet(*paths)
        rest = [c for c in rows.columns if c not in self.key]
        merged = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.col("_version")).alias("_r")).select(
            *self.key, "_r.*"
        )
        out = merged.filter(~F.col("_deleted")).drop("_deleted", "_version")
        if keys is not None:
            out = out.join(keys.select(*self.bucket_by).distinct(), self.bucket_by, "left_semi")
        return out

    def compact(self) -> int:
        """Rewrite the latest version as one segment without tombstones; returns its version."""
        before = self.manifest()
        latest = self.read()
        version = before["version"] + 1
        segment, buckets = self._segment(latest.withColumn("_deleted", F.lit(False)), version)
        self._publish({"version": version, "schema": before["schema"], "segments": [{"id": segment, "buckets": buckets}]})
        return version


class Published:
    """Tables that change together, published as one version.

    Each version writes its tables under ``versions/<id>/<name>`` and then a manifest that
    names them; readers take the newest manifest. A writer that stops between the tables,
    or before the manifest, leaves the version before whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.store = KeyedStore(spark, path, [], [])
        self.spark, self.path = spark, path.rstrip("/")

    def publish(self, tables: dict[str, DataFrame]) -> int:
        version = (self.store.versions() or [0])[-1] + 1
        folder = f"{self.path}/versions/{version}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        schemas = {name: df.schema.json() for name, df in tables.items()}
        self.store._publish({"version": version, "folder": folder, "schemas": schemas})
        return version

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        manifest = self.store.manifest(version)
        if "folder" not in manifest:
            raise FileNotFoundError(f"nothing published in {self.path}")
        return {
            name: self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{manifest['folder']}/{name}")
            for name, schema in manifest["schemas"].items()
        }
