"""A collection of rows by id that is added to, updated and deleted from, a version at a time.

Rows lie in buckets by a hash of their id. A change reads the buckets of its ids only, writes these anew, and then a
manifest: which version of each bucket belongs to the new one. Buckets that no id of the change falls into keep their files. A manifest is put
in its place by a rename, so a reader, or whoever comes after a crash, sees the old version whole or the new one. Of two writers of
one version the second fails (``Conflict``) and may try again on the first one's.

Layout: ``data/<version>-<token>/bucket=<n>/*.parquet``, ``versions/<version>.json``. The driver holds one manifest, an entry for each bucket;
the number of buckets is fixed when the collection is made, and says how much one change of a row writes.

Cases: rows or ids that are null are refused, as nothing could address them; of rows repeated under one id within a change, or within a new
collection, the one with the least hash of its other columns is taken; a change without rows, or without effect, is a version whose buckets are the
old ones; columns are those of the collection (missing ones null, others refused); any type can be an id that Spark can hash; columns may have any name but ``bucket``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.sources.store import Folder


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Collection:
    """The collection in ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._folder = spark, path.rstrip("/"), Folder(spark, path)
        if not self.versions():
            raise FileNotFoundError(f"no collection in {path}")

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 64) -> Collection:
        """Makes a collection of ``rows`` as its version 0."""
        if "bucket" in rows.columns:
            raise ValueError("a column can't be named bucket")
        folder = Folder(rows.sparkSession, path)
        manifest = {"key": key, "count": buckets, "schema": json.loads(rows.schema.json()), "buckets": {}}
        _written(folder, 0, _one(_checked(rows, key), key), manifest, None)
        return cls(rows.sparkSession, path)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._folder.names("versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        return json.loads(self._folder.read(f"versions/{version}.json")) | {"version": version}

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, of the last version or another one."""
        found = self.manifest(version)
        return self._rows(found, list(found["buckets"].items()))

    def get(self, ids: DataFrame) -> DataFrame:
        """The rows with these ids, from their buckets alone."""
        found = self.manifest()
        key = found["key"]
        asked = ids.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).distinct()
        touched = self._touched(asked.select(F.col("_key").alias(key)), found)
        rows = self._rows(found, touched)
        return rows.join(asked, F.col(key) == F.col("_key"), "left_semi")

    def add(self, rows: DataFrame) -> int:
        """Adds rows whose ids aren't there; others stay as they are. The new version's number."""
        return self._change(rows, lambda old, new: F.coalesce(old, new))

    def update(self, rows: DataFrame) -> int:
        """Puts rows in the place of those with their ids; ids that aren't there are left out."""
        return self._change(rows, lambda old, new: F.when(old.isNotNull(), F.coalesce(new, old)))

    def upsert(self, rows: DataFrame) -> int:
        """Puts rows in the place of those with their ids, and adds the others."""
        return self._change(rows, lambda old, new: F.coalesce(new, old))

    def delete(self, ids: DataFrame) -> int:
        """Takes out the rows with these ids."""
        return self._change(ids.select(self.manifest()["key"]), lambda old, new: F.when(new.isNull(), old))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Forgets all versions but the last ``keep``, and deletes data that no version left has, also what crashes left; which.

        Not while another writer is at work, whose data has no version yet.
        """
        stay = self.versions()[-keep:]
        for version in set(self.versions()) - set(stay):
            self._folder.delete(f"versions/{version}.json")
        used = {folder for v in stay for folder in self.manifest(v)["buckets"].values()}
        gone = [f"data/{batch}/{b}" for batch in self._folder.names("data") for b in self._folder.names(f"data/{batch}") if b.startswith("bucket=") and f"{batch}/{b}" not in used]
        for name in gone:
            self._folder.delete(name)
        for batch in self._folder.names("data"):
            if not any(n.startswith("bucket=") for n in self._folder.names(f"data/{batch}")):
                self._folder.delete(f"data/{batch}")
        return gone

    def _rows(self, manifest: dict, buckets: list[tuple[str, str]]) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        if not buckets:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{folder}" for _, folder in buckets))

    def _touched(self, ids: DataFrame, manifest: dict) -> list[tuple[str, str]]:
        """The buckets that these ids fall into and that have rows."""
        asked = {str(r[0]) for r in ids.select(_bucket(manifest)).distinct().collect()}
        return [(b, folder) for b, folder in manifest["buckets"].items() if b in asked]

    def _change(self, changes: DataFrame, keep: Callable[[Column, Column], Column]) -> int:
        found = self.manifest()
        key, schema = found["key"], T.StructType.fromJson(found["schema"])
        if more := set(changes.columns) - set(schema.names):
            raise ValueError(f"columns that the collection doesn't have: {sorted(more)}")
        changes = changes.select(*((F.col(f"`{f.name}`") if f.name in changes.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
        changes = _one(_checked(changes, key), key)
        whole = F.struct(*(F.col(f"`{n}`") for n in schema.names))
        new = changes.select(F.col(f"`{key}`").alias("_new_key"), whole.alias("_new"))
        touched = self._touched(changes, found)
        old = self._rows(found, touched).select(F.col(f"`{key}`").alias("_old_key"), whole.alias("_old"))
        both = old.join(new, F.col("_old_key") == F.col("_new_key"), "full_outer").select(keep(F.col("_old"), F.col("_new")).alias("_row"))
        return _written(self._folder, found["version"] + 1, both.where(F.col("_row").isNotNull()).select("_row.*"), found, [b for b, _ in touched])


def _bucket(manifest: dict) -> Column:
    return F.pmod(F.xxhash64(f"`{manifest['key']}`"), F.lit(manifest["count"])).cast("int").alias("bucket")


def _checked(rows: DataFrame, key: str) -> DataFrame:
    if not rows.where(F.col(f"`{key}`").isNull()).isEmpty():
        raise ValueError(f"rows without {key}")
    return rows


def _one(rows: DataFrame, key: str) -> DataFrame:
    """One row for each id."""
    rest = [F.col(f"`{c}`").cast("string") for c in rows.columns if c != key]
    order = F.xxhash64(*rest) if rest else F.lit(0)
    place = F.row_number().over(Window.partitionBy(f"`{key}`").orderBy(order, *rest))
    return rows.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def _written(folder: Folder, version: int, rows: DataFrame, manifest: dict, replaced: list[str] | None) -> int:
    """Writes ``rows`` in their buckets and the version's manifest, in which they stand for the buckets ``replaced``."""
    batch = f"{version}-{uuid.uuid4().hex[:12]}"
    rows.withColumn("bucket", _bucket(manifest)).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder.path}/data/{batch}")
    made = {n.removeprefix("bucket="): f"{batch}/{n}" for n in folder.names(f"data/{batch}") if n.startswith("bucket=")}
    buckets = {b: at for b, at in manifest["buckets"].items() if b not in (replaced or ())} | made
    content = {k: manifest[k] for k in ("key", "count", "schema")} | {"buckets": buckets}
    if not folder.create(f"versions/{version}.json", json.dumps(content)):
        folder.delete(f"data/{batch}")
        raise Conflict(f"version {version} is there already")
    return version
