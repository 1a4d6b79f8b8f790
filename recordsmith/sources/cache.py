"""A cache of rows by key in a folder, committed whole: data under a new name first, then a manifest that names it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DIGEST = "_digest"


class Cache:
    """Readers take the newest manifest that can be read and whose data is all there; so a writer that ends midway changes nothing.

    ``version`` is the schema's: data written under another one is not read.  Each row carries a digest of its values; a row
    that does not match it counts as absent, and so is worked out again.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, version: str, keep: int = 2):
        self.spark, self.folder, self.key, self.version, self.keep = spark, folder.rstrip("/"), key, version, keep
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(context._jsc.hadoopConfiguration())

    @staticmethod
    def _digest(columns: list[str]) -> Column:
        return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"}))

    def _manifests(self) -> list[str]:
        """Names, newest first."""
        at = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(at):
            return []
        return sorted((s.getPath().getName() for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json")), reverse=True)

    def _read(self, name: str) -> dict | None:
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{name}"))
        try:
            said = json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()
        whole = isinstance(said, dict) and {"version", "data", "schema"} <= set(said) and self._fs.exists(self._path(f"{self.folder}/{said['data']}/_SUCCESS"))
        return said if whole else None

    def manifest(self) -> dict | None:
        """The newest whole manifest of this version."""
        return next((m for m in map(self._read, self._manifests()) if m and m["version"] == self.version), None)

    def rows(self) -> DataFrame | None:
        """The rows that match their digests; null before the first commit."""
        said = self.manifest()
        if said is None:
            return None
        data = self.spark.read.schema(said["schema"]).parquet(f"{self.folder}/{said['data']}")
        own = [c for c in data.columns if c != _DIGEST]
        return data.where(F.col(_DIGEST) == self._digest(own)).select(*[F.col(f"`{c}`") for c in own])

    def stage(self, rows: DataFrame) -> str:
        """Write data that no manifest names yet; its name."""
        name = f"data-{uuid.uuid4().hex}"
        rows.withColumn(_DIGEST, self._digest(rows.columns)).write.parquet(f"{self.folder}/{name}")
        return name

    def commit(self, rows: DataFrame, data: str) -> None:
        """Put the manifest of staged data in its place by one rename; older data than ``keep`` commits goes."""
        names = self._manifests()
        number = int(names[0].split(".")[0]) + 1 if names else 1
        said = {"version": self.version, "data": data, "schema": ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", {_DIGEST} bigint"}
        new = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(said).encode()))
        stream.close()
        if not self._fs.rename(new, self._path(f"{self.folder}/manifests/{number:012d}.json")):
            raise OSError(f"manifest {number} was written by another")
        for name in self._manifests()[self.keep :]:
            old = self._read(name)
            self._fs.delete(self._path(f"{self.folder}/manifests/{name}"), False)
            if old and old["data"] != data:
                self._fs.delete(self._path(f"{self.folder}/{old['data']}"), True)

    def put(self, rows: DataFrame) -> None:
        self.commit(rows, self.stage(rows))

    def through(self, wanted: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(key, ...) -> the work's rows for every wanted key: cached ones as they are, the others worked out and kept with them."""
        have = self.rows()
        if have is None:
            self.put(work(wanted))
        else:
            missing = wanted.join(have.select(self.key).distinct(), self.key, "left_anti")
            if not missing.isEmpty():
                self.put(have.unionByName(work(missing)))
        return self.rows().join(wanted.select(self.key).distinct(), self.key, "left_semi")
