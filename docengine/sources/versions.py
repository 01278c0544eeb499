"""Committed versions of tables: a version is a manifest, and only its rename makes it seen.

A write first puts its tables into folders of their own, then a manifest that names them into a temporary file, and renames that
to the version's number; a rename onto a number that is taken fails. So readers see whole versions, a killed write leaves
nothing but folders that no manifest names, and of two writers that began with the same version one is told. Each manifest
carries a ledger: the last step that each source has committed, by which a run that begins again knows what is done.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import delete_folder


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


class VersionedTables:
    """Tables under a folder of any file system that the session knows; changed together, version by version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, folder: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in system.listStatus(at)) if system.exists(at) else []

    def versions(self) -> list[int]:
        """Committed versions, the oldest first."""
        return [int(name[:-5]) for name in self._files("manifest") if name.endswith(".json") and name[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """A version's manifest, the last one's by default; version 0 is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "tables": {}, "ledger": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version:012d}.json", wholetext=True).first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as it was in a version; None where that has none."""
        t = self.manifest(version)["tables"].get(name)
        return None if t is None else self.spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{self.path}/data/{t['folder']}")

    def _write(self, df: DataFrame) -> dict[str, Any]:
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{folder}")
        return {"folder": folder, "schema": df.schema.jsonValue()}

    def _publish(self, manifest: Mapping[str, Any]) -> None:
        fs = self.spark._jvm.org.apache.hadoop.fs
        target = fs.Path(f"{self.path}/manifest/{manifest['version']:012d}.json")
        draft = fs.Path(f"{self.path}/draft/{uuid.uuid4().hex}")
        files = fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        system = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        system.mkdirs(target.getParent())
        out = system.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        try:
            files.rename(draft, target, self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} is taken") from e
            raise

    def commit(self, tables: Mapping[str, DataFrame], step: tuple[str, int | str] | None = None, base: int | None = None) -> int:
        """The next version: these tables anew, others as they were. Returns its number.

        step names a source and what of it is done now, for the ledger. base is the version that the tables were made from (the last
        one by default); if it isn't the last one any more, there is a Conflict and nothing changes.
        """
        last = self.manifest() if base is None else self.manifest(base)
        written = {name: self._write(df) for name, df in tables.items()}
        ledger = last["ledger"] | ({step[0]: step[1]} if step else {})
        self._publish({"version": last["version"] + 1, "tables": last["tables"] | written, "ledger": ledger})
        return last["version"] + 1

    def done(self, source: str) -> int | str | None:
        """What of a source was committed last."""
        return self.manifest()["ledger"].get(source)

    def rollback(self, version: int) -> int:
        """A new version with the tables and the ledger of an earlier one, so that what came after it is done again."""
        old, last = self.manifest(version), self.manifest()
        self._publish(old | {"version": last["version"] + 1})
        return last["version"] + 1

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the last `keep` versions (1 at least), and folders that none of these names. Returns the folders; run it while nobody writes."""
        kept = self.versions()[-max(keep, 1) :]
        named = {t["folder"] for v in kept for t in self.manifest(v)["tables"].values()}
        gone = [f for f in self._files("data") if f not in named]
        for v in self.versions():
            if v not in kept:
                delete_folder(self.spark, f"{self.path}/manifest/{v:012d}.json")
        for folder in gone:
            delete_folder(self.spark, f"{self.path}/data/{folder}")
        delete_folder(self.spark, f"{self.path}/draft")
        return gone
