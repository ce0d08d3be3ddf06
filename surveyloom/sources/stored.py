"""Tables in a shared folder: written rounds of a loop, and a store whose tables change together."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints; a temporary one only where none is set and Spark is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="surveyloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def written(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: plans of loops stay flat, and nothing before it runs again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Remove the tables of ``written`` that a table reads, once nothing needs it any more."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession).rstrip("/")
    inside = re.compile(re.escape(folder.rpartition(":")[2].lstrip("/")) + r"/(table-[0-9a-f]{32})/")
    for name in sorted({m[1] for f in df.inputFiles() if (m := inside.search(f))}):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Store:
    """Named tables in a folder, replaced together as one version.

    A version is a manifest that names a path for each table.  New tables are written first;
    the manifest appears last, by one rename that fails if the version exists already.  So
    readers see all of a change or none, and a change that breaks off leaves the old version.
    Tables that a change doesn't name keep their path.  The log of versions is the audit
    trail: each manifest holds the note of its change.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{self.folder}/versions"))

    def versions(self) -> list[int]:
        found = self._files.listStatus(self._path(f"{self.folder}/versions"))
        names = [s.getPath().getName() for s in found]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Tables and note of a version; of the newest one unless said otherwise."""
        known = self.versions()
        if not known:
            return {"version": 0, "tables": {}, "note": {}}
        version = known[-1] if version is None else version
        stream = self._files.open(self._path(f"{self.folder}/versions/v{version:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        entry = self.manifest(version)["tables"].get(name)
        if entry is None:
            raise KeyError(name)
        return self.spark.read.schema(entry["schema"]).parquet(f"{self.folder}/{entry['path']}")

    def replace(self, tables: dict[str, DataFrame], note: dict | None = None) -> int:
        """Write new tables, then make them the newest version; returns its number.

        Raises FileExistsError if another change came first, and then changes nothing.
        """
        before = self.manifest()
        entries = dict(before["tables"])
        for name, df in tables.items():
            path = f"data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{path}")
            entries[name] = {"path": path, "schema": ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)}
        version = before["version"] + 1
        draft = self._path(f"{self.folder}/versions/.draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps({"version": version, "tables": entries, "note": note or {}}).encode()))
        stream.close()
        final = self._path(f"{self.folder}/versions/v{version:09d}.json")
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise FileExistsError(f"version {version} exists already")
        return version
