"""Sessions, and sending this package to Python workers."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Applications whose workers have this package.
_SHIPPED: set[str] = set()


def session(master: str = "local[*]", partitions: int = 8, **config: str) -> SparkSession:
    """A session with what the engine relies on: adaptive plans, UTC, Arrow."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false", "spark.sql.parquet.compression.codec": "zstd",
    } | config
    builder = SparkSession.builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def archive() -> Path:
    """A zip of this package in a fresh folder: equal sources give equal bytes and an equal name."""
    top = Path(__file__).resolve().parent
    files = sorted((path.relative_to(top.parent).as_posix(), path.read_bytes()) for path in top.rglob("*.py"))
    mark = hashlib.sha256(b"".join(name.encode() + b"\0" + body + b"\0" for name, body in files)).hexdigest()[:12]
    out = Path(tempfile.mkdtemp(prefix="docengine-")) / f"{top.name}-{mark}.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files:
            z.writestr(zipfile.ZipInfo(name), body)
    return out


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, whoever asks for it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        context.addPyFile(str(archive()))
        _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one where none is named and all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="docengine-"))
    return context.getCheckpointDir()


def durable(df: DataFrame, **options: str) -> DataFrame:
    """df as a table written to the shared folder, with a writer's options: computed once, and no lost executor makes it run again."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that the session knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what `durable` wrote, once nothing needs it any more."""
    for df in tables:
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            delete_folder(df.sparkSession, path)
