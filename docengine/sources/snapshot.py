"""Sinks and sources of whole corpora: snapshots with a manifest, exports for browsers, files of Markdown or JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import body_preview

SCHEMA_VERSION = 27
#: Tables of the running system, which a snapshot has empty.
OPERATIONAL = ("crawl_state", "update_log", "activity", "sync_checkpoint")


#: Frameworks whose table is broadcast.
FRAMEWORKS = 20_000


def _fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows, and a hash of them that doesn't depend on their order."""
    n, a, b = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64(F.lit(1), *df.columns)), F.lit(0))).first()
    return n, f"{a}:{b}"


def write_snapshot(tables: dict[str, DataFrame], path: str, tag: str, tier: str = "standard") -> None:
    """Writes tables as Parquet (zstd) with a manifest of counts and hashes; operational tables are written empty."""
    spark = next(iter(tables.values())).sparkSession
    manifest = {"tag": tag, "tier": tier, "schema_version": SCHEMA_VERSION, "tables": {}}
    for name, df in tables.items():
        df = df.limit(0) if name in OPERATIONAL else df
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        n, digest = _fingerprint(spark.read.parquet(f"{path}/{name}"))
        manifest["tables"][name] = {"rows": n, "hash": digest}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The snapshot's tables, after a check of its version, counts and hashes."""
    manifest = read_manifest(spark, path)
    if manifest["schema_version"] > SCHEMA_VERSION:
        raise ValueError(f"the snapshot has schema {manifest['schema_version']}, newer than {SCHEMA_VERSION}")
    out = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
    for name, df in out.items():
        if list(_fingerprint(df)) != [manifest["tables"][name]["rows"], manifest["tables"][name]["hash"]]:
            raise ValueError(f"the snapshot's table {name} isn't what its manifest says")
    return out


def title_index(docs: DataFrame) -> DataFrame:
    """One row per document in order of keys: what a browser's title search holds, frameworks as numbers."""
    from pyspark.sql import Window

    frameworks = docs.where("framework is not null").select("framework").distinct()
    numbered = frameworks.withColumn("fw_index", F.row_number().over(Window.orderBy("framework")) - 1)
    small = frameworks.limit(FRAMEWORKS + 1).count() <= FRAMEWORKS  # names of roots: thousands at most, but that is checked
    rows = docs.join(F.broadcast(numbered) if small else numbered, "framework", "left")
    return rows.select("key", "title", F.substring(F.coalesce("abstract", F.lit("")), 1, 80).alias("abstract"), F.coalesce("fw_index", F.lit(-1)).alias("fw_index"), F.coalesce("doc_kind", F.lit("")).alias("kind"), F.coalesce("role_heading", F.lit("")).alias("role_heading"))


def write_body_shards(docs: DataFrame, sections: DataFrame, path: str) -> DataFrame:
    """Writes body previews by letter; gives (letter, hash, n), the manifest."""
    rows = body_preview(docs, sections)
    rows.select("letter", "key", "preview").write.mode("overwrite").partitionBy("letter").json(path)
    return rows.groupBy("letter").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key", "preview")).alias("_h")).select("letter", F.substring(F.sha2(F.hex("_h"), 256), 1, 10).alias("hash"), "n")


def materialize(rows: DataFrame, path: str, column: str, roots: list[str] | None = None) -> None:
    """Writes (key, column) as text, a folder for each root."""
    rows = rows.withColumn("root", F.substring_index("key", "/", 1))
    if roots:
        rows = rows.where(F.col("root").isin(*roots))
    rows.select("root", F.to_json(F.struct("key", column)).alias("value")).write.mode("overwrite").partitionBy("root").text(path)


def sitemap(docs: DataFrame, base: str, most: int = 50_000) -> DataFrame:
    """(file, loc, lastmod) of all documents, `most` to a file. Files are numbered by the root and the place in it.

    lastmod is the day of the column updated_at, null where docs has none.
    """
    from pyspark.sql import Window

    from ..functions.urls import safe_key

    w = Window.partitionBy("_root").orderBy("key")
    rows = docs.withColumn("_root", F.substring_index("key", "/", 1)).withColumn("_i", F.row_number().over(w) - 1)
    name = F.concat(F.lit("sitemap-"), "_root", F.lit("-"), F.floor(F.col("_i") / most).cast("string"), F.lit(".xml"))
    lastmod = F.date_format("updated_at", "yyyy-MM-dd") if "updated_at" in docs.columns else F.lit(None).cast("string")
    return rows.select(name.alias("file"), F.concat(F.lit(f"{base}/docs/"), safe_key(F.col("key")), F.lit("/")).alias("loc"), lastmod.alias("lastmod"))
