"""Page and Markdown stores with files of a chosen size (K2, K7).

One file per page, or a folder per site, gives millions of tiny files; one task per site gives a huge one. Here rows
lie in order of (site, path), and a file ends where ``target_bytes`` are full, whatever the sites: a huge site has many
files, small ones share one. A manifest names the files that count and the sites in each. Replacing sites rewrites the
files that hold them and nothing else; a new version of the manifest makes the change visible at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import checkpoint_dir

TARGET_BYTES = 128 << 20


def with_files(df: DataFrame, order: list[str], size: Column, target_bytes: int, first: int = 0) -> tuple[DataFrame, int]:
    """``df`` with ``file``: the number of the file of each row when rows in ``order`` fill files of ``target_bytes``; and the first number beyond.

    Rows are range-partitioned by ``order``; each part starts at the bytes of the parts before it (one number per part
    goes through the driver), so no task sees more than its part."""
    checkpoint_dir(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.withColumn("_size", F.coalesce(size, F.lit(0)).cast("bigint")).repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint()
    sums = {r.p: r.b for r in parts.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("_size").alias("b")).collect()}
    starts = np.cumsum([0, *(sums.get(p, 0) for p in range(max(sums, default=-1) + 1))]).tolist()

    def number(batches):
        at = starts[TaskContext.get().partitionId()] if sums else 0
        for batch in batches:
            sizes = batch.column("_size").to_numpy()
            begins = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            columns = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != "_size"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first + begins // target_bytes)], [*(f.name for f in batch.schema if f.name != "_size"), "file"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return parts.mapInArrow(number, f"{fields}, file bigint"), first + starts[-1] // target_bytes + 1


def _write(df: DataFrame, path: str, site: str, order: list[str], size: Column, target_bytes: int, first: int) -> DataFrame:
    """Append the rows as files; returns their (file, site, rows)."""
    numbered, end = with_files(df, [site, *order], size, target_bytes, first)
    numbered = numbered.checkpoint()  # read twice: for the files and for the manifest
    files = numbered.repartitionById(max(1, end - first), (F.col("file") - first).cast("int"))
    files.sortWithinPartitions("file", site, *order).write.mode("append").partitionBy("file").parquet(f"{path}/data")
    return numbered.groupBy("file", F.col(site).alias("site")).agg(F.count("*").alias("rows"))


def _publish(manifest: DataFrame, path: str, version: int) -> None:
    manifest.select("file", "site", "rows").write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def _manifest(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    versions = spark.read.schema("file bigint, site string, rows bigint, version int").parquet(f"{path}/manifest")
    last = versions.agg(F.max("version")).first()[0] or 0
    return versions.where(F.col("version") == last).drop("version"), last


def write_store(df: DataFrame, path: str, site: str, order: list[str], size: Column, target_bytes: int = TARGET_BYTES) -> None:
    """A new store at ``path`` (an empty or new folder). A NULL site is a site of its own."""
    _publish(_write(df, path, site, order, size, target_bytes, 0), path, 0)


def read_store(spark: SparkSession, path: str, sites: list[str] | None = None) -> DataFrame:
    """The rows of the store; with ``sites`` only the files that hold them are read, and only their rows returned."""
    manifest, _ = _manifest(spark, path)
    if sites is not None:
        manifest = manifest.where(F.col("site").isin(sites))
    live = manifest.select(F.col("file").alias("_file")).distinct()
    rows = spark.read.parquet(f"{path}/data")
    site = rows.columns[0]
    rows = rows.join(F.broadcast(live), F.col("file") == F.col("_file"), "left_semi").drop("file")
    return rows if sites is None else rows.where(F.col(site).isin(sites))


def replace_sites(df: DataFrame, path: str, site: str, order: list[str], size: Column, target_bytes: int = TARGET_BYTES) -> None:
    """Replace the sites that occur in ``df``: the files that hold them are written anew with their other sites' rows; all other
    files stay. The old files leave the manifest with the new version, so readers see all of the change or none."""
    spark = df.sparkSession
    manifest, version = _manifest(spark, path)
    manifest = manifest.checkpoint()
    changed = df.select(F.col(site).alias("site")).distinct()
    same = F.col("site").eqNullSafe(F.col("_changed"))
    hit = manifest.join(changed.withColumnRenamed("site", "_changed"), same, "left_semi").select(F.col("file").alias("_file")).distinct()
    old = spark.read.parquet(f"{path}/data").join(hit, F.col("file") == F.col("_file"), "left_semi").drop("file")
    others = old.join(changed.select(F.col("site").alias("_changed")), F.col(site).eqNullSafe(F.col("_changed")), "left_anti")
    first = (manifest.agg(F.max("file")).first()[0] or 0) + 1
    written = _write(others.unionByName(df.select(*others.columns)), path, site, order, size, target_bytes, first)
    kept = manifest.join(hit, F.col("file") == F.col("_file"), "left_anti")
    _publish(kept.unionByName(written), path, version + 1)


def pages_of(pages: DataFrame) -> DataFrame:
    """K2 rows: site, mirror_path (the key within a site, Q16), then the page's columns."""
    return pages.select(U.site_folder("url").alias("site"), U.mirror_path("url").alias("mirror_path"), "*")


def page_bytes(column: str = "html") -> Column:
    return F.octet_length(F.col(column)) + F.lit(64)
