"""Readers (S1-S5, S8, E5) and the sidecar join.

All of them are Spark data sources (text, binaryFile, json); file lineage comes from
``_metadata.file_path``.  Large inputs should be many files: a single JSON array is one
record to Spark, so big URL lists belong in JSON Lines or text files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls as U


def url_item(c) -> F.Column:
    """A URL list item that is either a JSON string or an object with a 'url' field."""
    v = c if isinstance(c, F.Column) else F.col(c)
    as_string = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.coalesce(as_string, F.try_variant_get(v, "$.url", "string"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """``.json`` → a JSON array of strings or {url: …} objects; ``.jsonl`` → one item per
    line; anything else → one URL per line, stripped, blank lines dropped.  Unreadable JSON
    gives no rows (the reference returns an empty list).  Columns: file, seq, url."""
    if path.endswith(".json"):
        raw = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
        items = raw.select("file", F.posexplode(F.coalesce(
            F.try_variant_get("v", "$", "array<variant>"), F.array().cast("array<variant>"))).alias("seq", "item"))
        out = items.select("file", F.col("seq").cast("bigint").alias("seq"), url_item(F.col("item")).alias("url"))
        return out.where(F.col("url").isNotNull())
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = lines.withColumn("seq", F.monotonically_increasing_id())
    if path.endswith(".jsonl"):
        val = url_item(F.try_parse_json("value"))
    else:
        val = F.trim(F.col("value"))
    return lines.select("file", "seq", val.alias("url")).where(F.col("url").isNotNull() & (F.col("url") != ""))


def decode_text(content) -> F.Column:
    """Bytes → string with invalid UTF-8 replaced by U+FFFD (never fails)."""
    c = content if isinstance(content, F.Column) else F.col(content)
    return F.make_valid_utf8(c.cast("string"))


def read_html_files(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """S3 + E5: ``*.html`` and ``*.htm`` files (one glob); path, stem, size, html."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{html,htm}")
          .option("recursiveFileLookup", str(recursive).lower()).load(directory))
    return df.select(
        F.col("path"),
        F.regexp_extract("path", r"([^/]*)\.html?$", 1).alias("stem"),
        F.col("length").alias("size"),
        decode_text(F.col("content")).alias("html"),
    )


def read_markdown(spark: SparkSession, root: str, subdir: str = "pages") -> DataFrame:
    """Every ``*.md`` under root/subdir, recursively; path relative to root."""
    base = root.rstrip("/")
    df = (spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true")
          .load(f"{base}/{subdir}"))
    rel = F.regexp_extract(F.col("path"), r"(?s)/(\Q" + subdir.replace("\\E", "") + r"\E/.*)$", 1)
    return df.select(rel.alias("path"), decode_text(F.col("content")).alias("content"))


SIDECAR_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
])


def read_sidecars(spark: SparkSession, directory: str, schema: T.StructType = SIDECAR_SCHEMA) -> DataFrame:
    """The JSON metadata next to the pages (one object per file), keyed by file stem;
    malformed files yield NULL fields (PERMISSIVE)."""
    df = (spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE")
          .option("pathGlobFilter", "*.json").json(directory))
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)(_meta)?\.json$", 1)
    return df.select(stem.alias("stem"), "*")


def with_sidecars(pages: DataFrame, sidecars: DataFrame, base_url: str | None = None) -> DataFrame:
    """Pages ⟕ sidecar metadata on the file stem; the base URL for link resolution is the
    given one, else scheme://netloc of the sidecar's url."""
    j = pages.join(sidecars, "stem", "left")
    base = F.lit(base_url) if base_url else F.when(F.col("url").isNotNull(), U.origin("url"))
    return j.withColumn("base_url", base)
