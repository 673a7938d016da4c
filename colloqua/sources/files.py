"""Readers and writers of landed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTS = "id string, name string, subreddit string, author string, created_utc bigint, title string, score int, num_comments int, url string, permalink string"
COMMENTS = "id string, name string, subreddit string, author string, created_utc bigint, body string, score int, link_id string, parent_id string, permalink string, share_urls array<string>, source_post_id string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a declared schema; blank and malformed lines are left out."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parsed.alias("r"))
    return rows.filter("r is not null and r._bad is null").select("r.*").drop("_bad")


def json_or_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Each line as ``record``; a line that is no JSON object becomes a record with only its text."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).filter(F.trim("value") != "").select("value", parsed.alias("record"))
    good = F.col("record").isNotNull() & F.col("record._bad").isNull()
    return rows.select(F.when(good, F.col("record").dropFields("_bad")).alias("record"), F.when(~good, F.col("value")).alias("text"))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any file system Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", dry_run: bool = False) -> int | None:
    """Write ``df`` as parquet, json or csv; mode ``ignore`` leaves what exists alone. ``dry_run`` writes nothing and returns the number of rows."""
    if dry_run:
        return df.count()
    options = {"header": True, "escape": '"'} if kind == "csv" else {}
    df.write.mode(mode).options(**options).format(kind).save(path)
    return None


def line_count(spark: SparkSession, path: str) -> int | None:
    """Lines of a file or folder, None if there is none."""
    return spark.read.text(path).count() if exists(spark, path) else None


def cached_by_key(wanted: DataFrame, cache: DataFrame, key: str = "message_id", guards: tuple[str, ...] = ("text_hash", "model")) -> DataFrame:
    """Rows of ``wanted`` not yet in the cache under the same key, text hash and model."""
    return wanted.join(cache.select(key, *guards), [key, *guards], "left_anti")


def extend_cache(wanted: DataFrame, path: str, compute, key: str = "message_id", guards: tuple[str, ...] = ("text_hash", "model")) -> DataFrame:
    """The cache at ``path`` after ``compute`` has added the rows of ``wanted`` that it lacked; a row is valid for one text and model only."""
    spark = wanted.sparkSession
    missing = cached_by_key(wanted, spark.read.parquet(path), key, guards) if exists(spark, path) else wanted
    compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path)
