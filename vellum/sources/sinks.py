"""Sinks: replacing by document, upserts, write-back decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of the chunk table; a bucket, not a document, is a folder, so files stay large.
BUCKETS = 256


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old ones of documents that aren't among them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_by_document(new: DataFrame, path: str, key: str = "document_key") -> None:
    """Rewrites only the buckets of the new documents, each at once (dynamic partition overwrite). One writer at a time is assumed;
    each has a stage of its own, which goes when the table is written."""
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    fresh = new.withColumn("bucket", bucket)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files, staged = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), None
    if files.exists(at):
        touched = fresh.select("bucket").distinct()
        old = spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi")
        # The result is written beside the table before any of its buckets is replaced.
        fresh = replaced(old.select(*fresh.columns), fresh, key)
        staged = f"{path.rstrip('/')}__staged-{uuid.uuid4().hex}"
        fresh.write.mode("overwrite").parquet(staged)
        fresh = spark.read.schema(fresh.schema).parquet(staged)
    fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    if staged:
        files.delete(jvm.org.apache.hadoop.fs.Path(staged), True)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by `order`."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def accepted_value(value: Column) -> Column:
    """What may be written back: not empty, not a way of saying nothing, 200 characters at most."""
    v = F.trim(value)
    return F.when((v != "") & ~F.lower(v).isin("n/a", "not found", "unknown", "none"), F.substring(v, 1, 200))


def accepted_tags(tags: Column, most: int = 5) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")), 1, most)


def type_change(current: Column, detected: Column) -> Column:
    """Only the default type is changed."""
    return F.when((current == "Default") & detected.isNotNull(), detected)
