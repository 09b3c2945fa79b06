"""What the operators share: shared-folder tables, row identity and bounded Arrow slices."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from ..sources.tables import spread

#: Text bytes that one step of a Python operator holds at once (a single longer text is one step).
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one machine's session (tests) gets a new temporary
    folder; on a cluster that would be a folder that no one else sees, so it is an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


class Scratch:
    """Written tables in the shared folder. They cut lineage, survive lost executors and carry no
    partitioning, so a join on them gets exchanges of its own, which adaptive execution can split at hot keys.

    Results are lazy and may read these tables as long as the session lives; when the driver ends they go. What a step
    is the last to read it drops before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/vellum-{name}-{uuid.uuid4().hex}"
        self._conf, self._path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        atexit.register(self._at_exit)

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the driver's JVM may have ended first; then the folder stays
            self._delete(self.base)

    def _delete(self, path: str) -> None:
        at = self._path(path)
        at.getFileSystem(self._conf).delete(at, True)

    def write(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.base}/{name}")


def own_name(id_col: str, taken: Iterable[str]) -> str:
    """The id column's name in a result; `id` if a column of the result itself has that name."""
    return "id" if id_col.lower() in {t.lower() for t in taken} else id_col


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, so that batches of long texts stay small. Plans are lazy, so the setting stays for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batch: pa.RecordBatch, text: int | str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of at most `limit` text bytes (at least one row each)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out anew if its files give fewer splits than there are cores."""
    return spread(tables.table(spark, sf_dir, name))
