"""What the operators share: reading tables, cutting lineage, keys for documents without an id."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The id that stands for a null one inside an operator; no document may have it.
NO_ID = -(2**63)
TEXT_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_of(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset, on a local master, a new one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="furrow-checkpoints-"))
    return context.getCheckpointDir()


def stored(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs in here leaves no shuffle files: Spark removes those of each job when the job ends, instead of when the driver next collects its garbage.
    Meant for steps that end in `stored`, of which nothing reads a shuffle again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def text_batches(spark: SparkSession) -> None:
    """From now on Python gets at most TEXT_ROWS rows at a time: the usual 10,000 whole texts would be tens of MB in each task,
    on both sides of the pipe, for as long as the worker lives. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A document's id or, without one, a number from its text that is above any id in use."""
    other = F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(F.col(doc_id).cast("long"), other)


def one_row_per_document(docs: DataFrame) -> DataFrame:
    """(id, text): rows that repeat a doc_id count as one document, with the smallest text that isn't null; no id sorts first."""
    return docs.select(key_of("doc_id").alias("id"), F.col("text").cast("string").alias("text")) \
        .groupBy("id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once although use names it often or inside a lambda."""
    return F.transform(F.array(value), use)[0]


def fold(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n
