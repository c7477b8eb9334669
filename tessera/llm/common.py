"""Helpers that the training-data operators share: the shared folder, materialised tables, prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 64 << 20  # what a table that is broadcast may take
SALTS = 16  # places that the rows of one key are spread over
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a temporary folder; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _shuffle_cleanup(spark: SparkSession):
    """Shuffle files go as soon as the write that made them ends; what it wrote replaces them."""
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
    except Exception:  # a Spark without the setting keeps the files until its next garbage collection
        yield
        return
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with _shuffle_cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """``materialize`` in ``n`` buckets of ``key``: a join on it moves only the other side."""
    spark = df.sparkSession
    path, table = scratch(spark, name), f"{name}_{uuid.uuid4().hex}"
    with _shuffle_cleanup(spark):
        df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved now: the files stay when the name goes
    spark.sql(f"DROP TABLE {table}")
    return out


@functools.lru_cache(maxsize=1)
def _trim():
    """glibc's function that gives free pages back; elsewhere there is none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """What Arrow and the C library hold free goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(run):
    """``run`` over batches for ``mapInArrow``; at its end the worker gives back what it freed. Spark keeps workers for later
    tasks, of any stage, so each would else hold what its largest task took."""

    def rows(batches):
        yield from run(batches)
        give_back()

    return rows


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free(name: str, taken: list[str]) -> str:
    """``name``, longer if one of ``taken`` is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def fits(rows: int, size: int) -> bool:
    """Whether ``rows`` counted rows of at most ``size`` bytes in memory may be broadcast."""
    return rows * size <= BROADCAST_BYTES


def semi(left: DataFrame, right: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Rows of ``left`` with a match in ``right``, nulls equal to nulls. ``right`` has ``rows`` rows of an id and a digest, as
    counted by the caller; they are broadcast if they fit, else joined by a shuffle."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") for c in on])
    return left.join(F.broadcast(r) if fits(rows, 100) else r, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on], "left_semi")


def with_group(d: DataFrame, key: list[str], by: str, *aggregates: Column) -> DataFrame:
    """``d`` with aggregates over the rows of its ``key``. Rows are combined before they meet, and a key's rows get the result
    in up to ``SALTS`` places, by a hash of ``by``: in as many as have rows of it, so nothing grows for small keys."""
    d = d.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    g = d.groupBy(*key).agg(*aggregates, F.bit_or(F.expr("shiftleft(1, __salt)")).alias("__places"))
    g = g.withColumn("__salt", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> (__places & shiftleft(1, i)) <> 0)"))).drop("__places")
    return d.join(g, [*key, "__salt"]).drop("__salt")


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of ``group`` up to and including each row.

    The order is ``bucket``, then ``order``. Only one bucket's rows meet in a task: sums of buckets are added
    up first, in a table of groups times buckets, so a group with most of all rows is spread like any other.
    """
    v = "__value"
    d = df.withColumn(v, value)
    per = d.groupBy(*group, bucket).agg(F.sum(v).alias("__sum"))
    before = per.withColumn(
        "__before",
        F.coalesce(F.sum("__sum").over(W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).drop("__sum")
    inner = F.sum(v).over(W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    left, right = d.withColumn("__in", inner).alias("l"), before.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, bucket]]
    return left.join(right, on).select("l.*", "r.__before").withColumn(out, F.col("__before") + F.col("__in")).drop(v, "__in", "__before")


def bounded_sample(d: DataFrame, text: str, n: int, by: str | None = None, total: int | None = None, seed: int = 1) -> DataFrame:
    """At most ``n`` different texts (for each value of ``by``, and ``total`` in all, dealt evenly) that a hash picks:
    columns ``by`` and t. About 1.3 n texts leave the scan in all, however many there are: the share to let through
    follows from a count; copies of a text are one before anything is shuffled.
    """
    keys = [by] if by else []
    d = d.select(*keys, F.col(text).alias("t"), F.xxhash64(text, F.lit(seed)).alias("__h"))
    counts = d.groupBy(*keys).agg(F.approx_count_distinct("__h").alias("__c"))  # a row for each value of ``by``
    share = F.lit(1.3 * n + 50) / F.greatest(F.col("__c"), F.lit(1))
    at = F.col("__h") / F.lit(2.0**64) + F.lit(0.5)
    if by:
        some = counts.orderBy(F.desc("__c"), by).limit(total or n)  # no more values than that can have a text each
        d = d.join(F.broadcast(some), by).filter(at < share)
    else:
        d = d.filter(at < F.lit((1.3 * n + 50) / max(counts.first()[0], 1)))
    w = W.partitionBy(*keys).orderBy("__h")
    d = d.dropDuplicates([*keys, "__h"]).withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n)
    if total is not None:
        d = d.orderBy("__k", "__h").limit(total)
    return d.select(*keys, "t")
