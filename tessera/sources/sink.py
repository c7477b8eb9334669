"""Tables in versions: a write is seen whole or not at all."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _paths(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions; a folder that is still being written has another name."""
    _, p, fs = _paths(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def commit(df: DataFrame, path: str) -> int:
    """Write under a passing name, then rename to the next version; a failure leaves earlier versions as they were.
    Where two writers want the same version, one of them fails."""
    spark = df.sparkSession
    jvm, p, fs = _paths(spark, path)
    passing = f"{path}/_writing-{uuid.uuid4().hex}"
    try:
        df.write.parquet(passing)
        n = (versions(spark, path) or [0])[-1] + 1
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(passing), jvm.org.apache.hadoop.fs.Path(f"{path}/v={n}")):
            raise RuntimeError(f"version {n} of {path} is there already")
        return n
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(passing), True)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/v={version or versions(spark, path)[-1]}")


# Keyed tables: rows are in files that never change, and a manifest names those of a version. A version is there when its
# manifest is, which is created only if it is absent; so readers see it whole, and of two writers one has to begin again.


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file; False if it is there already."""
    jvm, p, fs = _paths(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _manifests(spark: SparkSession, path: str) -> list[int]:
    _, p, fs = _paths(spark, f"{path}/_manifests")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))


def files(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    """The files of a version of a keyed table, of the last one if none is given."""
    known = _manifests(spark, path)
    if not known:
        return []
    name = f"{path}/_manifests/{version or known[-1]:020d}.json"
    for _ in range(100):
        text = "".join(r[0] for r in spark.read.text(name, wholetext=True).collect())  # one file of names
        if text.endswith("]"):
            return json.loads(text)
        time.sleep(0.1)  # its writer has created it and is about to fill it
    raise RuntimeError(f"{name} was never finished")


def read_keyed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(*files(spark, path, version))


def upsert(rows: DataFrame, path: str, key: list[str], attempts: int = 10) -> int:
    """A version in which ``rows`` (one for each key, none of it null) stand in place of those with their keys, or beside the others."""
    return _rewrite(rows, path, key, rows, attempts)


def delete(keys: DataFrame, path: str, key: list[str], attempts: int = 10) -> int:
    """A version without the rows of these keys."""
    return _rewrite(keys, path, key, None, attempts)


def _rewrite(keys: DataFrame, path: str, key: list[str], rows: DataFrame | None, attempts: int) -> int:
    """Only files with a touched key are written anew; the others keep their names. Where another writer was first, all begins
    again from its version, so neither's rows are lost."""
    spark = keys.sparkSession
    keys = keys.select(*key).distinct()
    for _ in range(attempts):
        known = _manifests(spark, path)
        old = files(spark, path, known[-1]) if known else []
        stay, new = old, rows
        if old:
            table = spark.read.parquet(*old)
            touched = [r[0] for r in table.select(*key, F.col("_metadata.file_path").alias("__file")).join(keys, key, "left_semi").select("__file").distinct().collect()]  # names of files
            ends = {t.rsplit("/", 2)[-2] + "/" + t.rsplit("/", 1)[-1] for t in touched}
            hit = [f for f in old if f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] in ends]
            stay = [f for f in old if f not in set(hit)]
            if hit:
                rest = spark.read.parquet(*hit).join(keys, key, "left_anti")
                new = rest if rows is None else rest.unionByName(rows.select(*rest.columns))
        made = []
        if new is not None:
            folder = f"{path}/data-{uuid.uuid4().hex}"
            new.write.parquet(folder)
            _, p, fs = _paths(spark, folder)
            made = [f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]
        n = (known or [0])[-1] + 1
        if _create(spark, f"{path}/_manifests/{n:020d}.json", json.dumps(stay + made)):
            return n
    raise RuntimeError(f"other writers of {path} were first {attempts} times")


# Batches of a stream: each has a list of its files, which another attempt at the batch replaces as a whole.


def put_batch(spark: SparkSession, path: str, number: int, folder: str) -> None:
    """Make the Parquet files in ``folder`` the rows of a batch, in place of what it had; a batch without rows has no list."""
    jvm, p, fs = _paths(spark, folder)
    listed = jvm.org.apache.hadoop.fs.Path(f"{path}/_batches/{number:020d}.json")
    if spark.read.parquet(folder).isEmpty():
        fs.delete(listed, False)
        fs.delete(p, True)
        return
    out = fs.create(listed, True)
    out.write(bytearray(json.dumps([f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]).encode()))
    out.close()


def batch_files(spark: SparkSession, path: str) -> list[str]:
    """The files of all batches. A list that is still being written is left out: its batch has not ended."""
    jvm, p, fs = _paths(spark, f"{path}/_batches")
    if not fs.exists(p) or not fs.listStatus(p):
        return []
    lists = [r[0] for r in spark.read.text(f"{path}/_batches", wholetext=True).collect()]  # names of files
    return sorted(f for text in lists if text.endswith("]") for f in json.loads(text))
