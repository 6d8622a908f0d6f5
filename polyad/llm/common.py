"""What several text operators share: words, lower case, shared folders, Arrow helpers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same for Spark's and DuckDB's regular expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: str) -> str:
    """A-Z to a-z and nothing else."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def lower_col(column):
    """`ascii_lower` for Spark columns: translate() maps exactly A-Z."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local one if Spark itself is local (as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="polyad-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete what `materialize` has written; also runs when Python ends."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; its folder goes with the cluster's own clean-up
            return


atexit.register(release)


def join_hot(rows: DataFrame, unique: DataFrame, keys: list[str], total: int, how: str = "inner", share: int = 512) -> DataFrame:
    """`rows` joined with `unique(keys, n, ...)`, which has one row for each key; n is how many of the `total` rows have it.

    Keys with at least 1/share of all rows, no more than `share` of them, are broadcast; the others are shuffled,
    and none of them is hot. `unique` has to be stored, as it is read more than once.
    """
    hot = unique.where(F.col("n") * share >= total).drop("n")
    if hot.isEmpty():
        return rows.join(unique.drop("n"), keys, how)
    rest = unique.where(F.col("n") * share < total).drop("n")
    first = rows.join(F.broadcast(hot), keys, "inner" if how == "left" else how)
    return first.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
