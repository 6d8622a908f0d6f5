"""Tensor sources: text files, tables, arrays, closed forms and random low-rank models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.plans.planner import fits
from polyad.schema import TensorMeta


def grid(spark: SparkSession, modes: tuple[int, ...]) -> DataFrame:
    """All index combinations, from one range and arithmetic: no joins."""
    meta = TensorMeta(modes)
    lin, cols, step = F.col("id"), [], 1
    for name, size in zip(meta.index_columns, modes, strict=True):
        cols.append(F.pmod(F.floor(lin / step), F.lit(size)).cast("int").alias(name))
        step *= size
    return spark.range(meta.n_elements).select(*cols)


def read_text(spark: SparkSession, path: str) -> tuple[DataFrame, TensorMeta]:
    """First line: sizes; then values in any line layout, first index fastest. Raises if the count is wrong.

    A folder's files are read in the order of their names. Lines are in the order of file, start of the split and
    place in it, wherever Spark reads them; values get their place from the counts before, so all executors parse.
    """
    read = spark.read.text(path)
    lines = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    head = lines.where(F.col("value") != "").orderBy("file", "block", "at").first()
    if head is None:
        raise ValueError(f"{path} is empty")
    modes = tuple(int(x) for x in head.value.split())
    meta = TensorMeta(modes)
    first = (F.col("file") == head.file) & (F.col("block") == head.block) & (F.col("at") <= head.at)
    sized = lines.where(~first).withColumn("parts", F.filter(F.split("value", r"\s+"), lambda x: x != "")).withColumn("n", F.size("parts"))
    blocks = sized.groupBy("file", "block").agg(F.sum("n").alias("n")).orderBy("file", "block").collect()  # one row per file split
    if sum(b.n for b in blocks) != meta.n_elements:
        raise ValueError(f"{path}: {sum(b.n for b in blocks)} values for sizes {meta.label()}")
    offset, starts = 0, []
    for b in blocks:
        starts.append((b.file, b.block, offset))
        offset += b.n
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("before", before).join(F.broadcast(spark.createDataFrame(starts, "file string, block bigint, start bigint")), ["file", "block"])
    values = placed.select(F.posexplode("parts").alias("k", "v"), (F.col("start") + F.col("before")).alias("base"))
    lin, cols, step = F.col("base") + F.col("k"), [], 1
    for name, size in zip(meta.index_columns, modes, strict=True):
        cols.append(F.pmod(F.floor(lin / step), F.lit(size)).cast("int").alias(name))
        step *= size
    return values.select(*cols, F.col("v").cast("double").alias("val")), meta


def write_text(df: DataFrame, meta: TensorMeta, path: str) -> None:
    """A dense tensor as `read_text` reads it: a folder with the header in its first file and values in order."""
    from polyad.operators.algebra import linear

    spark = df.sparkSession
    cells = grid(spark, meta.modes).join(df.select(*meta.index_columns, "val"), meta.index_columns, "left")
    place = linear(meta.index_columns, list(meta.modes)).alias("at")
    values = cells.select(place, F.coalesce("val", F.lit(0.0)).cast("string").alias("value"))
    head = spark.createDataFrame([(-1, " ".join(map(str, meta.modes)))], "at bigint, value string")
    head.unionByName(values).repartitionByRange("at").sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path for files that a job writes and reads again, in the folder that the session names for checkpoints."""
    import tempfile
    import uuid

    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="polyad-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def domain(df: DataFrame, column: Column, most: int = 100_000) -> list:
    """Sorted distinct values of a dimension; a mode of a dense tensor has to be small, and this checks it."""
    found = [r.v for r in df.select(column.alias("v")).where("v is not null").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"a dimension has over {most} values")
    return sorted(found)


def from_table(df: DataFrame, dims: list[tuple[Column, list]], value: Column, agg: str = "sum", dense: bool = True) -> tuple[DataFrame, TensorMeta]:
    """Cells are aggregates of `value` by the dimensions, each given with its ordered values.

    The aggregate runs before anything else, with partial sums; the grid is only as large as the dense tensor.
    """
    spark = df.sparkSession
    meta = TensorMeta(tuple(len(values) for _, values in dims))
    coded = df
    for n, (column, values) in enumerate(dims):
        coded = coded.withColumn(f"_k{n}", column)
    keys = [f"_k{n}" for n in range(len(dims))]
    cells = coded.groupBy(*keys).agg(getattr(F, agg)(value).cast("double").alias("val"))
    for n, (_, values) in enumerate(dims):
        codes = spark.createDataFrame([(i, v) for i, v in enumerate(values)], schema=_code_schema(coded, f"_k{n}", n))
        cells = cells.join(codes, f"_k{n}")
    cells = cells.select(*meta.index_columns, "val")
    if dense:
        cells = grid(spark, meta.modes).join(cells, meta.index_columns, "left").select(*meta.index_columns, F.coalesce("val", F.lit(0.0)).alias("val"))
    return cells, meta


def _code_schema(df: DataFrame, key: str, n: int):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(f"i{n}", T.IntegerType()), T.StructField(key, df.schema[key].dataType)])


def from_array(spark: SparkSession, x: np.ndarray) -> tuple[DataFrame, TensorMeta]:
    """A dense tensor from an array, NaN as 0."""
    import pandas as pd

    meta = TensorMeta(x.shape)
    index = np.unravel_index(np.arange(x.size), x.shape, order="F")
    data = {c: i.astype(np.int32) for c, i in zip(meta.index_columns, index, strict=True)}
    return spark.createDataFrame(pd.DataFrame(data | {"val": np.nan_to_num(x.ravel(order="F"), nan=0.0)}), meta.schema()), meta


def to_array(df: DataFrame, meta: TensorMeta) -> np.ndarray:
    """The dense array on the driver, for tensors within the broadcast limit."""
    if not fits(meta.n_elements):
        raise ValueError(f"{meta.label()} is over the broadcast limit")
    table = df.select(*meta.index_columns, "val").toArrow()
    out = np.zeros(meta.modes)
    out[tuple(table.column(c).to_numpy() for c in meta.index_columns)] = table.column("val").to_numpy()
    return out


def matrix(spark: SparkSession, rows: int, cols: int, value: Column | None = None) -> DataFrame:
    """`(row, col, val)` from an expression of row and col; zeros without."""
    cells = spark.range(rows * cols).select((F.col("id") % rows).cast("int").alias("row"), F.floor(F.col("id") / rows).cast("int").alias("col"))
    return cells.withColumn("val", (F.lit(0.0) if value is None else value).cast("double"))


def fill(spark: SparkSession, modes: tuple[int, ...], value: Column) -> DataFrame:
    """Every cell from an expression of i0, i1, ..."""
    return grid(spark, modes).withColumn("val", value.cast("double"))


def low_rank(spark: SparkSession, modes: tuple[int, ...], rank: int, seed: int) -> tuple[DataFrame, TensorMeta]:
    """A random model of this rank written out as a tensor."""
    from polyad.functions.kernels import random_model, reconstruct

    lam, factors = random_model(modes, rank, seed)
    df, meta = from_array(spark, reconstruct(lam, factors))
    return df, TensorMeta(meta.modes, rank)
