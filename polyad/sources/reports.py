"""Report files and what is read from them: iteration reports, look-up tables, benchmark grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("sep", ";").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A `;`-separated report with a header; None and a warning if there is none."""
    from pyspark.errors import AnalysisException

    try:
        reader = spark.read.option("header", True).option("sep", ";")
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    except AnalysisException:
        import warnings

        warnings.warn(f"no report at {path}", stacklevel=2)
        return None


def lut_path(root: str, backend: str, modes: str, threads: int | None, mode: int) -> str:
    """Where the table of one mode lies: `<backend>/lookup_tables/<modes>[/<threads>]/<mode>`."""
    return "/".join([root.rstrip("/"), backend, "lookup_tables", modes, *([str(threads)] if threads is not None else []), str(mode)])


def write_lut(best: DataFrame, root: str, backend: str = "numpy") -> None:
    """`best(modes, threads, mode, rank, method)` as lines `rank method`, a folder for each mode."""
    for r in best.select("modes", "threads", "mode").distinct().collect():  # a few tables
        own = best.where((F.col("modes") == r.modes) & F.col("threads").eqNullSafe(r.threads) & (F.col("mode") == r["mode"]))
        lines = own.coalesce(1).sortWithinPartitions("rank").select(F.concat_ws(" ", "rank", "method").alias("value"))
        lines.write.mode("overwrite").text(lut_path(root, backend, r.modes, r.threads, r["mode"]))


def read_lut(spark: SparkSession, root: str, modes: str, threads: int | None, backend: str = "numpy", suppress: bool = True) -> dict[int, dict[int, int]]:
    """By mode: rank to method. Ranks are those of mode 0; any missing table makes it empty, with a warning unless suppressed."""
    from pyspark.errors import AnalysisException

    out: dict[int, dict[int, int]] = {}
    try:
        for n in range(len(modes.split("-"))):
            lines = spark.read.text(lut_path(root, backend, modes, threads, n)).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 2)
            out[n] = {r.rank: r.method for r in lines.select(F.col("p")[0].cast("int").alias("rank"), F.col("p")[1].cast("int").alias("method")).orderBy("rank").collect()}
    except AnalysisException:
        if not suppress:
            import warnings

            warnings.warn(f"no look-up table for {modes}", stacklevel=2)
        return {}
    return {n: {k: table[k] for k in out[0] if k in table} for n, table in out.items()}


def fastest(iterations: DataFrame, keys: list[str], timers: list[str]) -> DataFrame:
    """The least of each timer over all iterations, and their number."""
    return iterations.groupBy(*keys).agg(F.count("*").alias("iters"), *[F.min(t).alias(t) for t in timers])


def cumulative(iterations: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    return iterations.select(*keys, "iter", F.sum("flops").over(w).alias("cum_flops"))


def roll_up(iterations: DataFrame, keys: list[str]) -> DataFrame:
    return iterations.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("cols").alias("cols"), F.sum(F.col("flops") * F.col("iter")).alias("flops"), F.max("iter").alias("iters"))


def defrag_ratio(iterations: DataFrame) -> DataFrame:
    r = F.col("defrag") / F.col("total")
    return iterations.agg(F.avg(r).alias("mean"), F.percentile(r, 0.5).alias("median"), F.max(r).alias("max"), F.min(r).alias("min"))


def speed_up(slow: DataFrame, fast: DataFrame, key: str) -> DataFrame:
    """Sum of totals of one method over that of another, by key."""
    a, b = slow.groupBy(key).agg(F.sum("total").alias("a")), fast.groupBy(key).agg(F.sum("total").alias("b"))
    return a.join(b, key).select(key, (F.col("a") / F.col("b")).alias("speed_up"))


def pivot(timings: DataFrame, components: list[int]) -> DataFrame:
    """A row for each method, a column for each number of components, and their sum."""
    wide = timings.groupBy("method").pivot("components", components).agg(F.first("seconds"))
    return wide.select("method", *[F.col(f"`{c}`").alias(f"r{c}") for c in components], sum((F.coalesce(f"`{c}`", F.lit(0.0)) for c in components), F.lit(0.0)).alias("total"))


_ALS_HEAD = "TENSOR_RANK int, TENSOR_MODES string, KTENSOR_ID int, KTENSOR_COMP int, UPDATE_METHOD string, LINE_SEARCH boolean, MAX_ITERS int, ITER int, NUM_THREADS int, TOTAL double, FLOPS bigint"
_CALS_HEAD = "TENSOR_RANK int, TENSOR_MODES string, BUFFER_SIZE int, N_KTENSORS int, KTENSOR_COMP_SUM int, UPDATE_METHOD string, LINE_SEARCH boolean, MAX_ITERS int, ITER int, NUM_THREADS int, TOTAL double, FLOPS bigint, COLS int"
_TIMERS = "ITERATION double, DEFRAGMENTATION double, ERROR double, LINESEARCH double, G_COPY double"
MODEL_REPORT = "KTENSOR_ID int, KTENSOR_RANK int, ERROR double, ITERS int"
BENCH_REPORT = "MODE int, TENSOR_MODES string, FLOPS bigint, MEMOPS bigint, RANK int, THREADS int, TIME double, F_TIME double, S_TIME double"


def _mode_timers(n_modes: int) -> str:
    return ", ".join(f"MODE_{n}_TOTAL_MTTKRP double, MODE_{n}_UPDATE double" for n in range(n_modes))


def als_schema(n_modes: int) -> str:
    return f"{_ALS_HEAD}, {_TIMERS}, {_mode_timers(n_modes)}"


def concurrent_schema(n_modes: int) -> str:
    return f"{_CALS_HEAD}, {_TIMERS}, {_mode_timers(n_modes)}"


def jackknife_schema(components: list[int]) -> str:
    return "Method string, " + ", ".join(f"`{c}` double" for c in components) + ", total double"


def _timers(n_modes: int, value) -> list:
    """Columns of the timers; `value` makes a column of one of a sweep's fields."""
    names = [("seconds", "ITERATION"), ("defrag", "DEFRAGMENTATION"), ("error", "ERROR"), ("line_search", "LINESEARCH")]
    modes = [(F.col("s." + f)[n], f"MODE_{n}_{t}") for n in range(n_modes) for f, t in (("mttkrp", "TOTAL_MTTKRP"), ("update", "UPDATE"))]
    return [*(value(F.col("s." + f)).alias(t) for f, t in names), F.lit(0.0).alias("G_COPY"), *(value(c).alias(t) for c, t in modes)]


def als_report(results: DataFrame, meta, params, threads: int) -> DataFrame:
    """A row for each model that was fitted for itself; timers are the least over its sweeps but the last (or the only one)."""
    swept = results.select("model_id", "components", "iters", F.size("sweeps").alias("n"), F.posexplode("sweeps").alias("at", "s"))
    counted = (F.col("at") < F.col("n") - 1) | (F.col("n") == 1)
    per = swept.groupBy("model_id", "components", "iters").agg(
        F.sum("s.seconds").alias("TOTAL"), F.first("s.flops").alias("FLOPS"), *_timers(len(meta.modes), lambda c: F.min(F.when(counted, c)))
    )
    head = [F.lit(meta.rank).alias("TENSOR_RANK"), F.lit(meta.label()).alias("TENSOR_MODES"), F.col("model_id").alias("KTENSOR_ID"), F.col("components").alias("KTENSOR_COMP"), F.lit(params.update_method).alias("UPDATE_METHOD"), F.lit(params.line_search).alias("LINE_SEARCH"), F.lit(params.max_iterations).alias("MAX_ITERS"), F.col("iters").alias("ITER"), F.lit(threads).alias("NUM_THREADS")]
    return per.select(*head, *[c for c in per.columns if c not in ("model_id", "components", "iters")])


def concurrent_report(results: DataFrame, meta, params, threads: int) -> DataFrame:
    """A row for each sweep of a fused fit, with its models, columns, FLOPs, timers and line searches."""
    whole = results.agg(F.count("*").cast("int").alias("N_KTENSORS"), F.sum("components").cast("int").alias("KTENSOR_COMP_SUM"))
    swept = results.where("sweeps is not null").select("model_id", F.explode("sweeps").alias("s"))
    total = swept.groupBy("model_id").agg(F.sum("s.seconds").alias("TOTAL"))
    joined = swept.join(total, "model_id").join(F.broadcast(whole), F.lit(True))  # one row
    head = [F.lit(meta.rank).alias("TENSOR_RANK"), F.lit(meta.label()).alias("TENSOR_MODES"), F.lit(params.buffer_size).alias("BUFFER_SIZE"), "N_KTENSORS", "KTENSOR_COMP_SUM", F.lit(params.update_method).alias("UPDATE_METHOD"), F.lit(params.line_search).alias("LINE_SEARCH"), F.lit(params.max_iterations).alias("MAX_ITERS"), F.col("s.iter").alias("ITER"), F.lit(threads).alias("NUM_THREADS"), "TOTAL", F.col("s.flops").alias("FLOPS"), F.col("s.cols").alias("COLS")]
    return joined.select(*head, *_timers(len(meta.modes), lambda c: c), F.col("s.models").alias("MODELS"), F.col("s.extrapolated").alias("LS_EXTRAPOLATED"), F.col("s.reverted").alias("LS_REVERTED"))


def model_summary(results: DataFrame) -> DataFrame:
    return results.select(F.col("model_id").alias("KTENSOR_ID"), F.col("components").alias("KTENSOR_RANK"), F.col("error").alias("ERROR"), F.col("iters").alias("ITERS"))


def timing_stats(timings: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, largest, mean, median and population deviation."""
    v = F.col(value)
    return timings.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.stddev_pop(v).alias("std"))


def unpivot(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Back to a row for each key and measured column."""
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], "measure", "value")


def efficiency(bench: DataFrame, peak: float) -> DataFrame:
    """`bench(mode, rank, method, flops, time)`: share of the peak reached by the best method, summed over modes."""
    best = bench.groupBy("mode", "rank").agg(F.max_by(F.struct("flops", "time"), F.col("flops") / F.col("time")).alias("b"))
    return best.groupBy("rank").agg((F.sum("b.flops") / F.sum("b.time") / F.lit(peak)).alias("efficiency"))


def peak_flops(ghz: float, flops_per_cycle: int, threads: int) -> float:
    """FLOP/s of a machine at its best."""
    return ghz * 1e9 * flops_per_cycle * threads


def append_bench(bench: DataFrame, path: str) -> None:
    """Rows of BENCH_REPORT added to a report."""
    write_csv(bench, path, "append")


def describe(results: DataFrame, model_id: int, digits: int = 4) -> str:
    """A fitted model as text: its weights and the matrices of its factors."""
    row = results.where(F.col("model_id") == model_id).select("components", "error", "fit", "weights", "factors").first()
    if row is None:
        return f"no model {model_id}"
    line = lambda values: " ".join("-" if v is None else f"{v:.{digits}f}" for v in values)
    parts = [f"model {model_id}: {row.components} components, error {row.error:.{digits}f}, fit {row.fit:.{digits}f}", f"weights: {line(row.weights)}"]
    for n, factor in enumerate(row.factors):
        parts += [f"mode {n}, {len(factor)} x {row.components}:", *(line(r) for r in factor)]
    return "\n".join(parts)


def describe_tensor(x: DataFrame, meta, most: int = 20) -> str:
    """A tensor's sizes and its first cells as text."""
    cells = [" ".join([*(str(r[c]) for c in meta.index_columns), f"{r.val:g}"]) for r in x.orderBy(*reversed(meta.index_columns)).limit(most).collect()]
    return "\n".join([f"tensor {meta.label()}, {meta.n_elements} cells", *cells])
