"""Ways of fitting held against each other: serial, one task a model, fused; masked and deleting jackknife; contractions."""

from __future__ import annotations

import time
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad import schema as S
from polyad.plans import als, jackknife
from polyad.plans.planner import METHODS, mttkrp_flops
from polyad.sources import reports

WAYS = {"serial": als.cp_als_serial, "per_model": als.cp_als_many, "fused": als.cp_concurrent}


def _kept(results: DataFrame) -> tuple[DataFrame, float]:
    """Results, computed, and the seconds that took."""
    began = time.perf_counter()
    results = results.persist()
    results.count()
    return results, time.perf_counter() - began


def compare(x: DataFrame, meta: S.TensorMeta, models: DataFrame, params: als.Params, path: str | None = None, within: float = 0.1) -> DataFrame:
    """`(method, models, components, seconds, sweep_seconds, largest_difference, agree)` for each way of fitting.

    Errors are held against those of the serial fits; a difference over `within` does not agree. With a path, the
    reports of all ways and the models are written below it.
    """
    x = x.persist()
    threads, base, rows = x.sparkSession.sparkContext.defaultParallelism, None, []
    for name, fit in WAYS.items():
        results, seconds = _kept(fit(x, meta, models, params))
        errors = {r.model_id: r.error for r in als.models_of(results).collect()}
        base = base or errors
        apart = max((abs(errors[k] - base[k]) for k in base), default=0.0)
        swept = als.sweeps_of(results).agg(F.coalesce(F.sum("seconds"), F.lit(0.0))).first()[0]
        total = results.agg(F.coalesce(F.sum("components"), F.lit(0))).first()[0]
        rows.append((name, len(errors), int(total), seconds, float(swept), float(apart), bool(apart <= within)))
        if path:
            report = reports.concurrent_report if name == "fused" else reports.als_report
            reports.write_csv(report(results, meta, params, threads), f"{path}/{name}")
            reports.write_csv(reports.model_summary(results), f"{path}/{name}_models")
        results.unpersist()
    return x.sparkSession.createDataFrame(rows, "method string, models int, components int, seconds double, sweep_seconds double, largest_difference double, agree boolean")


def run_concurrent(x: DataFrame, meta: S.TensorMeta, models: DataFrame, params: als.Params, path: str) -> DataFrame:
    """One fused fit with its report and models written below a path."""
    results, _ = _kept(als.cp_concurrent(x, meta, models, params))
    reports.write_csv(reports.concurrent_report(results, meta, params, x.sparkSession.sparkContext.defaultParallelism), f"{path}/fused")
    reports.write_csv(reports.model_summary(results), f"{path}/fused_models")
    return results


def compare_jackknife(x: DataFrame, meta: S.TensorMeta, components: list[int], params: als.Params, path: str | None = None) -> DataFrame:
    """`(Method, <components>..., total)`: seconds of deleting and of masked replicas of a fit for each number of components."""
    spark, rows = x.sparkSession, []
    x = x.persist()
    for at, c in enumerate(components):
        reference, _ = _kept(als.cp_concurrent(x, meta, als.model_list(spark, [(at, c, None)]), params))
        for name, f in (("deleting", jackknife.jackknife_by_deletion), ("masked", jackknife.jackknife)):
            replicas, seconds = _kept(f(x, meta, reference, params))
            rows.append((name, c, seconds))
            replicas.unpersist()
        reference.unpersist()
    wide = reports.pivot(spark.createDataFrame(rows, "method string, components int, seconds double"), components)
    wide = wide.select(F.col("method").alias("Method"), *[F.col(f"r{c}").alias(str(c)) for c in components], "total")
    if path:
        reports.write_csv(wide, path)
    return wide


def benchmark_mttkrp(spark: SparkSession, modes: tuple[int, ...], ranks: list[int], methods: tuple[str, ...] = METHODS, repeats: int = 3, threads: int = 1) -> DataFrame:
    """Rows of BENCH_REPORT and `method`: the least of `repeats` times of each product, every case in a task of its own."""
    cases = [(n, r, m) for n in range(len(modes)) for r in ranks for m in methods]
    frame = spark.createDataFrame(cases, "mode int, rank int, method string").repartition(len(cases))

    def run(batches):
        import pandas as pd

        from polyad.functions import kernels as K

        for pdf in batches:
            rows = []
            for n, rank, method in pdf.itertuples(index=False):
                rng = np.random.default_rng(0)
                x, factors = rng.random(modes), [rng.random((i, rank)) for i in modes]
                times = []
                for _ in range(repeats):
                    began = time.perf_counter()
                    K.mttkrp(x, factors, n, method)
                    times.append(time.perf_counter() - began)
                moved = int(np.prod(modes)) + sum(i * rank for i in modes)
                rows.append((n, "-".join(map(str, modes)), mttkrp_flops(modes, n, rank, method), moved, rank, threads, min(times), times[0], times[-1], METHODS.index(method)))
            yield pd.DataFrame(rows, columns=[*(c.split()[0] for c in reports.BENCH_REPORT.split(", ")), "method"])

    return frame.mapInPandas(run, reports.BENCH_REPORT + ", method int")


def measured_lut(bench: DataFrame) -> DataFrame:
    """`(modes, threads, mode, rank, method)`: the fastest method of a benchmark, as look-up tables take it."""
    from polyad.plans.planner import best_method

    best = best_method(bench.select(F.col("MODE").alias("mode"), F.col("RANK").alias("rank"), "method", F.col("FLOPS").cast("double").alias("flops"), F.col("TIME").alias("time")))
    named = bench.groupBy("MODE").agg(F.first("TENSOR_MODES").alias("modes"), F.first("THREADS").alias("threads")).withColumnRenamed("MODE", "mode")
    return best.join(F.broadcast(named), "mode").select("modes", "threads", "mode", "rank", "method")  # a row for each mode


def with_table(params: als.Params, lut: dict) -> als.Params:
    return replace(params, lut=lut, mttkrp_method="auto")
