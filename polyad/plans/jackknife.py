"""Leave-one-out replicas of fitted models, alignment, and the flow from many models to errors of the best."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad import schema as S
from polyad.functions import kernels as K
from polyad.operators.algebra import best_per_rank, leave_out, replicas
from polyad.plans.als import RESULT, Model, Params, cp_concurrent, fit_array, result_rows
from polyad.plans.planner import fits
from polyad.sources.tensors import to_array


def prepared(references: DataFrame) -> DataFrame:
    """Results with weights folded into mode 0 and columns scaled anew."""

    def run(batches):
        for pdf in batches:
            models = []
            for row in pdf.to_dict("records"):
                factors = [np.array([list(r) for r in f]) for f in row["factors"]]
                lam, factors = K.normalize(K.denormalize(np.array(row["weights"]), factors))
                models.append(Model(int(row["model_id"]), factors, lam, iters=int(row["iters"]), fit=row["fit"], old_fit=row["old_fit"], error=row["error"], status=row["status"]))
            yield result_rows(models)

    return references.mapInPandas(run, RESULT)


def jackknife(x: DataFrame, meta: S.TensorMeta, references: DataFrame, params: Params = Params(), compat: bool = False, where: str | None = None) -> DataFrame:  # noqa: B008
    """Replicas as masked models over the full tensor, all in the same passes; aligned to their references.

    Columns as of results, and `ref_id`. The left-out row of mode 0 is null in `factors`.
    """
    size = meta.modes[0]
    ready = prepared(references).select("model_id", "components", "factors").persist()  # used three times: fitted once
    tagged = replicas(ready, size).join(ready, "model_id").select(F.col("model_id").alias("ref_id"), F.col("replica_id").alias("model_id"), "components", F.lit(None).cast("int").alias("seed"), "jk_mode", "jk_fiber", "factors")
    fitted = cp_concurrent(x, meta, tagged.drop("ref_id"), params, where)
    kept = ready.select(F.col("model_id").alias("ref_id"), F.col("factors").alias("reference"))
    joined = fitted.withColumn("ref_id", F.floor(F.col("model_id") / size).cast("int")).join(kept, "ref_id")
    return joined.mapInPandas(_finish(compat, True), RESULT.replace("model_id int", "ref_id int, model_id int", 1))


_COLUMNS = list(result_rows([]).columns)


def _finish(compat: bool, masked: bool):
    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                factors = [np.array([list(r) for r in f]) for f in row["factors"]]
                reference = [np.array([list(r) for r in f]) for f in row["reference"]]
                fiber = int(row["jk_fiber"])
                if masked:
                    factors[0][fiber] = 0.0
                lam, factors = K.normalize(K.denormalize(np.array(row["weights"]), factors))
                lam, factors = K.align(reference, lam, factors, literal=compat)
                lists = [f.tolist() for f in factors]
                if masked:
                    lists[0][fiber] = [None] * factors[0].shape[1]
                rows.append({**row, "weights": lam.tolist(), "factors": lists})
            import pandas as pd

            out = pd.DataFrame(rows, columns=pdf.columns)
            out["history"] = [[dict(h) for h in hs] for hs in out["history"]]
            out["sweeps"] = pd.Series([None if hs is None else [dict(h) for h in hs] for hs in out["sweeps"]], dtype=object)
            yield out[["ref_id", *_COLUMNS]]

    return run


def jackknife_by_deletion(x: DataFrame, meta: S.TensorMeta, references: DataFrame, params: Params = Params(), compat: bool = False) -> DataFrame:  # noqa: B008
    """The same by fitting reduced models to the tensor without the slice: one task for each replica.

    Over the broadcast limit replicas are masked, which gives the same models.
    """
    if not fits(meta.n_elements):
        return jackknife(x, meta, references, params, compat, "slabs")
    size = meta.modes[0]
    ready = prepared(references).select("model_id", "components", "factors", F.col("factors").alias("reference")).persist()
    tagged = replicas(ready, size).join(ready, "model_id").select(F.col("model_id").alias("ref_id"), F.col("replica_id").alias("model_id"), "components", "jk_mode", "jk_fiber", "factors", "reference")
    sent = x.sparkSession.sparkContext.broadcast(to_array(x, meta))

    def run(pdf):
        done = []
        for row in pdf.to_dict("records"):
            fiber = int(row["jk_fiber"])
            factors = [np.array([list(r) for r in f]) for f in row["factors"]]
            factors[0] = np.delete(factors[0], fiber, axis=0)
            fitted = fit_array(np.delete(sent.value, fiber, axis=0), [Model(int(row["model_id"]), factors, np.ones(factors[0].shape[1]))], params)[0][0]
            reference = [np.array([list(r) for r in f]) for f in row["reference"]]
            lam, moved = K.normalize(K.denormalize(fitted.lam, fitted.factors))
            lam, moved = K.align(reference, lam, moved, literal=compat)
            fitted.lam, fitted.factors, fitted.jk_mode, fitted.jk_fiber = lam, moved, 0, fiber
            table = result_rows([fitted])
            full = moved[0].tolist()
            full.insert(fiber, [None] * len(lam))
            table.at[0, "factors"] = [full, *[f.tolist() for f in moved[1:]]]
            table.insert(0, "ref_id", int(row["ref_id"]))
            done.append(table)
        import pandas as pd

        return pd.concat(done)

    return tagged.groupBy("model_id").applyInPandas(run, RESULT.replace("model_id int", "ref_id int, model_id int", 1))


def hybrid(x: DataFrame, meta: S.TensorMeta, models: DataFrame, ranks: list[int], params: Params = Params(), digits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """Fit many models, take the best of each rank, jackknife those of `ranks`: (all, best, replicas). With `digits`, errors that agree to so many places are equal."""
    fitted = cp_concurrent(x, meta, models, params).persist()
    best = best_per_rank(fitted.select("model_id", "components", "error"), digits).withColumnRenamed("error", "best_error")
    chosen = fitted.join(F.broadcast(best.select("model_id")), "model_id")  # one row for each rank
    return fitted, best, jackknife(x, meta, chosen.where(F.col("components").isin(ranks)), replace(params))


__all__ = ["hybrid", "jackknife", "jackknife_by_deletion", "leave_out", "prepared"]
