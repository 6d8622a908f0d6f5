"""Models that arrive as a stream are fitted in micro-batches, or go on being fitted from one to the next.

Each micro-batch is one pass of the fused fit over its models, which changes no model's result: a model's
result does not depend on what it is fitted with. Results are appended under the batch's number, so a batch
that is run again after a failure overwrites its own folder and nothing is written twice.

`refine` keeps each model's factors as state of the stream: every request adds sweeps to its model, and a model
that got its sweeps in several batches is the one that would have got them at once.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from polyad.plans.als import Model, Params, cp_concurrent, fit_array, models_of, start_model
from polyad.schema import TensorMeta
from polyad.sources.tensors import to_array

MODEL_STREAM = "model_id int, components int, seed int"


def fit_stream(x: DataFrame, meta: TensorMeta, models: DataFrame, path: str, checkpoint: str, params: Params = Params()) -> StreamingQuery:  # noqa: B008
    """Fit `models`, a streaming DataFrame of MODEL_STREAM; results are Parquet below `path`."""

    def run(batch: DataFrame, number: int) -> None:
        models_of(cp_concurrent(x, meta, batch, params)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return models.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of models as a stream."""
    return spark.readStream.schema(MODEL_STREAM).json(path)


REQUESTS = "model_id int, components int, seed int, sweeps int"
_STATE = "iters int, fit double, error double, weights array<double>, factors array<double>"


def refine(x: DataFrame, meta: TensorMeta, requests: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """From a stream of REQUESTS `(model_id, components, iters, error, fit)` of the models that got sweeps, in update mode.

    State is one model's factors and weights; a model's components and start are those of its first request.
    """
    spark, modes = x.sparkSession, meta.modes
    sent = spark.sparkContext.broadcast(to_array(x, meta))

    def run(key, batches, state):
        import pandas as pd

        rows = pd.concat(list(batches))
        sweeps = int(rows["sweeps"].sum())
        if state.exists:
            iters, fit, error, weights, flat = state.get
            lam = np.array(weights)
            cuts = np.cumsum([i * len(lam) for i in modes])[:-1]
            factors = [f.reshape(i, len(lam)) for f, i in zip(np.split(np.array(flat), cuts), modes, strict=True)]
            model = Model(int(key[0]), factors, lam, iters=iters, fit=fit, error=error)
        else:
            first = rows.iloc[0]
            model = start_model({"model_id": int(key[0]), "components": int(first["components"]), "seed": None if pd.isna(first["seed"]) else int(first["seed"])}, modes)
        if sweeps > 0:
            model = fit_array(sent.value, [model], replace(params, max_iterations=model.iters + sweeps, force_max_iter=True))[0][0]
            state.update((model.iters, float(model.fit), float(model.error), model.lam.tolist(), np.concatenate([f.ravel() for f in model.factors]).tolist()))
        yield pd.DataFrame({"model_id": [model.id], "components": [model.rank], "iters": [model.iters], "error": [model.error], "fit": [model.fit]})

    return requests.groupBy("model_id").applyInPandasWithState(run, "model_id int, components int, iters int, error double, fit double", _STATE, "update", "NoTimeout")
