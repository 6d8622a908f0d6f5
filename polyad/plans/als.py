"""Alternating least squares for one and for many models.

`fit_fused` is the arithmetic: all admitted models stand side by side in one buffer of columns; in each sweep and
mode one product of the tensor serves them all, and waiting models are admitted, first come first served, as
finished ones leave. What multiplies the tensor is a function, so the same code runs on an array inside one task
and on the driver over slabs that executors hold (for tensors over the broadcast limit): then each sweep and mode
is one job that returns sums of the size of one factor for each model.

On arrays, models stay together in one task, and so in one buffer, until their work is worth more than one task
(`planner.groups_for`); then they are dealt over tasks, each with its share of the buffer. No model's result depends on this.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad import schema as S
from polyad.functions import kernels as K
from polyad.plans.buffer import ColumnBuffer
from polyad.plans.planner import choose, fits, groups_for, mttkrp_flops, strategy
from polyad.sources.tensors import to_array


@dataclass(frozen=True)
class Params:
    update_method: str = "unconstrained"  # or nnls
    mttkrp_method: str = "auto"
    max_iterations: int = 200
    tol: float = 1e-7
    line_search: bool = False
    ls_interval: int = 5
    ls_step: float = 0.0  # 0: cube root of the model's iterations
    ls_method: str = "no_error_checking"  # error_checking and error_checking_parallel compute the error first
    force_max_iter: bool = False
    buffer_size: int = 4200
    always_evict_first: bool = False
    lut: dict | None = None  # mode: {columns: number of the method}; consulted by `auto`
    suppress_lut_warning: bool = True

    def __post_init__(self):
        for name, allowed in (("update_method", ("unconstrained", "nnls")), ("mttkrp_method", ("mttkrp", "twostep0", "twostep1", "auto")), ("ls_method", ("no_error_checking", "error_checking", "error_checking_parallel"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        for name, least in (("max_iterations", 1), ("buffer_size", 1), ("tol", 0), ("ls_interval", 2), ("ls_step", 0)):
            if not getattr(self, name) >= least:
                raise ValueError(f"{name} must be at least {least}")
        if self.mttkrp_method == "auto" and not self.lut and not self.suppress_lut_warning:
            import warnings

            warnings.warn("no look-up table; methods are chosen by the size of intermediate results", stacklevel=3)

    def method(self, modes: tuple[int, ...], n: int, columns: int) -> str:
        return choose(modes, n, self.mttkrp_method, (self.lut or {}).get(n), columns)

    @classmethod
    def from_options(cls, *options) -> Params:
        """From names and values as on a command line: `update-method nnls`, `tol 1e-5`, `ls`, `no-ls`, `no-cuda`."""
        names = {"update-method": ("update_method", str), "mttkrp-method": ("mttkrp_method", str), "maxiters": ("max_iterations", int), "buffer-size": ("buffer_size", int), "tol": ("tol", float), "ls-interval": ("ls_interval", int), "ls-step": ("ls_step", float), "ls-method": ("ls_method", str)}
        given: dict = {}
        rest = list(options)
        while rest:
            name = rest.pop(0)
            if name in ("ls", "no-ls"):
                given["line_search"] = name == "ls"
            elif name == "force-max-iter":
                given["force_max_iter"] = True
            elif name in ("cuda", "no-cuda"):
                if name == "cuda":
                    import warnings

                    warnings.warn("there is no GPU path; the option is ignored", stacklevel=2)
            elif name in names and rest:
                key, kind = names[name]
                given[key] = kind(rest.pop(0))
            else:
                raise ValueError(f"unknown option {name}")
        return cls(**given)


@dataclass
class Model:
    id: int
    factors: list[np.ndarray]
    lam: np.ndarray
    jk_mode: int | None = None
    jk_fiber: int | None = None
    iters: int = 0
    fit: float = 0.0
    old_fit: float = 0.0
    error: float = float("nan")
    status: str = "queued"
    active: list[np.ndarray] = field(default_factory=list)
    history: list[tuple[int, float, float, float]] = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)
    ls_count: int = 0
    pending: bool = False
    previous: Model | None = None
    backup: Model | None = None
    extrapolated: int = 0
    reverted: int = 0
    rises: int = 0

    @property
    def rank(self) -> int:
        return len(self.lam)

    def snapshot(self) -> Model:
        return replace(self, factors=[f.copy() for f in self.factors], lam=self.lam.copy(), active=[a.copy() for a in self.active], previous=None, backup=None, history=[], grams=[])

    def refresh(self) -> None:
        self.grams = [K.gramian(f) for f in self.factors]

    def new_fit(self, norm: float) -> None:
        self.old_fit, self.fit = self.fit, 1 - abs(self.error) / norm if norm else 0.0


def _line_search(model: Model, params: Params, norm: float, explicit: Callable[[np.ndarray, list[np.ndarray]], float]) -> None:
    checked = params.ls_method != "no_error_checking"
    if not checked and model.iters >= params.max_iterations:
        return
    step = params.ls_step or np.cbrt(model.iters)
    model.ls_count += 1
    if not checked and model.pending:
        model.pending = False
        if model.backup.error < model.error:
            b = model.backup
            model.factors, model.lam, model.fit, model.old_fit, model.error, model.iters, model.active = b.factors, b.lam, b.fit, b.old_fit, b.error, b.iters, b.active
            model.refresh()
            model.ls_count = 0
            model.reverted += 1
    if model.ls_count != params.ls_interval or model.previous is None:
        return
    model.ls_count = 0
    model.extrapolated += 1
    if checked:
        moved = [u + step * (u - p) for u, p in zip(model.factors, model.previous.factors, strict=True)]
        error = explicit(model.lam, moved)
        if error < model.error:
            lam, moved = K.normalize(K.denormalize(model.lam, moved))
            model.lam, model.factors, model.error = lam, moved, error
            model.new_fit(norm)
            model.refresh()
        else:
            model.reverted += 1
        return
    model.pending, model.backup = True, model.snapshot()
    now, before = K.denormalize(model.lam, model.factors), K.denormalize(model.previous.lam, model.previous.factors)
    model.lam, model.factors = K.normalize([u + step * (u - p) for u, p in zip(now, before, strict=True)])
    model.error = float(np.finfo(float).max)
    model.new_fit(1.0)
    model.refresh()


def fit_fused(
    product: Callable[[list[np.ndarray], int, str], np.ndarray],
    models: Iterable[Model],
    params: Params,
    modes: tuple[int, ...],
    x_norm: float,
    slice_norm: Callable[[int, int], float] = lambda mode, fiber: float("nan"),
    explicit: Callable[[np.ndarray, list[np.ndarray]], float] | None = None,
) -> tuple[list[Model], list[dict]]:
    """Fits all models; `product(factors, n, method)` is the tensor times all factors but n, for any number of columns.

    Models are taken from `models` one by one as there is room, so it may make them when asked. Also returned: a
    row for each sweep with its models, columns, FLOPs of the products, seconds by step and line searches.
    """
    queue, resident, done, report = iter(models), [], [], []
    waiting = next(queue, None)
    buffer = ColumnBuffer(modes, params.buffer_size)
    last, sweep = len(modes) - 1, 0
    clock = time.perf_counter
    while waiting or resident:
        while waiting:
            if waiting.rank > params.buffer_size:
                raise ValueError("a model is wider than the buffer")
            if not buffer.add(waiting.id, waiting.factors):
                break
            waiting.iters, waiting.status = waiting.iters + 1, "active"  # a model that has been fitted before goes on
            waiting.active = waiting.active or [np.ones(f.shape, bool) for f in waiting.factors]
            waiting.refresh()
            resident.append(waiting)
            waiting = next(queue, None)
        sweep += 1
        began = clock()
        columns = buffer.width
        row = {"iter": sweep, "models": len(resident), "cols": columns, "flops": 0, "defrag": 0.0, "error": 0.0, "line_search": 0.0, "mttkrp": [], "update": [], "extrapolated": 0, "reverted": 0}
        for m in resident:
            if params.line_search and m.ls_count == params.ls_interval - 1:
                m.previous = m.snapshot()
        for n in range(len(modes)):
            method = params.method(modes, n, columns)
            start = clock()
            g_all = product(buffer.active(), n, method)
            row["mttkrp"].append(clock() - start)
            row["flops"] += mttkrp_flops(modes, n, columns, method)
            start, errors = clock(), 0.0
            for m in resident:
                g = g_all[:, buffer.columns(m.id)]
                h = K.hadamard(m.grams, n)
                if params.update_method == "nnls":
                    new, regular = K.nnls(g, h, m.active[n])
                else:
                    new, regular = K.solve_spd(g, h)
                if not regular:
                    m.status = "singular"
                if m.jk_mode == n:
                    new[m.jk_fiber] = 0.0
                m.lam, m.factors[n] = K.normalize_mode(new, m.iters)
                m.grams[n] = K.gramian(m.factors[n])
                buffer.write(m.id, n, m.factors[n])
                if n == last:
                    since = clock()
                    own = x_norm if m.jk_mode is None else slice_norm(m.jk_mode, m.jk_fiber)
                    before = m.error
                    m.error = K.fast_error(own, m.lam, m.factors[n], g, K.hadamard(m.grams))
                    m.rises += bool(m.error > before + 1e-4)
                    m.new_fit(x_norm)
                    m.history.append((m.iters, m.error, m.fit, abs(m.old_fit - m.fit)))
                    errors += clock() - since
            row["update"].append(clock() - start - errors)
            row["error"] += errors
        if params.line_search:
            start = clock()
            for m in resident:
                counts = m.extrapolated, m.reverted
                _line_search(m, params, x_norm, explicit)
                row["extrapolated"] += m.extrapolated - counts[0]
                row["reverted"] += m.reverted - counts[1]
                if counts != (m.extrapolated, m.reverted):
                    for n, f in enumerate(m.factors):
                        buffer.write(m.id, n, f)
            row["line_search"] = clock() - start
        stay, first = [], buffer.leftmost()
        for m in resident:
            close = not params.force_max_iter and abs(m.old_fit - m.fit) < params.tol
            if close or m.iters >= params.max_iterations or params.always_evict_first and m.id == first:
                m.status = "singular" if m.status == "singular" else "converged" if close else "stopped"
                m.previous = m.backup = None
                buffer.remove(m.id)
                done.append(m)
            else:
                m.iters += 1
                stay.append(m)
        start = clock()
        buffer.compress()
        row["defrag"] = clock() - start
        report.append(row | {"seconds": clock() - began})
        resident = stay
    return sorted(done, key=lambda m: m.id), report


def array_product(x: np.ndarray) -> Callable[[list[np.ndarray], int, str], np.ndarray]:
    return lambda factors, n, method: K.mttkrp(x, factors, n, method)


def fit_array(x: np.ndarray, models: Iterable[Model], params: Params) -> tuple[list[Model], list[dict]]:
    squares = [np.square(x).sum(axis=tuple(a for a in range(x.ndim) if a != m)) for m in range(x.ndim)]
    total = float(np.square(x).sum())
    return fit_fused(
        array_product(x), models, params, x.shape, np.sqrt(total),
        lambda mode, fiber: float(np.sqrt(max(total - squares[mode][fiber], 0.0))),
        lambda lam, factors: float(np.linalg.norm(x - K.reconstruct(lam, factors))),
    )


# --- Spark -----------------------------------------------------------------------------------------------------


RESULT = (
    "model_id int, components int, jk_mode int, jk_fiber int, iters int, fit double, old_fit double, error double, status string, extrapolated int, reverted int, rises int, "
    "weights array<double>, factors array<array<array<double>>>, history array<struct<iter: int, error: double, fit: double, fit_diff: double>>, "
    "sweeps array<struct<iter: int, models: int, cols: int, flops: bigint, seconds: double, defrag: double, error: double, line_search: double, mttkrp: array<double>, update: array<double>, extrapolated: int, reverted: int>>"
)
_SWEEP = ("iter", "models", "cols", "flops", "seconds", "defrag", "error", "line_search", "mttkrp", "update", "extrapolated", "reverted")


def result_rows(models: list[Model], report: list[dict] | None = None):
    """A row for each model; the report of the sweeps they shared goes with the first."""
    import pandas as pd

    swept = [{k: row[k] for k in _SWEEP} for row in report] if report else None
    return pd.DataFrame(
        {
            "model_id": [m.id for m in models],
            "components": [m.rank for m in models],
            "jk_mode": pd.array([m.jk_mode for m in models], "Int32"),
            "jk_fiber": pd.array([m.jk_fiber for m in models], "Int32"),
            "iters": [m.iters for m in models],
            "fit": [m.fit for m in models],
            "old_fit": [m.old_fit for m in models],
            "error": [m.error for m in models],
            "status": [m.status for m in models],
            "extrapolated": [m.extrapolated for m in models],
            "reverted": [m.reverted for m in models],
            "rises": [m.rises for m in models],
            "weights": [m.lam.tolist() for m in models],
            "factors": [[f.tolist() for f in m.factors] for m in models],
            "history": [[{"iter": i, "error": e, "fit": f, "fit_diff": d} for i, e, f, d in m.history] for m in models],
            "sweeps": pd.Series([swept if i == 0 else None for i in range(len(models))], dtype=object),
        }
    )


def _given(value):
    """A value from pandas, with None for its many nothings."""
    import pandas as pd

    if isinstance(value, list | np.ndarray):
        return value
    if isinstance(value, np.generic):
        value = value.item()
    return None if value is None or value is pd.NA or value != value else value


def start_model(spec: dict, modes: tuple[int, ...]) -> Model:
    """From a row `(model_id, components, seed[, jk_mode, jk_fiber][, factors[, weights]])`; seed null: the closed-form start.

    Given weights are folded into mode 0 and the columns scaled anew, as a fit starts from unit columns.
    """
    if spec.get("factors") is not None:
        factors = [np.array([list(r) for r in f], float) for f in spec["factors"]]
        lam = np.ones(factors[0].shape[1])
        if spec.get("weights") is not None:
            lam, factors = K.normalize(K.denormalize(np.array(list(spec["weights"]), float), factors))
    elif spec.get("seed") is None:
        lam, factors = K.sine_model(modes, spec["components"], spec["model_id"])
    else:
        lam, factors = K.random_model(modes, spec["components"], spec["seed"])
    jk = [None if spec.get(k) is None or spec[k] != spec[k] else int(spec[k]) for k in ("jk_mode", "jk_fiber")]
    return Model(int(spec["model_id"]), factors, lam, *jk)


def _local(x: DataFrame, meta: S.TensorMeta, models: DataFrame, params: Params, groups: int | None) -> DataFrame:
    """All models in one job: the tensor goes to the executors, each task fits a share of the models together."""
    spark = x.sparkSession
    sent = spark.sparkContext.broadcast(to_array(x, meta))
    modes = meta.modes
    given = list(models.columns)
    if groups is None:
        sizes = models.agg(F.coalesce(F.sum("components"), F.lit(0)).alias("all"), F.coalesce(F.max("components"), F.lit(1)).alias("most")).first()
        groups = groups_for(meta.n_elements, sizes["all"], spark.sparkContext.defaultParallelism)
        if groups > 1:
            params = replace(params, buffer_size=max(-(-params.buffer_size // groups), min(sizes["most"], params.buffer_size)))

    def run(batches):
        specs = sorted(({k: _given(v) for k, v in row.items()} for pdf in batches for row in pdf[given].to_dict("records")), key=lambda r: r["model_id"])
        if specs:
            yield result_rows(*fit_array(sent.value, (start_model(r, modes) for r in specs), params))

    dealt = models.coalesce(1) if groups == 1 else models.repartition(groups, "model_id")
    return dealt.mapInPandas(run, RESULT)


def slabs(x: DataFrame, meta: S.TensorMeta, cells: int = 1 << 20) -> DataFrame:
    """`(slab, vals)`: the tensor cut along its last mode into dense slabs of about so many cells."""
    per = max(1, cells // (meta.n_elements // meta.modes[-1]))
    last = meta.index_columns[-1]
    from polyad.operators.algebra import linear

    place = linear(meta.index_columns, list(meta.modes))
    return x.where("val != 0").groupBy(F.floor(F.col(last) / per).cast("int").alias("slab")).agg(F.collect_list(F.struct(place.alias("at"), "val")).alias("vals")).withColumn("per", F.lit(per))


def _blocks(batches, modes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, int, int]]:
    """Dense slabs with their range of the last mode."""
    below = int(np.prod(modes[:-1]))
    for pdf in batches:
        for slab, vals, per in zip(pdf["slab"], pdf["vals"], pdf["per"], strict=True):
            low = slab * per
            high = min(low + per, modes[-1])
            block = np.zeros(below * (high - low))
            block[np.array([v["at"] for v in vals]) - low * below] = [v["val"] for v in vals]
            yield block.reshape(*modes[:-1], high - low, order="F"), low, high


def slab_product(held: DataFrame, meta: S.TensorMeta) -> Callable[[list[np.ndarray], int, str], np.ndarray]:
    """One job for each call: partial products by slab, summed by row before they come to the driver."""
    spark, modes = held.sparkSession, meta.modes

    def product(factors: list[np.ndarray], n: int, method: str) -> np.ndarray:
        sent = spark.sparkContext.broadcast(factors)
        columns = factors[0].shape[1]

        def run(batches):
            import pandas as pd

            total = np.zeros((modes[n], columns))
            for block, low, high in _blocks(batches, modes):
                part = K.mttkrp(block, [*sent.value[:-1], sent.value[-1][low:high]], n, method)
                if n == len(modes) - 1:
                    total[low:high] += part
                else:
                    total += part
            yield pd.DataFrame({"row": np.arange(modes[n], dtype=np.int32), "vec": list(total)})

        parts = held.mapInPandas(run, "row int, vec array<double>")
        summed = parts.select("row", F.posexplode("vec").alias("c", "v")).groupBy("row", "c").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros((modes[n], columns))
        out[summed["row"].to_numpy(), summed["c"].to_numpy()] = summed["v"].to_numpy()
        sent.unpersist()
        return out

    return product


def _squares(held: DataFrame, modes: tuple[int, ...]) -> list[np.ndarray]:
    """Sums of squares of all slices of all modes, in one pass over the slabs."""

    def run(batches):
        import pandas as pd

        sums = [np.zeros(i) for i in modes]
        for block, low, high in _blocks(batches, modes):
            square = np.square(block)
            for m in range(len(modes)):
                part = square.sum(axis=tuple(a for a in range(len(modes)) if a != m))
                sums[m][slice(low, high) if m == len(modes) - 1 else slice(None)] += part
        for m, s in enumerate(sums):
            yield pd.DataFrame({"mode": np.full(len(s), m, np.int32), "at": np.arange(len(s), dtype=np.int32), "s": s})

    found = held.mapInPandas(run, "mode int, at int, s double").groupBy("mode", "at").agg(F.sum("s").alias("s")).toArrow()
    out = [np.zeros(i) for i in modes]
    for m in range(len(modes)):
        own = found["mode"].to_numpy() == m
        out[m][found["at"].to_numpy()[own]] = found["s"].to_numpy()[own]
    return out


def cp_concurrent(x: DataFrame, meta: S.TensorMeta, models: DataFrame, params: Params = Params(), where: str | None = None, groups: int | None = None) -> DataFrame:  # noqa: B008
    """All models share the passes over the tensor. `models(model_id, components, seed[, jk_mode, jk_fiber][, factors[, weights]])`."""
    if len(meta.modes) < 3:
        raise ValueError("a tensor has three modes at least")
    if (where or strategy(meta.n_elements)) == "local":
        return _local(x, meta, models, params, groups)
    held = slabs(x, meta).persist()
    squares = _squares(held, meta.modes)
    total = float(squares[0].sum())
    product = slab_product(held, meta)

    def explicit(lam, factors):
        # from the algebraic form: exact up to rounding, without writing the model out
        g = product(factors, len(factors) - 1, params.method(meta.modes, len(factors) - 1, len(lam)))
        return K.fast_error(np.sqrt(total), lam, factors[-1], g, K.hadamard([K.gramian(f) for f in factors]))

    # one model at a time is read and started, as the buffer has room for it
    specs = (start_model(r.asDict(recursive=True), meta.modes) for r in models.orderBy("model_id").toLocalIterator())
    done, report = fit_fused(product, specs, params, meta.modes, float(np.sqrt(total)), lambda m, f: float(np.sqrt(max(total - squares[m][f], 0.0))), explicit)
    held.unpersist()
    rows = [[_given(v) for v in row] for row in result_rows(done, report).itertuples(index=False)]
    rows = [[_given(v) for v in row] for row in result_rows(done, report).itertuples(index=False)]
    return x.sparkSession.createDataFrame(rows, RESULT)


def cp_als_many(x: DataFrame, meta: S.TensorMeta, models: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """Each model for itself, many at once: one task for each model. A tensor over the broadcast limit is held in slabs, whose
    passes models share; no model's result depends on that."""
    if not fits(meta.n_elements):
        return cp_concurrent(x, meta, models, params, "slabs")
    spark = x.sparkSession
    sent = spark.sparkContext.broadcast(to_array(x, meta))
    modes = meta.modes

    def run(pdf):
        import pandas as pd

        return pd.concat([result_rows(*fit_array(sent.value, [start_model({k: _given(v) for k, v in row.items()}, modes)], params)) for row in pdf.to_dict("records")])

    return models.groupBy("model_id").applyInPandas(run, RESULT)


def cp_als_serial(x: DataFrame, meta: S.TensorMeta, models: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """One model after another in one task: what the others are measured against."""
    spark = x.sparkSession
    sent = spark.sparkContext.broadcast(to_array(x, meta))
    modes = meta.modes

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield result_rows(*fit_array(sent.value, [start_model({k: _given(v) for k, v in row.items()}, modes)], params))

    return models.coalesce(1).mapInPandas(run, RESULT)


def cp_als(x: DataFrame, meta: S.TensorMeta, components: int, seed: int | None = None, params: Params = Params()) -> DataFrame:  # noqa: B008
    """One model."""
    spark = x.sparkSession
    return cp_concurrent(x, meta, model_list(spark, [(0, components, seed)]), params)


def model_list(spark: SparkSession, rows: list[tuple[int, int, int | None]]) -> DataFrame:
    return spark.createDataFrame(rows, "model_id int, components int, seed int")


def ranks_and_copies(low: int, high: int, copies: int) -> list[int]:
    return [r for r in range(low, high + 1) for _ in range(copies)]


def shuffled(models: DataFrame, seed: int) -> DataFrame:
    """Models in an order that depends on the seed alone."""
    return models.orderBy(F.xxhash64(F.lit(seed), "model_id"), "model_id")


def models_of(results: DataFrame) -> DataFrame:
    return results.select("model_id", "components", "jk_mode", "jk_fiber", "iters", "fit", "old_fit", "error", "status")


def factors_of(results: DataFrame) -> DataFrame:
    modes = results.select("model_id", F.posexplode("factors").alias("mode", "f"))
    rows = modes.select("model_id", "mode", F.posexplode("f").alias("row", "r"))
    return rows.select("model_id", "mode", "row", F.posexplode("r").alias("comp", "val"))


def weights_of(results: DataFrame) -> DataFrame:
    return results.select("model_id", F.posexplode("weights").alias("comp", "val"))


def history_of(results: DataFrame) -> DataFrame:
    return results.select("model_id", F.explode("history").alias("h")).select("model_id", "h.*")


def sweeps_of(results: DataFrame) -> DataFrame:
    """The report: a row for each sweep of each group of models that were fitted together (named by its least model)."""
    return results.where("sweeps is not null").select(F.col("model_id").alias("fit_id"), F.explode("sweeps").alias("s")).select("fit_id", "s.*")
