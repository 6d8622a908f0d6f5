"""Queries over the driver's tables, one for each operator; `polyad.oracles` has the same in SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.operators import algebra as A
from polyad.plans import als, jackknife, planner
from polyad.schema import TensorMeta
from polyad.sources import reports, tensors


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, d: str) -> tuple[DataFrame, TensorMeta]:
    """Quantity by supplier nation, part type and month of shipping."""
    part, supplier, nation = _read(spark, d, "part"), _read(spark, d, "supplier"), _read(spark, d, "nation")
    lines = _read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    flat = lines.join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    dims = [(F.col("s_nationkey"), tensors.domain(nation, F.col("n_nationkey"))), (F.col("p_type"), tensors.domain(part, F.col("p_type"))), (F.month("l_shipdate"), list(range(1, 13)))]
    return tensors.from_table(flat, dims, F.col("l_quantity"))


def sales4(spark: SparkSession, d: str) -> tuple[DataFrame, TensorMeta]:
    """Quantity by region, part type, return flag and year of shipping."""
    part, supplier, nation = _read(spark, d, "part"), _read(spark, d, "supplier"), _read(spark, d, "nation")
    lines = _read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    flat = lines.join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    flat = flat.join(nation.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    years = tensors.domain(lines, F.year("l_shipdate"))
    dims = [(F.col("n_regionkey"), tensors.domain(nation, F.col("n_regionkey"))), (F.col("p_type"), tensors.domain(part, F.col("p_type"))), (F.col("l_returnflag"), tensors.domain(lines, F.col("l_returnflag"))), (F.year("l_shipdate"), years)]
    return tensors.from_table(flat, dims, F.col("l_quantity"))


def events(spark: SparkSession, d: str) -> tuple[DataFrame, TensorMeta]:
    """Value by last digit of the user, event type and hour."""
    rows = _read(spark, d, "events").select("user_id", "event_type", "ts", "value")
    dims = [((F.col("user_id") % 10).cast("int"), list(range(10))), (F.col("event_type"), tensors.domain(rows, F.col("event_type"))), (F.hour("ts"), list(range(24)))]
    return tensors.from_table(rows, dims, F.col("value"))


def embeddings(spark: SparkSession, d: str) -> tuple[DataFrame, TensorMeta]:
    """Mean element by label and place in an 8 x 8 grid."""
    rows = _read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "v"))
    dims = [(F.col("label"), tensors.domain(_read(spark, d, "embeddings"), F.col("label"))), (F.floor(F.col("k") / 8).cast("int"), list(range(8))), (F.col("k") % 8, list(range(8)))]
    return tensors.from_table(rows, dims, F.col("v").cast("double"), "avg")


def out(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as int and doubles rounded, so that the order of sums does not show."""
    cols = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            cols.append((F.round(F.col(name).cast("double"), digits) + F.lit(0.0)).alias(name))
        elif kind in ("bigint", "int", "smallint", "tinyint"):
            cols.append(F.col(name).cast("int").alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def factors(spark: SparkSession, meta: TensorMeta, ranks: dict[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    return A.normalize(A.sine_factors(spark, meta.modes, ranks or {0: 3}))


QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def tensor_from_table(s, d):
    return out(sales(s, d)[0], 2)


@query
def tensor_4d_from_table(s, d):
    return out(sales4(s, d)[0], 2)


@query
def tensor_events(s, d):
    return out(events(s, d)[0], 4)


@query
def tensor_embeddings(s, d):
    return out(embeddings(s, d)[0], 6)


@query
def tensor_norm(s, d):
    return out(A.norm(sales(s, d)[0]), 4)


@query
def tensor_min(s, d):
    return out(A.minimum(sales(s, d)[0]), 4)


@query
def tensor_masked_max(s, d):
    x, m = sales(s, d)
    return out(A.masked_max(x, F.col("i2") % 2 == 0, A.linear(m.index_columns, list(m.modes))), 4)


@query
def tensor_fill(s, d):
    return out(tensors.fill(s, (4, 3, 5), F.col("i0") + 10 * F.col("i1") + 100 * F.col("i2")), 2)


@query
def tensor_element(s, d):
    return out(A.element(sales(s, d)[0], 3, 2, 5), 4)


@query
def tensor_mode_string(s, d):
    return s.createDataFrame([(sales(s, d)[1].label(), sales4(s, d)[1].label())], "sales string, sales4 string")


def _unfold(s, d, n):
    x, m = sales(s, d)
    return out(A.unfold(x, m.modes, n), 2)


for _n in range(3):
    QUERIES[f"unfold_mode{_n}"] = partial(_unfold, n=_n)


@query
def unfold_4d_mode2(s, d):
    x, m = sales4(s, d)
    return out(A.unfold(x, m.modes, 2), 2)


@query
def matrix_transpose(s, d):
    x, m = sales(s, d)
    return out(A.transpose(A.unfold(x, m.modes, 1)), 2)


@query
def matrix_resize(s, d):
    x, m = sales(s, d)
    return out(A.resize(A.unfold(x, m.modes, 0), 10, 20), 2)


@query
def matrix_one_norm(s, d):
    x, m = sales(s, d)
    return out(A.one_norm(A.unfold(x, m.modes, 0)), 4)


@query
def matrix_hadamard(s, d):
    x, m = sales(s, d)
    a = A.unfold(x, m.modes, 0)
    return out(A.hadamard(a, a.withColumn("val", F.col("val") + 1)), 2)


@query
def factor_init(s, d):
    return out(A.sine_factors(s, sales(s, d)[1].modes, {0: 3, 1: 2}))


@query
def factor_normalize(s, d):
    f, _ = factors(s, sales(s, d)[1], {0: 3, 1: 2})
    return out(f)


@query
def factor_weights(s, d):
    return out(factors(s, sales(s, d)[1], {0: 3, 1: 2})[1])


@query
def factor_normalize_maxabs(s, d):
    f, _ = factors(s, sales(s, d)[1])
    return out(A.normalize_mode(f, 0, 2)[0])


@query
def factor_normalize_first(s, d):
    return out(A.normalize_mode(A.sine_factors(s, sales(s, d)[1].modes, {0: 3}), 1, 1)[0])


@query
def factor_denormalize(s, d):
    return out(A.denormalize(*factors(s, sales(s, d)[1])))


@query
def factor_extrapolate(s, d):
    f, _ = factors(s, sales(s, d)[1])
    return out(A.extrapolate(f, f.withColumn("val", F.col("val") * 0.9), 1.5))


@query
def gramian(s, d):
    return out(A.gramian(factors(s, sales(s, d)[1], {0: 3, 1: 2})[0]))


@query
def hadamard_all(s, d):
    return out(A.hadamard_all(A.gramian(factors(s, sales(s, d)[1])[0])))


@query
def hadamard_but_one(s, d):
    return out(A.hadamard_all(A.gramian(factors(s, sales(s, d)[1])[0]), 1))


@query
def khatri_rao_pair(s, d):
    m = sales(s, d)[1]
    f, _ = factors(s, m)
    return out(A.khatri_rao(A.mode_of(f, 2), A.mode_of(f, 1), m.modes[1]))


@query
def khatri_rao_4d(s, d):
    m = sales4(s, d)[1]
    return out(A.khatri_rao_but(factors(s, m)[0], m.modes, 1))


def _mttkrp(s, d, n, method):
    x, m = sales(s, d)
    return out(A.mttkrp(x, factors(s, m)[0], m.modes, n, method), 3)


for _n in range(3):
    for _method, _name in (("mttkrp", f"mttkrp_mode{_n}"), ("twostep0", f"mttkrp_twostep0_mode{_n}"), ("twostep1", f"mttkrp_twostep1_mode{_n}"), ("auto", f"mttkrp_auto_mode{_n}")):
        QUERIES[_name] = partial(_mttkrp, n=_n, method=_method)


@query
def mttkrp_4d(s, d):
    x, m = sales4(s, d)
    return out(A.mttkrp(x, factors(s, m)[0], m.modes, 2), 3)


@query
def mttkrp_multi_model(s, d):
    x, m = sales(s, d)
    return out(A.mttkrp(x, factors(s, m, {0: 3, 1: 1, 2: 2})[0], m.modes, 0, "twostep1"), 3)


@query
def reconstruct(s, d):
    m = sales(s, d)[1]
    return out(A.reconstruct(*factors(s, m), 3))


@query
def residual(s, d):
    x, m = sales(s, d)
    return out(A.subtract(x, A.reconstruct(*factors(s, m), 3).drop("model_id")), 3)


def _errors(s, d, n_models=2):
    x, m = sales(s, d)
    f, w = factors(s, m, {0: 3, 1: 2})
    return x, m, f, w


@query
def error_fast(s, d):
    x, m, f, w = _errors(s, d)
    return out(A.fast_error(x, f, w, A.mttkrp(x, f, m.modes, 2), 3), 3)


@query
def error_explicit(s, d):
    x, m, f, w = _errors(s, d)
    return out(A.explicit_error(x, f, w, 3), 3)


def _sparse(s, d):
    """A fifth of the cells of the sales tensor; the others are absent, that is zero."""
    x, m, f, w = _errors(s, d)
    return x.where("(i0 + 2 * i1 + 3 * i2) % 5 = 0"), m, f, w


@query
def error_fast_sparse(s, d):
    x, m, f, w = _sparse(s, d)
    return out(A.fast_error(x, f, w, A.mttkrp(x, f, m.modes, 2), 3), 3)


@query
def error_explicit_sparse(s, d):
    x, m, f, w = _sparse(s, d)
    return out(A.explicit_error(x, f, w, 3), 3)


@query
def set_factor(s, d):
    f, _ = factors(s, sales(s, d)[1], {0: 2, 1: 2})
    return out(A.set_factor(f, 1, A.mode_of(f.where("model_id = 1"), 1).withColumn("val", F.col("val") * 2)))


@query
def set_weights(s, d):
    _, w = factors(s, sales(s, d)[1], {0: 2, 1: 2})
    return out(A.set_weights(w, w.where("model_id = 0").withColumn("val", F.lit(1.0))))


@query
def matrix_fill(s, d):
    return out(tensors.matrix(s, 4, 3, F.col("row") + 10 * F.col("col")))


@query
def component_list(s, d):
    """Each rank from 2 to 4 three times, as models."""
    return als.model_list(s, [(i, r, None) for i, r in enumerate(als.ranks_and_copies(2, 4, 3))]).select("model_id", "components")


@query
def fit(s, d):
    x, m, f, w = _errors(s, d)
    return out(A.fit(A.explicit_error(x, f, w, 3), x), 6)


@query
def jk_norms(s, d):
    return out(A.slice_norms(sales(s, d)[0]), 4)


@query
def jk_slice_removed(s, d):
    return out(A.leave_out(sales(s, d)[0], 4), 2)


@query
def jk_replicas(s, d):
    models = s.createDataFrame([(0,), (3,)], "model_id int")
    return out(A.replicas(models, sales(s, d)[1].modes[0]))


@query
def jk_mask(s, d):
    f, _ = factors(s, sales(s, d)[1])
    return out(A.mask(f, 0, 4, 0.0))


@query
def jk_mask_null(s, d):
    f, _ = factors(s, sales(s, d)[1])
    return out(A.mask(f, 0, 4, None))


@query
def jk_to_regular(s, d):
    f, _ = factors(s, sales(s, d)[1])
    return out(A.to_regular(f, 0, 4))


@query
def jk_concat(s, d):
    f, _ = factors(s, sales(s, d)[1], {4: 2, 7: 2})
    return out(A.concatenate(f, s.createDataFrame([(7, 0), (4, 1)], "model_id int, position int"), 2))


@query
def jk_std(s, d):
    f, _ = factors(s, sales(s, d)[1], {0: 2, 1: 2, 2: 2})
    return out(A.spread(f, []), 8)


@query
def jk_alignment_scores(s, d):
    f, _ = factors(s, sales(s, d)[1], {0: 3, 1: 3})
    return out(A.alignment_scores(f.where("model_id = 0"), f.where("model_id = 1").withColumn("ref_id", F.lit(0))))


def _als(s, d, rank, sweeps, tensor=sales, what="history", **options):
    x, m = tensor(s, d)
    params = als.Params(max_iterations=sweeps, force_max_iter=True, **options)
    r = als.cp_concurrent(x, m, als.model_list(s, [(0, rank, None)]), params)
    if what == "history":
        return out(als.history_of(r).select("iter", "error", "fit"), 4)
    if what == "factors":
        return out(als.factors_of(r).drop("model_id"), 5)
    return out(als.weights_of(r).drop("model_id"), 3)


QUERIES |= {
    "als_rank1": partial(_als, rank=1, sweeps=3),
    "als_rank2": partial(_als, rank=2, sweeps=3),
    "als_rank2_factors": partial(_als, rank=2, sweeps=3, what="factors"),
    "als_rank2_weights": partial(_als, rank=2, sweeps=3, what="weights"),
    "als_nonneg_rank2": partial(_als, rank=2, sweeps=3, update_method="nnls"),
    "als_4d_rank1": partial(_als, rank=1, sweeps=3, tensor=sales4),
    "als_4d_rank2": partial(_als, rank=2, sweeps=2, tensor=sales4),
    "als_events_rank2": partial(_als, rank=2, sweeps=3, tensor=events),
    "als_embeddings_rank2": partial(_als, rank=2, sweeps=3, tensor=embeddings),
    "als_twostep0_rank2": partial(_als, rank=2, sweeps=3, mttkrp_method="twostep0"),
}


@query
def als_slabs_rank2(s, d):
    x, m = sales(s, d)
    r = als.cp_concurrent(x, m, als.model_list(s, [(0, 2, None)]), als.Params(max_iterations=3, force_max_iter=True), where="slabs")
    return out(als.history_of(r).select("iter", "error", "fit"), 4)


@query
def als_many_models(s, d):
    x, m = sales(s, d)
    r = als.cp_als_many(x, m, als.model_list(s, [(0, 1, None), (1, 2, None), (2, 2, None)]), als.Params(max_iterations=2, force_max_iter=True))
    return out(als.models_of(r).select("model_id", "components", "iters", "error", "fit"), 4)


@query
def concurrent_models(s, d):
    x, m = sales(s, d)
    r = als.cp_concurrent(x, m, als.model_list(s, [(0, 1, None), (1, 2, None), (2, 2, None)]), als.Params(max_iterations=2, force_max_iter=True, buffer_size=3))
    return out(als.models_of(r).select("model_id", "components", "iters", "error", "fit"), 4)


@query
def concurrent_als(s, d):
    """The flagship: ranks 1 to 3, two starts each, in one buffer of four columns, so that models wait for room."""
    x, m = sales(s, d)
    models = als.model_list(s, [(i, r, None) for i, r in enumerate(als.ranks_and_copies(1, 3, 2))])
    r = als.cp_concurrent(x, m, models, als.Params(max_iterations=3, force_max_iter=True, buffer_size=4))
    return out(als.models_of(r).select("model_id", "components", "iters", "error", "fit"), 2)


@query
def concurrent_als_converged(s, d):
    """Random starts, to convergence."""
    x, m = sales(s, d)
    models = [(i, r, 10 * r + i) for i, r in enumerate(als.ranks_and_copies(1, 3, 2))]
    return als.models_of(als.cp_concurrent(x, m, als.model_list(s, models), als.Params(tol=1e-5))).select("model_id", "components", "iters", "error", "fit")


@query
def als_line_search(s, d):
    """Checked: an extrapolation is taken if its error is less."""
    return _als(s, d, 2, 4, line_search=True, ls_interval=2, ls_method="error_checking").select("iter", "error")


@query
def als_line_search_unchecked(s, d):
    """Unchecked: an extrapolation is taken, and taken back if the sweep after it is worse."""
    x, m = sales(s, d)
    r = als.cp_concurrent(x, m, als.model_list(s, [(0, 2, None)]), als.Params(max_iterations=4, force_max_iter=True, line_search=True, ls_interval=2))
    return out(r.select("iters", "error", "extrapolated", "reverted"), 4)


@query
def hybrid_best_per_rank(s, d):
    x, m = sales(s, d)
    f, w = factors(s, m, {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 5: 3})
    errors = A.explicit_error(x, f, w, 3).join(w.groupBy("model_id").agg(F.count("*").cast("int").alias("components")), "model_id")
    return out(A.best_per_rank(errors), 3)


@query
def hybrid_fit(s, d):
    """The best of each rank among fitted models, by errors as reported: to four digits, the earliest of equals. Replicas of them are `jk_*`."""
    x, m = sales(s, d)
    models = als.model_list(s, [(0, 1, None), (1, 1, None), (2, 2, None), (3, 2, None)])
    _, best, _ = jackknife.hybrid(x, m, models, [1], als.Params(max_iterations=2, force_max_iter=True), digits=4)
    return out(best.select("components", "model_id", F.col("best_error").alias("error")), 4)


@query
def queue_of_both(s, d):
    """A reference model and leave-one-out models in one queue and buffer."""
    x, m = events(s, d)
    rows = [(0, 1, None, None, None)] + [(1 + j, 1, None, 0, j) for j in range(m.modes[0])]
    models = s.createDataFrame(rows, "model_id int, components int, seed int, jk_mode int, jk_fiber int")
    r = als.cp_concurrent(x, m, models, als.Params(max_iterations=2, force_max_iter=True, buffer_size=5))
    return out(als.models_of(r).select("model_id", "error"), 4)


@query
def jk_fit_std(s, d):
    """Deviation over fitted replicas."""
    x, m = events(s, d)
    r = jackknife.jackknife(x, m, _references(s, x, m), als.Params(max_iterations=2, force_max_iter=True))
    return out(A.spread(als.factors_of(r).where("val is not null"), []), 6)


def _references(s, x, m, rank=1):
    return als.cp_concurrent(x, m, als.model_list(s, [(0, rank, None)]), als.Params(max_iterations=2, force_max_iter=True))


@query
def jk_als_rank1(s, d):
    """Errors of the leave-one-out models after two sweeps."""
    x, m = events(s, d)
    r = jackknife.jackknife(x, m, _references(s, x, m), als.Params(max_iterations=2, force_max_iter=True))
    return out(r.select("jk_fiber", "error"), 4)


@query
def jk_mask_equals_deletion(s, d):
    """Largest difference between the factors of masked and of deleting replicas, rounded."""
    x, m = events(s, d)
    params = als.Params(max_iterations=4, force_max_iter=True)
    ref = _references(s, x, m, 2)
    a, b = (als.factors_of(f(x, m, ref, params)).where("val is not null") for f in (jackknife.jackknife, jackknife.jackknife_by_deletion))
    keys = ["model_id", "mode", "row", "comp"]
    joined = a.join(b.withColumnRenamed("val", "other"), keys, "full")
    return joined.agg(F.count("*").cast("int").alias("n"), (F.max(F.coalesce(F.abs(F.col("val") - F.col("other")), F.lit(1.0))) < 1e-8).alias("equal"))


@query
def lut_lookup(s, d):
    lut = s.createDataFrame([(0, 1, 2), (0, 4, 0), (0, 16, 1), (1, 2, 1), (1, 8, 0)], "mode int, rank int, method int")
    wanted = s.range(1, 21).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("mode"), F.col("id").cast("int").alias("active"))
    return out(planner.lut_lookup(lut, wanted))


def _bench(s):
    """A made-up measurement grid in closed form."""
    grid = s.range(3 * 3 * 5).select((F.col("id") % 3).cast("int").alias("mode"), (F.floor(F.col("id") / 3) % 3).cast("int").alias("method"), (F.floor(F.col("id") / 9) + 1).cast("int").alias("rank"))
    return grid.withColumn("flops", (F.col("rank") * 1000).cast("double")).withColumn("time", 1.0 + F.pmod(F.col("method") * 7 + F.col("rank") * 5 + F.col("mode") * 3, F.lit(11)))


@query
def lut_best_method(s, d):
    return out(planner.best_method(_bench(s)))


@query
def flops_model(s, d):
    m = sales(s, d)[1]
    rows = [(n, r, k, planner.mttkrp_flops(m.modes, n, r, k)) for n in range(3) for r in (1, 5) for k in planner.METHODS]
    return s.createDataFrame(rows, "mode int, rank int, method string, flops bigint")


def _cells(s):
    return s.range(24).select(F.col("id").cast("int").alias("cell"), F.when((F.col("id") % 7 < 3) | (F.col("id") == 12), F.floor(F.col("id") / 7).cast("int")).alias("owner"))


@query
def buffer_first_fit(s, d):
    return out(planner.first_fit(_cells(s), 4))


@query
def buffer_compress(s, d):
    return out(planner.compress(_cells(s)))


def _history(s, d):
    """Iteration reports from the orders table: a model is a priority, an iteration a month."""
    o = _read(s, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("method"), F.month("o_orderdate").alias("iter")).agg(F.count("*").cast("int").alias("cols"), F.sum("o_totalprice").alias("flops"), F.avg("o_totalprice").alias("total"), F.min("o_totalprice").alias("defrag"))


@query
def report_als(s, d):
    return out(reports.fastest(_history(s, d), ["method"], ["total", "defrag"]), 2)


@query
def report_cumflops(s, d):
    return out(reports.cumulative(_history(s, d), ["method"]), 1)


@query
def report_rollup(s, d):
    return out(reports.roll_up(_history(s, d), ["method"]), 2)


@query
def report_defrag_ratio(s, d):
    return out(reports.defrag_ratio(_history(s, d)), 8)


@query
def report_speedup(s, d):
    h = _history(s, d)
    return out(reports.speed_up(h.where("method like '1%'"), h.where("method not like '1%'"), "iter"), 8)


@query
def report_pivot(s, d):
    h = _history(s, d).where("iter <= 3").select("method", F.col("iter").alias("components"), F.col("total").alias("seconds"))
    return out(reports.pivot(h, [1, 2, 3]), 2)


@query
def report_fit_difference(s, d):
    h = _history(s, d).select(F.substring("method", 1, 1).cast("int").alias("model_id"), "iter", (F.col("total") / 1e6).alias("fit"))
    return out(A.fit_difference(h), 6)


@query
def report_timing_stats(s, d):
    return out(reports.timing_stats(_history(s, d), ["method"], "total"), 4)


@query
def report_unpivot(s, d):
    h = _history(s, d).where("iter <= 3").select("method", F.col("iter").alias("components"), F.col("total").alias("seconds"))
    return out(reports.unpivot(reports.pivot(h, [1, 2, 3]), ["method"]), 2)


@query
def report_efficiency(s, d):
    return out(reports.efficiency(_bench(s), 1e4), 8)


@query
def buffer_leftmost(s, d):
    return out(planner.leftmost(_cells(s)))


@query
def report_models(s, d):
    x, m = sales(s, d)
    r = als.cp_concurrent(x, m, als.model_list(s, [(0, 1, None), (1, 2, None), (2, 2, None)]), als.Params(max_iterations=2, force_max_iter=True))
    return out(reports.model_summary(r), 4)


def _queued(s, d):
    x, m = sales(s, d)
    models = als.model_list(s, [(i, r, None) for i, r in enumerate(als.ranks_and_copies(1, 3, 2))])
    params = als.Params(max_iterations=3, force_max_iter=True, buffer_size=4)
    return x, m, models, params


@query
def report_concurrent(s, d):
    """The sweeps of a fused fit whose models wait for room in the buffer."""
    x, m, models, params = _queued(s, d)
    r = reports.concurrent_report(als.cp_concurrent(x, m, models, params), m, params, 1)
    return r.select("TENSOR_MODES", "BUFFER_SIZE", "N_KTENSORS", "KTENSOR_COMP_SUM", "ITER", "COLS", "MODELS", "FLOPS")


@query
def report_run(s, d):
    """The report of models fitted one by one."""
    x, m, models, params = _queued(s, d)
    r = reports.als_report(als.cp_als_many(x, m, models, params), m, params, 1)
    return r.select("TENSOR_MODES", "KTENSOR_ID", "KTENSOR_COMP", "UPDATE_METHOD", "MAX_ITERS", "ITER", "FLOPS")


@query
def report_csv(s, d):
    """That report written to files and read by its schema."""
    x, m, models, params = _queued(s, d)
    reports.write_csv(reports.als_report(als.cp_als_many(x, m, models, params), m, params, 1), path := tensors.scratch(s, "report"))
    r = reports.read_csv(s, path, reports.als_schema(3))
    return r.select("TENSOR_MODES", "KTENSOR_ID", "KTENSOR_COMP", "UPDATE_METHOD", "MAX_ITERS", "ITER", "FLOPS")


@query
def lut_files(s, d):
    """The best methods of a benchmark written as look-up tables and read again."""
    best = planner.best_method(_bench(s)).select(F.lit("25-6-12").alias("modes"), F.lit(1).alias("threads"), "mode", "rank", "method")
    reports.write_lut(best, path := tensors.scratch(s, "tables"))
    found = reports.read_lut(s, path, "25-6-12", 1)
    return s.createDataFrame([(n, r, k) for n, table in found.items() for r, k in table.items()], "mode int, rank int, method int")


@query
def tensor_text(s, d):
    """The sales tensor written as text and read again."""
    x, m = sales(s, d)
    tensors.write_text(x, m, path := tensors.scratch(s, "tensor"))
    return out(tensors.read_text(s, path)[0], 2)


@query
def table_function(s, d):
    """`cp_als` called from SQL."""
    from polyad.functions.udtf import register

    register(s)
    sales(s, d)[0].createOrReplaceTempView("polyad_sales")
    r = s.sql("SELECT mode, row, comp, val FROM cp_als(TABLE(SELECT * FROM polyad_sales) WITH SINGLE PARTITION, 2, 3)")
    return out(r, 5)


@query
def als_to_tolerance(s, d):
    """Models stop by themselves once the fit changes by less than the tolerance."""
    x, m = sales(s, d)
    r = als.cp_concurrent(x, m, als.model_list(s, [(0, 1, None), (1, 1, None)]), als.Params(max_iterations=50, tol=0.01))
    return out(als.models_of(r).select("model_id", "iters", "status", "error"), 4)


@query
def als_evict_first(s, d):
    """The model in the first columns leaves after each sweep."""
    x, m = sales(s, d)
    r = als.cp_concurrent(x, m, als.model_list(s, [(0, 1, None), (1, 2, None), (2, 2, None)]), als.Params(max_iterations=50, force_max_iter=True, always_evict_first=True, buffer_size=5))
    return out(als.models_of(r).select("model_id", "iters", "error"), 4)


@query
def jk_align(s, d):
    """Components in another order are put back in that of the reference, weights included."""
    import numpy as np

    from polyad.functions import kernels as K

    lam, reference = K.sine_model(sales(s, d)[1].modes, 3)
    order = [2, 0, 1]
    lam, moved = K.align(reference, np.array([5.0, 6.0, 7.0])[order], [f[:, order] for f in reference])
    rows = [(n, i, c, float(v)) for n, f in enumerate(moved) for i, r in enumerate(f) for c, v in enumerate(r)] + [(-1, 0, c, float(v)) for c, v in enumerate(lam)]
    return out(s.createDataFrame(rows, "mode int, row int, comp int, val double"))
