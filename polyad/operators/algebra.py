"""Tensor and factor algebra as joins and aggregates over relations.

Factor relations carry `model_id`, so one join serves all models at once. Aggregates come as early as they can
(the two-step contraction sums before its second join). No side is broadcast by hint: factors of a known
small size are broadcast by Catalyst, larger ones are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyad.functions.kernels import contraction

CELL = ["model_id", "mode", "comp"]


# --- tensors and matrices ------------------------------------------------------------------------------------


def index_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[0] == "i" and c[1:].isdigit()]


def zero(df: DataFrame) -> DataFrame:
    return df.withColumn("val", F.lit(0.0))


def randomize(df: DataFrame, seed: int) -> DataFrame:
    """Uniform on [-1, 1), by a hash of the place: the same for any partitioning."""
    return df.withColumn("val", F.pmod(F.xxhash64(F.lit(seed), *index_columns(df)), F.lit(1 << 53)) / F.lit(float(1 << 52)) - 1)


def element(df: DataFrame, *index: int) -> DataFrame:
    for c, i in zip(index_columns(df), index, strict=True):
        df = df.where(F.col(c) == i)
    return df.select("val")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def resize(m: DataFrame, rows: int, cols: int) -> DataFrame:
    return m.where((F.col("row") < rows) & (F.col("col") < cols))


def linear(columns: list[str], sizes: list[int]) -> Column:
    """Place in the order in which the first column is fastest."""
    out, step = F.lit(0).cast("bigint"), 1
    for c, size in zip(columns, sizes, strict=True):
        out = out + F.col(c) * F.lit(step)
        step *= size
    return out


def unfold(df: DataFrame, modes: tuple[int, ...], n: int) -> DataFrame:
    """Mode-n matricisation `(row, col, val)`."""
    names = index_columns(df)
    rest = [i for i in range(len(modes)) if i != n]
    columns = 1
    for i in rest:
        columns *= modes[i]
    col = linear([names[i] for i in rest], [modes[i] for i in rest])
    return df.select(F.col(names[n]).alias("row"), (col.cast("int") if columns < 2**31 else col).alias("col"), "val")


def subtract(x: DataFrame, y: DataFrame) -> DataFrame:
    """x - y cell by cell; cells that either lacks are zeros."""
    names = index_columns(x)
    return x.join(y.withColumnRenamed("val", "_y"), names, "full").select(*names, (F.coalesce("val", F.lit(0.0)) - F.coalesce("_y", F.lit(0.0))).alias("val"))


def masked_max(df: DataFrame, mask: Column, order: Column) -> DataFrame:
    """The largest value where the mask holds, and its place; the first of equals by `order`. One row; null, 0 if none."""
    return df.where(mask).agg(F.max("val").alias("val"), F.coalesce(F.max_by(order, F.struct("val", -order)), F.lit(0)).cast("int").alias("at"))


def leave_out(df: DataFrame, fiber: int) -> DataFrame:
    """Without one slice of mode 0; later slices move up."""
    return df.where(F.col("i0") != fiber).withColumn("i0", F.col("i0") - (F.col("i0") > fiber).cast("int"))


def norm(df: DataFrame) -> DataFrame:
    return df.agg(F.sqrt(F.coalesce(F.sum(F.col("val") * F.col("val")), F.lit(0.0))).alias("norm"))


def minimum(df: DataFrame) -> DataFrame:
    return df.agg(F.min("val").alias("min"))


def one_norm(m: DataFrame) -> DataFrame:
    """Largest column sum of absolute values."""
    return m.groupBy("col").agg(F.sum(F.abs("val")).alias("s")).agg(F.max("s").alias("one_norm"))


def slice_norms(df: DataFrame, mode: int = 0) -> DataFrame:
    """For each slice of a mode the norm of the tensor without it: a sum per slice, then the total of those few."""
    parts = df.groupBy(F.col(f"i{mode}").alias("fiber")).agg(F.sum(F.col("val") * F.col("val")).alias("s"))
    total = parts.agg(F.sum("s").alias("t"))
    return parts.join(F.broadcast(total), F.lit(True)).select("fiber", F.sqrt(F.greatest(F.col("t") - F.col("s"), F.lit(0.0))).alias("norm"))


# --- factors -------------------------------------------------------------------------------------------------


def sine_factors(spark, modes: tuple[int, ...], ranks: dict[int, int]) -> DataFrame:
    """Unnormalised closed-form factors for models `{model_id: rank}`; the model's id shifts the sine."""
    models = spark.createDataFrame(sorted(ranks.items()), "model_id int, rank int")
    sizes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(i).alias("size")) for m, i in enumerate(modes)])
    rows = models.select("model_id", "rank", F.explode(sizes).alias("s")).select("model_id", "rank", "s.mode", F.explode(F.sequence(F.lit(0), F.col("s.size") - 1)).alias("row"))
    cells = rows.select("model_id", "mode", "row", F.explode(F.sequence(F.lit(0), F.col("rank") - 1)).alias("comp"))
    return cells.withColumn("val", 0.5 + 0.5 * F.sin((F.col("row") + 1 + F.col("model_id")) * (F.col("comp") + 1) * (F.col("mode") + 1).cast("double")))


def normalize(factors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unit columns in all modes, and weights: the products of the columns' norms. Zero columns stay, with weight 0."""
    norms = factors.groupBy(*CELL).agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("_c"))
    scaled = factors.join(norms, CELL).withColumn("val", F.when(F.col("_c") == 0, F.col("val")).otherwise(F.col("val") / F.col("_c"))).drop("_c")
    return scaled.select("model_id", "mode", "row", "comp", "val"), norms.groupBy("model_id", "comp").agg(F.product("_c").alias("val"))


def normalize_mode(factors: DataFrame, mode: int, sweep: int) -> tuple[DataFrame, DataFrame]:
    """One mode: 2-norms in sweep 1, later the signed value of largest size (lowest row of equals)."""
    own = factors.where(F.col("mode") == mode)
    size = F.sqrt(F.sum(F.col("val") * F.col("val"))) if sweep == 1 else F.max_by("val", F.struct(F.abs("val"), -F.col("row")))
    weights = own.groupBy(*CELL).agg(size.alias("_c"))
    scaled = own.join(weights, CELL).withColumn("val", F.when(F.col("_c") == 0, F.col("val")).otherwise(F.col("val") / F.col("_c"))).drop("_c")
    return scaled.select("model_id", "mode", "row", "comp", "val"), weights.select("model_id", "comp", F.col("_c").alias("val"))


def denormalize(factors: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights folded into mode 0."""
    w = weights.withColumnRenamed("val", "_w")
    return factors.join(w, ["model_id", "comp"]).select("model_id", "mode", "row", "comp", F.when(F.col("mode") == 0, F.col("val") * F.col("_w")).otherwise(F.col("val")).alias("val"))


def gramian(factors: DataFrame) -> DataFrame:
    """`(model_id, mode, r, s, val)`: inner products of components."""
    a, b = factors.alias("a"), factors.alias("b")
    same = (F.col("a.model_id") == F.col("b.model_id")) & (F.col("a.mode") == F.col("b.mode")) & (F.col("a.row") == F.col("b.row"))
    return a.join(b, same).groupBy(F.col("a.model_id").alias("model_id"), F.col("a.mode").alias("mode"), F.col("a.comp").alias("r"), F.col("b.comp").alias("s")).agg(F.sum(F.col("a.val") * F.col("b.val")).alias("val"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("val", "_b"), ["row", "col"]).select("row", "col", (F.col("val") * F.col("_b")).alias("val"))


def hadamard_all(grams: DataFrame, but: int | None = None) -> DataFrame:
    """Products of the Gramians over all modes, or all but one."""
    kept = grams if but is None else grams.where(F.col("mode") != but)
    return kept.groupBy("model_id", "r", "s").agg(F.product("val").alias("val"))


def khatri_rao(a: DataFrame, b: DataFrame, rows_b: int) -> DataFrame:
    """Column-wise Kronecker product of `(model_id, row, comp, val)`; b's rows are fastest."""
    right = b.select("model_id", "comp", F.col("row").alias("_row"), F.col("val").alias("_val"))
    return a.join(right, ["model_id", "comp"]).select("model_id", (F.col("row") * rows_b + F.col("_row")).alias("row"), "comp", (F.col("val") * F.col("_val")).alias("val"))


def mode_of(factors: DataFrame, n: int) -> DataFrame:
    return factors.where(F.col("mode") == n).select("model_id", "row", "comp", "val")


def khatri_rao_but(factors: DataFrame, modes: tuple[int, ...], n: int) -> DataFrame:
    """Of all modes but n; the lowest is fastest."""
    out, rows = None, 1
    for m in (m for m in range(len(modes)) if m != n):
        own = mode_of(factors, m)
        out = own if out is None else khatri_rao(own, out, rows)
        rows *= modes[m]
    return out


def mttkrp_explicit(x: DataFrame, factors: DataFrame, modes: tuple[int, ...], n: int) -> DataFrame:
    """`(model_id, row, comp, val)`: the tensor joined with one factor after another, then one sum.

    The Khatri-Rao product of the other factors is never written out: its rows arise cell by cell in the joins.
    """
    out = None
    for m in (m for m in range(len(modes)) if m != n):
        own = mode_of(factors, m).select("model_id", F.col("row").alias(f"i{m}"), "comp", F.col("val").alias("_u"))
        out = x.join(own, f"i{m}") if out is None else out.join(own, ["model_id", f"i{m}", "comp"])
        out = out.withColumn("val", F.col("val") * F.col("_u")).drop("_u", f"i{m}")
    return out.groupBy("model_id", F.col(f"i{n}").alias("row"), "comp").agg(F.sum("val").alias("val"))


def mttkrp_two_step(x: DataFrame, factors: DataFrame, n: int, which: int) -> DataFrame:
    """Three modes: contract one factor and sum, then the other."""
    first, second = contraction(n, which)
    own, kept = f"i{n}", f"i{second}"
    a = mode_of(factors, first).select("model_id", F.col("row").alias(f"i{first}"), "comp", F.col("val").alias("_a"))
    part = x.join(a, f"i{first}").groupBy("model_id", own, kept, "comp").agg(F.sum(F.col("val") * F.col("_a")).alias("val"))
    b = mode_of(factors, second).select("model_id", F.col("row").alias(kept), "comp", F.col("val").alias("_b"))
    return part.join(b, ["model_id", kept, "comp"]).groupBy("model_id", F.col(own).alias("row"), "comp").agg(F.sum(F.col("val") * F.col("_b")).alias("val"))


def mttkrp(x: DataFrame, factors: DataFrame, modes: tuple[int, ...], n: int, method: str = "auto") -> DataFrame:
    from polyad.plans.planner import choose

    method = choose(modes, n, method)
    if method in ("mttkrp", "auto"):
        return mttkrp_explicit(x, factors, modes, n)
    return mttkrp_two_step(x, factors, n, 0 if method == "twostep0" else 1)


def reconstruct(factors: DataFrame, weights: DataFrame, n_modes: int) -> DataFrame:
    """`(model_id, i0, ..., val)`."""
    out = weights.withColumnRenamed("val", "_v")
    for m in range(n_modes):
        own = mode_of(factors, m).select("model_id", "comp", F.col("row").alias(f"i{m}"), F.col("val").alias("_u"))
        out = out.join(own, ["model_id", "comp"]).withColumn("_v", F.col("_v") * F.col("_u")).drop("_u")
    return out.groupBy("model_id", *[f"i{m}" for m in range(n_modes)]).agg(F.sum("_v").alias("val"))


def fast_error(x: DataFrame, factors: DataFrame, weights: DataFrame, g_last: DataFrame, n_modes: int) -> DataFrame:
    """`(model_id, error)` from Gramians and the last MTTKRP, without writing the model out."""
    h = hadamard_all(gramian(factors))
    w = weights.select("model_id", F.col("comp").alias("r"), F.col("val").alias("_r"))
    v = weights.select("model_id", F.col("comp").alias("s"), F.col("val").alias("_s"))
    own = h.join(w, ["model_id", "r"]).join(v, ["model_id", "s"]).groupBy("model_id").agg(F.sum(F.col("_r") * F.col("_s") * F.col("val")).alias("own"))
    last = mode_of(factors, n_modes - 1).join(g_last.withColumnRenamed("val", "_g"), ["model_id", "row", "comp"]).join(weights.withColumnRenamed("val", "_w"), ["model_id", "comp"])
    cross = last.groupBy("model_id").agg(F.sum(F.col("_w") * F.col("val") * F.col("_g")).alias("cross"))
    square = norm(x)
    return own.join(cross, "model_id").join(F.broadcast(square), F.lit(True)).select("model_id", F.sqrt(F.greatest(F.col("norm") ** 2 + F.col("own") - 2 * F.col("cross"), F.lit(0.0))).alias("error"))


def explicit_error(x: DataFrame, factors: DataFrame, weights: DataFrame, n_modes: int) -> DataFrame:
    """`(model_id, error)`: the norm of the residual. The model has every cell; those that the tensor lacks are zeros."""
    names = index_columns(x)
    full = reconstruct(factors, weights, n_modes).join(x.withColumnRenamed("val", "_x"), names, "left")
    return full.groupBy("model_id").agg(F.sqrt(F.sum((F.coalesce("_x", F.lit(0.0)) - F.col("val")) ** 2)).alias("error"))


def fit(errors: DataFrame, x: DataFrame) -> DataFrame:
    return errors.join(F.broadcast(norm(x)), F.lit(True)).select("model_id", (1 - F.abs("error") / F.col("norm")).alias("fit"))


def fit_difference(history: DataFrame) -> DataFrame:
    """Change of fit from iteration to iteration; from 0 at the first."""
    w = Window.partitionBy("model_id").orderBy("iter")
    return history.withColumn("fit_diff", F.abs(F.coalesce(F.lag("fit").over(w), F.lit(0.0)) - F.col("fit")))


def extrapolate(now: DataFrame, before: DataFrame, step: float) -> DataFrame:
    """now + step * (now - before)."""
    keys = ["model_id", "mode", "row", "comp"]
    return now.join(before.withColumnRenamed("val", "_p"), keys).select(*keys, (F.col("val") + step * (F.col("val") - F.col("_p"))).alias("val"))


def set_factor(factors: DataFrame, mode: int, other: DataFrame) -> DataFrame:
    """`factors` with one mode taken from `other(model_id, row, comp, val)` for the models that `other` has."""
    own = (F.col("mode") == mode)
    ids = other.select("model_id").distinct()
    kept = factors.where(~own).unionByName(factors.where(own).join(ids, "model_id", "left_anti").select(*factors.columns))
    return kept.unionByName(other.select("model_id", F.lit(mode).alias("mode"), "row", "comp", "val"))


def set_weights(weights: DataFrame, other: DataFrame) -> DataFrame:
    """`weights` with those of the models that `other` has taken from there."""
    return weights.join(other.select("model_id").distinct(), "model_id", "left_anti").select("model_id", "comp", "val").unionByName(other.select("model_id", "comp", "val"))


# --- jackknife and sets of models ----------------------------------------------------------------------------


def mask(factors: DataFrame, mode: int, fiber: int | Column, value: float | None) -> DataFrame:
    """One row of one mode times a value; None makes it null."""
    hit = (F.col("mode") == mode) & (F.col("row") == fiber)
    return factors.withColumn("val", F.when(hit, F.lit(None).cast("double") if value is None else F.col("val") * value).otherwise(F.col("val")))


def to_regular(factors: DataFrame, mode: int, fiber: int) -> DataFrame:
    """Without the left-out row; later rows of that mode move up."""
    own = F.col("mode") == mode
    return factors.where(~(own & (F.col("row") == fiber))).withColumn("row", F.col("row") - (own & (F.col("row") > fiber)).cast("int"))


def replicas(models: DataFrame, size: int) -> DataFrame:
    """`(model_id, jk_mode, jk_fiber, replica_id)`: each model once for every slice of mode 0."""
    if size <= 1:
        raise ValueError("a jackknife needs more than one slice")
    fibers = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    return models.select("model_id", F.lit(0).alias("jk_mode"), fibers.alias("jk_fiber")).withColumn("replica_id", F.col("model_id") * size + F.col("jk_fiber"))


def alignment_scores(reference: DataFrame, replica: DataFrame, skip: int = 0) -> DataFrame:
    """`(model_id, r, s, val)`: inner products of a reference's components with those of replicas `(model_id, ref_id, ...)`."""
    a = reference.where(F.col("mode") != skip).select(F.col("model_id").alias("ref_id"), "mode", "row", F.col("comp").alias("r"), F.col("val").alias("_a"))
    b = replica.where(F.col("mode") != skip).withColumnRenamed("comp", "s")
    return b.join(a, ["ref_id", "mode", "row"]).groupBy("model_id", "r", "s").agg(F.sum(F.col("_a") * F.col("val")).alias("val"))


def concatenate(factors: DataFrame, order: DataFrame, rank: int) -> DataFrame:
    """Models of equal rank side by side; `order(model_id, position)`."""
    return factors.join(order, "model_id").select("mode", "row", (F.col("position") * rank + F.col("comp")).alias("comp"), "val")


def spread(factors: DataFrame, keys: list[str]) -> DataFrame:
    """Sample standard deviation of each entry over replicas."""
    return factors.groupBy(*keys, "mode", "row", "comp").agg(F.stddev_samp("val").alias("std"))


def best_per_rank(models: DataFrame, digits: int | None = None) -> DataFrame:
    """The model of least error for each number of components; the earliest of equals. With `digits`, errors count and are returned to so many places."""
    error = (F.col("error") if digits is None else F.round("error", digits)).alias("error")
    return models.groupBy("components").agg(F.min_by("model_id", F.struct(error, "model_id")).alias("model_id"), F.min(error).alias("error"))
