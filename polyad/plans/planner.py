"""Choices that Catalyst can't make: contraction order, where the tensor lives, how many models share a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("mttkrp", "twostep0", "twostep1")
#: Tensors of up to this many bytes may be sent to every executor.
MOST_BROADCAST = 256 << 20


def lookup(lut: dict[int, int], active: int) -> str | None:
    """The method measured for the next larger number of components, else for the largest."""
    if not lut:
        return None
    keys = sorted(lut)
    return METHODS[lut[next((k for k in keys if k >= active), keys[-1])]]


def choose(modes: tuple[int, ...], n: int, method: str = "auto", lut: dict[int, int] | None = None, active: int = 1) -> str:
    """A method's name; `auto` takes the table's word for this many columns, else the cheaper intermediate result."""
    if method not in ("auto", *METHODS):
        raise ValueError(f"unknown method {method}")
    if len(modes) != 3:
        return "auto" if method.startswith("twostep") else method
    if method != "auto":
        return method
    found = lookup(lut or {}, active)
    if found:
        return found
    from polyad.functions.kernels import contraction

    left = {f"twostep{w}": modes[n] * modes[contraction(n, w)[1]] for w in (0, 1)}
    best = min(left, key=lambda k: (left[k], k))
    krp = modes[0] * modes[1] * modes[2] // modes[n]
    return "mttkrp" if krp < left[best] else best


def strategy(n_elements: int) -> str:
    """`local` while the tensor fits the broadcast limit, else `slabs`."""
    return "local" if fits(n_elements) else "slabs"


def lut_lookup(lut: DataFrame, wanted: DataFrame) -> DataFrame:
    """`lut(mode, rank, method)`, `wanted(mode, active)`: the entry of the least rank >= active, else of the largest rank."""
    both = wanted.join(lut, "mode")
    up = F.when(F.col("rank") >= F.col("active"), F.col("rank"))
    return both.groupBy("mode", "active").agg(F.coalesce(F.min_by("method", up), F.max_by("method", "rank")).alias("method"))


def best_method(bench: DataFrame) -> DataFrame:
    """`bench(mode, rank, method, flops, time)`: the method of most FLOP/s for each mode and rank; the lowest of equals."""
    return bench.groupBy("mode", "rank").agg(F.max_by("method", F.struct(F.col("flops") / F.col("time"), -F.col("method"))).alias("method"))


def mttkrp_flops(modes: tuple[int, ...], n: int, rank: int, method: str) -> int:
    """Multiplications and additions; the Khatri-Rao product counts once."""
    total, rest = 1, 1
    for m, size in enumerate(modes):
        total *= size
        rest *= size if m != n else 1
    if method == "mttkrp":
        return 2 * total * rank + rest * rank * (len(modes) - 2)
    from polyad.functions.kernels import contraction

    if len(modes) == 3 and method != "auto":
        left = [modes[contraction(n, 0 if method == "twostep0" else 1)[1]]]
    else:
        left = sorted((size for m, size in enumerate(modes) if m != n), reverse=True)[1:]
    flops, kept = 2 * total * rank, modes[n]
    for size in reversed(left):
        kept *= size
        flops += 2 * kept * rank
    return flops


def fits(n_elements: int) -> bool:
    """Whether a dense tensor of so many cells may be sent around."""
    return 8 * n_elements <= MOST_BROADCAST


def groups_for(n_elements: int, columns: int, parallelism: int, work: int = 1 << 27) -> int:
    """Tasks among which a fit's models are dealt: one, so that all share a buffer and each pass, until cells times columns
    are worth more than one task."""
    return max(1, min(parallelism, n_elements * columns // work))


# --- admission of models to a buffer of columns ------------------------------------------------------------------


def first_fit(cells: DataFrame, width: int) -> DataFrame:
    """`cells(cell, owner)`, owner null: free. One row: the start of the first run of `width` free cells, or null.

    Free runs are islands: cell number minus rank among free cells is constant along a run. The buffer is a
    few thousand cells by its option, so one window over it is bounded.
    """
    from pyspark.sql import Window

    free = cells.where("owner is null").withColumn("island", F.col("cell") - F.row_number().over(Window.orderBy("cell")))
    runs = free.groupBy("island").agg(F.min("cell").alias("start"), F.count("*").alias("n")).where(F.col("n") >= width)
    return runs.agg(F.min("start").alias("start"))


def compress(cells: DataFrame) -> DataFrame:
    """`(owner, cell, new_cell)`: cells after the gaps are closed to the left."""
    from pyspark.sql import Window

    w = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    moved = cells.withColumn("gaps", F.sum(F.col("owner").isNull().cast("int")).over(w))
    return moved.where("owner is not null").select("owner", "cell", (F.col("cell") - F.col("gaps")).cast("int").alias("new_cell"))


def leftmost(cells: DataFrame) -> DataFrame:
    """The owner of the first column in use."""
    return cells.where("owner is not null").agg(F.min_by("owner", "cell").alias("owner"))
