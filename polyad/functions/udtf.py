"""`cp_als` as a table function for SQL: SELECT * FROM cp_als(TABLE(tensor), rank, sweeps)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="mode int, row int, comp int, val double, weight double, error double")
class CpAls:
    """Collects the cells of one call, fits one model from the closed-form start and returns its factors.

    The tensor has to fit one task: over `MOST` cells it is an error, and `cp_concurrent` is the way.
    """

    MOST = 4_000_000

    def __init__(self):
        self.cells: list[tuple[tuple[int, ...], float]] = []
        self.rank, self.sweeps = 1, 50

    def eval(self, row, rank: int, sweeps: int):
        if len(self.cells) >= self.MOST:
            raise ValueError(f"a tensor of over {self.MOST} cells; fit it with cp_concurrent")
        values = row.asDict()
        index = tuple(values[k] for k in sorted((k for k in values if k[0] == "i" and k[1:].isdigit()), key=lambda k: int(k[1:])))
        self.cells.append((index, values["val"]))
        self.rank, self.sweeps = rank, sweeps

    def terminate(self):
        from polyad.functions.kernels import sine_model
        from polyad.plans.als import Model, Params, fit_array

        if not self.cells:
            return
        x = np.zeros(tuple(1 + max(c[0][m] for c in self.cells) for m in range(len(self.cells[0][0]))))
        for index, value in self.cells:
            x[index] = value
        lam, factors = sine_model(x.shape, self.rank)
        done = fit_array(x, [Model(0, factors, lam)], Params(max_iterations=self.sweeps))[0][0]
        for m, f in enumerate(done.factors):
            for i, r in enumerate(f):
                for c, v in enumerate(r):
                    yield m, i, c, float(v), float(done.lam[c]), float(done.error)


def register(spark: SparkSession) -> None:
    spark.udtf.register("cp_als", CpAls)
