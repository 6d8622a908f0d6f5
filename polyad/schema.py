"""Relations and metadata of tensors and Kruskal models.

A tensor is a relation `(i0, i1, ..., val)`; absent cells are zeros. A set of models is a relation
`factors(model_id, mode, row, comp, val)` with `weights(model_id, comp, val)`, one row per model in `models`.
The first index is the fastest in every linear order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class TensorMeta:
    """Sizes of the modes and the rank the tensor was generated with (0: unknown)."""

    modes: tuple[int, ...]
    rank: int = 0

    @property
    def n_elements(self) -> int:
        return math.prod(self.modes)

    @property
    def index_columns(self) -> list[str]:
        return [f"i{n}" for n in range(len(self.modes))]

    def label(self) -> str:
        """Sizes joined by hyphens, as look-up tables and reports name a tensor."""
        return "-".join(map(str, self.modes))

    def schema(self) -> T.StructType:
        return T.StructType([*(T.StructField(c, T.IntegerType()) for c in self.index_columns), T.StructField("val", T.DoubleType())])


FACTORS = "model_id int, mode int, row int, comp int, val double"
WEIGHTS = "model_id int, comp int, val double"
MODELS = "model_id int, components int, jk_mode int, jk_fiber int, iters int, fit double, old_fit double, error double, status string"
HISTORY = "model_id int, iter int, error double, fit double, fit_diff double"
