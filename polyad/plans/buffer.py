"""The buffer of columns that all models in a fit share: one matrix for each mode, models side by side."""

from __future__ import annotations

import numpy as np


class ColumnBuffer:
    """Room for `width` columns. A model takes the first run of free columns that is long enough.

    Memory grows with the columns in use, not with `width`.
    """

    def __init__(self, modes: tuple[int, ...], width: int):
        self.modes, self.limit = modes, width
        self.owner = np.full(0, -1, np.int64)
        self.data = [np.zeros((i, 0), order="F") for i in modes]
        self.starts: dict[int, tuple[int, int]] = {}

    @property
    def width(self) -> int:
        """Columns up to the last in use."""
        used = np.flatnonzero(self.owner >= 0)
        return int(used[-1]) + 1 if len(used) else 0

    def first_fit(self, n: int) -> int | None:
        """Start of the first run of n free columns, or None."""
        run, edge = 0, self.width
        for at in range(edge):
            run = run + 1 if self.owner[at] < 0 else 0
            if run == n:
                return at - n + 1
        start = edge - run
        return start if start + n <= self.limit else None

    def add(self, key: int, factors: list[np.ndarray]) -> bool:
        """Copy a model's factors in; False if there is no room for it."""
        n = factors[0].shape[1]
        start = self.first_fit(n)
        if start is None:
            return False
        if start + n > len(self.owner):
            size = min(self.limit, max(start + n, 2 * len(self.owner)))
            self.owner = np.concatenate([self.owner, np.full(size - len(self.owner), -1, np.int64)])
            self.data = [np.asfortranarray(np.hstack([d, np.zeros((len(d), size - d.shape[1]))])) for d in self.data]
        self.owner[start : start + n] = key
        self.starts[key] = (start, start + n)
        for mode, f in enumerate(factors):
            self.write(key, mode, f)
        return True

    def columns(self, key: int) -> slice:
        return slice(*self.starts[key])

    def write(self, key: int, mode: int, values: np.ndarray) -> None:
        self.data[mode][:, self.columns(key)] = values

    def active(self) -> list[np.ndarray]:
        """All modes up to the last column in use; free columns are zero."""
        edge = self.width
        return [d[:, :edge] for d in self.data]

    def remove(self, key: int) -> None:
        where = self.columns(key)
        self.owner[where] = -1
        for d in self.data:
            d[:, where] = 0.0
        del self.starts[key]

    def compress(self) -> None:
        """Close the gaps to the left; the order of models stays."""
        kept = np.flatnonzero(self.owner >= 0)
        if len(kept) == self.width:
            return
        for d in self.data:
            d[:, : len(kept)] = d[:, kept]
            d[:, len(kept) :] = 0.0
        owner = self.owner[kept]
        self.owner[: len(kept)], self.owner[len(kept) :] = owner, -1
        at = 0
        for key in dict.fromkeys(owner.tolist()):
            n = self.starts[key][1] - self.starts[key][0]
            self.starts[key] = (at, at + n)
            at += n

    def leftmost(self) -> int | None:
        """The model in the first column in use."""
        used = np.flatnonzero(self.owner >= 0)
        return int(self.owner[used[0]]) if len(used) else None
