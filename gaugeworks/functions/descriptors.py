"""Descriptors of grids as a table function: a row for each transform and descriptor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

NAMES = ("mean", "spread", "edges", "high_share", "entropy")
TRANSFORMS = ("raw", "smooth", "gradient", "half")


def transformed(grid: np.ndarray, name: str) -> np.ndarray:
    """``raw``; ``smooth``: means of 3 x 3 cells, the border repeated; ``gradient``: greatest less least of them; ``half``: means of 2 x 2 cells."""
    if name == "raw":
        return grid
    if name == "half":
        rows, columns = (n // 2 * 2 for n in grid.shape)
        return grid[:rows, :columns].reshape(rows // 2, 2, columns // 2, 2).mean(axis=(1, 3))
    wide = np.pad(grid, 1, mode="edge")
    around = np.stack([wide[i : i + grid.shape[0], j : j + grid.shape[1]] for i in range(3) for j in range(3)])
    return around.mean(axis=0) if name == "smooth" else around.max(axis=0) - around.min(axis=0)


def described(grid: np.ndarray, bins: int = 8) -> dict[str, float]:
    """Mean, standard deviation, mean step to the right and down, share of cells above the mean, entropy (bits) of the histogram over the range."""
    steps = np.concatenate((np.abs(np.diff(grid, axis=0)).ravel(), np.abs(np.diff(grid, axis=1)).ravel()))
    low, high = grid.min(), grid.max()
    shares = np.histogram(grid, bins, (low, high))[0] / grid.size if high > low else np.ones(1)
    shares = shares[shares > 0]
    values = (grid.mean(), grid.std(), steps.mean() if len(steps) else 0.0, (grid > grid.mean()).mean(), -(shares * np.log2(shares)).sum())
    return dict(zip(NAMES, map(float, values), strict=True))


@udtf(returnType="transform string, descriptor string, value double", useArrow=True)
class Descriptors:
    """Rows (transform, descriptor, value) of a grid given as numbers row by row; none for a null, empty or ragged one."""

    def eval(self, numbers: list, columns: int) -> Iterator[tuple[str, str, float]]:
        if not numbers or columns < 1 or len(numbers) % columns or any(x is None for x in numbers):
            return
        grid = np.asarray(numbers, float).reshape(-1, columns)
        for name in TRANSFORMS:
            made = transformed(grid, name)
            if made.size:
                for descriptor, value in described(made).items():
                    yield name, descriptor, value


def register(spark: SparkSession) -> None:
    """Makes ``descriptors(numbers, columns)`` known to SQL, for lateral calls."""
    spark.udtf.register("descriptors", Descriptors)
