"""Sums of matrices that tasks make: bytes on the way, a few tasks before the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PART = "key int, width int, g binary"


def sum_matrices(df: DataFrame, each: Callable[[pd.DataFrame], dict[int, np.ndarray]], tasks: int = 16) -> dict[int, np.ndarray]:
    """For each key the sum of the matrices that ``each`` makes of the batches of ``df``; no batch, no sum.

    A task adds up its own batches and sends one matrix for each key, ``tasks`` tasks add those, and the driver gets their sums: at most
    ``tasks`` matrices for each key, whatever the number of rows.
    """

    def rows(sums: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
        if sums:
            yield pd.DataFrame({"key": list(sums), "width": [g.shape[1] for g in sums.values()], "g": [np.ascontiguousarray(g, float).tobytes() for g in sums.values()]})

    def add(sums: dict[int, np.ndarray], more: dict[int, np.ndarray]) -> None:
        for k, g in more.items():
            sums[k] = sums[k] + g if k in sums else g

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            if len(pdf):
                add(sums, each(pdf))
        yield from rows(sums)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, width, raw in zip(pdf["key"], pdf["width"], pdf["g"]):
                add(sums, {k: np.frombuffer(raw).reshape(-1, width)})
        yield from rows(sums)

    found: dict[int, np.ndarray] = {}
    for r in df.mapInPandas(make, PART).repartition(tasks).mapInPandas(meet, PART).collect():  # at most tasks x keys rows
        add(found, {r["key"]: np.frombuffer(r["g"]).reshape(-1, r["width"])})
    return found
