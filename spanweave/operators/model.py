"""Feature assembly and scoring with fitted parameters that the caller gives."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: features in order, and the label of each cluster index
FEATURES = ["sd_max", "sd_var", "sim_bubble", "com_bubble", "Vscore", "TEgini", "vntr_cov", "vntr_gini_max"]
LABELS = ["simple", "CC4", "CC1", "CC3", "CC5", "CC2", "CC6", "CC7"]


def assemble(base: DataFrame, tables: list[DataFrame], keys: list[str], drop_null: bool = True) -> DataFrame:
    """Left joins of feature tables on the keys; rows with a null feature go if asked."""
    out = reduce(lambda a, b: a.join(b, keys, "left"), tables, base)
    return out.dropna() if drop_null else out


def vscore(win_sim: Column, entropy: Column) -> Column:
    return (1 - win_sim) + entropy


def scale(values: Column, mean: list[float], std: list[float]) -> Column:
    """Standard scores of an array column."""
    pairs = F.arrays_zip(values.alias("v"), F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, std)).alias("s"))
    return F.transform(pairs, lambda p: (p["v"] - p["m"]) / p["s"])


def soft_assign(z: Column, centroids: list[list[float]], alpha: float = 1.0) -> Column:
    """Student-t kernel of an array column with each centroid; sums to 1."""

    def kernel(mu: list[float]) -> Column:
        square = F.aggregate(F.zip_with(z, F.array(*map(F.lit, mu)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        return F.pow(1 + square / alpha, -(alpha + 1) / 2)

    q = F.array(*[kernel(mu) for mu in centroids])
    return F.transform(q, lambda x: x / F.aggregate(q, F.lit(0.0), lambda s, y: s + y))


def argmax_label(q: Column, labels: list[str]) -> Column:
    """The label at the first largest position of an array column."""
    return F.get(F.array(*map(F.lit, labels)), (F.array_position(q, F.array_max(q)) - 1).cast("int"))


def encode(df: DataFrame, column: str, weights: list[tuple[np.ndarray, np.ndarray]], name: str = "z") -> DataFrame:
    """Dense layers on an array column, ReLU between them but not after the last; vectorised on Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast([(np.asarray(w, float), np.asarray(b, float)) for w, b in weights])

    @F.arrow_udf("array<double>")
    def forward(x: pa.Array) -> pa.Array:
        layers = shared.value
        h = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(layers[0][0]))
        for k, (w, b) in enumerate(layers):
            h = h @ w + b
            h = np.maximum(h, 0) if k < len(layers) - 1 else h
        return pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * h.shape[1]), pa.array(h.ravel()))

    return df.withColumn(name, forward(column))
