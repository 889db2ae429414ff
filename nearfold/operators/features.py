"""Standardisation by feature groups and principal components of feature vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Standard deviation of a column that is not constant; singular value of a component by the first; components.
CONSTANT, RANK, DIMENSIONS = 1e-12, 1e-10, 32


def long_form(features: DataFrame) -> DataFrame:
    """(node, feature, value) from (node, f)."""
    return features.select("node", F.posexplode("f").alias("feature", "value"))


def feature_stats(features: DataFrame) -> DataFrame:
    """(feature, mean, std): std is the population's."""
    return long_form(features).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def kept_columns(stats: DataFrame) -> DataFrame:
    return stats.withColumn("kept", F.col("std") > CONSTANT)


def group_weights(stats: DataFrame, borders: list[int]) -> DataFrame:
    """(feature, mean, std, kept, grp, weight): 1 / sqrt(kept columns of the group), 0 in a group without any. Group g holds
    the features from borders[g - 1] (0 at first) up to borders[g]."""
    grp = sum((F.col("feature") >= b).cast("int") for b in borders)
    s = kept_columns(stats).withColumn("grp", grp)
    n = F.count_if("kept").over(Window.partitionBy("grp"))
    return s.withColumn("weight", F.when(n > 0, 1 / F.sqrt(n.cast("double"))).otherwise(0.0))


@dataclass(frozen=True)
class Preprocessing:
    """Fitted by fit(): apply() is the same on every run. ``components``: (d, kept columns)."""

    mean: np.ndarray
    std: np.ndarray
    keep: np.ndarray
    weight: np.ndarray
    pca_mean: np.ndarray
    components: np.ndarray
    variance_ratio: np.ndarray
    singular: np.ndarray

    def apply(self, features: DataFrame) -> DataFrame:
        """(node, f): d principal coordinates of every row."""
        shift, scale = self.mean[self.keep], self.weight[self.keep] / self.std[self.keep]
        keep, centre, turn = self.keep, self.pca_mean, self.components

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _rows(batch.column(1), len(keep))
                y = ((x[:, keep] - shift) * scale - centre) @ turn.T
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["node", "f"])

        return features.select("node", "f").mapInArrow(run, "node long, f array<double>")


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def weighted_zscore(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, feature, z): (value - mean) / std * weight over the kept columns."""
    # one row per feature: as many as a vector is long
    w = F.broadcast(weights.where("kept").select("feature", "mean", "std", "weight"))
    return long_form(features).join(w, "feature").select("node", "feature", ((F.col("value") - F.col("mean")) / F.col("std") * F.col("weight")).alias("z"))


def fit(features: DataFrame, borders: list[int], dimensions: int = DIMENSIONS) -> Preprocessing:
    """Means, weights and exact principal components. Every partition reduces its rows to a triangular factor (QR), factors
    are reduced in turn, and only one factor of columns by columns comes to the driver: singular values keep full precision."""
    table = group_weights(feature_stats(features), borders).orderBy("feature").collect()  # a row per feature
    if not any(r["kept"] for r in table):
        raise ValueError("all feature columns are constant")
    mean, std, weight = (np.array([r[c] for r in table]) for c in ("mean", "std", "weight"))
    keep = np.array([r["kept"] for r in table])
    shift, scale, width = mean[keep], weight[keep] / std[keep], len(keep)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, total, n = np.zeros((0, int(keep.sum()))), np.zeros(int(keep.sum())), 0
        for batch in batches:
            if batch.num_rows:
                x = (_rows(batch.column(0), width)[:, keep] - shift) * scale  # of mean 0 but for rounding
                r = np.linalg.qr(np.concatenate([r, x]), mode="r")
                total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_pydict({"r": pa.array([r.tobytes()], pa.binary()), "total": pa.array([total.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    def join(table: pa.Table) -> pa.Table:
        cols = int(keep.sum())
        parts = [np.frombuffer(b, float).reshape(-1, cols) for b in table.column("r").to_pylist()]
        total = sum(np.frombuffer(b, float) for b in table.column("total").to_pylist())
        return pa.table({"r": pa.array([np.linalg.qr(np.concatenate(parts), mode="r").tobytes()], pa.binary()), "total": pa.array([total.tobytes()], pa.binary()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})

    schema = "r binary, total binary, n long"
    parts = features.select("f").mapInArrow(factor, schema).withColumn("part", F.spark_partition_id() % 64)
    parts = parts.groupBy("part").applyInArrow(lambda t: join(t.select(["r", "total", "n"])), schema)
    last = join(pa.Table.from_pylist([r.asDict() for r in parts.collect()], schema=pa.schema([("r", pa.binary()), ("total", pa.binary()), ("n", pa.int64())])))
    r, n = np.frombuffer(last.column("r")[0].as_py(), float).reshape(-1, int(keep.sum())), last.column("n")[0].as_py()
    centre = np.frombuffer(last.column("total")[0].as_py(), float) / n
    # R'R - n c c' is the centred Gram matrix; c is rounding only, so R's own singular values serve
    _, s, v = np.linalg.svd(r, full_matrices=False)
    rank = int((s > s[0] * RANK).sum())
    if not rank:
        raise ValueError("the features have no variance")
    d = min(dimensions, rank)
    return Preprocessing(mean, std, keep, weight, centre, v[:d], s**2 / (s**2).sum(), s)


def explained_variance(ratios: DataFrame, retained: int) -> DataFrame:
    """(component, explained_variance_ratio, cumulative_explained_variance, retained) from (component from 1, ratio)."""
    running = F.sum("explained_variance_ratio").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0))
    return ratios.select("component", "explained_variance_ratio", running.alias("cumulative_explained_variance"), (F.col("component") <= retained).alias("retained"))


def distinct_vectors(features: DataFrame) -> DataFrame:
    return features.agg(F.count_distinct("f").alias("distinct_vectors"))
