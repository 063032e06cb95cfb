"""Z-scores and the nearest-centroid activity classifier."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesift.session import durable


def _literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


@dataclass(frozen=True)
class ZScore:
    """Mean and (population) deviation per feature position; a deviation under 1e-6 counts as 1."""

    mean: list[float]
    std: list[float]

    def apply(self, features: Column) -> Column:
        scales = F.arrays_zip(_literal(self.mean).alias("m"), _literal(self.std).alias("s"))
        return F.zip_with(features, scales, lambda x, z: (x - z["m"]) / z["s"])


def fit_zscore(features: DataFrame, column: str = "features") -> ZScore:
    """One row per feature position comes back to the driver (the vector's length)."""
    rows = (
        features.select(F.posexplode_outer(column).alias("p", "x"))
        .groupBy("p")
        .agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
        .orderBy("p")
        .collect()
    )
    return ZScore([r["m"] for r in rows], [r["s"] if r["s"] >= 1e-6 else 1.0 for r in rows])


def sensor_scale(windows: DataFrame, sensor: str = "sensor") -> DataFrame:
    """One row: mean and population deviation over every value of every window (under 1e-6 counts as 1)."""
    spread = windows.select(F.explode_outer(F.flatten(F.col(sensor))).alias("v")).agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")
    )
    return spread.select("mean", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")).alias("std"))


#: Bytes of centers that are sent to the tasks at once; more go in several rounds.
CENTER_BYTES = 64 << 20
#: Centers and rows that are compared at once.
TILE, ROWS = 256, 1024


def _closer(z: np.ndarray, centers: np.ndarray, norms: np.ndarray, names: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
    """Improves ``best`` (squared distance) and ``found`` (rank of the label) of rows ``z`` by ``centers`` in order of norm.

    A center is no nearer than the difference of the norms, so a tile of centers is passed over when that is more than
    all rows of the block have already. Products find who may win, the sums of squares in order of features decide.
    """
    own = np.sqrt((z * z).sum(axis=1))
    tiles = range(0, len(centers), TILE)
    near = [max(0.0, norms[t] - own.max(), own.min() - norms[min(t + TILE, len(centers)) - 1]) for t in tiles]
    for _, t in sorted(zip(near, tiles, strict=True)):
        part, size = centers[t : t + TILE], norms[t : t + TILE]
        low = np.maximum(0.0, np.maximum(size[0] - own, own - size[-1]))
        slack = 1e-9 * (1.0 + own * own + size[-1] ** 2)
        if (low * low > best + slack).all():
            continue
        about = (own * own)[:, None] - 2.0 * (z @ part.T) + (size * size)[None, :]
        least = np.minimum(about.min(axis=1), best)
        r, c = np.nonzero(about <= (least + 2 * slack)[:, None])
        exact = np.zeros(len(r))
        for j in range(z.shape[1]):
            exact += (z[r, j] - part[c, j]) ** 2
        order = np.lexsort((names[t + c], exact, r))
        r, exact, label = r[order], exact[order], names[t + c][order]
        top = np.flatnonzero(np.diff(r, prepend=-1))
        r, exact, label = r[top], exact[top], label[top]
        wins = (exact < best[r]) | ((exact == best[r]) & (label < found[r]))
        best[r[wins]], found[r[wins]] = exact[wins], label[wins]


def _nearest(model: Broadcast, place: int):
    """Rows -> rows with the squared distance and the rank of the nearest center so far (columns behind the others)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, std, centers, norms, names = model.value
        for batch in batches:
            listed = batch.column(place)
            fits = np.array([v is not None and len(v) == len(mean) and None not in v for v in listed.to_pylist()], bool)
            best, found = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (-2, -1))
            rows = np.flatnonzero(fits)
            if len(rows):
                z = (listed.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) - mean) / std
                order = np.argsort((z * z).sum(axis=1))
                for k in range(0, len(rows), ROWS):
                    at = order[k : k + ROWS]
                    own, label = best[rows[at]], found[rows[at]]
                    _closer(z[at], centers, norms, names, own, label)
                    best[rows[at]], found[rows[at]] = own, label
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(best), pa.array(found)], names=batch.schema.names)

    return run


@dataclass(frozen=True)
class Centroids:
    scale: ZScore
    centers: dict[str, list[float]]

    def predict(self, features: DataFrame, column: str = "features") -> DataFrame:
        """Adds ``predicted``: the nearest center, the first label on ties; null without features of the right length.

        Centers go to the tasks as arrays of checked size, ``CENTER_BYTES`` at a time; rows keep the best so far between
        rounds. Nothing is shuffled.
        """
        labels = sorted(self.centers)
        mean, std = np.array(self.scale.mean), np.array(self.scale.std)
        matrix = np.array([self.centers[k] for k in labels], float).reshape(len(labels), len(mean))
        norms = np.sqrt((matrix * matrix).sum(axis=1))
        held = features.select("*", F.lit(float("inf")).alias("_best"), F.lit(-1).cast("bigint").alias("_found"))
        step = max(1, CENTER_BYTES // max(1, 8 * len(mean)))
        spark = features.sparkSession
        for start in range(0, len(labels), step):
            own = np.arange(start, min(start + step, len(labels)))
            own = own[np.argsort(norms[own], kind="stable")]
            sent = spark.sparkContext.broadcast((mean, std, matrix[own], norms[own], own))
            held = held.mapInArrow(_nearest(sent, features.columns.index(column)), held.schema)
            if start + step < len(labels):
                held = durable(held)
        name = spark.createDataFrame(list(enumerate(labels)), "_found bigint, predicted string")
        return held.join(F.broadcast(name), "_found", "left").select(*features.columns, "predicted")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [("mean", None, self.scale.mean), ("std", None, self.scale.std)]
        rows += [("center", k, v) for k, v in sorted(self.centers.items())]
        return spark.createDataFrame(rows, "part string, label string, at array<double>")

    @staticmethod
    def from_table(table: DataFrame) -> "Centroids":
        rows = table.collect()
        part = {r["part"]: list(r["at"]) for r in rows if r["part"] != "center"}
        return Centroids(
            ZScore(part["mean"], part["std"]), {r["label"]: list(r["at"]) for r in rows if r["part"] == "center"}
        )


def fit_centroids(features: DataFrame, label: str = "label", column: str = "features") -> Centroids:
    """Class means of the z-scored features: one vector per label comes back, as the model's parameters."""
    scale = fit_zscore(features, column)
    means = (
        features.select(F.col(label).cast("string").alias("label"), F.posexplode_outer(scale.apply(F.col(column))).alias("p", "x"))
        .groupBy("label", "p")
        .agg(F.avg("x").alias("m"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("p", "m"))).alias("ms"))
        .collect()
    )
    return Centroids(scale, {r["label"]: [m["m"] for m in r["ms"]] for r in means})
