"""Centroid clustering of whole-number vectors with an incrementally kept distance matrix.

Every vector keeps its exact integer dot products with all centroids in a stored table.
When centroids move, only the components that changed are multiplied and added to the
products; distances follow from products and squared lengths, and the nearest centroid is
taken anew. Nothing is rounded, so any layout of the input gives the same classes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demarca.llm.common import drop_stored, shared_folder, stored

#: Components below this fit 64-bit products and distances; others are handled as Python integers.
NARROW = 1 << 24

#: Sums go through Spark in limbs of so many bits, so that no total overflows.
LIMB = 40

STATE = "v binary, dots binary, wide string, cluster int, distance long"

#: Places of a cluster's row count and distance sum among its component sums.
ROWS, DISTANCE = -1, -2

Centroids = list[list[int]]


@dataclass
class Clustering:
    """``rows`` (vec_id, cluster, distance), the final ``centroids``, and rows and distance sum per cluster."""

    rows: DataFrame
    centroids: Centroids
    sizes: list[int]
    inertias: list[int]


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, all of them numbers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dims) & sound


def seeds(vectors: DataFrame, k: int, seed: int) -> Centroids:
    """The whole-number vectors with the smallest sha256 of seed and id, at most ``k``, in that order.

    Equal ids go by their components; null ids come last.
    """
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.select("v", hashed.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    return [[int(x) for x in r.v] for r in first.collect()]


def moved(v: np.ndarray, dots: np.ndarray, old: Centroids, new: Centroids) -> None:
    """Add to the products what the nonzero component changes of each centroid make."""
    for c, (before, after) in enumerate(zip(old, new, strict=True)):
        changed = [j for j, (a, b) in enumerate(zip(before, after, strict=True)) if a != b]
        if changed:
            dots[:, c] += v[:, changed] @ np.array([after[j] - before[j] for j in changed], dtype=v.dtype)


def nearest(v: np.ndarray, dots: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (the smaller number among equals) and the squared distance to it."""
    norms = np.array([sum(x * x for x in c) for c in centroids], dtype=v.dtype)
    distances = (v * v).sum(axis=1)[:, None] - 2 * dots + norms[None, :]
    cluster = distances.argmin(axis=1)
    return cluster, distances[np.arange(len(v)), cluster]


def integers(values: np.ndarray) -> np.ndarray:
    """Whole doubles of any size as Python integers."""
    return np.array([int(x) for x in values.ravel()], dtype=object).reshape(values.shape)


def assigned(state: DataFrame, old: Centroids, new: Centroids) -> DataFrame:
    """The state after the centroids moved from ``old`` to ``new``."""
    k, dims = len(new), len(new[0])
    far = max((abs(x) for c in [*old, *new] for x in c), default=0) >= NARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype="<f8").reshape(n, dims)
            kept, text = batch.column("dots").to_pylist(), batch.column("wide").to_pylist()
            wide = (np.abs(v) >= NARROW).any(axis=1) | far | np.array([t is not None for t in text])
            dots, texts = [None] * n, [None] * n
            cluster, distance = np.zeros(n, dtype=np.int32), [None] * n
            for at, exact in ((np.flatnonzero(~wide), False), (np.flatnonzero(wide), True)):
                if not len(at):
                    continue
                own = integers(v[at]) if exact else v[at].astype(np.int64)
                products = np.zeros((len(at), k), dtype=own.dtype)
                for row, i in enumerate(at):
                    if text[i] is not None:
                        products[row] = [int(x) for x in text[i].split(",")]
                    elif kept[i] is not None:
                        products[row] = np.frombuffer(kept[i], dtype="<i8").astype(own.dtype)
                moved(own, products, old, new)
                cluster[at], found = nearest(own, products, new)
                for row, i in enumerate(at):
                    distance[i] = int(found[row]) if found[row] < 1 << 63 else None
                    if exact:
                        texts[i] = ",".join(map(str, products[row]))
                    else:
                        dots[i] = products[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("v"),
                    pa.array(dots, pa.binary()),
                    pa.array(texts, pa.string()),
                    pa.array(cluster),
                    pa.array(distance, pa.int64()),
                ],
                names=["vec_id", "v", "dots", "wide", "cluster", "distance"],
            )

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.mapInArrow(run, f"vec_id {kind}, {STATE}")


def totals(state: DataFrame, centroids: Centroids) -> dict[int, dict[int, int]]:
    """Per non-empty cluster its component sums, row count and distance sum, whatever their size.

    A task adds up its own rows; Spark adds up the tasks' sums. What comes back is one
    value per cluster, component and limb.
    """
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = defaultdict(int)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype="<f8").reshape(n, dims)
            cluster = batch.column("cluster").to_numpy()
            narrow = np.abs(v).max() < NARROW
            v = v.astype(np.int64) if narrow else integers(v)
            for c in np.unique(cluster).tolist():
                own = v[cluster == c]
                for j, total in enumerate(own.sum(axis=0)):
                    sums[c, j] += int(total)
                sums[c, ROWS] += len(own)
                center = np.array(centroids[c], dtype=object)
                near = narrow and max(map(abs, centroids[c])) < NARROW
                apart = own - (center.astype(np.int64) if near else center)
                sums[c, DISTANCE] += int((apart * apart).sum(axis=1).astype(object).sum())
        out = defaultdict(list)
        for (c, j), total in sums.items():
            limb = 0
            while True:
                last = -(1 << LIMB) <= total < 1 << LIMB
                for name, x in zip(("c", "j", "limb", "part"), (c, j, limb, total if last else total % (1 << LIMB)), strict=True):
                    out[name].append(x)
                if last:
                    break
                total, limb = total >> LIMB, limb + 1
        arrays = [pa.array(out[n], pa.int32()) for n in ("c", "j", "limb")]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(out["part"], pa.int64())], names=["c", "j", "limb", "part"])

    parts = state.select("v", "cluster").mapInArrow(run, "c int, j int, limb int, part long")
    found: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for c, j, limb, part in parts.groupBy("c", "j", "limb").agg(F.sum("part")).collect():
        found[c][j] += part << (LIMB * limb)
    return found


def clustered(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> Clustering:
    """Cluster floor(scale * x) of all usable vectors around ``k`` moving centroids.

    Each of ``rounds`` rounds assigns every vector to the nearest centroid and moves every
    non-empty centroid to the componentwise floor of its vectors' mean; then vectors are
    assigned once more. Vectors with null or non-finite components or another length, and
    null vectors, are left out; null and repeated ids, and repeated vectors, are rows of
    their own. Fewer vectors than ``k`` make fewer centroids; none give no rows. A squared
    distance beyond 64 bits is null, the assignment stays exact. Other columns are not read.

    The driver holds the centroids and one sum per cluster and component. Each round's
    state is written to the shared folder and its predecessor removed.
    """
    spark, col = vectors.sparkSession, F.col(f"`{vector}`")
    whole = F.transform(col, lambda x: F.lit(float(scale)) * x.cast("double"))
    rows = vectors.where(usable(col, dims)).select(F.col(f"`{vec_id}`").alias("vec_id"), whole.alias("v"))
    rows = rows.where(usable(F.col("v"), dims))  # a product may leave the range of doubles
    kind = rows.schema["vec_id"].dataType.simpleString()
    centroids = [[int(np.floor(x)) for x in c] for c in seeds(floored(rows), k, seed)]
    if not centroids:
        return Clustering(spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), [], [], [])
    state = rows.mapInArrow(packed, f"vec_id {kind}, v binary").withColumns(
        {"dots": F.lit(None).cast("binary"), "wide": F.lit(None).cast("string")}
    )
    old, path = [[0] * dims for _ in centroids], None
    for turn in range(rounds + 1):
        before, path = path, shared_folder(spark)
        state = stored(assigned(state, old, centroids), path=path)
        found = totals(state, centroids)
        if before:
            drop_stored(spark, before)
        if turn < rounds:
            old = centroids
            centroids = [
                [found[c][j] // found[c][ROWS] for j in range(dims)] if c in found else own for c, own in enumerate(old)
            ]
    numbers = range(len(centroids))
    return Clustering(
        state.select("vec_id", "cluster", "distance"),
        centroids,
        [found[c][ROWS] if c in found else 0 for c in numbers],
        [found[c][DISTANCE] if c in found else 0 for c in numbers],
    )


def floored(rows: DataFrame) -> DataFrame:
    """Whole components as doubles, for the seeds; floor on doubles would end at 64 bits."""
    small = F.lit(float(1 << 52))
    whole = F.transform("v", lambda x: F.when(F.abs(x) < small, F.floor(x).cast("double")).otherwise(x))
    return rows.withColumn("v", whole)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their whole doubles."""
    for batch in batches:
        n, flat = batch.num_rows, batch.column("v").flatten().to_numpy(zero_copy_only=False)
        v = np.floor(flat).astype("<f8").reshape(n, -1) if n else np.empty((0, 0))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array([x.tobytes() for x in v], pa.binary())], names=["vec_id", "v"]
        )
