"""Centroid clustering over zone maps on a space-filling curve.

Vectors of small integers are put in the order of a Hilbert curve over all their dimensions and cut into blocks, each
with the least and the largest value of every component (its box). For a box, the distance to a centroid has a lower and
an upper bound; a centroid whose lower bound is beyond the least upper bound is nearest to none of the block's vectors.
What is left are the block's candidates, and they alone are compared with its vectors, all at once and exactly. Blocks
are written once and read in every round; what the driver gets of a round is one sum for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize
from tidemark.session import local_table

EXACT = 1 << 22  # up to here products of 64 components and their sums are exact in doubles
LARGEST = (1 << 63) - 1
HAIR = 1e-12  # bounds are in doubles: a hair more than needed stays
TYPES = ("<i2", "<i4", "<i8")
BLOCK = "first long, ids array<string>, type string, cells binary, low array<double>, high array<double>"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of whole numbers below 2 ** bits: equally long bytes that sort as the curve goes."""
    x = cells.astype(np.uint32).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(turned, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= flip
    planes = [(x[i] >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1) for i in range(n)]
    return np.packbits(np.array(planes, dtype=np.uint8).T, axis=1)


def whole_vectors(df: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: vectors of `size` finite components, each floor(scale * x); repeated rows stay."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.where(F.coalesce((F.size("v") == size) & finite, F.lit(False)))
    end = 2.0**62
    floor = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(end)), F.lit(-end))).cast("double")
    return kept.select("vec_id", F.transform("v", floor).alias("v"))


def _blocks(vectors: DataFrame, rows: int, bits: int) -> DataFrame:
    """Vectors on the curve, in blocks of at most `rows` that lie next to each other. Equal vectors have one place, so the id spreads them."""
    size = F.col("v")
    span = vectors.agg(F.min(F.array_min(size)).alias("a"), F.max(F.array_max(size)).alias("b")).first()
    low, step = (span["a"] or 0.0), max((span["b"] or 0.0) - (span["a"] or 0.0), 1.0) / ((1 << bits) - 1)

    def placed(v: pd.Series) -> pd.Series:
        cells = np.rint((np.array(v.tolist()) - low) / step) if len(v) else np.zeros((0, 1))
        return pd.Series([k.tobytes() for k in hilbert_keys(np.clip(cells, 0, (1 << bits) - 1), bits)])

    place = F.pandas_udf(placed, "binary")
    ordered = vectors.withColumn("_place", place("v")).repartitionByRange("_place", F.xxhash64("vec_id")).sortWithinPartitions("_place", F.xxhash64("vec_id"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= rows:
                whole = pd.concat(held)
                whole_blocks = len(whole) // rows * rows
                yield boxed(whole[:whole_blocks])
                held = [whole[whole_blocks:]]
        if held and sum(map(len, held)):
            yield boxed(pd.concat(held))

    def boxed(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for at in range(0, len(part), rows):
            own = part[at : at + rows]
            cells = np.array(own["v"].tolist())
            least, most = cells.min(axis=0), cells.max(axis=0)
            reach = max(abs(least).max(), abs(most).max())
            kind = next(t for t in TYPES if reach <= np.iinfo(t).max)
            out.append((at, list(own["vec_id"]), kind, cells.astype(kind).tobytes(), least, most))
        return pd.DataFrame(out, columns=["first", "ids", "type", "cells", "low", "high"])

    return materialize(ordered.select(F.col("vec_id").cast("string").alias("vec_id"), "v").mapInPandas(cut, BLOCK), "curve-blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector of the box, ties included.

    Two bounds: a centroid goes if its least distance to the box is beyond the largest of another; or if another is nearer
    all over the box. The difference of two squared distances is linear in the vector, so its largest value over a box is
    exact: one end of each component.
    """
    c = centroids.astype(np.float64)
    inside = np.maximum(np.maximum(low - c, c - high), 0)
    farthest = np.maximum(np.abs(low - c), np.abs(high - c))
    near, far = (inside**2).sum(axis=1), (farthest**2).sum(axis=1)
    some = np.flatnonzero(near * (1 - HAIR) <= far.min() * (1 + HAIR))
    c = c[some]
    slope = 2 * (c[:, None, :] - c[None, :, :])
    norms = (c**2).sum(axis=1)
    most = np.maximum(slope * low, slope * high).sum(axis=2) + norms[None, :] - norms[:, None]  # of d(x, other) - d(x, own)
    return some[~(most < -HAIR * (1 + far.max())).any(axis=1)]


def nearest_of(cells: np.ndarray, centroids: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centroids `some` to each row, ties to the smaller number, and the squared distance. Exact.

    Whole numbers up to 2 ** 22 are compared in doubles, which hold all sums; larger ones as Python's, their distances end
    at the largest long.
    """
    own = centroids[some]
    reach = max([abs(int(x)) for x in (cells.min(), cells.max(), own.min(), own.max())])
    if reach <= EXACT:
        x, c = cells.astype(np.float64), own.astype(np.float64)
        distances = (x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)
    else:
        x = cells.astype(object)
        distances = np.array([((x - c) ** 2).sum(axis=1) for c in own.astype(object)]).T
    best = distances.argmin(axis=1)
    least = distances[np.arange(len(cells)), best]
    return some[best], np.array([min(int(d), LARGEST) for d in least], dtype=np.int64) if reach > EXACT else least.astype(np.int64)


def _assigned(batches: Iterator[pd.DataFrame], centroids: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, cells, cluster and distance of every block."""
    for batch in batches:
        for ids, kind, raw, low, high in zip(batch["ids"], batch["type"], batch["cells"], batch["low"], batch["high"], strict=True):
            cells = np.frombuffer(raw, dtype=kind).reshape(len(ids), -1)
            cluster, distance = nearest_of(cells, centroids, candidates(np.asarray(low), np.asarray(high), centroids))
            yield ids, cells, cluster, distance


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each centroid's mean; empty ones stay. A task gives one row of sums for each centroid."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(centroids.shape, dtype=object)
        count = np.zeros(len(centroids), dtype=np.int64)
        for _, cells, cluster, _ in _assigned(batches, centroids):
            for k in np.unique(cluster):
                own = cells[cluster == k]
                wide = own.astype(np.int64) if cells.dtype.itemsize < 8 else own.astype(object)
                total[k] += wide.sum(axis=0)
                count[k] += len(own)
        used = np.flatnonzero(count)
        if len(used):
            yield pd.DataFrame({"cluster": used, "n": count[used], "total": [[str(x) for x in total[k]] for k in used]})

    parts = blocks.select("ids", "type", "cells", "low", "high").mapInPandas(sums, "cluster int, n long, total array<string>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("place", "x"))
    found = each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # clusters x components
    new = centroids.copy()
    for r in found:
        new[r["cluster"], r["place"]] = int(r["x"]) // r["n"]
    return new


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster_vectors(
    df: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, block_rows: int = 256, bits: int = 4, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `size` components, none null or not finite, as whole numbers floor(scale * x); beyond 2 ** 62 these end
    there, and so do distances and inertias at the largest long. The centroids start as the `k` vectors with the smallest
    SHA-256 of `seed:vec_id` (vectors of equal ids by their components), fewer if there are fewer; a vector without an id is
    assigned but never a start. Ties go to the smaller number. Repeated rows give repeated rows and count each; an empty table gives an
    empty result; other columns are not read.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, size, scale, id_col, vector_col)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    starts = vectors.where("vec_id IS NOT NULL").orderBy(order, "v").select("v").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([[int(x) for x in r["v"]] for r in starts], dtype=np.int64)
    blocks = _blocks(vectors, block_rows, bits)
    for _ in range(rounds):
        centroids = _moved(blocks, centroids)

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, _, cluster, distance in _assigned(batches, centroids):
            yield pd.DataFrame({"vec_id": list(ids), "cluster": cluster.astype(np.int32), "distance": distance})  # ids as text are exact, with nulls too

    found = materialize(blocks.select("ids", "type", "cells", "low", "high").mapInPandas(final, "vec_id string, cluster int, distance long"), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # a row for each cluster
    ends = lambda x: min(int(x), LARGEST)
    whole = ends(sum(int(r["d"]) for r in sums))
    rows = [(r["cluster"], ends(r["d"]), whole, _digest(centroids[r["cluster"]])) for r in sums]
    about = local_table(spark, rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(F.col("vec_id").cast("long").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
