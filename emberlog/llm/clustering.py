"""Centroid clustering with bounds that follow the centroids' moves by planar geometry.

Vectors are whole numbers, and so are centroids and squared distances, which makes every assignment
exact: the nearest centroid, the smaller number of equally near ones.

Each vector keeps an upper bound of the distance to its own centroid and a lower bound of the
distance to all others. When centroids move, the upper bound grows by the own centroid's drift.
The lower bound shrinks by less than the largest drift: all vectors of a cluster lie in a sphere
around its old centroid, and for a centroid moving from p to q, seen from the middle of p and q,

    |x - p| - |x - q|  <=  |q - p| * cos(angle between x and the direction of the move),

as |x - p| + |x - q| is at least twice the distance of x from the middle. In the plane of p, q and
the centre of the sphere the smallest such angle is the centre's angle less the half-angle under
which the sphere is seen. A centroid that moves sideways or away hardly loosens the bound.
Vectors whose bounds still leave their own centroid strictly nearest stay; the others tighten the
upper bound, and those still ambiguous are compared with every centroid exactly. Bounds carry a
margin far above rounding errors, so rounding costs a comparison, never a result.

Every round is one narrow pass that writes vectors with their bounds to the shared folder, and one
aggregate of sums per cluster, combined on each task first: a cluster of any size is a few rows
from each task. ``k`` centroids, k sums and k radii pass the driver, whatever the number of
vectors.

Vectors that are NULL, of another length or with a NULL or non-finite component take no part.
Repeated rows count each. Rows without an id are the last to become first centroids. With fewer
than ``k`` vectors there are as many centroids as vectors; an empty table gives an empty table.
Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.registry import query
from emberlog.llm.support import table, written
from emberlog.llm.vectors import complete, matrix, products, scaled

K = 40
ROUNDS = 5
SEED = 2
SCALE = 256
WIDTH = 64
_MARGIN = 1e-9  # relative, of bounds; rounding errors are below 1e-13
_STATE = "id long, v array<int>, cluster int, upper double, lower double"


def squared_distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to each centroid."""
    own, other = (v * v).sum(axis=1), (centroids * centroids).sum(axis=1)
    return own[:, None] + other[None, :] - 2 * products(v, centroids)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, how much nearer any other centroid can have come to a point within
    ``radius`` of the cluster's old centroid."""
    move = (new - old).astype(np.float64)
    drift = np.sqrt((move * move).sum(axis=1))
    middle = (new + old) / 2.0
    out = np.zeros(len(old))
    for i, r in enumerate(radius):
        to_centre = old[i] - middle
        far = np.sqrt((to_centre * to_centre).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip((to_centre * move).sum(axis=1) / (far * drift), -1, 1))
            half = np.arcsin(np.clip(r / far, 0, 1))
            nearer = drift * np.cos(np.maximum(angle - half - _MARGIN, 0))
        # From within the sphere every direction is seen: the whole drift counts.
        nearer = np.where(r * (1 + _MARGIN) < far, np.maximum(nearer, 0), drift)
        nearer[drift == 0] = 0
        nearer[i] = 0
        out[i] = nearer.max() * (1 + _MARGIN)
    return out


def _bounds(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, distance to it and to the next one, by comparison with all."""
    squares = squared_distances(v, centroids)
    at = squares.argmin(axis=1)
    rows = np.arange(len(v))
    upper = np.sqrt(squares[rows, at].astype(np.float64)) * (1 + _MARGIN)
    squares[rows, at] = np.iinfo(np.int64).max
    lower = np.sqrt(squares.min(axis=1).astype(np.float64)) * (1 - _MARGIN)
    return at, upper, lower if len(centroids) > 1 else np.full(len(v), np.inf)


def _half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to its nearest other one, rounded down: what is nearer
    to a centroid than that is nearest to it."""
    squares = squared_distances(centroids, centroids)
    np.fill_diagonal(squares, np.iinfo(np.int64).max)
    return np.sqrt(squares.min(axis=1).astype(np.float64)) / 2 * (1 - _MARGIN)


def _scan(batch: pa.RecordBatch, v: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column("id"), batch.column("v"), pa.array(at.astype(np.int32)), pa.array(upper), pa.array(lower)],
        ["id", "v", "cluster", "upper", "lower"],
    )


def _first(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"), centroids.shape[1])
                yield _scan(batch, v, *_bounds(v, centroids))

    return run


def _again(old: np.ndarray, new: np.ndarray, radius: np.ndarray):
    """Assign anew after centroids moved."""
    drift = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + _MARGIN)
    loose, gaps = loosening(old, new, radius), _half_gaps(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"), new.shape[1])
            at = batch.column("cluster").to_numpy().astype(np.int64)
            upper = batch.column("upper").to_numpy() * (1 + _MARGIN) + drift[at]
            lower = np.maximum(batch.column("lower").to_numpy() * (1 - _MARGIN) - loose[at], 0)
            safe = np.maximum(lower, gaps[at])
            open_ = np.flatnonzero(upper >= safe)
            own = v[open_] - new[at[open_]]
            upper[open_] = np.sqrt((own * own).sum(axis=1).astype(np.float64)) * (1 + _MARGIN)
            open_ = open_[upper[open_] >= safe[open_]]
            if len(open_):
                at[open_], upper[open_], lower[open_] = _bounds(v[open_], new)
            yield _scan(batch, v, at, upper, lower)

    return run


def _distances(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.column("cluster").to_numpy()
                apart = matrix(batch.column("v"), centroids.shape[1]) - centroids[at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("cluster"), pa.array((apart * apart).sum(axis=1))],
                    ["id", "cluster", "distance"],
                )

    return run


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors (id, v) with the least hashes of seed and id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH,
            scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector that takes part, and the final centroids."""
    vector = F.col(vector_col)
    kept = vectors.filter(complete(vector) & (F.size(vector) == width)).select(
        F.col(id_col).cast("long").alias("id"), scaled(vector, scale).alias("v")
    )
    kept = written(kept, "vectors")
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    state = written(kept.mapInArrow(_first(centroids), _STATE), "assigned")
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(width)]
    for _ in range(rounds):
        new, radius = centroids.copy(), np.zeros(len(centroids))
        for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("upper").alias("radius"), *sums).collect():
            new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
            radius[r["cluster"]] = r["radius"]
        state = written(state.mapInArrow(_again(centroids, new, radius), _STATE), "assigned")
        centroids = new
    return written(state.mapInArrow(_distances(centroids), "id long, cluster int, distance long"), "distances"), centroids


def _op12_sql() -> str:
    vectors = f"""
with vectors as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = {WIDTH}
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select cast(row_number() over (order by h, v) - 1 as integer) as c, v as m
  from (select sha256('{SEED}:' || cast(vec_id as varchar)) as h, v from vectors order by h, v limit {K}))"""
    parts = [vectors]
    for i in range(ROUNDS + 1):
        parts.append(f"""
a{i} as materialized (
  select r, min(struct_pack(d := d, c := c)) as best from (
    select r, c, cast(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d
    from vectors, c{i}) group by r)""")
        if i < ROUNDS:
            parts.append(f"""
s{i} as (
  select best.c as c, i, cast(sum(v[i]) as bigint) as s, count(*) as n
  from (select best, v, unnest(range(1, {WIDTH + 1})) as i from a{i} join vectors using (r)) group by best.c, i),
f{i} as (select c, list((s - ((s % n) + n) % n) // n order by i) as m from s{i} group by c),
c{i + 1} as materialized (select c, coalesce(f{i}.m, c{i}.m) as m from c{i} left join f{i} using (c))""")
    last = ROUNDS
    return ",".join(parts) + f"""
select vec_id, best.c as cluster, best.d as distance,
  cast(sum(best.d) over (partition by best.c) as bigint) as cluster_inertia,
  cast(sum(best.d) over () as bigint) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{last} join vectors using (r) join c{last} on c{last}.c = best.c
"""


@query("op12_centroid_clustering", _op12_sql())
def _op12(spark, sf_dir):
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    sums = {r["cluster"]: r["sum"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    total = sum(sums.values())
    # As many rows as centroids.
    per_cluster = spark.createDataFrame(
        [(i, sums.get(i, 0), total, name) for i, name in enumerate(names)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(per_cluster), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
