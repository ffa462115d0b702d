"""Centroid clustering of integer vectors, the nearest centroid found by the threshold algorithm.

For every dimension the centroids stand in a list sorted by their component.  From a vector's own value the list is walked outward,
nearest component first, in all dimensions in step; a centroid met for the first time gets its exact distance.  What no list has
shown yet lies at least as far in every dimension as that list's next entry, so the walk ends once the sum of these frontier
distances strictly exceeds the best exact distance: a farther walk could not even find a tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltally.llm.registry import query, table
from reeltally.plans.session import discard, shared_dir

CLUSTERS, ROUNDS, WALK_ROWS = 16, 3, 4096


class Clusters(NamedTuple):
    """``rows``: ``id``, ``cluster``, ``distance``; ``centroids``: one row of components for each number, as Python integers."""

    rows: DataFrame
    centroids: list[list[int]]


class Lists:
    """The centroids' sorted lists, one for each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.who = np.argsort(centroids, axis=0, kind="stable")
        self.value = np.take_along_axis(centroids, self.who, 0)
        self.top = int(np.abs(centroids).max(initial=0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (the smaller of equally near ones) and squared distance of every row's nearest centroid."""
        k, dims = self.centroids.shape
        if (int(np.abs(x).max(initial=0)) + self.top) ** 2 * dims >= 1 << 63:
            raise ValueError("squared distances leave 64 bits")
        number, best = np.full(len(x), k), np.full(len(x), np.iinfo(np.int64).max)
        met = np.zeros((len(x), k), bool)
        live, dim = np.arange(len(x)), np.arange(dims)
        right = np.stack([np.searchsorted(self.value[:, j], x[:, j]) for j in range(dims)], 1) if dims else np.zeros(x.shape, np.int64)
        left = right - 1
        while len(live):
            own = x[live]
            back, ahead = own - self.value[np.maximum(left, 0), dim], self.value[np.minimum(right, k - 1), dim] - own
            down = (left >= 0) & ((right >= k) | (back <= ahead))
            shown = self.who[np.where(down, left, right), dim]
            left, right = left - down, right + ~down
            fresh = np.zeros((len(live), k), bool)
            np.put_along_axis(fresh, shown, True, 1)
            fresh &= ~met[live]
            met[live] |= fresh
            i, c = np.nonzero(fresh)  # ascending numbers, so the first of equal distances is the smallest
            exact = ((own[i] - self.centroids[c]) ** 2).sum(1)
            order = np.lexsort((c, exact, i))
            order = order[np.diff(i[order], prepend=-1) > 0]
            i, c, exact = live[i[order]], c[order], exact[order]
            win = (exact < best[i]) | (exact == best[i]) & (c < number[i])
            number[i[win]], best[i[win]] = c[win], exact[win]
            # A list that is walked to both ends has shown every centroid.
            over = ((left < 0) & (right >= k)).any(1) if dims else np.ones(len(live), bool)
            back, ahead = own - self.value[np.maximum(left, 0), dim], self.value[np.minimum(right, k - 1), dim] - own
            step = np.where(left < 0, ahead, np.where(right >= k, back, np.minimum(back, ahead)))
            go = ~over & ((step**2).sum(1) <= best[live])
            live, left, right = live[go], left[go], right[go]
        return number, best


def _vectors(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of the batch's vectors, with the place of their first row."""
    flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    for lo in range(0, len(flat), WALK_ROWS):
        yield lo, flat[lo : lo + WALK_ROWS]


def cluster_vectors(df: DataFrame, *, dims: int, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, id_col: str = "id", vec_col: str = "vec") -> Clusters:
    """Assigns integer vectors to the nearest of ``clusters`` centroids, moved ``rounds`` times to the floored mean of their vectors.

    ``vec_col`` is an array of long with ``dims`` components.  The centroids begin as the vectors of the smallest sha256 of
    ``<seed>:<id>``, in the order of these hashes (equal ids by their vectors); a centroid without vectors stays.

    The vectors are written once and stay where they are: each round is one pass that leaves a row of sums for each centroid and
    batch, combined before a shuffle of at most ``clusters`` * ``dims`` rows a task.  Only centroids, ``clusters`` * ``dims``
    numbers whatever the table's size, travel through the driver.

    Null vectors, vectors of another length and vectors with null components take no part.  Rows with a null id are clustered, but
    are the last to begin a centroid.  Repeated rows count as often as they occur; with fewer rows than ``clusters`` there
    are as many centroids as rows; an empty table gives no rows and no centroids; other columns are ignored.  Components so large
    that a squared distance leaves 64 bits raise an error.
    """
    spark = df.sparkSession
    sound = F.col(vec_col).isNotNull() & (F.size(vec_col) == dims) & F.forall(vec_col, lambda x: x.isNotNull())
    path = shared_dir(spark)
    df.where(sound).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<long>").alias("vec")).write.parquet(path)
    rows = spark.read.parquet(path)
    kind = rows.schema["id"].dataType.simpleString()

    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    begun = rows.orderBy(first.asc_nulls_last(), "vec").limit(clusters).select("vec").collect()
    centroids = [list(r.vec) for r in begun]

    def sums(now: list[list[int]]):
        lists = Lists(np.array(now, np.int64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total, n = np.zeros((len(now), dims), np.int64), np.zeros(len(now), np.int64)
                for _, x in _vectors(batch, dims):
                    number, _ = lists.nearest(x)
                    np.add.at(total, number, x)
                    n += np.bincount(number, minlength=len(now))
                has = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"cluster": has.astype("i4"), "n": n[has], "total": [*total[has]]}, schema=out)

        out = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])
        return rows.mapInArrow(run, "cluster int, n long, total array<long>")

    for _ in range(rounds if centroids else 0):
        part = sums(centroids).select("cluster", "n", F.posexplode("total").alias("dim", "x"))
        moved = part.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()
        centroids = [list(c) for c in centroids]
        for r in moved:
            centroids[r.cluster][r.dim] = int(r.x) // r.n

    last = Lists(np.array(centroids, np.int64).reshape(-1, dims))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [last.nearest(x) for _, x in _vectors(batch, dims)]
            number, distance = map(np.concatenate, zip(*found)) if found else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number.astype("i4")), pa.array(distance.astype("i8"))], ["id", "cluster", "distance"])

    done = shared_dir(spark)
    rows.mapInArrow(assign, f"id {kind}, cluster int, distance long").write.parquet(done)
    discard(spark, path)
    return Clusters(spark.read.parquet(done), centroids)


def with_inertia(found: Clusters) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` (distances summed over the cluster and over all) and ``centroid_sha256``, the digest of the
    centroid's components as decimal integers joined by commas.  One row for each centroid is joined, so it is broadcast."""
    spark = found.rows.sparkSession
    held = {r.cluster: r.total for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    every = sum(held.values())
    named = [(c, held[c], every, hashlib.sha256(",".join(map(str, found.centroids[c])).encode()).hexdigest()) for c in held]
    per = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(per), "cluster")


def _rounds_sql(rounds: int) -> str:
    """``c<r>`` and ``a<r>``: centroids and assignment of round ``r``, over ``v`` (row, component) in long form."""
    out = []
    for r in range(rounds + 1):
        if r:
            out.append(f"""
    m{r} AS MATERIALIZED (
        SELECT a.cluster AS c, v.d, sum(v.x) AS s, count(*) AS n FROM a{r - 1} a JOIN v USING (rid) GROUP BY ALL
    ), c{r} AS MATERIALIZED (
        SELECT c.c, c.d, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x FROM c{r - 1} c LEFT JOIN m{r} m USING (c, d)
    ),""")
        out.append(f"""
    a{r} AS MATERIALIZED (
        SELECT rid, c AS cluster, distance FROM (
            SELECT v.rid, c.c, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM v JOIN c{r} c USING (d) GROUP BY ALL
        ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, c) = 1
    ),""")
    return "".join(out)


@query(
    "op11_centroid_clustering",
    f"""
    WITH k AS MATERIALIZED (
        SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x AS DOUBLE)) AS BIGINT)) AS vec
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), v AS MATERIALIZED (
        SELECT rid, unnest(vec) AS x, unnest(range(64)) AS d FROM k
    ), s AS (
        SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, vec) - 1 AS c, rid FROM k
    ), c0 AS MATERIALIZED (
        SELECT c, v.d, v.x FROM s JOIN v USING (rid) WHERE c < 16
    ), {_rounds_sql(ROUNDS)}
    h AS (SELECT c, sha256(string_agg(cast(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
    SELECT vec_id, cast(cluster AS INTEGER) AS cluster, cast(distance AS BIGINT) AS distance,
        cast(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, cast(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM a{ROUNDS} JOIN k USING (rid) JOIN h ON h.c = cluster
    """,
)
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    sound = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("embedding").isNotNull() & sound)
    rows = rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)).alias("vec"))
    out = with_inertia(cluster_vectors(rows, dims=64))
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
