"""Centroid clustering by delta Lloyd rounds.

The state, each vector with its centroid, lies in a table of the shared folder, and the sums and counts of every
centroid's vectors are kept between rounds. A round knows which centroids changed at its start. A vector whose own
centroid stayed is compared with the changed ones only, for all others were farther before and are so now; one whose
own centroid changed is compared with all. Vectors that move are written apart, so that only they are read to learn
what centroids gain and lose: Spark sums signed integer transfers by (centroid, component), and centroids that
neither gained nor lost aren't computed anew. When no centroid changes, the remaining rounds would change nothing.

Only the centroids, k * dims whole numbers, reach the driver and go to all tasks. No step groups vectors by centroid
other than in sums with partial results, so a centroid may own any share of all rows. Each round's table is written
before the one before it is deleted; a lost executor costs the tasks it held.

Arithmetic is exact: 64-bit integers where these hold all that can occur, else Python's.

Defined cases: vectors that are null, of another length, or with null or non-finite components take no part. A row
with a null id is assigned like others, but never a first centroid. Rows with equal ids are rows of their own; of
those the smaller vector comes first where first centroids are taken. Fewer rows than k give as many centroids. An
empty table, or one without an id, gives an empty result. A component beyond 2^62 / scale, or a distance or a sum of them beyond 64 bits, is
an error. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.shared import cut, drop, shared_dir, small_batches
from paceline.llm.vectors import as_longs, floor_mean, matrix, squared_distances, whole_vectors

STATE = "id {}, v array<long>, was int, cluster int, moved boolean"


def first_centroids(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids, in the order of the hashes."""
    named = rows.filter(F.col("id").isNotNull()).withColumn("hash", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    return [list(r.v) for r in named.orderBy("hash", "v").limit(k).select("v").collect()]


def nearest(v: np.ndarray, owner: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> np.ndarray:
    """Each vector's nearest centroid, ties to the smaller number. owner: that of the round before, -1 for none."""
    out = owner.copy()
    anew = (owner < 0) | changed[owner]
    if anew.any():
        out[anew] = squared_distances(v[anew], centroids).argmin(axis=1)
    stayed, moved_to = np.flatnonzero(~anew), np.flatnonzero(changed)
    if len(stayed) and len(moved_to):
        d = squared_distances(v[stayed], centroids[moved_to])
        best = d.argmin(axis=1)
        to, at = moved_to[best], d[np.arange(len(d)), best]
        own = distance_to(v[stayed], centroids, owner[stayed])
        nearer = (at < own) | ((at == own) & (to < owner[stayed]))
        out[stayed[nearer.astype(bool)]] = to[nearer.astype(bool)]
    return out


def distance_to(v: np.ndarray, centroids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to the centroid of its own."""
    parts = [(owner == c, squared_distances(v[owner == c], centroids[c : c + 1])[:, 0]) for c in np.unique(owner)]
    out = np.zeros(len(v), object if any(d.dtype == object for _, d in parts) else np.int64)
    for mine, d in parts:
        out[mine] = d
    return out


def _assigned(state: DataFrame, centroids: list[list[int]], changed: list[bool]) -> DataFrame:
    sc = state.sparkSession.sparkContext
    sent = sc.broadcast((np.array(centroids, np.int64), np.array(changed)))
    kind = dict(state.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, new = sent.value
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                owner = part.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                now = nearest(matrix(part.column("v"), c.shape[1]), owner, c, new)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(owner.astype(np.int32)), pa.array(now.astype(np.int32)), pa.array(now != owner)], names=["id", "v", "was", "cluster", "moved"])

    return state.select("id", "v", "cluster").mapInArrow(run, STATE.format(kind))


def _written(state: DataFrame) -> DataFrame:
    """The state in the shared folder, vectors that moved in files of their own."""
    spark = state.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with small_batches(spark):
        state.write.partitionBy("moved").option("compression", "zstd").parquet(path)
    out = spark.read.schema(state.schema).parquet(path)
    out.cut_path = path
    return out


def transfers(state: DataFrame) -> list[tuple[int, int, list[int]]]:
    """(centroid, gained rows, gained sums) of the vectors that moved; losses count as negative gains."""
    moved = state.filter("moved").select("v", F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")))).alias("m"))
    parts = moved.filter("m.c >= 0").select("m.c", "m.sign", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("c", "i").agg(F.sum((F.col("x") * F.col("sign")).cast("decimal(38,0)")).alias("s"), F.sum("sign").alias("n"))
    found: dict[int, tuple[int, dict[int, int]]] = {}
    for r in sums.collect():  # k * dims rows at most
        found.setdefault(r.c, (r.n, {}))[1][r.i] = int(r.s)
    return [(c, n, [s[i] for i in range(len(s))]) for c, (n, s) in sorted(found.items())]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, salt: str = "2:", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid (its whole components) by vector."""
    kept = whole_vectors(vectors.filter(F.size(vector) == dims), scale, vector, F.col(id_col).alias("id"))
    rows = cut(kept)
    centroids = first_centroids(rows, k, salt)
    out = "id {}, cluster int, distance long".format(dict(rows.dtypes)["id"])
    if not centroids:
        drop(rows)
        return finished(rows.sparkSession.createDataFrame([], out), [], id_col)
    n, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
    changed = [True] * len(centroids)
    state = rows.withColumn("cluster", F.lit(-1))
    table = rows
    for r in range(rounds + 1):
        if not any(changed):
            break
        new = _written(_assigned(state, centroids, changed))
        drop(table)
        state = table = new
        if r == rounds:
            break
        gained = transfers(state)
        changed = [False] * len(centroids)
        for c, dn, ds in gained:
            n[c] += dn
            sums[c] = [a + b for a, b in zip(sums[c], ds, strict=True)]
            if n[c]:
                mean = floor_mean(sums[c], n[c])
                changed[c] = mean != centroids[c]
                centroids[c] = mean
    sent = rows.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            owner = b.column("cluster").to_numpy(zero_copy_only=False)
            d = as_longs(distance_to(matrix(b.column("v"), c.shape[1]), c, owner))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cluster"), pa.array(d)], names=["id", "cluster", "distance"])

    done = cut(state.select("id", "v", "cluster").mapInArrow(measured, out))
    drop(table)
    return finished(done, centroids, id_col)


def finished(done: DataFrame, centroids: list[list[int]], id_col: str) -> DataFrame:
    """The vectors with what is known of their centroids and of all."""
    named = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), x) for c, x in enumerate(centroids)]
    means = done.sparkSession.createDataFrame(named, "cluster int, centroid_sha256 string, centroid array<long>")
    per = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = per.agg(F.sum("cluster_inertia").alias("inertia"))
    known = per.join(F.broadcast(means), "cluster").join(F.broadcast(total), F.lit(True))  # a row for each centroid; one row
    return done.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
