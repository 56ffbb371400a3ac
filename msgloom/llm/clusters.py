"""Clustering of vectors around centroids, exact in integers, over subvector dictionaries.

The dimensions of a vector form blocks. Chunks of vectors are encoded once: per block a
dictionary of the different subvectors of the chunk, and one code per vector. Nothing is lost. In
a round each chunk computes the squared distances of its different subvectors to the blocks of
all centroids, once, and a vector's distance is the sum of its codes' entries. A dictionary
travels with its chunk, so that no table grows with the data: a task holds one chunk and the
centroids. What is shuffled in a round is a sum per chunk, cluster and dimension, and the driver gets
one row per cluster.

Vectors with another number of components, or with a NULL or non-finite one, are left out; so are
NULL vectors. A component x counts as floor(256 x), which must lie within 2^27, so that a distance
is a long; another is an error. Equal distances go to the smaller cluster. Rows that share a vec_id, also
NULL, are separate vectors; seeds are told apart by id and then by components, and vectors without id
come last. With fewer vectors than clusters there are as many clusters. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.llm.tables import Scratch

DIMENSIONS = 64
SCALE = 256
#: Dimensions of a subvector.
BLOCK = 2
#: Vectors encoded together.
CHUNK = 16_384
#: Vectors whose distances are summed at a time.
_ROWS = 2_048
LIMIT = 1 << 27
# Fixed value: prefix of the hashed id that orders the seeds.
SEED_PREFIX = "2:"

_CHUNKS = "vec_ids array<long>, codes binary, sizes array<int>, subvectors binary"
ASSIGNED = "vec_id long, cluster int, distance long"


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and the vector in integers, of the vectors that count."""
    valid = embeddings.where(
        f"size(embedding) = {DIMENSIONS} AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    )
    scaled = f"{SCALE} * CAST(x AS DOUBLE)"
    whole = f"if(abs({scaled}) <= {LIMIT}, CAST(floor({scaled}) AS INT), raise_error('a component is beyond the range of distances'))"
    return valid.selectExpr("CAST(vec_id AS LONG) AS vec_id", f"transform(embedding, x -> {whole}) AS vector")


def seeds(vectors: DataFrame, clusters: int) -> np.ndarray:
    """The first centroids: vectors in the order of their hashed ids. A top-k of bounded size."""
    order = F.sha2(F.concat(F.lit(SEED_PREFIX), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(order.asc_nulls_last(), "vector").limit(clusters).collect()
    return np.array([r["vector"] for r in first], np.int64).reshape(-1, DIMENSIONS)


def _encode(batches):
    """Chunks of vectors: codes by block, and the blocks' dictionaries one after another."""

    def chunk(parts):
        ids = pa.concat_arrays([p.column(0) for p in parts])
        flat = np.concatenate([p.column(1).flatten().to_numpy() for p in parts])
        blocks = np.ascontiguousarray(flat.reshape(len(ids), -1, BLOCK).astype(np.int32))
        codes, different = np.empty((blocks.shape[1], len(ids)), np.uint16), []
        for k in range(blocks.shape[1]):
            found, inverse = np.unique(blocks[:, k], axis=0, return_inverse=True)
            different.append(found)
            codes[k] = inverse.reshape(-1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([codes.tobytes()], pa.binary()),
                pa.array([[len(d) for d in different]], pa.list_(pa.int32())),
                pa.array([np.concatenate(different).tobytes()], pa.binary()),
            ],
            [f.split()[0] for f in _CHUNKS.split(", ")],
        )

    parts, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(at, CHUNK)
            if rows + piece.num_rows > CHUNK:
                yield chunk(parts)
                parts, rows = [], 0
            parts.append(piece)
            rows += piece.num_rows
    if rows:
        yield chunk(parts)


class _Chunk(NamedTuple):
    vec_ids: pa.Array
    codes: np.ndarray  # block, vector
    dictionaries: list[np.ndarray]  # subvectors of each block

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of every vector."""
        partial = []
        for k, found in enumerate(self.dictionaries):
            away = found[:, None, :] - centroids[None, :, k * BLOCK : (k + 1) * BLOCK]
            partial.append((away * away).sum(axis=2))
        n = self.codes.shape[1]
        cluster, distance = np.empty(n, np.int32), np.empty(n, np.int64)
        for at in range(0, n, _ROWS):
            total = sum(table[code[at : at + _ROWS]] for table, code in zip(partial, self.codes))
            best = total.argmin(axis=1)  # the first of equal ones
            cluster[at : at + _ROWS], distance[at : at + _ROWS] = best, total[np.arange(len(best)), best]
        return cluster, distance

    def sums(self, cluster: np.ndarray, clusters: int) -> np.ndarray:
        """Componentwise sums per cluster: uses of each subvector, times the subvector."""
        out = np.zeros((clusters, len(self.dictionaries) * BLOCK), np.int64)
        for k, (found, code) in enumerate(zip(self.dictionaries, self.codes)):
            uses = np.bincount(cluster * np.int64(len(found)) + code, minlength=clusters * len(found))
            out[:, k * BLOCK : (k + 1) * BLOCK] = uses.reshape(clusters, -1) @ found
        return out


def _chunks(batches):
    for batch in batches:
        for ids, codes, sizes, subvectors in zip(*batch.columns):
            sizes = sizes.as_py()
            found = np.frombuffer(subvectors.as_buffer(), np.int32).reshape(-1, BLOCK).astype(np.int64)
            yield _Chunk(
                ids.values,
                np.frombuffer(codes.as_buffer(), np.uint16).reshape(len(sizes), -1),
                np.split(found, np.cumsum(sizes)[:-1]),
            )


def _totals(centroids: np.ndarray):
    """Vectors and componentwise sums of a chunk's clusters."""

    def run(batches):
        for chunk in _chunks(batches):
            cluster, _ = chunk.nearest(centroids)
            sums = chunk.sums(cluster, len(centroids))
            count = np.bincount(cluster, minlength=len(centroids))
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(count[used], pa.int64()), pa.array(list(sums[used]), pa.list_(pa.int64()))],
                ["cluster", "vectors", "sums"],
            )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for chunk in _chunks(batches):
            cluster, distance = chunk.nearest(centroids)
            yield pa.RecordBatch.from_arrays([chunk.vec_ids, pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


class Clustering(NamedTuple):
    centroids: np.ndarray  # cluster, component
    assigned: DataFrame  # ASSIGNED

    def described(self, spark: SparkSession) -> DataFrame:
        """One row per cluster, as bounded as the number of clusters."""
        rows = [(i, c) for i, c in enumerate(self.centroids.tolist())]
        return spark.createDataFrame(rows, "cluster int, centroid array<long>")


def cluster(embeddings: DataFrame, scratch: Scratch, clusters: int = 40, rounds: int = 5) -> Clustering:
    """Centroids after so many rounds, and every vector's cluster and squared distance."""
    vectors = integer_vectors(embeddings)
    chunks = scratch.table(vectors.mapInArrow(_encode, _CHUNKS), "chunks")
    centroids = seeds(vectors, clusters)
    for _ in range(rounds if len(centroids) else 0):
        totals = chunks.mapInArrow(_totals(centroids), "cluster int, vectors long, sums array<long>")
        sums = ", ".join(f"sum(sums[{d}])" for d in range(DIMENSIONS))
        found = totals.groupBy("cluster").agg(F.sum("vectors").alias("vectors"), F.expr(f"array({sums})").alias("sums"))
        # One row per cluster.
        centroids = centroids.copy()
        for r in found.collect():
            centroids[r["cluster"]] = [s // r["vectors"] for s in r["sums"]]
    assigned = scratch.table(chunks.mapInArrow(_assigned(centroids), ASSIGNED), "assigned")
    return Clustering(centroids, assigned)
