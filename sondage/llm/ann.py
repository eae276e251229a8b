"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt into shards of bounded size. A shard holds, for each tree,
its vectors' long hash strings as a sorted array. A query descends every tree
to its longest-prefix match, then ascends all trees in step, one bit at a
time, so that the ranges of vectors that share its prefix grow, until they
hold a given share of the shard in the mean of the trees (0.7 of it, as ranges
halve only about); the vectors in the ranges are compared exactly. The share is fitted: the least at which a bounded sample, searched
the same way, has the wanted recall against brute force.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sondage.llm._common import bites, col, partitions, stored

BITS = 32
SHARES = tuple(2.0**-k for k in range(12, -1, -1))


@dataclass
class Hashes:
    """One direction and threshold per bit and tree."""

    directions: np.ndarray  # trees, dimensions, bits
    thresholds: np.ndarray  # trees, bits

    def codes(self, x: np.ndarray) -> np.ndarray:
        """trees x rows; the first bit of a hash string is the highest of its number."""
        weights = (1 << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
        return np.array([((x @ d > t).astype(np.uint64) * weights).sum(1) if len(x) else np.zeros(0, np.uint64) for d, t in zip(self.directions, self.thresholds, strict=True)], np.uint64)


class Forest:
    """The trees of one shard."""

    def __init__(self, x: np.ndarray, hashes: Hashes):
        self.x, self.norms, codes = x, (x * x).sum(1), hashes.codes(x)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def ranges(self, codes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where, in each tree's array, the strings begin and end that share ``bits`` bits with each query."""
        free = (np.uint64(1) << (np.uint64(BITS) - bits.astype(np.uint64))) - np.uint64(1)
        low, high = codes & ~free, codes | free
        at = [(np.searchsorted(s, a), np.searchsorted(s, b, "right")) for s, a, b in zip(self.sorted, low, high, strict=True)]
        return np.array([a for a, _ in at]), np.array([b for _, b in at])

    def search(self, q: np.ndarray, codes: np.ndarray, share: float, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query: rows of the ``k`` nearest candidates and of all that tie with the last, and their distances."""
        wanted, trees = 0.7 * share * len(self.x), len(self.sorted)
        depth, open_ = np.zeros(len(q), np.int64), np.ones(len(q), bool)
        for bits in range(BITS, 0, -1):  # all trees ascend in step
            if not open_.any():
                break
            a, b = self.ranges(codes[:, open_], np.full(int(open_.sum()), bits))
            enough = (b - a).mean(0) >= wanted
            at = np.flatnonzero(open_)[enough]
            depth[at], open_[at] = bits, False
        begin, end = self.ranges(codes, depth)
        out = []
        for i, v in enumerate(q):
            met = np.zeros(len(self.x), bool)
            if depth[i]:
                for t in range(trees):
                    met[self.order[t, begin[t, i] : end[t, i]]] = True
                rows = np.flatnonzero(met)
            else:
                rows = np.arange(len(self.x))
            near = self.norms[rows] - 2 * (self.x[rows] @ v)
            if len(rows) > k:
                slack = 1e-9 * (float(v @ v) + float(self.norms.max()) + 1e-300)
                rows = rows[near <= np.partition(near, k - 1)[k - 1] + slack]
            exact = np.sqrt(((self.x[rows] - v) ** 2).sum(1))
            out.append((rows, exact))
        return out


def fit(sample: np.ndarray, trees: int = 10, wanted: float = 0.97, k: int = 10, seed: int = 7) -> tuple[Hashes, float]:
    """Hash functions, with each bit split at the sample's median, and the share of a shard to meet."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, sample.shape[1], BITS))
    thresholds = np.array([np.median(sample @ d, axis=0) for d in directions])
    hashes = Hashes(directions, thresholds)
    forest, q = Forest(sample, hashes), sample[:: max(1, len(sample) // 64)]
    codes = hashes.codes(q)
    true = [set(r[np.lexsort((r, d))][: k + 1].tolist()) for r, d in forest.search(q, codes, 1.0, k + 1)]
    for share in SHARES:
        got = [set(r[np.lexsort((r, d))][: k + 1].tolist()) for r, d in forest.search(q, codes, share, k + 1)]
        if sum(len(a & b) for a, b in zip(true, got, strict=True)) >= wanted * sum(map(len, true)):
            return hashes, share
    return hashes, 1.0


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector that is not null, not zero, and holds finite numbers only."""
    v = col(vec_col).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return vectors.where(col(id_col).isNotNull() & col(vec_col).isNotNull()).where(fine).select(col(id_col).cast("long").alias("id"), v.alias("v"))


def _classes(rows: DataFrame, most: int) -> DataFrame:
    """(v, ids): equal vectors once, with their ``most`` smallest ids, which are all that any result can hold."""

    def partial(batches):
        held: dict[bytes, list[int]] = {}
        for batch in bites(batches, 2048):
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = np.array(v, "<f8").tobytes()
                ids = held.get(key)
                if ids is None:
                    held[key] = [i]
                elif i not in ids:
                    ids.append(i)
                    if len(ids) > most:
                        ids.remove(max(ids))
            if len(held) >= 100_000:
                yield _held(held)
                held = {}
        if held:
            yield _held(held)

    return (
        rows.mapInArrow(partial, "v binary, ids array<long>").groupBy("v")
        .agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))
    )


def _as_bytes(rows: DataFrame) -> DataFrame:
    """(v, id): vectors as their doubles' bytes."""

    def run(batches):
        for batch in batches:
            v = batch.column(1)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            ends = np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.split(flat, ends[:-1])] if len(ends) else [], pa.binary()), batch.column(0)], names=["v", "id"])

    return rows.mapInArrow(run, "v binary, id long")


def _held(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["v", "ids"])


def _gathered(rows: DataFrame, group: str, into: int, rank: int) -> DataFrame:
    """One row per value of ``group``: the ids and vectors of its rows."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for g, v, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                a, b = held.setdefault(g, ([], []))
                a.append(v)
                b.append(ids)
        for g, (a, b) in held.items():
            flat = np.array([i for ids in b for i in ids], "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([rank], pa.int32()), pa.array([b"".join(a)], pa.binary()), pa.array([np.array([len(x) for x in b], "<i4").tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], names=["shard", "rank", "v", "n", "ids"])

    return rows.select(F.col(group).cast("int"), "v", "ids").repartition(into, group).mapInArrow(run, "shard int, rank int, v binary, n binary, ids binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = 10, wanted: float = 0.97, sample_rows: int = 2048, shard_rows: int = 8192, query_rows: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query, all others if there are fewer.

    Nearest by Euclidean distance in double precision, ties to the smaller id.
    Vectors null, zero, or holding null or non-finite components take no part,
    nor do rows without an id or with another number of components than most
    rows of the sample have. A repeated id with the same vector counts once;
    no row of a query's own id is its neighbour. Hashes and share are fitted on
    ``sample_rows`` rows; every row is indexed. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    classes = stored(_classes(usable(vectors, id_col, vec_col), k + 1))
    sample = [np.frombuffer(r.v, "<f8") for r in classes.select("v").orderBy(F.xxhash64("v"), "v").limit(sample_rows).collect()]
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    sizes = [len(v) for v in sample]
    dims = max(sorted(set(sizes)), key=sizes.count)
    hashes, share = fit(np.array([v for v in sample if len(v) == dims]), trees, wanted, k)
    fitting = F.octet_length("v") == 8 * dims
    here = classes.where(fitting)
    shards = max(1, -(-here.count() // shard_rows))
    asked = stored(_as_bytes(usable(queries, id_col, vec_col)).where(fitting).distinct().select("v", F.array("id").alias("ids"), "id"))
    blocks = max(1, -(-asked.count() // query_rows))
    tasks = min(shards, 8 * partitions(spark))
    index = _gathered(here.withColumn("__s", F.pmod(F.xxhash64("v"), F.lit(shards))), "__s", tasks, 0)
    block_rows = _gathered(asked.withColumn("__b", F.pmod(F.xxhash64("id"), F.lit(blocks))), "__b", min(blocks, tasks), 1)
    # the stated queries, in blocks, go to every shard; a shard comes before its blocks
    sent = index.unionByName(block_rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))

    def run(batches):
        forest, counts, starts, ids, at = None, None, None, None, None
        for batch in batches:
            for shard, rank, v, n, flat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(v, "<f8").reshape(-1, dims)
                if not rank:
                    forest, counts, ids, at = Forest(x, hashes), np.frombuffer(n, "<i4"), np.frombuffer(flat, "<i8"), shard
                    starts = np.cumsum(counts) - counts
                    continue
                if shard != at:  # a shard that nothing fell into
                    continue
                out = ([], [], [])
                for q, (rows, dist) in zip(np.frombuffer(flat, "<i8").tolist(), forest.search(x, hashes.codes(x), share, k + 1), strict=True):
                    pairs = sorted((d, i) for r, d in zip(rows.tolist(), dist.tolist(), strict=True) for i in ids[starts[r] : starts[r] + counts[r]].tolist() if i != q)[:k]
                    out[0].extend([q] * len(pairs))
                    out[1].extend(d for d, _ in pairs)
                    out[2].extend(i for _, i in pairs)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int64())], names=["query_id", "score", "vec_id"])

    found = sent.repartition(tasks, "shard").sortWithinPartitions("shard", "rank").mapInArrow(run, "query_id long, score double, vec_id long")
    best = found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("p")).agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("b"))
    best = best.groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("b")))), 1, k).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def query_op7(spark, sf_dir: str) -> DataFrame:
    """The nearest of all ``embeddings`` for each whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
