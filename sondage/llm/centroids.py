"""Exact centroid clustering of integer vectors, with bounds kept by groups of centroids.

Centroids are put into groups once. A vector remembers its centroid, an upper
bound of the distance to it, and per group a lower bound of the distance to
the group's other centroids. When the centroids move, the bounds move by as
much. A vector whose upper bound stays below all its lower bounds keeps its
centroid unseen (the global filter); of the others, only groups whose bound is
not above the upper one are looked into, and of their centroids those whose
own move lets them come close enough are computed, in whole numbers.

Vectors lie in blocks, in a table in buckets by block. What vectors remember is
a table of its own in the same buckets, a tenth as large, written anew each
round; both are joined without an exchange. Sums of clusters follow from the
vectors that changed theirs, so a round sends a row per task and moved cluster.
"""

from __future__ import annotations

import hashlib
import uuid
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sondage.llm._common import col, quoted, shared_folder, tasks_for

#: More than the error of a root in double precision.
UP, DOWN = 1 + 1e-15, 1 - 1e-15


def largest(dims: int) -> int:
    """Components must stay below this, so that the squared distance of two vectors fits in a long."""
    return isqrt((1 << 63) // dims) // 2 - 1


def integer_blocks(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int, block_rows: int) -> DataFrame:
    """(block, ids, x): usable vectors as floor(scale * component), ``block_rows`` at a time."""
    v = col(vec_col).cast("array<double>")
    fine = (F.size(v) == dims) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kind = pa.list_(pa.int64())

    def run(batches):
        ids, rows, held, number = [], [], 0, 0
        first = TaskContext.get().partitionId() << 40
        schema = pa.schema([("block", pa.int64()), ("ids", kind), ("x", pa.binary())])

        def block(i, x):
            return pa.RecordBatch.from_arrays([pa.array([first + number], pa.int64()), pa.array([i], kind), pa.array([x.tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            flat = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if flat.size and not float(np.abs(flat).max()) < largest(dims):
                raise ArithmeticError(f"a component beyond {largest(dims) / scale:g}: its squared distance does not fit in a long")
            ids += batch.column(0).to_pylist()
            rows.append(flat.astype("<i4").reshape(-1, dims))
            held += batch.num_rows
            if held >= block_rows:
                x = np.concatenate(rows)
                at = 0
                while held - at >= block_rows:
                    yield block(ids[at : at + block_rows], x[at : at + block_rows])
                    number, at = number + 1, at + block_rows
                ids, rows, held = ids[at:], [x[at:]], held - at
        if held:
            yield block(ids, np.concatenate(rows))

    return vectors.where(col(vec_col).isNotNull()).where(fine).select(col(id_col).cast("long"), v).mapInArrow(run, "block long, ids array<long>, x binary")


def first_centroids(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int, k: int, seed: str) -> list[list[int]]:
    """The ``k`` usable vectors with the smallest hex sha256 of ``seed`` and their id, in that order; ties go by components, null ids last."""
    v = col(vec_col).cast("array<double>")
    fine = (F.size(v) == dims) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(v, lambda e: F.floor(e * F.lit(float(scale))))
    rows = vectors.where(col(vec_col).isNotNull()).where(fine).select(F.sha2(F.concat(F.lit(seed), col(id_col).cast("string")), 256).alias("h"), whole.alias("x"))
    return [list(r.x) for r in rows.orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()]


def group_centroids(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of plain clustering of the centroids themselves."""
    x = centroids.astype(np.float64)
    centres = x[np.linspace(0, len(x) - 1, groups).astype(int)].copy()
    for _ in range(rounds):
        own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (own == g).any():
                centres[g] = x[own == g].mean(0)
    return own


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows x centroids; in double precision where all products and sums are whole there."""
    if 4 * x.shape[1] * max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))) ** 2 < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1) if len(c) else np.zeros((len(x), 0), np.int64)


class Bounds:
    """What the vectors of a block remember: centroid, upper bound, lower bound per group."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.own, self.upper, self.lower = own, upper, lower

    @classmethod
    def first(cls, x: np.ndarray, centroids: np.ndarray, groups: np.ndarray) -> Bounds:
        """All distances."""
        d = squared(x, centroids)
        own = d.argmin(1)
        upper = np.sqrt(d[np.arange(len(x)), own]) * UP
        root = np.sqrt(d) * DOWN
        root[np.arange(len(x)), own] = np.inf
        return cls(own, upper, np.stack([root[:, groups == g].min(1) for g in range(int(groups.max()) + 1)], 1))

    def move(self, x: np.ndarray, centroids: np.ndarray, groups: np.ndarray, drift: np.ndarray) -> int:
        """Follows the centroids to where they are now, ``drift`` away; how many distances that took."""
        before = self.lower
        far = np.array([drift[groups == g].max(initial=0) for g in range(before.shape[1])])
        self.upper = (self.upper + drift[self.own]) * UP
        self.lower = np.where(before > far, (before - far) * DOWN, 0.0)
        rows = np.flatnonzero(self.upper >= self.lower.min(1))
        if not len(rows):
            return 0
        exact = np.empty(len(rows), np.int64)
        for c in np.unique(self.own[rows]):
            at = self.own[rows] == c
            exact[at] = squared(x[rows[at]], centroids[c : c + 1])[:, 0]
        self.upper[rows] = np.sqrt(exact) * UP
        taken = len(rows)
        near = self.upper[rows] >= self.lower[rows].min(1)
        rows, exact = rows[near], exact[near]
        if not len(rows):
            return taken
        old, upper, low = self.own[rows], self.upper[rows], self.lower[rows].copy()
        best, new = exact.copy(), old.copy()
        looked = []
        for g in range(low.shape[1]):
            at = np.flatnonzero(low[:, g] <= upper)
            members = np.flatnonzero(groups == g)
            if not len(at) or not len(members):
                continue
            floor = np.where(before[rows[at], g][:, None] > drift[members], (before[rows[at], g][:, None] - drift[members]) * DOWN, 0.0)
            d = np.full(floor.shape, np.iinfo(np.int64).max)
            for j, c in enumerate(members):
                mine = old[at] == c
                d[mine, j] = exact[at[mine]]
                scan = np.flatnonzero(~mine & (floor[:, j] <= upper[at]))
                if len(scan):
                    d[scan, j] = squared(x[rows[at[scan]]], centroids[c : c + 1])[:, 0]
                    taken += len(scan)
                seen = np.r_[np.flatnonzero(mine), scan]
                floor[seen, j] = np.sqrt(d[seen, j]) * DOWN
                closer = (d[:, j] < best[at]) | ((d[:, j] == best[at]) & (c < new[at]))
                best[at[closer]], new[at[closer]] = d[closer, j], c
            looked.append((g, at, members, floor))
        # a group's bound is that of its centroids but the one now chosen; one left behind in a group not looked into counts there
        left = np.flatnonzero(new != old)
        home = groups[old[left]]
        low[left, home] = np.minimum(low[left, home], np.sqrt(exact[left]) * DOWN)
        for g, at, members, floor in looked:
            floor[new[at][:, None] == members[None]] = np.inf
            low[at, g] = floor.min(1)
        self.own[rows], self.upper[rows], self.lower[rows] = new, np.sqrt(best) * UP, low
        return taken

    def as_bytes(self) -> tuple[bytes, bytes, bytes]:
        return self.own.astype("<i4").tobytes(), self.upper.astype("<f8").tobytes(), self.lower.astype("<f8").tobytes()

    @classmethod
    def of_bytes(cls, own: bytes, upper: bytes, lower: bytes) -> Bounds:
        n = len(own) // 4
        return cls(np.frombuffer(own, "<i4").astype(np.int64), np.frombuffer(upper, "<f8").copy(), np.frombuffer(lower, "<f8").reshape(n, -1).copy())


def _moved(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, sums: dict) -> None:
    """Adds what the clusters gained and lost to ``sums``: by cluster, the number of vectors and their sum."""
    rows = np.arange(len(x)) if old is None else np.flatnonzero(old != new)
    for own, sign in ((new, 1), (old, -1)):
        if own is not None and len(rows):
            for c in np.unique(own[rows]):
                part = x[rows[own[rows] == c]]
                n, total = sums.get(int(c), (0, 0))
                sums[int(c)] = n + sign * len(part), total + sign * part.sum(0)


class Store:
    """Tables of one run in buckets by block, in the shared folder; old ones go when they are no longer read."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.run = spark, buckets, f"centroids_{uuid.uuid4().hex}"
        self.folder = f"{shared_folder(spark)}/{self.run}"

    def write(self, rows: DataFrame, name: str) -> DataFrame:
        table = f"{self.run}_{name}"
        rows.write.format("parquet").bucketBy(self.buckets, "block").option("path", f"{self.folder}/{name}").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.run}_{name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


STATE = "block long, own binary, upper binary, lower binary, scanned long, moved array<struct<cluster:int,n:long,total:array<long>>>"


def _round(rows: DataFrame, dims: int, centroids: np.ndarray, groups: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """One assignment of all blocks: rows (block, x[, own, upper, lower]); a task's moves stand in its last row."""
    moved = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))
    schema = pa.schema([("block", pa.int64()), ("own", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("scanned", pa.int64()), ("moved", moved)])

    def run(batches):
        sums, last = {}, None
        row = lambda values, out: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*values, out), schema, strict=True)], schema=schema)
        for batch in batches:
            for k in range(batch.num_rows):
                block, raw, *held = (c[k].as_py() for c in batch.columns)
                x = np.frombuffer(raw, "<i4").reshape(-1, dims).astype(np.int64)
                if drift is None:
                    state, old, scanned = Bounds.first(x, centroids, groups), None, len(x) * len(centroids)
                else:
                    state = Bounds.of_bytes(*held)
                    old = state.own.copy()
                    scanned = state.move(x, centroids, groups, drift)
                _moved(x, old, state.own, sums)
                if last:
                    yield row(last, [])
                last = block, *state.as_bytes(), scanned
        if last:
            yield row(last, [{"cluster": c, "n": n, "total": total.tolist()} for c, (n, total) in sorted(sums.items())])

    return rows.mapInArrow(run, STATE)


def _sums(state: DataFrame) -> dict[int, tuple[int, dict[int, int]]]:
    """By cluster the change in number and in the sum of each component: k times dims numbers, whatever the data."""
    moved = state.select(F.explode("moved").alias("m")).select("m.cluster", F.posexplode(F.concat(F.array("m.n"), F.col("m.total"))).alias("at", "part"))
    out: dict[int, dict[int, int]] = {}
    for r in moved.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("sum")).collect():
        out.setdefault(r.cluster, {})[r.at] = int(r.sum)
    return {c: (v[0], {at - 1: s for at, s in v.items() if at}) for c, v in out.items()}


def cluster(vectors: DataFrame, k: int, rounds: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 1024, seed: str = "3:", group_size: int = 4, block_rows: int = 4096, buckets: int | None = None) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(id, cluster, distance) of every usable vector, the centroids, and the distances computed per assignment.

    Usable are vectors of ``dims`` components, none null or not finite; each
    component x counts as floor(scale * x). Every round assigns all vectors to
    the nearest centroid by squared Euclidean distance (ties: the smaller
    number) and moves each centroid that has vectors to the floor of their
    mean; then all are assigned once more. The result is that of computing all
    distances. Null and repeated ids are rows of their own; fewer vectors than
    ``k`` make fewer centroids, no vectors an empty result; extra columns are
    not read. A component beyond ``largest(dims)`` / scale (131,072 for 64 and 1024)
    raises an error, as squared distances of such don't fit in a long.
    """
    spark = vectors.sparkSession
    schema = StructType([StructField(id_col, LongType()), StructField("cluster", IntegerType()), StructField("distance", LongType())])
    start = first_centroids(vectors, id_col, vec_col, dims, scale, k, seed)
    if not start:
        return spark.createDataFrame([], schema), [], []
    if max(abs(e) for c in start for e in c) >= largest(dims):
        raise ArithmeticError(f"a component beyond {largest(dims) / scale:g}: its squared distance does not fit in a long")
    centroids = [list(map(int, c)) for c in start]
    now = np.array(centroids, np.int64)
    groups = group_centroids(now, -(-len(now) // group_size))
    buckets = buckets or tasks_for(vectors)
    store = Store(spark, buckets)
    blocks = store.write(integer_blocks(vectors, id_col, vec_col, dims, scale, block_rows).repartition(buckets, "block"), "blocks")
    count, total = [0] * len(now), [[0] * dims for _ in now]
    drift, scanned = None, []
    for number in range(rounds + 1):
        rows = blocks.select("block", "x")
        if number:
            rows = rows.join(state.select("block", "own", "upper", "lower").hint("shuffle_hash"), "block")
        state, before = store.write(_round(rows, dims, now, groups, drift), f"state_{number}"), number - 1
        if before >= 0:
            store.drop(f"state_{before}")
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        if number == rounds:
            break
        for c, (n, sums) in _sums(state).items():
            count[c] += n
            for at, part in sums.items():
                total[c][at] += part
        after = [[t // n for t in sums] if n else old for n, sums, old in zip(count, total, now.tolist(), strict=True)]
        after = np.array(after, np.int64)
        drift = np.array([float(np.sqrt(int(sum(int(d) ** 2 for d in a - b)))) * UP for a, b in zip(after, now, strict=True)])
        now = after

    def distances(batches):
        names = [f.name for f in schema]
        for batch in batches:
            for k in range(batch.num_rows):
                ids, raw, own = batch.column(0)[k].values, batch.column(1)[k].as_py(), np.frombuffer(batch.column(2)[k].as_py(), "<i4")
                x = np.frombuffer(raw, "<i4").reshape(-1, dims).astype(np.int64)
                d = ((x - now[own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(d, pa.int64())], names=names)

    found = blocks.join(state.select("block", "own").hint("shuffle_hash"), "block").select("ids", "x", "own").mapInArrow(distances, schema)
    found.write.parquet(f"{store.folder}/found")
    store.drop("blocks")
    store.drop(f"state_{rounds}")
    return spark.read.parquet(f"{store.folder}/found"), now.tolist(), scanned


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``found`` with the distances summed over the cluster and over all, and the sha256 of the cluster's centroid."""
    spark = found.sparkSession
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row per centroid
    whole = sum(inertia.values())
    rows = [(c, inertia.get(c, 0), whole, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select(*[quoted(c) for c in found.columns], "cluster_inertia", "inertia", "centroid_sha256")


def query_op12(spark, sf_dir: str) -> DataFrame:
    """All usable ``embeddings`` in eight clusters after ten rounds; unusable rows and the rest as in ``cluster``."""
    found, centroids, _ = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 8)
    return with_inertia(found, centroids)


def _oracle(k: int = 8, rounds: int = 10) -> str:
    """The same by computing all distances, round by round."""
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) - 1 AS c, x AS y FROM v QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) <= {k})",
    ]
    near = lambda n: f"a{n} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS m FROM (SELECT r, c, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{n}) GROUP BY r)"
    for n in range(rounds):
        parts += [
            near(n),
            f"u{n} AS (SELECT m.c AS c, unnest(x) AS e, generate_subscripts(x, 1) AS k FROM a{n} JOIN v USING (r))",
            f"s{n} AS (SELECT c, k, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n FROM u{n} GROUP BY 1, 2)",
            f"m{n} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS y FROM s{n} GROUP BY 1)",
            f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m{n}.y, c{n}.y) AS y FROM c{n} LEFT JOIN m{n} USING (c))",
        ]
    parts += [near(rounds), f"f AS MATERIALIZED (SELECT r, m.c::INT AS cluster, m.d::BIGINT AS distance FROM a{rounds})"]
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(y, ',')) AS centroid_sha256 FROM f JOIN v USING (r) JOIN c{rounds} ON c = cluster"
    )


ORACLE_OP12 = _oracle()
