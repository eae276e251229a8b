"""Near-duplicate join on the Jaccard similarity of word n-grams by chosen paths.

In every run a text's n-grams are sampled by a hash function per level; the
sampled n-gram is the branch taken. Texts on one path share the sampled
n-grams and form a bucket. Small buckets are compared by brute force; a large
one is split by the next level, however deep, unless most of it would take one
branch (then its texts are alike and splitting only loses links; it is compared
in blocks). Beyond the first levels a path takes several branches at once, so
that going deeper loses few pairs; ever deeper, only as many as keep the
expected meetings of a pair at the threshold.

Runs are repeated until the target recall. The first number of runs is that
which meets a pair at the threshold on the first levels; then recall is
measured on the links found, by how many of them were met in one run alone and
how many in two, and while it is short of the target as many runs again are
added, with functions of their own; what was found stays.

Equal texts are one class and are compared once. A pair met in several
buckets belongs to the least of them, so that links are counted once without
listing pairs; a bucket gives each text's number of links and one edge to its
local group, and groups are joined over all buckets by alternating stars.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sondage.llm._common import bites, col, pack_bytes, partitions, stored, text_or_empty, unpack_bytes, whole_rows

WORD = re.compile(r"\w+")
N, THRESHOLD = 5, 0.8
LEVELS, RECALL = 3, 0.99
#: Members up to which a bucket counts as small, and members of a block of a larger one.
SMALL, BLOCK = 512, 512
#: Branches that a path takes on each of the two levels beyond the first ones.
BRANCHES = 2
REMEMBERED = 700_000


def runs_for(threshold: float = THRESHOLD, levels: int = LEVELS, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has shared a path to the last level with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**levels))


class Shingler:
    """Hashes of word n-grams; a text of fewer words has one, of all its words; one without words has none."""

    def __init__(self, n: int = N):
        self.n, self.known = n, {}
        self.powers = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(n)]

    def hashes(self, text: str) -> np.ndarray:
        import hashlib

        words = WORD.findall(text.lower())
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.n, len(w))
        if not width:
            return w
        h = np.zeros(len(w) - width + 1, np.uint64)
        for k in range(width):
            h += w[k : k + len(h)] * self.powers[k]
        return mixed(h + np.uint64(width))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sampled(flat: np.ndarray, starts: np.ndarray, count: int, first: int = 0) -> np.ndarray:
    """count x texts: the least hash of each text's n-grams under each of ``count`` functions, from number ``first`` on."""
    out = np.empty((count, len(starts)), np.uint64)
    for k in range(count):
        a, b = np.random.default_rng((11, first + k)).integers(1, 1 << 63, 2, dtype=np.uint64)
        h = (flat ^ b) * (a | np.uint64(1))
        h ^= h >> np.uint64(32)
        out[k] = np.minimum.reduceat(h * (b | np.uint64(1)), starts)
    return out


def _key(text):
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _sketches(docs: DataFrame, id_col: str, text_col: str, n: int, runs: int, levels: int, first: int = 0) -> DataFrame:
    """(key, id, sketch, paths): each distinct text once, with its smallest id; texts without words drop out. Runs are numbered from ``first`` on."""

    def run(batches):
        shingler = Shingler(n)
        for batch in bites(batches):
            hashed = [shingler.hashes(t) for t in batch.column(2).to_pylist()]
            full = np.array([k for k, h in enumerate(hashed) if len(h)], np.int64)
            if not len(full):
                continue
            sizes = np.array([len(hashed[k]) for k in full])
            tokens = sampled(np.concatenate([hashed[k] for k in full]), np.cumsum(sizes) - sizes, runs * levels, first * levels)
            paths = np.empty((len(full), runs, levels), np.int64)
            for r in range(runs):
                path = np.full(len(full), first + r + 1, np.uint64)
                for level in range(levels):
                    path = mixed(path * np.uint64(0x9E3779B97F4A7C15) ^ tokens[r * levels + level])
                    paths[:, r, level] = (path >> np.uint64(1)).astype(np.int64)
            rows = pa.array(full)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([t.tobytes() for t in np.ascontiguousarray(tokens.T)], pa.binary()), pa.array(list(paths.reshape(len(full), -1)), pa.list_(pa.int64()))],
                names=["key", "id", "sketch", "paths"],
            )

    kind = dict(docs.dtypes)[id_col]
    found = docs.select(_key(text_or_empty(text_col)).alias("key"), col(id_col).alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(run, f"key binary, id {kind}, sketch binary, paths array<long>")
    return found.groupBy("key").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))


def branches_at(depth: int, threshold: float, branches: int = BRANCHES) -> float:
    """Branches that a path takes in the mean, ``depth`` levels beyond the first ones.

    ``branches`` at first; from the third on as many as make up for the pairs at
    the threshold that a level parts, so that a text's paths stay few however
    deep it goes, and no more pairs are lost in the mean.
    """
    return branches if depth <= 2 else min(branches, 1 / threshold)


def _deeper(open_: DataFrame, sketches: DataFrame, text_of, n: int, mean: float) -> DataFrame:
    """(key, path, to): the open paths of each text, each once per branch that it takes on the next level.

    A path's functions, and how many of them there are, follow from the path,
    so all texts of a bucket take them alike.
    """

    def run(batches):
        shingler = Shingler(n)
        for batch in bites(batches):
            keys, froms, tos = [], [], []
            for key, paths, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = shingler.hashes(text)
                seeds = mixed(np.array(paths, np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
                wide = int(mean) + (mixed(seeds ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(11)) * 2.0**-53
                for path, seed, width in zip(paths, seeds, (wide + (mean - int(mean))).astype(np.int64).tolist(), strict=True):
                    for branch in range(width):
                        a, b = mixed(np.array([seed + np.uint64(2 * branch), seed + np.uint64(2 * branch + 1)]))
                        token = (h ^ b) * (a | np.uint64(1))
                        token = ((token ^ (token >> np.uint64(32))) * (b | np.uint64(1))).min()
                        keys.append(key)
                        froms.append(path)
                        tos.append(int(mixed(np.array([token ^ a]))[0] >> np.uint64(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(froms, pa.int64()), pa.array(tos, pa.int64())], names=["key", "path", "to"])

    asked = stored(open_.groupBy("key").agg(F.collect_list("path").alias("paths")).join(sketches.select("key", F.col("id").alias("rep")), "key"))
    return text_of(asked).mapInArrow(run, "key binary, path long, to long").distinct()


def _leaves(sketches: DataFrame, text_of, n: int, runs: int, levels: int, small: int, branches: int, threshold: float) -> DataFrame:
    """(key, leaf, size): the buckets of two and more in which a text is compared.

    ``text_of`` gives the texts (key, t) of rows (key, rep); they are read only
    where buckets are still large after the first levels.
    """
    first = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.slice("paths", r * levels + 1, F.lit(levels)))
    open_ = sketches.select("key", F.explode(first).alias("p")).select("key", F.col("p")[0].alias("path"), "p")
    out, level = None, 0
    while True:
        # both sides of each join come from storage or an exchange of their own, and its result goes to storage,
        # so that Spark may split the partition of a hot path while it runs
        sizes = stored(open_.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"))
        here = stored(open_.join(sizes, "path"))
        large = here.where(F.col("size") > small)
        level += 1
        if large.isEmpty():
            done, further = here, None
        else:
            if level < levels:
                taken = large.select("key", "path", F.col("p")[level].alias("to"), "p")
            else:
                taken = stored(_deeper(large.select("key", "path"), sketches, text_of, n, branches_at(level - levels + 1, threshold, branches)).withColumn("p", F.lit(None).cast("array<long>")))
            widest = taken.groupBy("path", "to").agg(F.count("*").alias("n")).groupBy("path").agg(F.max("n").alias("widest"))
            # a large bucket is split if no branch holds more than half of it
            split = stored(widest.join(sizes, "path").where(F.col("widest") * 2 <= F.col("size")).select("path", F.lit(True).alias("split")))
            done = here.where(F.col("size") <= small).unionByName(large.join(split, "path", "left_anti"))
            further = taken.join(split, "path", "left_semi").select("key", F.col("to").alias("path"), "p")
        done = done.select("key", F.col("path").alias("leaf"), "size")
        out = done if out is None else out.unionByName(done)
        if further is None:
            return out
        open_ = further


def _blocked(members: DataFrame) -> DataFrame:
    """Each member once for every pair of blocks of its bucket that it is in; one pair for a small bucket."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    return (
        members.withColumn("b", F.pmod(F.xxhash64("key", F.lit(5)), blocks).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("lo", F.least("b", "j")).withColumn("hi", F.greatest("b", "j"))
    )


def _groups(batches, columns: int):
    """Consecutive rows of one (leaf, lo, hi), as lists of columns."""
    held, now = [[] for _ in range(columns)], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != now:
                if now is not None:
                    yield now, held
                held, now = [[] for _ in range(columns)], row[:3]
            for x, v in zip(held, row, strict=True):
                x.append(v)
    if now is not None:
        yield now, held


def _in_common(leaves: list[np.ndarray]) -> np.ndarray:
    """How many of their buckets each pair of texts shares; a text has as many as it is in, and no more are looked at."""
    m, sizes = len(leaves), [len(x) for x in leaves]
    out = np.zeros((m, m), np.int32)
    if not any(sizes):
        return out
    _, column, count = np.unique(np.concatenate(leaves), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(m), sizes), count > 1
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    for begin in range(0, int(shared.sum()), 2048):
        here = (begin <= column) & (column < begin + 2048)
        x = np.zeros((m, 2048), np.float32)
        x[owner[here], column[here] - begin] = 1
        out += (x @ x.T).astype(np.int32)
    return out


def _mine(leaf: int, lo: int, hi: int, blocks: np.ndarray, leaves: list[np.ndarray]) -> np.ndarray:
    """The pairs (upper triangle) that belong to this bucket and this pair of blocks: met in no lesser bucket of this or an earlier pass."""
    m = len(blocks)
    pairs = np.triu(np.ones((m, m), bool), 1)
    if lo != hi:
        pairs &= blocks[:, None] != blocks[None, :]
    return pairs & (_in_common([x[: np.searchsorted(x, leaf)] for x in leaves]) == 0)


def _agreeing(sketches: np.ndarray) -> np.ndarray:
    """How many sampled n-grams each pair of texts has in common."""
    out = np.zeros((len(sketches),) * 2, np.int16)
    for column in sketches.T:
        out += column[:, None] == column[None, :]
    return out


def _hopeful(sketched: DataFrame, threshold: float, functions: int) -> DataFrame:
    """Members that have a pair of their own to compare in a bucket, by their sketches.

    A pair may fall short of the expected agreement by five standard deviations.
    """
    least = max(1, math.floor(functions * threshold - 5 * math.sqrt(functions * threshold * (1 - threshold))))

    def run(batches):
        rows = [[], [], [], []]
        for (leaf, lo, hi), (_, _, _, key, b, leaves, sketch) in _groups(batches, 7):
            if len(key) < 2:
                continue
            pairs = _mine(leaf, lo, hi, np.array(b), [np.array(x, np.int64) for x in leaves])
            if not pairs.any():
                continue
            pairs &= _agreeing(np.frombuffer(b"".join(sketch), np.uint64).reshape(len(key), -1)) >= least
            for k in np.flatnonzero(pairs.any(0) | pairs.any(1)).tolist():
                for x, v in zip(rows, (leaf, lo, hi, key[k]), strict=True):
                    x.append(v)
            if len(rows[0]) > 4096:
                yield _flags(rows)
                rows = [[], [], [], []]
        if rows[0]:
            yield _flags(rows)

    return sketched.select("leaf", "lo", "hi", "key", "b", "leaves", "sketch").mapInArrow(run, "leaf long, lo int, hi int, key binary")


def _flags(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["leaf", "lo", "hi", "key"])


def similar(sets: list[np.ndarray], wanted: np.ndarray, threshold: float) -> np.ndarray:
    """The ``wanted`` pairs whose sets' Jaccard similarity is at least ``threshold``, exactly."""
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    # only pairs of near enough sizes can be similar
    wanted = wanted & (np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9)
    if not wanted.any():
        return wanted
    at = np.argwhere(wanted)
    common = np.zeros((m, m), np.int64)
    if len(at) <= 4 * m:
        for i, j in at.tolist():
            common[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        keep = shared[column]
        column, owner = place[column[keep]], owner[keep]
        by = np.argsort(column, kind="stable")
        column, owner = column[by], owner[by]
        for begin in range(0, int(shared.sum()), 2048):
            a, b = np.searchsorted(column, (begin, begin + 2048))
            x = np.zeros((m, 2048), np.float32)
            x[owner[a:b], column[a:b] - begin] = 1
            common += (x @ x.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    return wanted & (common >= threshold * union - 1e-9) & (common > 0)


def _least(links: np.ndarray) -> np.ndarray:
    """Each row's group: the least row that it reaches by the (symmetric) links."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def recall_of(links: int, once: int, twice: int, runs: int) -> float:
    """The share of links that were found, if ``once`` of them were met in one of the runs and ``twice`` in two.

    What was met in no run is estimated from these two numbers, as the number
    of unseen species is from those seen in one and in two samples.
    """
    if not links or not once:
        return 1.0
    unseen = (runs - 1) / runs * (once * once / (2 * twice) if twice else once * (once - 1) / 2)
    return links / (links + unseen)


def _verified(with_sets: DataFrame, threshold: float) -> DataFrame:
    """(key, to, n, once, twice, again): a text's links in a bucket and the least text of its group there.

    ``n``: those that no earlier pass had met; ``again``: the others; ``once``
    and ``twice``: of both, those met in one bucket of this pass and in two.
    """

    def run(batches):
        rows = [[], [], [], [], [], []]
        for (leaf, lo, hi), (_, _, _, key, b, leaves, before, sets) in _groups(batches, 8):
            first = {}
            for k, x in enumerate(key):
                first.setdefault(x, k)
            at = sorted(first.values())
            if len(at) < 2:
                continue
            key = [key[k] for k in at]
            own, old = ([np.array(x[k], np.int64) for k in at] for x in (leaves, before))
            pairs = _mine(leaf, lo, hi, np.array(b)[at], own)
            links = similar([np.frombuffer(unpack_bytes(sets[k]), np.uint64) for k in at], pairs, threshold)
            links |= links.T
            found = links.any(1)
            if not found.any():
                continue
            met = _in_common(own) * links
            again = (_in_common(old) > 0) & links
            group = _least(links)
            for k in np.flatnonzero(found).tolist():
                values = key[k], key[int(group[k])], int((links[k] & ~again[k]).sum()), int((met[k] == 1).sum()), int((met[k] == 2).sum()), int(again[k].sum())
                for x, v in zip(rows, values, strict=True):
                    x.append(v)
            if len(rows[0]) > 4096:
                yield _edges(rows)
                rows = [[], [], [], [], [], []]
        if rows[0]:
            yield _edges(rows)

    return with_sets.select("leaf", "lo", "hi", "key", "b", "leaves", "before", "set").mapInArrow(run, "key binary, to binary, n long, once long, twice long, again long")


def _edges(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.binary(), pa.binary(), *[pa.int64()] * 4), strict=True)], names=["key", "to", "n", "once", "twice", "again"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for every node of ``edges`` (u, v).

    Alternating large and small stars: each round links every node's
    neighbours to the least of them, until nothing changes.
    """
    edges = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = stored(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _linked(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, levels: int, runs: int, small: int, branches: int, first: int = 0, earlier: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One pass of ``runs`` runs, whose functions are numbered from ``first`` on, after those that ``earlier`` has the buckets of.

    (links, buckets): (key, to, n, once, twice, again) of all links met, and
    (key, leaves), the sorted buckets of each text in this pass and before, as
    many as it is in. Both are stored.
    """
    sketches = stored(_sketches(docs, id_col, text_col, n, runs, levels, first))
    texts = docs.select(col(id_col).alias("id"), text_or_empty(text_col).alias("t")).withColumn("key", _key(F.col("t")))
    one = lambda keys: texts.join(keys, (texts["key"] == keys["key"]) & texts["id"].eqNullSafe(keys["rep"])).select(texts["key"], *[keys[c] for c in keys.columns if c not in ("key", "rep")], "t")
    leaves = stored(_leaves(sketches, one, n, runs, levels, small, branches, threshold))
    owned = leaves.groupBy("key").agg(F.collect_list(F.struct("leaf", "size")).alias("found")).withColumn("leaves", F.array_sort(F.transform("found", lambda x: x["leaf"])))
    none = F.array().cast("array<long>")
    owned = owned.withColumn("before", none) if earlier is None else owned.join(earlier.withColumnRenamed("leaves", "before"), "key", "left").withColumn("before", F.coalesce("before", none))
    owned = stored(owned)
    members = owned.join(sketches.select("key", "sketch", "id"), "key").select("key", "id", "sketch", "leaves", F.explode("found").alias("x")).select("key", "id", "sketch", "leaves", "x.leaf", "x.size")
    tasks = 2 * partitions(docs.sparkSession)
    by = ["leaf", "lo", "hi"]
    sketched = _blocked(members).repartition(tasks, *by).sortWithinPartitions(*by, "key")
    flagged = stored(_hopeful(sketched, threshold, runs * levels))
    asked = stored(flagged.select("key").distinct().join(owned.select("key", "leaves", "before"), "key").join(sketches.select("key", F.col("id").alias("rep")), "key"))

    def sets(batches):
        shingler = Shingler(n)
        for batch in bites(batches):
            got = [pack_bytes(np.unique(shingler.hashes(t)).tobytes()) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got, pa.binary())], names=["key", "leaves", "before", "set"])

    with_sets = flagged.join(one(asked).mapInArrow(sets, "key binary, leaves array<long>, before array<long>, set binary").dropDuplicates(["key"]), "key")
    blocks = members.select("key", "leaf", "size").join(flagged.select("leaf", "key").distinct(), ["leaf", "key"]).select("leaf", "key", F.pmod(F.xxhash64("key", F.lit(5)), F.ceil(F.col("size") / BLOCK).cast("int")).cast("int").alias("b"))
    links = stored(_verified(with_sets.join(blocks, ["leaf", "key"]).repartition(tasks, *by).sortWithinPartitions(*by, "key"), threshold))
    here = owned.select("key", "leaves")
    every = here if earlier is None else earlier.join(here.withColumnRenamed("leaves", "new"), "key", "full").select("key", F.array_sort(F.concat(F.coalesce("leaves", none), F.coalesce("new", none))).alias("leaves"))
    return links, every


def _found(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, levels: int, recall: float, runs: int, small: int, branches: int) -> tuple[DataFrame, float]:
    """(key, to, n) of all links, and the recall measured on them, which is ``recall`` at least.

    The first pass is measured by the links met in one of its runs and in two.
    While recall is short, a further pass makes as many runs as there were,
    with functions of their own, and what was found stays: of the links that
    the new pass met, the share that had been met before says what share of
    all had been.
    """
    counts = lambda links: [v // 2 for v in links.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "once", "twice", "again")]).first()]
    links, buckets = _linked(docs, id_col, text_col, n, threshold, levels, runs, small, branches)
    new, once, twice, _ = counts(links)
    done, found, measured = runs, new, recall_of(new, once, twice, runs)
    while measured < recall:
        more, buckets = _linked(docs, id_col, text_col, n, threshold, levels, done, small, branches, done, stored(buckets))
        links = links.unionByName(more)
        new, _, _, again = counts(more)
        measured = met_by_both(found, new + again, again)
        found, done = found + new, 2 * done
    return links.select("key", "to", "n"), measured


def met_by_both(before: int, now: int, both: int) -> float:
    """The share of all links that two passes have met together, of which ``both`` were met by either one.

    Each pass finds a share of its own of all links, the older ``both / now``.
    """
    if not before + now - both:
        return 1.0
    return (before + now - both) * both / (before * now) if both else 0.0


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, levels: int = LEVELS, recall: float = RECALL, small: int = SMALL, branches: int = BRANCHES) -> DataFrame:
    """One row per row of ``docs``: its class and the number of its links.

    Texts are compared as sets of n-grams of lower-case words, whole. Columns:
    the id; ``class_id``, the smallest id of its group; ``rep_id``, the smallest
    id of the rows with the very same text; ``n_links``, the number of other
    texts that are similar to its own; ``text_key``. Groups are the connected
    components of the links. Null texts count as empty; texts without words are
    similar to none but equal ones. Null ids come last; repeated rows are rows
    of their own. An empty table gives an empty result; extra columns are not
    read.

    recall: what must be reached, both computed for a pair at the threshold on
    ``levels`` levels and measured on the links found; small: texts up to which
    a bucket is compared as it is; branches: those taken on the first deeper levels.
    """
    links, _ = _found(docs, id_col, text_col, n, threshold, levels, recall, runs_for(threshold, levels, recall), small, branches)
    roots = components(links.select(F.col("key").alias("u"), F.col("to").alias("v")))
    counted = links.groupBy("key").agg(F.sum("n").alias("n_links")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    every = docs.select(col(id_col).alias("id"), _key(text_or_empty(text_col)).alias("text_key"))
    texts_ids = stored(every.groupBy("text_key").agg(F.min("id").alias("rep_id")).join(counted.withColumnRenamed("key", "text_key"), "text_key", "left").withColumn("root", F.coalesce("root", "text_key")))
    classes = texts_ids.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    full = texts_ids.join(classes, "root").select("text_key", "rep_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return every.join(full, "text_key").select(F.col("id").alias(id_col), "class_id", "rep_id", "n_links", "text_key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group, with all their columns, of any type and name.

    A group without any id keeps the rows of its least text. Repeated rows of
    the id that stays all stay, where exact copies haven't been removed before.
    Null texts count as empty; an empty table gives an empty result.
    """
    groups = near_duplicates(docs, id_col, text_col)
    stay = groups.where(col(id_col).eqNullSafe(F.col("class_id"))).select(col(id_col).alias("keep"), F.col("text_key").alias("sha")).distinct()
    named = whole_rows(docs, col(id_col).alias("id"), _key(text_or_empty(text_col)).alias("digest"))
    return named.join(stay, F.col("id").eqNullSafe(F.col("keep")) & (F.col("digest") == F.col("sha")), "left_semi").select("r.*")


def query_op8(spark, sf_dir: str) -> DataFrame:
    """``near_duplicates`` over every whole text of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")
