"""Linear models over sets of text features, fitted on a bounded sample of labelled rows."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sondage.llm._common import bites, col, stored

#: Parts that the labelled rows are dealt into by the hash of their id.
FOLDS = 4
WORD = re.compile(r"\w+")
SIGNS = re.compile(r"[^\w\s]{2,}")


def words_and_stems(text: str) -> set[str]:
    """The distinct lower-case words of a text, and the beginnings of three to eight letters of longer ones."""
    words = set(WORD.findall(text.lower()))
    out = set(words)
    for n in range(3, 9):
        out.update(w[:n] + "~" for w in words if len(w) > n)
    return out


def content(text: str) -> set[str]:
    """Distinct words, runs of signs, and the text's shape in steps."""
    words = text.split()
    low = set(WORD.findall(text.lower()))
    out = set(low)
    out.update("run:" + s for s in SIGNS.findall(text))
    n, letters = max(1, len(words)), max(1, sum(map(str.isalpha, text)))
    lines = [x for x in text.split("\n") if x]
    shape = {
        "upper": sum(map(str.isupper, text)) / letters,
        "letters": letters / max(1, len(text)),
        "distinct": len(set(words)) / n,
        "lines": len(set(lines)) / max(1, len(lines)),
        "length": min(1.0, len(text) / n / 16),
        "digits": sum(map(str.isdigit, text)) / max(1, len(text)),
    }
    out.update(f"{k}:{round(10 * v)}" for k, v in shape.items())
    out.add(f"size:{int(math.log2(len(text) + 1))}")
    return out


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int) -> tuple[DataFrame, DataFrame]:
    """At most ``most`` labelled ids, by their hash, with ``y``; and one row per such id of ``docs`` (doc_id, y, fold, ...).

    Repeated labels of an id count as one, 1 if any says so; null labels, null
    ids and ids that no document has don't count. Of several documents of an id
    the least row counts. Both tables have a row per id at most, so they are bounded.
    """
    wanted = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).alias("doc_id")).agg(F.max((col(label_col) != 0).cast("int")).alias("y"))
    chosen = stored(wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rest = [c for c in docs.columns if c != "doc_id"]
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*rest)).alias("r"))
    return chosen, stored(rows.select("doc_id", "y", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(FOLDS)).cast("int").alias("fold"), "r.*"))


def associated(rows: DataFrame, view: Callable[[dict], Iterable[str]], label: str, least: float = 30.0, most: int = 256) -> list[list[str]]:
    """The features that go most with a 0/1 label, by the log-likelihood ratio of the sample's counts.

    First those of all rows; then, for each fold, those of the rows of other
    folds alone. Counts are summed per task and then by feature and fold;
    features that occur in the same documents are represented by the longest.
    At most ``most`` of each come back.
    """

    def count(batches):
        seen: dict[str, list[int]] = defaultdict(lambda: [0] * (3 * FOLDS))
        for batch in bites(batches):
            for row in batch.to_pylist():
                y, mark, at = row[label], hash_of(row), 3 * row["fold"]
                for f in view(row):
                    c = seen[f]
                    c[at] += 1
                    c[at + 1] += y
                    c[at + 2] += mark
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), *(pa.array([c[k] for c in seen.values()], pa.int64()) for k in range(3 * FOLDS))], names=["f", *names])

    names = [f"{c}{k}" for k in range(FOLDS) for c in ("n", "pos", "mark")]
    totals = {r.fold: (r.n, r.pos) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum(label).alias("pos")).collect()}
    counts = stored(rows.mapInArrow(count, "f string, " + ", ".join(f"{c} long" for c in names)).groupBy("f").agg(*[F.sum(c).alias(c) for c in names]))
    return [_strongest(counts, totals, [k for k in range(FOLDS) if k != out], least, most) for out in (None, *range(FOLDS))]


def _strongest(counts: DataFrame, totals: dict[int, tuple[int, int]], folds: list[int], least: float, most: int) -> list[str]:
    total, pos = (sum(totals.get(k, (0, 0))[i] for k in folds) for i in (0, 1))
    if not pos or pos == total:
        return []
    summed = counts.select("f", *[sum((F.col(f"{c}{k}") for k in folds[1:]), F.col(f"{c}{folds[0]}")).alias(c) for c in ("n", "pos", "mark")])

    def term(k, e):
        return F.when(k > 0, k * F.log(k / e)).otherwise(0.0)

    n, p, share = F.col("n"), F.col("pos"), pos / total
    ratio = 2 * (term(p, n * share) + term(n - p, n * (1 - share)) + term(pos - p, (total - n) * share) + term(total - n - (pos - p), (total - n) * (1 - share)))
    strong = summed.where((n >= 3) & (n < total)).withColumn("g", ratio).where(F.col("g") >= least)
    one = strong.groupBy("n", "pos", "mark").agg(F.max("g").alias("g"), F.max(F.struct(F.length("f").alias("l"), "f")).alias("m"))
    return [r.f for r in one.select("g", "m.f").orderBy(F.desc("g"), "f").limit(most).collect()]


def hash_of(row: dict) -> int:
    import zlib

    return zlib.crc32(repr(row.get("doc_id")).encode()) * 2654435761 % (1 << 40)


def bits(features: list[str], view: Callable[[dict], Iterable[str]]):
    """A function from rows to the packed 0/1 rows of their matrix of ``features``."""
    places = {f: k for k, f in enumerate(features)}

    def run(rows: list[dict]) -> list[bytes]:
        out = []
        for row in rows:
            x = np.zeros(len(places), np.uint8)
            x[[places[f] for f in places.keys() & set(view(row))]] = 1
            out.append(np.packbits(x).tobytes())
        return out

    return run


def unpacked(packed: list[bytes], width: int) -> np.ndarray:
    if not width or not packed:
        return np.zeros((len(packed), width))
    return np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1, count=width).astype(np.float64)


def matrix(rows: DataFrame, view: Callable[[dict], Iterable[str]], features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bounded sample's 0/1 matrix of ``features``, its labels and its folds, in the order of the ids."""
    pack = bits(features, view)

    def run(batches):
        for batch in bites(batches):
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(pack(batch.to_pylist()), pa.binary())], names=[*keep, "bits"])

    keep = ["doc_id", "y", "fold"]
    schema = rows.select(*keep, F.lit(None).cast("binary").alias("bits")).schema
    got = sorted(rows.mapInArrow(run, schema).collect(), key=lambda r: repr(r.doc_id))
    return unpacked([bytes(r.bits) for r in got], len(features)), np.array([r.y for r in got], np.float64), np.array([r.fold for r in got], np.int64)


def places_of(sets: list[list[str]]) -> tuple[list[str], list[np.ndarray]]:
    """All features of some sets, the first set's before the others', and each set's places among them."""
    union = list(dict.fromkeys(f for fs in sets for f in fs))
    at = {f: k for k, f in enumerate(union)}
    return union, [np.array([at[f] for f in fs], np.int64) for fs in sets]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the intercept, which isn't shrunk."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    if not len(y):
        w[-1] = -30.0
        return w
    s = np.ones(len(y)) if weight is None else weight
    share = np.clip((s @ y + 0.5) / (s.sum() + 1), 1e-6, 1 - 1e-6)
    w[-1] = math.log(share / (1 - share))
    if x.shape[1] == 1 or y.min() == y.max():
        return w
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (s * (p - y)) + shrink * w
        h = (x * (s * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink)
        move = np.linalg.solve(h, g)
        w -= move * min(1.0, 8 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, places: list[np.ndarray] | None = None, ridge: float = 1.0) -> np.ndarray:
    """Each row's probability by a model fitted on the rows of the other folds; ``places``: a fold's own columns."""
    out = np.zeros(len(y))
    for k in range(FOLDS):
        own, here = (x if places is None else x[:, places[k]]), fold == k
        if here.any():
            out[here] = predict(own[here], fit(own[~here], y[~here], ridge=ridge))
    return out
