"""Document quality by co-training.

Two classifiers see different views of a document: its text content, and its
page metadata (language, source, size). In each round each of them labels all
unlabelled documents that it is confident of, and the other is fitted on them
too, by the counts of its features among them. Both are then calibrated on
predictions for rows they had not seen, combined, and applied to every document.

For each fold of the labelled rows there is a pair of classifiers of its own,
whose features, fits and pseudo-labels come without that fold; all pairs go
through the rounds side by side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sondage.llm import _linear as L
from sondage.llm._common import bites, col, quoted, stored, text_or_empty

#: Labelled rows that the classifiers are fitted on, at most; further labelled rows count as unlabelled.
FIT_ROWS = 6000
#: Rounds; what a probability must reach for a pseudo-label; what all pseudo-labels weigh, by the labelled rows, at most.
ROUNDS, CONFIDENT, PSEUDO_WEIGHT = 3, 0.95, 0.5
META = ("lang", "source", "n_chars")


def content_view(row: dict) -> set[str]:
    return L.content(row["text"])


def metadata_view(row: dict) -> set[str]:
    n = row["n_chars"]
    size = "none" if n is None else int(math.log2(max(0, n) + 1))
    return {f"lang:{row['lang']}", f"source:{row['source']}", f"size:{size}", f"lang:{row['lang']},size:{size}", f"source:{row['source']},size:{size}"}


VIEWS = (content_view, metadata_view)


@dataclass
class CoTrained:
    features: tuple[list[str], list[str]]
    weights: tuple[np.ndarray, np.ndarray]
    calibration: tuple[np.ndarray, np.ndarray]
    combined: np.ndarray

    def probabilities(self, x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Columns: content view, metadata view, both; all calibrated."""
        z = [L.logit(L.predict(a, w)) for a, w in zip(x, self.weights, strict=True)]
        p = [L.predict(a[:, None], c) for a, c in zip(z, self.calibration, strict=True)]
        return np.c_[p[0], p[1], L.predict(np.c_[L.logit(p[0]), L.logit(p[1])], self.combined)]


@dataclass
class Labelled:
    """The labelled rows: a matrix per view, labels, folds, and per view the columns of each pair of classifiers."""

    x: tuple[np.ndarray, np.ndarray]
    y: np.ndarray
    fold: np.ndarray
    places: tuple[list[np.ndarray], list[np.ndarray]]

    def train(self, pair: int) -> np.ndarray:
        """Pair 0 is fitted on all rows, pair k + 1 on those outside fold k."""
        return np.ones(len(self.y), bool) if pair == 0 else self.fold != pair - 1


def pseudo_counts(x: tuple[np.ndarray, np.ndarray], weights, places) -> np.ndarray:
    """What the views tell each other of some unlabelled rows, summed over them.

    An array pairs x views x labels x (features + 2), by the view that is told:
    how many rows with each feature the other view is confident of, how many
    rows in all, and how many features they have.
    """
    pairs, width = len(places[0]), max(a.shape[1] for a in x)
    out = np.zeros((pairs, 2, 2, width + 2), np.int64)
    for k in range(pairs):
        for v in (0, 1):
            p = L.predict(x[v][:, places[v][k]], weights[k][v])
            told, use = x[1 - v], places[1 - v][k]
            for label, sure in enumerate((p <= 1 - CONFIDENT, p >= CONFIDENT)):
                rows = told[sure][:, use]
                out[k, 1 - v, label, use] = rows.sum(0)
                out[k, 1 - v, label, -2:] = sure.sum(), rows.sum()
    return out


def _fit(known: Labelled, pair: int, v: int, counts: np.ndarray | None) -> np.ndarray:
    """A view's model on its labelled rows and, by feature, on the pseudo-labels that the other view gave."""
    train, use = known.train(pair), known.places[v][pair]
    x, y, weight = known.x[v][train][:, use], known.y[train], np.ones(int(train.sum()))
    if counts is not None and (rows := int(counts[:, -2].sum())) and len(use) and len(y):
        each = PSEUDO_WEIGHT * min(1.0, len(y) / rows) / max(1.0, counts[:, -1].sum() / rows)
        x = np.r_[x, np.eye(len(use)), np.eye(len(use))]
        y, weight = np.r_[y, np.zeros(len(use)), np.ones(len(use))], np.r_[weight, each * counts[0, use], each * counts[1, use]]
    return L.fit(x, y, weight)


def cotrain(known: Labelled, exchange, features: tuple[list[str], list[str]], rounds: int = ROUNDS) -> CoTrained:
    """``exchange(weights)`` gives ``pseudo_counts`` over all unlabelled rows; weights: of each pair and view."""
    pairs = range(len(known.places[0]))
    weights = [[_fit(known, k, v, None) for v in (0, 1)] for k in pairs]
    for _ in range(rounds):
        counts = exchange(weights)
        weights = [[_fit(known, k, v, counts[k, v]) for v in (0, 1)] for k in pairs]
    unseen = [np.zeros(len(known.y)) for _ in (0, 1)]
    for v in (0, 1):
        for k in range(L.FOLDS):
            here = known.fold == k
            unseen[v][here] = L.logit(L.predict(known.x[v][here][:, known.places[v][k + 1]], weights[k + 1][v]))
    calibration = tuple(L.fit(z[:, None], known.y, ridge=0.01) for z in unseen)
    both = np.c_[tuple(L.logit(L.predict(z[:, None], c)) for z, c in zip(unseen, calibration, strict=True))]
    own = tuple([f[k] for k in places[0]] for f, places in zip(features, known.places, strict=True))
    return CoTrained(own, tuple(weights[0]), calibration, L.fit(both, known.y, ridge=0.01))


def _seen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    have = [col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in META[:2]]
    size = col(META[2]).cast("long") if META[2] in docs.columns else F.char_length(text_or_empty(text_col)).cast("long")
    return docs.select(col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), *have, size.alias(META[2]))


def _packed(seen: DataFrame, chosen: DataFrame, features: tuple[list[str], list[str]]) -> DataFrame:
    """(doc_id, free, bits0, bits1): each row's features in both views, stored; ``free``: it isn't a labelled row."""
    make = [L.bits(f, v) for f, v in zip(features, VIEWS, strict=True)]

    def run(batches):
        for batch in bites(batches):
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.num_columns - 1), *(pa.array(m(rows), pa.binary()) for m in make)], names=["doc_id", "free", "bits0", "bits1"])

    marked = seen.join(F.broadcast(chosen.select("doc_id", F.lit(False).alias("free"))), "doc_id", "left").select(*seen.columns, F.coalesce("free", F.lit(True)).alias("free"))
    return stored(marked.mapInArrow(run, f"doc_id {dict(seen.dtypes)['doc_id']}, free boolean, bits0 binary, bits1 binary"))


def _matrices(batch: pa.RecordBatch, widths: list[int]) -> tuple[np.ndarray, ...]:
    return tuple(L.unpacked(batch.column(batch.schema.get_field_index(f"bits{v}")).to_pylist(), widths[v]) for v in (0, 1))


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int, rounds: int) -> tuple[CoTrained, DataFrame, list[list[str]]]:
    """The model, and all rows' features in both views with their names."""
    seen = _seen(docs, id_col, text_col)
    chosen, rows = L.labelled(seen, labels, id_col, label_col, fit_rows)  # bounded, so it may be broadcast
    named = [L.places_of(L.associated(rows, view, "y", least=least)) for view, least in zip(VIEWS, (30.0, 8.0), strict=True)]
    features, places = [f for f, _ in named], tuple(p for _, p in named)
    got = [L.matrix(rows, view, f) for view, f in zip(VIEWS, features, strict=True)]
    known = Labelled((got[0][0], got[1][0]), got[0][1], got[0][2], places)
    packed, widths = _packed(seen, chosen, features), [len(f) for f in features]

    def exchange(weights):
        def run(batches):
            total = None
            for batch in bites(batches, 4096):
                own = pseudo_counts(_matrices(batch, widths), weights, places)
                total = own if total is None else total + own
            if total is not None:
                flat = total.ravel()
                at = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], names=["at", "n"])

        # as many numbers as the features have, whatever the corpus
        summed = packed.where("free").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
        out = np.zeros((len(places[0]), 2, 2, max(widths) + 2), np.int64)
        out.ravel()[[r["at"] for r in summed]] = [r["n"] for r in summed]
        return out

    return cotrain(known, exchange, features, rounds), packed, features


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> CoTrained:
    """Fits on at most ``fit_rows`` labelled documents, by hash of their id, and on all others, unlabelled.

    Repeated labels of an id count as one, good if any says so; null labels
    don't count; of several documents of an id the least row counts. Without
    labels of both kinds all views say the share of good rows, or near 0
    without rows. Null texts count as empty. Extra columns are not read.
    """
    return _fitted(docs, labels, id_col, text_col, label_col, fit_rows, rounds)[0]


def _scored(rows: DataFrame, id_kind: str, id_col: str, model: CoTrained, matrices) -> DataFrame:
    def run(batches):
        for batch in bites(batches, 1024):
            p = model.probabilities(matrices(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 2] >= 0.5)], names=[id_col, "p_content", "p_metadata", "quality_score", "keep"])

    return rows.mapInArrow(run, f"{quoted(id_col)} {id_kind}, p_content double, p_metadata double, quality_score double, keep boolean")


def score(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``p_content``, ``p_metadata``, ``quality_score`` and ``keep``, from whole texts.

    Null texts count as empty, null metadata as a value of its own; repeated
    and null ids are rows of their own; an empty table gives an empty result.
    """
    make = [L.bits(f, v) for f, v in zip(model.features, VIEWS, strict=True)]

    def matrices(batch):
        parts = [batch.slice(at, 256).to_pylist() for at in range(0, batch.num_rows, 256)]
        return tuple(np.concatenate([L.unpacked(m(rows), len(f)) for rows in parts]) for m, f in zip(make, model.features, strict=True))

    return _scored(_seen(docs, id_col, text_col), dict(docs.dtypes)[id_col], id_col, model, matrices)


def fit_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``score`` by a model from ``train``, the texts read once for both: co-training and scoring share their features."""
    model, packed, features = _fitted(docs, labels, id_col, text_col, label_col, fit_rows, rounds)
    at = [{f: k for k, f in enumerate(fs)} for fs in features]
    use = [[at[v][f] for f in model.features[v]] for v in (0, 1)]
    widths = [len(f) for f in features]
    return _scored(packed, dict(docs.dtypes)[id_col], id_col, model, lambda batch: tuple(x[:, u] for x, u in zip(_matrices(batch, widths), use, strict=True)))


def query_op2(spark, sf_dir: str) -> DataFrame:
    """Every document's quality, by classifiers fitted on ``labels`` and all unlabelled documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return fit_and_score(docs, labels)
