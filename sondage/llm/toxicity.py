"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each category's model sees the
text's features and the probabilities of the categories before it. In training
those probabilities are out-of-fold predictions, so that a later model learns
from what an earlier one will really say of texts it has not seen.

The labels name toxic documents only. The categories before the last are kinds
of toxicity: clusters of the toxic rows by the terms that they hold together,
as insults of one language do. Features, clusters and models of a fold are all
found on the rows of the other folds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sondage.llm import _linear as L
from sondage.llm._common import bites, col, map_rows, quoted, text_or_empty

#: The chain's order: kinds of toxicity, and at last the label itself.
KINDS = 3
CATEGORIES = (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic")
#: Labelled rows that the chain is fitted on, at most.
FIT_ROWS = 6000


@dataclass
class Chain:
    features: list[str]
    weights: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column per category, in the chain's order."""
        done = np.zeros((len(x), 0))
        for w in self.weights:
            done = np.c_[done, L.predict(np.c_[x, done], w)]
        return done


def kinds_of(x: np.ndarray, kinds: int = KINDS) -> np.ndarray:
    """Centres (kinds x features) of the rows of ``x`` by the angle between them; the first two are far apart, and so on."""
    rows = x[x.any(1)]
    if not len(rows):
        return np.zeros((kinds, x.shape[1]))
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    centres = [rows[np.argmax(rows @ rows.mean(0))]]
    while len(centres) < kinds:
        centres.append(rows[np.argmin((rows @ np.array(centres).T).max(1))])
    centres = np.array(centres)
    for _ in range(20):
        mine = (rows @ centres.T).argmax(1)
        moved = np.array([rows[mine == k].mean(0) if (mine == k).any() else centres[k] for k in range(kinds)])
        moved /= np.linalg.norm(moved, axis=1, keepdims=True)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def categories_of(x: np.ndarray, y: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """A 0/1 column per kind: toxic rows that are nearest to its centre. A row without any term is of no kind."""
    near = x @ centres.T
    return np.eye(len(centres))[near.argmax(1)] * ((y > 0) & (near.max(1) > 0))[:, None] if len(x) and len(centres) else np.zeros((len(x), len(centres)))


def matched(centres: np.ndarray, to: np.ndarray) -> np.ndarray:
    """``centres`` in that order in which each goes with the most similar of ``to``, the most similar pair first."""
    alike, out = centres @ to.T, np.zeros_like(centres)
    for _ in range(len(to)):
        a, b = np.unravel_index(np.argmax(alike), alike.shape)
        out[b], alike[a, :], alike[:, b] = centres[a], -np.inf, -np.inf
    return out


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, places: list[np.ndarray], features: list[str], kinds: int = KINDS) -> Chain:
    """places: the columns of ``x`` for all rows, then for each fold those found without it; ``kinds`` of 0 is no chain."""

    def centres(k: int | None) -> np.ndarray:
        use, out = places[0 if k is None else k + 1], np.zeros((kinds, x.shape[1]))
        train = y > 0 if k is None else (y > 0) & (fold != k)
        out[:, use] = kinds_of(x[train][:, use], kinds) if kinds else out[:, use]
        return out

    every = centres(None)
    folds = [matched(centres(k), every) for k in range(L.FOLDS)]
    targets = np.c_[categories_of(x, y, every), y]
    before, weights = np.zeros((len(x), 0)), []
    for j in range(kinds + 1):
        weights.append(L.fit(np.c_[x[:, places[0]], before], targets[:, j], ridge=0.3))
        unseen = np.zeros(len(y))
        for k in range(L.FOLDS):
            own, here = np.c_[x[:, places[k + 1]], before], fold == k
            target = categories_of(x, y, folds[k])[:, j] if j < kinds else y
            if here.any():
                unseen[here] = L.predict(own[here], L.fit(own[~here], target[~here], ridge=0.3))
        before = np.c_[before, unseen]
    return Chain([features[k] for k in places[0]], weights)


def _view(row: dict) -> set[str]:
    return L.words_and_stems(row["text"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Chain:
    """The chain, from at most ``fit_rows`` labelled documents (by hash of their id), over their whole texts.

    Repeated labels of an id count as one, toxic if any says so; null labels
    and ids that no document has don't count; of several documents of an id the
    one of least text counts. Without labels of both kinds every probability is
    the share of toxic rows, or near 0 without rows. Extra columns are not read.
    """
    _, rows = L.labelled(docs.select(col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), labels, id_col, label_col, fit_rows)
    features, places = L.places_of(L.associated(rows, _view, "y"))
    return fit_chain(*L.matrix(rows, _view, features), places, features)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``p_<category>`` for each category and ``toxic``, over the whole text.

    Null texts count as empty; repeated and null ids are rows of their own; an
    empty table gives an empty result; extra columns are not read.
    """
    names = [f"p_{c}" for c in CATEGORIES]
    schema = f"{quoted(id_col)} {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean"

    def run(batches):
        places = {f: k for k, f in enumerate(chain.features)}
        for batch in bites(batches):
            p = _scores(batch.column(1).to_pylist(), places, chain)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= 0.5)], names=[id_col, *names, "toxic"])

    return docs.select(col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def _scores(texts: list[str], places: dict[str, int], chain: Chain) -> np.ndarray:
    x = np.zeros((len(texts), len(places)))
    for k, t in enumerate(texts):
        x[k, [places[f] for f in places.keys() & L.words_and_stems(t)]] = 1
    return chain.probabilities(x)


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose whole text isn't toxic, with all their columns, of any name and type.

    Null texts count as empty; repeated and null ids are rows of their own; an
    empty table gives an empty result.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        places = {f: k for k, f in enumerate(chain.features)}
        for batch in bites(batches):
            p = _scores([t or "" for t in batch.column(at).to_pylist()], places, chain)
            yield batch.filter(pa.array(p[:, -1] < 0.5)) if len(p) else batch

    return map_rows(docs, run)


def query_op6(spark, sf_dir: str) -> DataFrame:
    """Every document's probabilities, by a chain fitted on ``labels``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
