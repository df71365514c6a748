"""Toxicity by a classifier chain.

The label columns are predicted one after another. Each link is a linear (logistic) model over the
hashed distinct words and word beginnings of a text, trained by FTRL-proximal, whose L1 term leaves weights only on
words that tell; every later link also gets the log-odds of the links before it. In training
those come from models that did not see the row (FOLDS folds), so a later link learns how far an
earlier one can be trusted on new texts; in use they come from models fitted on all folds.

MAX_TRAIN labelled rows at most are used for fitting, those with the least hashes of their ids. The
sample is therefore bounded and its labels can be broadcast; all texts are scored, whole.

Defined results: null or empty texts have no words and get the models' biases; labels that are null
count as 0; repeated rows have equal results; null ids are scored (their labels are not used); an empty
document table gives an empty table; without labelled rows every probability is 0.5 and nothing is
toxic; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text

BITS = 20
FOLDS = 5
EPOCHS = 3
PREFIXES = (4, 6)
MAX_TRAIN = 20_000
THRESHOLD = 0.5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
#: Punctuation counts as white space.
_PUNCTUATION = bytes(32 if chr(c) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def feature_ids(text: bytes) -> np.ndarray:
    """Hashed distinct words and word beginnings, lower-cased, punctuation dropped.

    The beginnings (PREFIXES bytes) let an inflected form count that training did not hold.
    """
    words = set(text.lower().translate(_PUNCTUATION).split())
    for n in PREFIXES:
        words |= {b"^%d" % n + w[:n] for w in words if len(w) >= n and w[:1] != b"^"}
    found = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    return np.unique(found & ((1 << BITS) - 1))


class Link:
    """A logistic model over feature ids and a few dense values, fitted by FTRL-proximal."""

    def __init__(self, dense: int) -> None:
        self.z, self.n = np.zeros((1 << BITS) + dense + 1), np.zeros((1 << BITS) + dense + 1)
        self.dense = np.arange(1 << BITS, (1 << BITS) + dense + 1)  # the last is the bias

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = at >= 1 << BITS
        small = np.where(free, 0.0, L1)
        return np.where(np.abs(z) <= small, 0.0, -(z - np.sign(z) * small) / ((BETA + np.sqrt(n)) / ALPHA + L2 * ~free))

    def fit(self, ids: list[np.ndarray], dense: np.ndarray, y: np.ndarray, rows: np.ndarray) -> Link:
        for _ in range(EPOCHS):
            for r in rows:
                at = np.concatenate([ids[r], self.dense])
                x = np.ones(len(at))
                x[len(ids[r]) : -1] = dense[r]
                w = self._weights(at)
                p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
                g = (p - y[r]) * x
                square = g * g
                self.z[at] += g - (np.sqrt(self.n[at] + square) - np.sqrt(self.n[at])) / ALPHA * w
                self.n[at] += square
        return self

    def vector(self) -> np.ndarray:
        return self._weights(np.arange(len(self.z)))


def log_odds(weights: np.ndarray, ids: np.ndarray, dense: list[float]) -> float:
    extra = weights[1 << BITS :]
    return float(np.clip(weights[ids].sum() + extra[-1] + (extra[:-1] @ np.array(dense) if dense else 0.0), -30, 30))


def fit_chain(ids: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """Weights of each link. labels: [row, link] 0 or 1; folds: 0 to FOLDS - 1 of each row."""
    n, links = labels.shape
    given = np.zeros((n, links))
    out = []
    for c in range(links):
        y, dense = labels[:, c].astype(float), given[:, :c]
        everything = np.arange(n)
        if c < links - 1:
            for fold in range(FOLDS):
                w = Link(c).fit(ids, dense, y, everything[folds != fold]).vector()
                for r in everything[folds == fold]:
                    given[r, c] = log_odds(w, ids[r], list(dense[r]))
        out.append(Link(c).fit(ids, dense, y, everything).vector())
    return out


def train(docs: DataFrame, labels: DataFrame, links: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> list[np.ndarray]:
    """Fit the chain on the bounded sample, in one executor task; its non-zero weights come back."""
    order = F.xxhash64(F.col(id_col))
    sample = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(f"y{k}") for k, c in enumerate(links)], order.alias("at")).orderBy("at", "doc_id").limit(MAX_TRAIN)
    names = [f"y{k}" for k in range(len(links))]

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [feature_ids(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), *(b.column(c) for c in ("at", *names))], ["ids", "at", *names])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["at"], r["ids"]))
        if not rows:
            return
        ids = [np.array(r["ids"], np.int64) for r in rows]
        chain = fit_chain(ids, np.array([[r[c] for c in names] for r in rows]), np.array([r["at"] % FOLDS for r in rows]))
        for k, w in enumerate(chain):
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(w[at])], ["link", "at", "weight"])

    met = id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("text", "at", *names)
    rows = met.mapInArrow(featured, "ids array<long>, at long, " + ", ".join(f"{c} int" for c in names)).repartition(1).mapInArrow(fitted, "link int, at long, weight double").collect()
    out = [np.zeros((1 << BITS) + k + 1) for k in range(len(links))]
    for r in rows:
        out[r.link][r.at] = r.weight
    return out


def score(docs: DataFrame, chain: list[np.ndarray], links: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and p_<link> for each link, in order, for each row."""
    shared = docs.sparkSession.sparkContext.broadcast([w.astype(np.float32) for w in chain])
    names = ["doc_id", *[f"p_{c}" for c in links]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                ids, odds = feature_ids(x.as_py()), []
                for w in shared.value:
                    odds.append(log_odds(w, ids, odds))
                out.append(odds)
            p = 1 / (1 + np.exp(-np.array(out).reshape(-1, len(links))))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(p[:, k]) for k in range(len(links)))], names)

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, ", ".join(["doc_id long", *[f"{n} double" for n in names[1:]]]))


def annotate(docs: DataFrame, labels: DataFrame, links: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<link> for each link, and toxic (the last link over THRESHOLD)."""
    found = score(docs, train(docs, labels, links, id_col, text_col), links, id_col, text_col)
    return found.withColumn("toxic", F.col(f"p_{links[-1]}") > THRESHOLD)
