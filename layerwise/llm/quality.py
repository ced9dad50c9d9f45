"""Quality classifier: random-indexing word vectors, pooled per document, and a small numpy network.

Random indexing: each word has a fixed sparse random vector; a word's context vector is the sum of those of
its neighbours over the whole corpus. Words are hashed to a fixed number of rows, so the matrix has a fixed
size whatever the corpus. A document is the mean of its words' vectors, once plain and once with frequent
words weighed down. A two-layer network gives a probability whose temperature is set on rows kept apart.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_BYTES, bounded_batches, fold_of, packed_row, row_key, small, stored, unpacked, words
from .labelled import FOLDS, MAX_TRAIN, fitted_on, training_labels

ROWS = 1 << 14  # hashed vocabulary
DIM = 48
NONZERO = 2
REACH = 2  # neighbours on either side
SEED = 11
_PART = re.compile(r"\w+|[^\w\s]+")
_MEMO = 300_000


class Vocabulary:
    """Words to rows of the matrix; a word gives its letter runs, its runs of signs, and whether it is all capitals."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, ...]] = {}

    def _rows(self, word: str) -> tuple[int, ...]:
        parts = _PART.findall(word.lower())
        if len(word) > 1 and word.isupper():
            parts.append("<capitals>")
        got = tuple(zlib.crc32(p.encode()) % ROWS for p in parts)
        if len(self.memo) >= _MEMO:
            self.memo.clear()
        self.memo[word] = got
        return got

    def ids(self, text: str | None) -> np.ndarray:
        memo, miss = self.memo, self._rows
        return np.fromiter(chain.from_iterable(memo[w] if w in memo else miss(w) for w in words(text or "")), np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's nonzero entries; the extra last row is for gaps between documents."""
    rng = np.random.default_rng(SEED)
    at, sign = rng.integers(0, DIM, (ROWS + 1, NONZERO)), rng.choice([-1.0, 1.0], (ROWS + 1, NONZERO))
    sign[ROWS] = 0
    return at, sign


def context_sums(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ROWS, DIM) context vectors and (ROWS) word counts of the whole corpus.

    Each task adds up its own matrix; the tasks' rows are added by an aggregation, and ROWS rows come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sign = index_vectors()
        total, counts, vocabulary = np.zeros((ROWS + 1) * DIM), np.zeros(ROWS + 1), Vocabulary()
        gap = np.full(REACH, ROWS, np.int64)
        for b in batches:
            ids = np.concatenate([x for t in b.column(0).to_pylist() for x in (vocabulary.ids(t), gap)] or [gap])
            counts += np.bincount(ids, minlength=ROWS + 1)
            for o in range(1, REACH + 1):
                for here, there in ((ids[:-o], ids[o:]), (ids[o:], ids[:-o])):
                    for k in range(NONZERO):
                        total += np.bincount(here * DIM + at[there, k], sign[there, k], (ROWS + 1) * DIM)
        full = np.flatnonzero(counts[:ROWS])
        values = pa.array(total.reshape(-1, DIM)[full].ravel())
        sums = pa.ListArray.from_arrays(pa.array(np.arange(0, len(full) * DIM + 1, DIM), pa.int32()), values)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full]), sums], ["row", "n", "sums"])

    parts = docs.select("text").mapInArrow(run, "row long, n double, sums array<double>")
    added = parts.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DIM)])
    got = added.toPandas()  # ROWS rows at most
    sums, counts = np.zeros((ROWS, DIM)), np.zeros(ROWS)
    rows = got["row"].to_numpy(np.int64)
    counts[rows] = got["n"]
    sums[rows] = got[[f"s{i}" for i in range(DIM)]]
    return sums, counts


def word_vectors(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(ROWS, 2 * DIM + 1): unit context vectors, the same weighed by 1e-3 / (1e-3 + frequency), and that weight."""
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    weight = 1e-3 / (1e-3 + counts / max(counts.sum(), 1.0))
    return np.hstack([unit, unit * weight[:, None], weight[:, None]]).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, _row, pooled binary): the means of the word vectors as float32; a text without words gives zeros."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", row_key(docs).alias("_row"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # ROWS rows, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, vocabulary = shared.value, Vocabulary()
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                ids = vocabulary.ids(t)
                if not len(ids):
                    out.append(np.zeros(2 * DIM, np.float32).tobytes())
                    continue
                rows, times = np.unique(ids, return_counts=True)
                total = times.astype(np.float32) @ table[rows]
                mean = np.concatenate([total[:DIM] / len(ids), total[DIM : 2 * DIM] / max(total[-1], 1e-9)])
                out.append(mean.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "_row", "pooled"])

    return keyed.mapInArrow(run, f"doc_id {kind}, _row binary, pooled binary")


class Network:
    """Standardised input, one tanh layer, one logistic output over a temperature."""

    def __init__(self, hidden: int = 24, seed: int = SEED) -> None:
        self.hidden, self.seed, self.temperature = hidden, seed, 1.0
        self.weights: list[np.ndarray] | None = None

    def _logit(self, x: np.ndarray) -> np.ndarray:
        mean, spread, w1, b1, w2, b2 = self.weights
        return np.tanh((x - mean) / spread @ w1 + b1) @ w2 + b2

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> Network:
        """Adam on the log loss; a tenth of the rows sets the temperature. Without both labels the network gives their mean."""
        if len(set(y.tolist())) < 2:
            self.weights, self.constant = None, float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 10], order[len(y) // 10 :]
        mean, spread = x[used].mean(0), x[used].std(0) + 1e-6
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        z = (x - mean) / spread
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(used), max(1, len(used) // batch)):
                h = np.tanh(z[part] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -35, 35))) - y[part]) / len(part)
                back = np.outer(d, w[2]) * (1 - h * h)
                grads = [z[part].T @ back + decay * w[0], back.sum(0), h.T @ d + decay * w[2], d.sum(keepdims=True)]
                t += 1
                for a, g, mi, vi in zip(w, grads, m, v):
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    a -= rate * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.999**t)) + 1e-8)
        self.weights = [mean, spread, *w]
        if len(held) >= 20:
            logits = self._logit(x[held])
            loss = lambda s: np.mean(np.logaddexp(0, np.where(y[held] == 1, -logits, logits) / s))
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -35, 35)))


def scored(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, _row, score) of every row; _row tells different rows apart."""
    bounded_batches(docs.sparkSession)
    rows = stored(pooled(docs, word_vectors(*context_sums(docs))), "pooled")
    sample = fitted_on(rows, training_labels(labels, "quality", limit)).orderBy("doc_id").toPandas()
    x = np.frombuffer(b"".join(sample["pooled"]), np.float32).reshape(len(sample), 2 * DIM).astype(float)
    network = Network().fit(x, sample["label"].to_numpy(float))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float32).reshape(b.num_rows, 2 * DIM).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(network.probability(x), pa.float64())], ["doc_id", "_row", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, _row binary, score double")


def score(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, threshold: float = 0.3) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, score, predicted), a row a row.

    Only the text enters the score. Null and empty texts pool to zeros and get the network's answer to that.
    Null and repeated ids pass through; an empty table gives none. At most `limit` labelled rows fit the
    network; context vectors come from all texts.
    """
    return scored(docs, labels, limit).select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    rejected = stored(scored(docs, labels, limit).where(F.col("score") < threshold).select("_row").distinct(), "rejected")
    kept = docs.select(packed_row(docs), row_key(docs).alias("_row")).join(small(rejected, rejected.count(), KEY_BYTES), "_row", "left_anti")
    return unpacked(kept, docs.columns)
