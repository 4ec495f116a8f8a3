"""Quality of texts: random-indexing word vectors, pooled, then a small calibrated network.

Every term has a fixed sparse index vector of a few +1 and -1. A term's context vector is the
sum of the index vectors of the words around it, over all texts. Terms are words and
word endings, hashed into a fixed number of slots, so that the vectors have a fixed size
whatever the vocabulary. A text is the mean and the spread of its terms' vectors, with a few
figures of its form. A two-layer network scores it; its logits are divided by a temperature
chosen on rows that the network was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import fresh, wider
from .words import CHUNK_BYTES, Words, mixed, word_chunks

_U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    slots: int = 1 << 13
    dimensions: int = 24
    signs: int = 2  # entries of an index vector that are not 0
    around: int = 2  # words on either side
    # The network is fitted on a sample of at most so many labelled rows.
    most_rows: int = 6000
    hidden: int = 24
    epochs: int = 60
    batch: int = 128
    rate: float = 0.003
    decay: float = 1e-4
    seed: int = 5


def _terms(words: Words, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The slots of each word and of its ending, its last two bytes."""
    half = _U64(s.slots // 2)
    word = (words.hashes % half).astype(np.int64)
    last = words.data[words.ends - 1].astype(np.uint64)
    prior = words.data[np.maximum(words.ends - 2, words.starts)].astype(np.uint64)
    ending = (mixed(last * _U64(256) + prior + _U64(1)) % half).astype(np.int64) + s.slots // 2
    return word, ending


def _index_vectors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, sign) of each slot's entries."""
    rng = np.random.default_rng(s.seed)
    return (
        rng.integers(0, s.dimensions, (s.slots, s.signs)),
        rng.choice(np.array([-1.0, 1.0]), (s.slots, s.signs)),
    )


def _context_sums(words: Words, s: Settings, where: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """What the words of a chunk add to the context vectors, slots times dimensions."""
    row = words.row_of_word()
    terms = _terms(words, s)
    total = np.zeros(s.slots * s.dimensions)
    for gap in range(1, s.around + 1):
        near = np.flatnonzero(row[gap:] == row[: len(row) - gap]) if len(row) > gap else np.zeros(0, np.int64)
        for centre, beside in ((near, near + gap), (near + gap, near)):
            # A word's surroundings are told by the endings of the words there.
            context = terms[1][beside]
            for own in terms:
                base = own[centre] * s.dimensions
                for k in range(s.signs):
                    total += np.bincount(
                        base + where[context, k], weights=sign[context, k], minlength=len(total)
                    )
    return total.reshape(s.slots, s.dimensions)


def context_vectors(docs: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Context vectors of all slots from all texts of ``docs``, each of length 1.

    Every task sums up what it reads and gives one row per slot with anything; these are
    summed by slot. The result has ``slots`` times ``dimensions`` numbers at any size of input.
    """
    where, sign = _index_vectors(s)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((s.slots, s.dimensions))
        for batch in batches:
            for _, _, words in word_chunks(batch.column(0), CHUNK_BYTES):
                total += _context_sums(words, s, where, sign)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some, pa.int32()),
                *[pa.array(total[some, d].astype(np.int64)) for d in range(s.dimensions)],
            ],
            names=["slot", *[f"d{d}" for d in range(s.dimensions)]],
        )

    columns = [f"d{d}" for d in range(s.dimensions)]
    parts = docs.select("text").mapInArrow(gather, "slot int, " + ", ".join(f"{c} bigint" for c in columns))
    summed = parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    vectors = np.zeros((s.slots, s.dimensions), dtype=np.float32)
    for r in summed:
        vectors[r["slot"]] = [r[c] for c in columns]
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def features(words: Words, vectors: np.ndarray, s: Settings) -> np.ndarray:
    """A row per text: mean and spread of its terms' vectors, distinct share, length."""
    n = np.diff(words.first)
    some = np.flatnonzero(n > 0)
    out = np.zeros((words.rows, 3 * s.dimensions + 3), dtype=np.float32)
    if not len(some):
        return out
    word, ending = _terms(words, s)
    at = words.first[some]
    size = n[some, None]
    own, ends = vectors[word], vectors[ending]
    mean = np.add.reduceat(own, at, axis=0) / size
    end_mean = np.add.reduceat(ends, at, axis=0) / size
    square = np.add.reduceat(ends * ends, at, axis=0) / size
    row = words.row_of_word()
    order = np.lexsort((words.hashes, row))
    new = np.append(True, (words.hashes[order][1:] != words.hashes[order][:-1]) | (row[order][1:] != row[order][:-1]))
    distinct = np.bincount(row[order][new], minlength=words.rows)[some]
    d = s.dimensions
    out[some, :d], out[some, d : 2 * d] = mean, end_mean
    out[some, 2 * d : 3 * d] = np.sqrt(np.maximum(square - end_mean**2, 0))
    # Long texts repeat words more: the share is set against what such a length has.
    out[some, 3 * d] = np.log(distinct) / np.log(n[some] + 1.0)
    out[some, 3 * d + 1] = np.log1p(n[some]) / 10
    out[some, 3 * d + 2] = 1
    return out


class Network:
    """Two layers, features scaled by those of the rows it was fitted on."""

    def __init__(self, x: np.ndarray, y: np.ndarray, s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        part = rng.random(len(x)) < 0.8
        part[0] = True
        self.temperature = 1.0
        self.params = [
            rng.normal(0, 1, (x.shape[1], s.hidden)) / np.sqrt(x.shape[1]), np.zeros(s.hidden),
            rng.normal(0, 1, s.hidden) / np.sqrt(s.hidden), np.zeros(1),
        ]
        self._fit(x[part], y[part], rng, s)
        self._calibrate(x[~part], y[~part])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.params
        return np.maximum(x @ a + b, 0) @ c + d

    def _fit(self, x: np.ndarray, y: np.ndarray, rng, s: Settings) -> None:
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in self.params]
        step = 0
        for _ in range(s.epochs):
            order = rng.permutation(len(x))
            for start in range(0, len(x), s.batch):
                bx, by = x[order[start : start + s.batch]], y[order[start : start + s.batch]]
                a, b, c, d = self.params
                hidden = np.maximum(bx @ a + b, 0)
                slope = (_sigmoid(hidden @ c + d) - by) / len(by)
                back = slope[:, None] * c[None, :] * (hidden > 0)
                slopes = [bx.T @ back, back.sum(0), hidden.T @ slope, slope.sum(keepdims=True)]
                step += 1
                for p, g, (m, v) in zip(self.params, slopes, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                    p -= s.rate * s.decay * p

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least cross entropy on rows the layers have not seen."""
        if not len(x):
            return
        logits = self._logits(x)

        def loss(t: float) -> float:
            p = np.clip(_sigmoid(logits / t), 1e-7, 1 - 1e-7)
            return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

        self.temperature = float(min(np.geomspace(0.5, 8, 81), key=loss))

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logits((x - self.mean) / self.scale) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    network: Network | None
    settings: Settings

    def score(self, words: Words) -> np.ndarray:
        if self.network is None:
            return np.full(words.rows, 0.5)
        return self.network.score(features(words, self.vectors, self.settings))


def fitted(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Vectors from all texts of ``docs``, a network from a sample of ``labels``.

    ``labels`` gives ``doc_id`` and ``quality`` (0 or 1). Null ids and labels are passed over; of a
    document labelled several times the mean counts, 1 from a half on. Without any labelled
    text every score is 0.5. At most ``most_rows`` rows are used, chosen by a hash of the id.
    """
    vectors = context_vectors(docs, s)
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(s.seed)), "doc_id")
        .limit(s.most_rows)
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in word_chunks(batch.column(0), CHUNK_BYTES // 4):
                x = features(words, shared.value, s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["label", "x"],
                )

    rows = joined.mapInArrow(read, "label int, x binary").orderBy("x", "label").limit(2 * s.most_rows).collect()
    if not rows:
        return Model(vectors, None, s)
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in rows]).astype(np.float64)
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    return Model(vectors, Network(x, y, s), s)


def with_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``quality_score``, the calibrated probability of label 1, for every text.

    Null and empty texts are scored as texts without words. A name that clashes gets
    underscores in front.
    """
    (score,) = fresh(docs, "quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in word_chunks(batch.column(text_at), CHUNK_BYTES // 4):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(shared.value.score(words), pa.float64())],
                    names=[*part.schema.names, score],
                )

    return docs.mapInArrow(predict, wider(docs, [score], ["double"]))
