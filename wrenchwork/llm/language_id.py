"""Language of texts by a convolutional network over bytes, trained in numpy.

Bytes are embedded, filters of several widths slide over a window, each filter's largest
value in the window is kept, and a softmax over these gives the languages' probabilities. A
text is cut into windows of one fixed length, all of it, and the windows' probabilities are
averaged by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import fresh, wider
from .words import row_chunks, text_buffers

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    window: int = 256  # bytes
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16  # of each width
    # The labelled rows are sampled: at most about so many per language, and so many languages.
    rows_per_language: int = 1500
    languages: int = 200
    epochs: int = 12
    batch: int = 64
    rate: float = 0.003
    seed: int = 11


class ByteNetwork:
    """Filters of all widths side by side, zero beyond their width; they begin at each byte."""

    def __init__(self, classes: list[str], s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        self.classes, self.settings = classes, s
        self.widest = max(s.widths)
        n = s.filters * len(s.widths)
        self.embedding = rng.normal(0, 1, (256, s.embedding)).astype(np.float32)
        self.embedding[0] = 0
        kernel = rng.normal(0, 1, (self.widest, s.embedding, n))
        width = np.repeat(s.widths, s.filters)
        self.mask = (np.arange(self.widest)[:, None] < width[None, :])[:, None, :].astype(np.float32)
        self.kernel = (kernel * self.mask / np.sqrt(width * s.embedding)).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = (rng.normal(0, 1, (n, len(classes))) / np.sqrt(n)).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, widest * embedding): the bytes that the filters see at each place."""
        x = self.embedding[windows]
        b, length, e = x.shape
        view = np.lib.stride_tricks.as_strided(
            x, (b, length - self.widest + 1, self.widest * e), (x.strides[0], x.strides[1], x.strides[2])
        )
        return np.ascontiguousarray(view)

    def _pooled(self, windows: np.ndarray, with_place: bool = False):
        columns = self._columns(windows)
        b, places, k = columns.shape
        values = (columns.reshape(-1, k) @ self.kernel.reshape(k, -1)).reshape(b, places, -1)
        if with_place:
            place = values.argmax(axis=1)
            return np.take_along_axis(values, place[:, None, :], 1)[:, 0], place, columns
        return values.max(axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self._pooled(windows) + self.bias, 0)
        return _softmax(hidden @ self.out + self.out_bias)

    def fit(self, windows: np.ndarray, labels: np.ndarray) -> None:
        """Adam on the mean cross entropy, languages weighted alike."""
        s = self.settings
        rng = np.random.default_rng(s.seed)
        weight = 1.0 / np.maximum(np.bincount(labels, minlength=len(self.classes)), 1)
        weight = (weight / weight[labels].mean()).astype(np.float32)
        names = ("embedding", "kernel", "bias", "out", "out_bias")
        moments = {n: [np.zeros_like(getattr(self, n)) for _ in range(2)] for n in names}
        step = 0
        for _ in range(s.epochs):
            order = rng.permutation(len(windows))
            for start in range(0, len(order), s.batch):
                pick = order[start : start + s.batch]
                x, y = windows[pick], labels[pick]
                pooled, place, columns = self._pooled(x, with_place=True)
                hidden = np.maximum(pooled + self.bias, 0)
                slope = _softmax(hidden @ self.out + self.out_bias)
                slope[np.arange(len(y)), y] -= 1
                slope *= (weight[y] / len(y))[:, None]
                back = (slope @ self.out.T) * (hidden > 0)
                seen = np.take_along_axis(columns, place[:, :, None], 1)  # (batch, filters, widest * e)
                shape = self.kernel.shape
                kernel = np.einsum("bf,bfk->kf", back, seen).reshape(shape) * self.mask
                to_seen = np.einsum("bf,kf->bfk", back, self.kernel.reshape(-1, shape[2]))
                embedding = np.zeros_like(self.embedding)
                for k in range(self.widest):
                    byte = np.take_along_axis(x, place + k, 1)
                    part = to_seen[:, :, k * shape[1] : (k + 1) * shape[1]]
                    np.add.at(embedding, byte.reshape(-1), part.reshape(-1, shape[1]))
                embedding[0] = 0
                slopes = dict(
                    embedding=embedding, kernel=kernel, bias=back.sum(0), out=hidden.T @ slope, out_bias=slope.sum(0)
                )
                step += 1
                for name, g in slopes.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    change = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                    getattr(self, name)[...] -= (s.rate * change).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of all rows in windows filled up with zeros; each one's row and bytes."""
    sizes = np.diff(offsets)
    per_row = -(-sizes // length)
    row = np.repeat(np.arange(len(sizes)), per_row)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    filled = np.minimum(sizes[row] - number * length, length)
    out = np.zeros((len(row), length), dtype=np.uint8)
    target = np.repeat(np.arange(len(row)) * length - np.cumsum(filled) + filled, filled)
    out.reshape(-1)[target + np.arange(len(data))] = data
    return out, row, filled


def _training_rows(docs: DataFrame, s: Settings) -> tuple[list[str], list[str]]:
    """(texts, languages): a piece at a hashed place of each sampled text.

    Languages are counted first, the most frequent taken; then rows are taken by a hash of
    their text at the rate that gives each language its share, so no language is lost in a
    table of another one.
    """
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(s.languages).collect()
    if not counts:
        return [], []
    rates = F.create_map(
        *[F.lit(x) for r in counts for x in (r["lang"], min(1.0, s.rows_per_language / r["count"]))]
    )
    chance = F.pmod(F.xxhash64("text", F.lit(s.seed)), F.lit(1 << 30)) / float(1 << 30)
    room = F.greatest(F.length("text") - s.window, F.lit(0))
    piece = F.substring(
        F.col("text"), (F.pmod(F.xxhash64("text"), room + 1) + 1).cast("int"), F.lit(s.window)
    )
    picked = docs.where(chance < F.coalesce(rates[F.col("lang")], F.lit(0.0))).select(
        piece.alias("piece"), "lang", chance.alias("chance")
    )
    most = s.rows_per_language * len(counts)
    rows = picked.orderBy("chance", "piece", "lang").limit(2 * most).collect()
    return [r["piece"] for r in rows], [r["lang"] for r in rows]


def fitted(labelled: DataFrame, s: Settings = Settings()) -> ByteNetwork | None:
    """A network fitted on rows with ``text`` and ``lang``, or None if there are none.

    Rows with a null or letterless text or a null language are passed over. The rows used are
    a sample bounded by ``rows_per_language`` and ``languages``.
    """
    usable = labelled.where(has_letter(F.col("text")) & F.col("lang").isNotNull())
    texts, langs = _training_rows(usable, s)
    if not texts:
        return None
    classes = sorted(set(langs))
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    windows, row, filled = windows_of(data, offsets, s.window)
    use = filled >= min(32, s.window)  # ends of a few bytes teach nothing, short texts do
    use |= np.append(True, row[1:] != row[:-1])
    labels = np.searchsorted(classes, np.array(langs))[row]
    network = ByteNetwork(classes, s)
    network.fit(windows[use], labels[use])
    return network


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def with_language(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, the mean probability over the whole text.

    A null text, one without a letter, and any text if there is no network, is ``und`` with
    score 0. Names that clash get underscores in front.
    """
    label, score, letters = fresh(docs, "lang_pred", "lang_score", "has_letter")
    shared = docs.sparkSession.sparkContext.broadcast(network)
    text_at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lettered = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column(text_at))
            names, scores = [], []
            for a, b in row_chunks(offsets, 1 << 18):
                part = offsets[a : b + 1] - offsets[a]
                total = _row_sums(net, data[offsets[a] : offsets[b]], part) if net else np.zeros((b - a, 1))
                mean = total / np.maximum(np.diff(part), 1)[:, None]
                best = mean.argmax(axis=1)
                known = lettered[a:b] & (net is not None)
                names += [net.classes[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                scores.append(np.where(known, np.clip(mean.max(axis=1), 0.0, 1.0), 0.0))
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.concatenate(scores))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], label, score])

    schema = wider(docs, [label, score], ["string", "double"])
    return docs.withColumn(letters, has_letter(F.col("text"))).mapInArrow(predict, schema)


def _row_sums(net: ByteNetwork, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities summed over the windows of each row, weighted by their bytes."""
    windows, row, filled = windows_of(data, offsets, net.settings.window)
    total = np.zeros((len(offsets) - 1, len(net.classes)))
    for start in range(0, len(windows), 16):  # few at a time stay in the cache
        block = slice(start, start + 16)
        np.add.at(total, row[block], net.probabilities(windows[block]) * filled[block, None])
    return total
