"""Language identification by a convolutional network over bytes, trained in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over a fixed-length window and given to a
softmax. It is fitted on a bounded sample of labelled texts and applied to all windows of every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
BLOCK = 64  # windows multiplied at once
BATCH_LANGUAGES = 64  # more languages than this train for more steps
WINDOWS_PER_TEXT = 16  # random windows of a sampled text
UNKNOWN = "und"


@dataclass
class ByteNetwork:
    """Parameters of the network; `languages` are its classes in order."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    @staticmethod
    def fresh(languages: list[str], rng: np.random.Generator) -> ByteNetwork:
        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        pooled = len(WIDTHS) * FILTERS
        return ByteNetwork(
            languages, normal(256, EMBEDDING, scale=0.5),
            [normal(w * EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5) for w in WIDTHS],
            np.zeros(pooled, np.float32), normal(pooled, len(languages), scale=pooled**-0.5),
            np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.weights, self.offset]

    def pooled(self, windows: np.ndarray, where: list | None = None) -> np.ndarray:
        """Largest response of each filter in each window; `where` also gets inputs and places, for training."""
        embedded = self.embedding[windows]
        length, out = windows.shape[1], []
        for width, kernel in zip(WIDTHS, self.filters, strict=True):
            parts = [embedded[:, j : length - width + 1 + j] for j in range(width)]
            stacked = np.concatenate(parts, axis=2)
            responses = stacked @ kernel
            if where is None:
                out.append(responses.max(axis=1))
                continue
            places = responses.argmax(axis=1)
            out.append(np.take_along_axis(responses, places[:, None], 1)[:, 0])
            where.append((stacked, places))
        return np.concatenate(out, axis=1) + self.bias

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(windows), BLOCK):
            hidden = np.maximum(self.pooled(windows[at : at + BLOCK]), 0)
            out.append(softmax(hidden @ self.weights + self.offset))
        return np.concatenate(out) if out else np.empty((0, len(self.languages)), np.float32)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        where: list = []
        pooled = self.pooled(windows, where)
        hidden = np.maximum(pooled, 0)
        error = softmax(hidden @ self.weights + self.offset)
        error[np.arange(len(labels)), labels] -= 1
        error /= len(labels)
        back = (error @ self.weights.T) * (pooled > 0)
        d_embedding = np.zeros_like(self.embedding)
        d_filters = []
        rows = np.arange(len(labels))[:, None]
        for i, (width, kernel) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            stacked, places = where[i]
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            inputs = stacked[rows, places]  # window, filter, width * embedding
            d_filters.append(np.einsum("bfi,bf->if", inputs, own))
            d_inputs = own[:, :, None] * kernel.T[None]
            for j in range(width):
                np.add.at(d_embedding, windows[rows, places + j], d_inputs[:, :, j * EMBEDDING : (j + 1) * EMBEDDING])
        return [d_embedding, *d_filters, back.sum(0), hidden.T @ error, error.sum(0)]


def softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def windows_of(data: bytes) -> np.ndarray:
    """All bytes as rows of WINDOW bytes, the last one filled with zeros."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(texts: list[list[bytes]], labels: list[str], steps: int = 600, batch: int = 64, seed: int = 0) -> ByteNetwork:
    """Fit a network with Adam; windows of short and full length, from all parts of each text, some in capitals.

    Languages take turns over all steps; more than BATCH_LANGUAGES of them get steps in proportion.
    """
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    network = ByteNetwork.fresh(languages, rng)
    by_language = [[t for t, x in zip(texts, labels, strict=True) if x == lang and t] for lang in languages]
    usable = [i for i, own in enumerate(by_language) if own]
    if len(usable) < 1:
        return network
    steps = -(-steps * max(BATCH_LANGUAGES, len(usable)) // BATCH_LANGUAGES)
    first = [np.zeros_like(p) for p in network.parameters()]
    second = [np.zeros_like(p) for p in network.parameters()]
    for step in range(1, steps + 1):
        windows, wanted = np.zeros((batch, WINDOW), np.uint8), np.empty(batch, np.int64)
        for k in range(batch):
            wanted[k] = usable[((step - 1) * batch + k) % len(usable)]
            own = by_language[wanted[k]]
            parts = own[rng.integers(len(own))]
            text = parts[rng.integers(len(parts))]
            size = WINDOW if rng.random() < 0.7 else int(rng.integers(8, WINDOW))
            at = int(rng.integers(max(1, len(text) - size + 1)))
            part = text[at : at + size]
            part = np.frombuffer(part.upper() if rng.random() < 0.1 else part, np.uint8)
            windows[k, : len(part)] = part
        rate = 0.01 * (1 - 0.9 * step / steps)
        for p, g, m, v in zip(network.parameters(), network.gradients(windows, wanted), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return network


def sample_texts(labelled: DataFrame, per_language: int) -> tuple[list[list[bytes]], list[str]]:
    """Windows of at most `per_language` texts of each language, the first by a hash of doc_id; ids are chosen before
    texts move. Longer texts are cut to WINDOWS_PER_TEXT windows of WINDOW bytes, from random places, where they stand."""
    ids = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language).drop("_n")
    found = labelled.join(F.broadcast(chosen), ["doc_id", "lang"])  # per_language rows a language
    rows = found.select("doc_id", "lang", F.col("text").cast("binary").alias("text"))
    schema = rows.select("doc_id", "lang").schema.add("parts", ArrayType(BinaryType()))
    rows = rows.mapInArrow(_some_windows(schema.names), schema).dropDuplicates(["doc_id", "lang"])
    rows = sorted(rows.collect(), key=lambda x: (x.doc_id, x.lang))
    return [[bytes(part) for part in x.parts] for x in rows], [x.lang for x in rows]


def _some_windows(names: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [random_windows(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(parts, pa.list_(pa.binary()))], names)

    return cut


def random_windows(data: bytes) -> list[bytes]:
    """A text of up to WINDOWS_PER_TEXT windows as it is, else that many windows from places drawn by its bytes."""
    if len(data) <= WINDOWS_PER_TEXT * WINDOW:
        return [data]
    places = np.random.default_rng(zlib.crc32(data)).integers(len(data) - WINDOW + 1, size=WINDOWS_PER_TEXT)
    return [data[at : at + WINDOW] for at in places.tolist()]


def fit(labelled: DataFrame, per_language: int = 300, steps: int = 600) -> ByteNetwork:
    """Train on a sample of `labelled` (doc_id, text, lang), at most `per_language` texts for each language."""
    texts, labels = sample_texts(labelled, per_language)
    return train(texts, labels, steps)


def predictions(network: ByteNetwork, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text, from all windows of it."""
    found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    wanted = [i for i, t in enumerate(texts) if t and network.languages and any(map(str.isalpha, t))]
    for group in _groups(wanted, texts):
        data = [texts[i].encode() for i in group]
        rows = [windows_of(x) for x in data]
        scores = network.probabilities(np.concatenate(rows))
        at = 0
        for i, text, own in zip(group, data, rows, strict=True):
            weights = np.full(len(own), WINDOW, np.float64)
            weights[-1] = len(text) - WINDOW * (len(own) - 1)
            mean = weights @ scores[at : at + len(own)].astype(np.float64) / weights.sum()
            best = int(mean.argmax())
            found[i] = (network.languages[best], min(1.0, float(mean[best])))
            at += len(own)
    return found


def predict(docs: DataFrame, network: ByteNetwork, *keep: str | Column) -> DataFrame:
    """Columns `keep` of every row of `docs`, with lang_pred and score, from all windows of its whole `text`.

    A text's probabilities are the mean over its windows, by their bytes. Null texts and texts without a letter
    get `und` and 0, and so does everything if no language was learned; of equal languages the first wins.
    """
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    names = schema.names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predictions(network, batch.column(batch.num_columns - 1).to_pylist())
            predicted = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *predicted], names)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(apply, schema)


def accepted(docs: DataFrame, network: ByteNetwork, least: float) -> DataFrame:
    """The rows of `docs` whose text has a language, with a score of at least `least`."""
    place = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predictions(network, batch.column(place).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)


def _groups(wanted: list[int], texts: list[str], chars: int = 1 << 20) -> Iterator[list[int]]:
    """Rows in groups of about `chars` characters."""
    group, size = [], 0
    for i in wanted:
        group.append(i)
        size += len(texts[i])
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group
