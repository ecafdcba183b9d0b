"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths run over embedded bytes of fixed-length windows; each filter's largest value in a window
goes into a softmax layer. Training windows come from a bounded sample of labelled rows. To predict, a whole text
is cut into windows, and the mean of their log-odds decides.

For prediction each filter is folded with the embedding into tables over byte pairs, so a filter of width 4 costs
two look-ups for a position; the result is the same network's.

Defined results: a null text, or one without a letter, is `und` with score 0; without any labelled row every text
is `und`; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, mapped, small

UNDETERMINED = "und"
WIDTHS, FILTERS, EMBEDDING, WINDOW = (2, 3, 4), 12, 8, 96


@dataclass
class Network:
    classes: list[str]
    embedding: np.ndarray  # (256, EMBEDDING)
    filters: list[np.ndarray]  # (width, EMBEDDING, FILTERS) each
    bias: np.ndarray  # all filters
    dense: np.ndarray
    offset: np.ndarray


def windows(text: str) -> np.ndarray:
    """All bytes of a text, ASCII letters in lower case, in windows of fixed length; blanks fill the last."""
    raw = text.encode().lower()
    raw += b" " * (-len(raw) % WINDOW)
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, WINDOW)


def _forward(net: Network, x: np.ndarray) -> tuple:
    e = net.embedding[x]  # (n, WINDOW, EMBEDDING)
    pooled, where, cols = [], [], []
    for w, k in zip(net.filters, WIDTHS):
        m = WINDOW - k + 1
        col = np.concatenate([e[:, j : j + m] for j in range(k)], axis=2)
        z = col @ w.reshape(-1, FILTERS)
        top = z.argmax(axis=1)
        pooled.append(np.take_along_axis(z, top[:, None, :], axis=1)[:, 0])
        where.append(top)
        cols.append(col)
    h = np.concatenate(pooled, axis=1) + net.bias
    a = np.maximum(h, 0)
    z = a @ net.dense + net.offset
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True), a, h, where, cols


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    p, a, h, where, cols = _forward(net, x)
    n = len(x)
    dz = p
    dz[np.arange(n), y] -= 1
    dz /= n
    dh = (dz @ net.dense.T) * (h > 0)
    d_embedding = np.zeros_like(net.embedding)
    d_filters = []
    for i, (w, k) in enumerate(zip(net.filters, WIDTHS)):
        d = dh[:, i * FILTERS : (i + 1) * FILTERS]
        chosen = np.take_along_axis(cols[i], where[i][:, :, None], axis=1)  # (n, FILTERS, k * EMBEDDING)
        d_filters.append(np.einsum("nf,nfc->cf", d, chosen).reshape(w.shape))
        back = (d[:, :, None] * w.reshape(-1, FILTERS).T).reshape(-1, k, EMBEDDING)
        at = (where[i][:, :, None] + np.arange(k)).reshape(n, -1)
        np.add.at(d_embedding, np.take_along_axis(x, at, axis=1).ravel(), back.reshape(-1, EMBEDDING))
    return [d_embedding, *d_filters, dh.sum(axis=0), a.T @ dz, dz.sum(axis=0)]


def fit(x: np.ndarray, y: np.ndarray, classes: list[str], epochs: int | None = None, batch: int = 64, rate: float = 0.004, seed: int = 5) -> Network:
    """The network trained on windows x of class numbers y, by Adam: 4 epochs, more of a small sample for 600 steps."""
    epochs = max(4, -(-600 * batch // max(1, len(x)))) if epochs is None else epochs
    rng = np.random.default_rng(seed)
    n = len(classes)
    net = Network(
        classes,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(k * EMBEDDING), (k, EMBEDDING, FILTERS)).astype(np.float32) for k in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), dtype=np.float32),
        rng.normal(0, 0.2, (FILTERS * len(WIDTHS), n)).astype(np.float32),
        np.zeros(n, dtype=np.float32),
    )
    params = [net.embedding, *net.filters, net.bias, net.dense, net.offset]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick, t = order[at : at + batch], t + 1
            step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for p, g, m, v in zip(params, _gradients(net, x[pick], y[pick]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= step * m / (np.sqrt(v) + 1e-8)
    return net


class Tables:
    """The network for prediction."""

    def __init__(self, net: Network):
        self.net = net
        single = [[(net.embedding @ w[j]).astype(np.float32) for j in range(k)] for w, k in zip(net.filters, WIDTHS)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.two, self.three, self.last = pair(*single[0]), pair(*single[1][:2]), single[1][2]
        self.front, self.back = pair(*single[2][:2]), pair(*single[2][2:])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of each window; positions are the first axis, so that pooling runs over long rows."""
        out = np.empty((len(x), len(self.net.classes)), dtype=np.float32)
        for at in range(0, len(x), 256):
            b = np.ascontiguousarray(x[at : at + 256].T).astype(np.intp)
            p = b[:-1] << 8 | b[1:]
            pooled = [
                self.two[p].max(axis=0),
                (self.three[p[:-1]] + self.last[b[2:]]).max(axis=0),
                (self.front[p[:-2]] + self.back[p[2:]]).max(axis=0),
            ]
            out[at : at + 256] = np.maximum(np.concatenate(pooled, axis=1) + self.net.bias, 0) @ self.net.dense
        return out + self.net.offset


def sample(df: DataFrame, key: str, text: str = "text", lang: str = "lang", per_class: int = 800, per_text: int = 4, seed: int = 5) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Training windows, class numbers and classes from labelled rows.

    About per_class rows of each language, drawn by hash of key and text, give at most per_text windows each, spread
    over their whole text. Every language is a class, however rare.
    """
    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = cut_lineage(rows.groupBy("lang").agg(F.count("*").alias("n")))
    u = F.pmod(F.xxhash64("key", "text", F.lit(seed)), F.lit(1 << 20))
    chosen = rows.join(small(sizes, sizes.count()), "lang").filter(u * F.col("n") < (per_class << 20)).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = windows(t)
                for i in sorted({int(k) for k in np.linspace(0, len(x) - 1, min(per_text, len(x)))} if len(x) else []):
                    langs.append(c)
                    found.append(x[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, type=pa.string()), pa.array(found, type=pa.binary())], names=["lang", "w"])

    got = chosen.mapInArrow(cut, "lang string, w binary").toPandas().sort_values(["lang", "w"])
    classes = sorted(got["lang"].unique().tolist())
    x = np.frombuffer(b"".join(bytes(w) for w in got["w"]), dtype=np.uint8).reshape(-1, WINDOW)
    number = {c: i for i, c in enumerate(classes)}
    return x, got["lang"].map(number).to_numpy(dtype=np.int64), classes


def predict(df: DataFrame, keep: list[str], net: Network | None, text: str = "text") -> DataFrame:
    """keep, lang_pred and score of every whole text."""
    held: list[Tables] = []

    def made(texts: list) -> list:
        if net and not held:  # once in a task
            held.append(Tables(net))
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        use = [i for i, t in enumerate(texts) if held and t and any(map(str.isalpha, t))]
        if use:
            cut = [windows(texts[i]) for i in use]
            ends = np.cumsum([len(c) for c in cut])
            z = np.add.reduceat(held[0].log_odds(np.concatenate(cut)).astype(np.float64), np.concatenate([[0], ends[:-1]]), axis=0)
            z /= np.diff(np.concatenate([[0], ends]))[:, None]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for i, row in zip(use, p):
                langs[i], scores[i] = net.classes[int(row.argmax())], float(row.max())
        return [langs, scores]

    return mapped(df, keep, text, {"lang_pred": T.StringType(), "score": T.DoubleType()}, made)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fold: int = 0, folds: int = 5) -> DataFrame:
    """key, held_out, lang_pred, score; learned from rows outside the held-out fold of crc32(key as text)."""
    part = F.crc32(F.col(key).cast("string").cast("binary")) % folds
    net = None
    x, y, classes = sample(docs.filter(part != fold), key, text, lang)
    if classes:
        net = fit(x, y, classes)
    out = predict(docs.select(F.col(key), F.coalesce(part == fold, F.lit(False)).alias("held_out"), F.col(text)), [key, "held_out"], net, text)
    return out
