"""Language identification with a byte convolutional network trained in numpy.

The network reads a text's UTF-8 bytes in windows of a fixed length. Filters two, three and four bytes wide slide
over each window, their largest responses over the window are kept (max pooling) and a softmax layer turns these
into language probabilities. The logarithms of the probabilities of a text's windows are averaged, each weighted by
its bytes, so that every byte of the text counts.

A filter of width w adds up one number per byte position. Two positions are looked up together in a table of
65,536 byte pairs, so a filter costs one or two table look-ups per byte when texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, forget

WIDTHS = (2, 3, 4)


@dataclass(frozen=True)
class LanguageParams:
    window: int = 256  # bytes in a window
    filters: int = 8  # filters of each width
    embedding: int = 12  # numbers for a byte
    docs_per_language: int = 600  # the training sample holds about so many documents of each language
    windows_per_doc: int = 3  # and so many windows of each, at hashed places
    epochs: int = 10
    rate: float = 0.02
    seed: int = 7


def windows_of(data: bytes, size: int) -> np.ndarray:
    """The bytes as rows of the window's length; the last row is filled up with spaces."""
    n = max(1, -(-len(data) // size))
    out = np.full(n * size, 32, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


class ByteConvNet:
    """Embedding, filters of several widths, max pooling, softmax. Weights are plain arrays, so it pickles small."""

    def __init__(self, labels: list[str], params: LanguageParams):
        rng = np.random.default_rng(params.seed)
        self.labels, self.params = labels, params
        self.weights = {"emb": rng.normal(0, 0.3, (256, params.embedding))}
        for w in WIDTHS:
            self.weights[f"conv{w}"] = rng.normal(0, 1 / np.sqrt(w * params.embedding), (w, params.embedding, params.filters))
        features = params.filters * len(WIDTHS)
        self.weights |= {"out": rng.normal(0, 0.1, (features, len(labels))), "bias": np.zeros(len(labels)), "shift": np.zeros(features)}

    def fit(self, x: np.ndarray, y: np.ndarray) -> ByteConvNet:
        """Adam on the cross-entropy of windows x (rows of bytes) and label numbers y."""
        p, w = self.params, self.weights
        rng = np.random.default_rng(p.seed + 1)
        m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
        share = np.bincount(y, minlength=len(self.labels))
        weight = (len(y) / np.maximum(share, 1) / max(1, len(self.labels)))[y]
        for epoch in range(p.epochs):
            rate = p.rate * (1 - epoch / p.epochs)
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                grad, step = self._gradient(x[at], y[at], weight[at]), step + 1
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.params.filters
        seen = w["emb"][x]
        rows = np.arange(len(x))
        pooled, places = [], []
        for width in WIDTHS:
            n = x.shape[1] - width + 1
            response = sum(seen[:, j : j + n] @ w[f"conv{width}"][j] for j in range(width))
            best = response.argmax(1)
            places.append(best)
            pooled.append(np.take_along_axis(response, best[:, None], 1)[:, 0])
        z = np.concatenate(pooled, 1) + w["shift"]
        h = np.maximum(z, 0)
        p = softmax(h @ w["out"] + w["bias"])
        p[rows, y] -= 1
        p *= (weight / len(x))[:, None]
        dz = (p @ w["out"].T) * (z > 0)
        grad = {"out": h.T @ p + 1e-4 * w["out"], "bias": p.sum(0), "shift": dz.sum(0), "emb": np.zeros_like(w["emb"])}
        for i, width in enumerate(WIDTHS):
            d, best = dz[:, i * f : (i + 1) * f], places[i]
            g = np.zeros_like(w[f"conv{width}"])
            for j in range(width):
                byte = x[rows[:, None], best + j]
                g[j] = np.einsum("bfe,bf->ef", w["emb"][byte], d)
                np.add.at(grad["emb"], byte.ravel(), (d[:, :, None] * w[f"conv{width}"][j].T[None]).reshape(-1, w["emb"].shape[1]))
            grad[f"conv{width}"] = g
        return grad

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each filter: what a byte pair adds at the first two positions, and at the rest (None: nothing)."""
        w, out = self.weights, []
        for width in WIDTHS:
            single = np.einsum("be,jef->fjb", w["emb"], w[f"conv{width}"]).astype(np.float32)
            for t in single:
                first = (t[0][:, None] + t[1][None, :]).ravel()
                rest = None if width == 2 else t[2] if width == 3 else (t[2][:, None] + t[3][None, :]).ravel()
                out.append((width, first, rest))
        return out

    def windows_probability(self, x: np.ndarray, tables: list | None = None) -> np.ndarray:
        """Probabilities (rows, languages) of windows."""
        n, size = x.shape
        flat = x.ravel()
        pair = np.zeros(n * size, np.uint16)
        pair[:-1] = (flat[:-1].astype(np.uint16) << 8) | flat[1:]
        pooled = np.empty((n, len(WIDTHS) * self.params.filters), np.float32)
        for i, (width, first, rest) in enumerate(tables or self.tables()):
            r = first.take(pair)
            if width == 3:
                r[:-2] += rest.take(flat[2:])
            elif width == 4:
                r[:-2] += rest.take(pair[2:])
            pooled[:, i] = r.reshape(n, size)[:, : size - width + 1].max(1)
        h = np.maximum(pooled + self.weights["shift"], 0)
        return softmax(h @ self.weights["out"] + self.weights["bias"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def training_sample(docs: DataFrame, params: LanguageParams, text: str, label: str, key: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A bounded sample: each language's documents are thinned by a hash of their key to docs_per_language on average."""
    marked = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(label).alias("l"))
    counts = {r["l"]: r["n"] for r in marked.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return np.zeros((0, params.window), np.uint8), np.zeros(0, int), []
    mark = F.pmod(F.xxhash64("k", F.lit(params.seed)), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, params.docs_per_language / n))])
    length = F.length("t")
    places = [F.substring("t", F.lit(1) + (F.pmod(F.xxhash64("k", F.lit(i)), F.greatest(length - params.window, F.lit(1)))).cast("int"), F.lit(params.window)) for i in range(params.windows_per_doc)]
    rows = marked.where(mark < share[F.col("l")]).select("k", "l", F.array_distinct(F.array(*places)).alias("w")).collect()
    labels = sorted(counts)
    number = {v: i for i, v in enumerate(labels)}
    picked = sorted((r["k"] or "", r["l"], w) for r in rows for w in r["w"] if w)
    x = [windows_of(w.encode()[: params.window], params.window)[0] for _, _, w in picked]
    return np.array(x, np.uint8).reshape(-1, params.window), np.array([number[v] for _, v, _ in picked], int), labels


def train(docs: DataFrame, params: LanguageParams = LanguageParams(), text: str = "text", label: str = "lang", key: str = "doc_id") -> ByteConvNet | None:
    """Fit the network on a bounded sample of labelled documents; None if there are none."""
    x, y, labels = training_sample(docs, params, text, label, key)
    return ByteConvNet(labels, params).fit(x, y) if len(x) else None


def predict(docs: DataFrame, net: ByteConvNet | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the likeliest language and its probability.

    Null text and text without a letter: language und, score 0. No trained network: und for all. Ties go to the
    label first in code point order. Repeated rows each get their row; a column of docs that has one of the new
    names is replaced. The whole text is read, in batches of windows, so memory doesn't follow a text's length.
    """
    kept = docs.drop(pred, score)
    if net is None:
        return kept.select("*", F.lit("und").alias(pred), F.lit(0.0).alias(score))
    names = [*kept.columns]
    schema = extended(kept, f"{pred} string, {score} double")
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        forget()
        letter, tables, size = regex.compile(r"\p{L}"), net.tables(), net.params.window
        for batch in batches:
            for lo in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(lo, 256)
                if not part.num_rows:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([], pa.string()), pa.array([], pa.float64())], names=[*names, pred, score])
                    continue
                texts = part.column(at).to_pylist()
                total, seen, size_of = np.zeros((len(texts), len(net.labels))), np.zeros(len(texts), bool), np.zeros(len(texts))
                queue, owner, weight, held = [], [], [], 0
                for i, t in enumerate([*texts, None]):
                    if t is not None and letter.search(t):
                        data, seen[i] = t.encode(), True
                        size_of[i] = len(data)
                        for cut in range(0, len(data), size * 4096):
                            piece = data[cut : cut + size * 4096]
                            w = windows_of(piece, size)
                            queue.append(w)
                            owner.append(np.full(len(w), i))
                            n = np.full(len(w), float(size))
                            n[-1] = len(piece) - size * (len(w) - 1)
                            weight.append(n)
                            held += len(w)
                            if held >= 1024:
                                _flush(net, tables, queue, owner, weight, total)
                                queue, owner, weight, held = [], [], [], 0
                if queue:
                    _flush(net, tables, queue, owner, weight, total)
                total = softmax(total / np.maximum(size_of, 1)[:, None])
                best = total.argmax(1)
                lang = [net.labels[b] if s else "und" for b, s in zip(best, seen, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(np.where(seen, np.clip(total[np.arange(len(best)), best], 0, 1), 0.0))], names=[*names, pred, score])

    return kept.mapInArrow(run, schema)


def _flush(net: ByteConvNet, tables: list, queue: list, owner: list, weight: list, total: np.ndarray) -> None:
    logs = np.log(net.windows_probability(np.concatenate(queue), tables) + 1e-6) * np.concatenate(weight)[:, None]
    np.add.at(total, np.concatenate(owner), logs)
