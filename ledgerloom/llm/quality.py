"""Quality classifier by compression: which of two zstandard dictionaries explains a text better?

One dictionary is trained on good labelled text, one on bad. A text is cut into pieces, each piece is compressed with
either dictionary, and the sizes are added up. Their difference over the text's bytes goes through a logistic curve
fitted on other labelled documents, which turns it into a probability that the label is 1. Nothing else enters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended


@dataclass(frozen=True)
class QualityParams:
    docs_per_class: int = 1200  # bound of the training sample: about so many labelled documents of each class
    piece: int = 2048  # bytes compressed at once, so that the dictionary matters in long texts too
    pieces: int = 8  # of a training text, spread evenly over it, from which dictionaries are trained
    dictionary: int = 100_000  # bytes of each dictionary
    damping: int = 64  # bytes added to the text's in the denominator, so that a few words don't decide much
    level: int = 3
    threshold: float = 0.7  # predicted is 1 from this score on
    seed: int = 11


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    params: QualityParams

    def compressors(self) -> list:
        import zstandard as zs

        dictionaries = [zs.ZstdCompressionDict(raw) for raw in (self.good, self.bad)]
        return [zs.ZstdCompressor(level=self.params.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False) for d in dictionaries]

    def difference(self, data: bytes, compressors: list) -> float:
        """How much smaller the good dictionary makes the text than the bad one, over its bytes."""
        good, bad = (sum(len(c.compress(p)) for p in pieces(data, self.params.piece)) for c in compressors)
        return (bad - good) / (len(data) + self.params.damping)

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.intercept, -30, 30)))


def pieces(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def training_sample(docs: DataFrame, labels: DataFrame, params: QualityParams, text: str, key: str, label: str) -> list[tuple[str, int]]:
    """About docs_per_class labelled texts of each class, thinned by a hash of the key, in the order of the keys."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("q"))
    counts = {r["q"]: r["n"] for r in marked.groupBy("q").agg(F.count("*").alias("n")).collect()}
    mark = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(params.seed)), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    picked = marked.where(mark < F.when(F.col("q") == 1, params.docs_per_class / max(1, counts.get(1, 0))).otherwise(params.docs_per_class / max(1, counts.get(0, 0))))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k").collect()
    return [(t, q) for _, t, q in sorted((str(r["k"]), r["t"], r["q"]) for r in rows)]


def train(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), text: str = "text", key: str = "doc_id", label: str = "quality") -> CompressionModel | None:
    """Dictionaries from one half of the sample, the logistic curve from the other; None without labels of both classes."""
    return fit(training_sample(docs, labels, params, text, key, label), params)


def fit(sample: list[tuple[str, int]], params: QualityParams) -> CompressionModel | None:
    by = {q: [t.encode() for t, c in sample if c == q] for q in (0, 1)}
    if min(map(len, by.values())) < 2:
        return None
    halves = {q: (v[::2], v[1::2]) for q, v in by.items()}
    good, bad = (_dictionary(halves[q][0], params) for q in (1, 0))
    model = CompressionModel(good, bad, 0.0, 0.0, params)
    tools = model.compressors()
    x = np.array([model.difference(t, tools) for q in (0, 1) for t in halves[q][1]])
    y = np.array([q for q in (0, 1) for _ in halves[q][1]], float)
    centre, scale = x.mean(), x.std() + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(2)
    for _ in range(40):  # Newton steps of a ridge logistic regression, both classes with equal weight
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        s = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * s[:, None]).T @ z + 0.5 * np.eye(2), z.T @ (weight * (y - p)) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.slope = float(w[0] / scale)
    model.intercept = float(w[1] - w[0] * centre / scale)
    return model


def _dictionary(texts: list[bytes], params: QualityParams) -> bytes:
    """Trained on pieces of the texts; of what little text there is itself, if that is too little to train on."""
    import zstandard as zs

    samples = []
    for t in texts:
        own = pieces(t, params.piece)
        samples += [own[i * len(own) // params.pieces] for i in range(params.pieces)] if len(own) > params.pieces else own
    try:
        return zs.train_dictionary(min(params.dictionary, sum(map(len, samples)) // 4), samples).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-params.dictionary :]


def score(docs: DataFrame, model: CompressionModel | None, text: str = "text", out: str = "score", predicted: str = "predicted", threshold: float = 0.7) -> DataFrame:
    """docs with the probability that the quality label is 1, and whether it reaches the threshold.

    Null and empty texts get the curve's value at no bytes. Without a model every score is 0.5. Equal texts get equal
    scores. Columns of docs with the new names are replaced. Very long texts are compressed piece by piece. No rows give
    no rows.
    """
    kept = docs.drop(out, predicted)
    if model is None:
        return kept.withColumns({out: F.lit(0.5), predicted: F.lit(int(threshold <= 0.5))})
    schema = extended(kept, f"{out} double")
    names, at = [*kept.columns, out], kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.compressors()
        for batch in batches:
            p = model.probability(np.array([model.difference((t or "").encode(), tools) for t in batch.column(at).to_pylist()], float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=names)

    return kept.mapInArrow(run, schema).withColumn(predicted, (F.col(out) >= threshold).cast("int"))
