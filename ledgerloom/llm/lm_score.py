"""Language-model scores: a log-bilinear model trained in numpy with noise-contrastive estimation.

Every distinct token of the training documents is counted (a Spark aggregation that grows with the corpus). The
model's outputs are the most frequent tokens, the end of a text, and classes for all other tokens: one for each of
the most frequent last two bytes and one for the rest. There are more of both the more distinct tokens there are: they
grow with the square root of the vocabulary. The embeddings of the previous tokens' outputs, each through
its position's matrix, add up to a predicted vector; its products with the output vectors plus biases, normalised by
a softmax over all outputs, are probabilities. A token of a class has the class's probability times its smoothed
share of the class, so probabilities of all tokens, with one unseen token per class, add up to one.

Outputs are normalised in two levels, which keeps the work a token near the square root of their number: groups of
outputs have vectors of their own, a softmax over groups gives a group's probability and one within the group the
output's share of it. Both kinds of vectors are trained against noise, where no normalisation is needed.

The neural weights are fitted on all training texts, whole. They are written as output numbers once; in each round
every task fits the weights that all share on its own texts, and the tasks' weights, averaged by their tokens, are those
of the next round. A large corpus is read once, a quarter of the texts in each of four rounds; a small one is read
again in each round. Scoring takes texts whole, too: tokens with a common count are looked up in a broadcast table of
bounded size, the others are joined to the counts by a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once_per_worker, written

END = b""  # no word is empty, so the end of a text can be


@dataclass(frozen=True)
class LmParams:
    words: int = 255  # outputs that are single words, at least
    classes: int = 127  # outputs that are classes by the last two bytes, at least; one more holds the rest
    dim: int = 32
    context: int = 4  # previous tokens
    common: int = 300_000  # bound of the broadcast table of counts
    task_tokens: int = 1_000_000  # tokens of a training task, at least
    buffer: int = 65_536  # tokens shuffled together within a task, about
    noise: int = 96  # noise tokens, shared by a batch
    group_noise: int = 24  # noise groups, shared by a batch
    batch: int = 2048
    rounds: int = 4  # after each of which the tasks' weights are averaged
    read_tokens: int = 8_000_000  # training reads so many tokens at least, by reading small corpora up to once in each round
    rate: float = 0.01
    seed: int = 13

    def outputs(self, distinct: int) -> tuple[int, int]:
        """Words and classes for so many distinct tokens."""
        return max(self.words, isqrt(distinct) // 2), max(self.classes, isqrt(distinct) // 4)


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of many texts: how many tokens each has, and all tokens end to end, each text's end (END) behind its words."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # split after its last space, a text has an empty part behind its words; a text without words is one empty part
    parts = pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), "", pc.binary_join_element_wise(trimmed, "", " ")))
    return pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64), parts.flatten().cast(pa.binary())


def distinct_tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of many texts: how many tokens each has, the place of each token among the distinct ones, and these."""
    lengths, all_tokens = tokens_of(texts)
    coded = all_tokens.dictionary_encode()
    return lengths, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c): every distinct token of docs with its count, the end of each text among them."""
    most = 1_000_000  # distinct tokens that a task holds, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, limit = 0, most
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                found = pc.value_counts(tokens_of(batch.column(0).slice(lo, 1024))[1])
                held.append(pa.table({"word": found.field("values"), "c": found.field("counts")}))
                rows += len(found)
                if rows > limit:
                    held = [added(held)]
                    rows = len(held[0])
                    limit = rows + most
                    if rows > most:
                        yield from held[0].to_batches()
                        held, rows, limit = [], 0, most
        if held:
            yield from added(held).to_batches()

    def added(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns({"c_sum": "c"}).select(["word", "c"])

    return docs.select(text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _last(word: Column) -> Column:
    return F.substring(word, -2, 2)


@dataclass
class Vocabulary:
    """What scoring looks up: common words with counts, outputs, class sizes. Bounded by the parameters."""

    total: int  # N
    distinct: int  # V
    common: list[tuple[bytes, int]]
    words: list[bytes]  # outputs 0 .. len(words) - 1; the first is END
    suffixes: list[bytes]  # outputs after the words; one more output holds the rest
    class_tokens: list[int]  # of the suffix classes and the rest
    class_distinct: list[int]

    @property
    def outputs(self) -> int:
        return len(self.words) + len(self.suffixes) + 1

    def share(self) -> np.ndarray:
        """How often each output occurs in training, smoothed."""
        counts = dict(self.common)
        n = np.array([counts.get(w, 0) for w in self.words] + self.class_tokens, float) + 0.5
        return n / n.sum()

    def inner(self, c: np.ndarray | int, k: np.ndarray | int) -> np.ndarray:
        """log10 of the share that a token counted c times has of class k (0: the first suffix)."""
        return np.log10((c + 0.5) / (np.array(self.class_tokens)[k] + 0.5 * (np.array(self.class_distinct)[k] + 1)))


def vocabulary(counts: DataFrame, params: LmParams) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, room = None, params.common
    for s, n in sizes:
        if n > room:
            break
        least, room = s, room - n
    got = [] if least is None else counts.where(step >= least).collect()
    common = sorted(((bytes(r["word"]), r["c"]) for r in got), key=lambda x: (-x[1], x[0]))
    n_words, n_classes = params.outputs(total["v"])
    words = [END] + [w for w, _ in common if w != END][:n_words]
    chosen = counts.sparkSession.createDataFrame([(w,) for w in words], "word binary")
    by_last = counts.join(F.broadcast(chosen), "word", "left_anti").groupBy(_last(F.col("word")).alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    top = by_last.orderBy(F.desc("n"), "s").limit(n_classes).collect()
    in_words = dict(common)
    rest_n = total["n"] - sum(in_words.get(w, 0) for w in words) - sum(r["n"] for r in top)
    rest_v = total["v"] - sum(w in in_words for w in words) - sum(r["v"] for r in top)
    return Vocabulary(total["n"], total["v"], common, words, [bytes(r["s"]) for r in top], [r["n"] for r in top] + [rest_n], [r["v"] for r in top] + [max(0, rest_v)])


class LogBilinear:
    """Input vectors (one more for the time before a text), a matrix per context position, vectors and biases of outputs and of their groups."""

    def __init__(self, outputs: int, share: np.ndarray, params: LmParams):
        rng = np.random.default_rng(params.seed)
        d = params.dim
        self.params, self.share = params, share
        self.width = isqrt(max(0, outputs - 1)) + 1  # outputs in a group
        groups = -(-outputs // self.width)
        self.group_share = np.add.reduceat(share, np.arange(groups) * self.width)
        self.w = {
            "inp": rng.normal(0, 0.1, (outputs + 1, d)).astype(np.float32),
            "mat": (np.stack([np.eye(d)] * params.context) / params.context + rng.normal(0, 0.02, (params.context, d, d))).astype(np.float32),
            "out": rng.normal(0, 0.1, (outputs, d)).astype(np.float32),
            "bias": np.log(share).astype(np.float32),
            "group": rng.normal(0, 0.1, (groups, d)).astype(np.float32),
            "group_bias": np.log(self.group_share).astype(np.float32),
        }

    def contexts(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each token of texts laid end to end, the outputs of the tokens before it; starts: each token's text's first place."""
        before = np.arange(len(ids)) - starts
        out = np.full((self.params.context, len(ids)), len(self.w["inp"]) - 1, ids.dtype)
        for j in range(1, self.params.context + 1):
            np.copyto(out[j - 1, j:], ids[:-j], where=before[j:] >= j)
        return out

    def fit(self, texts: Iterator[np.ndarray], turn: int, seed: int) -> int:
        """One pass over texts (outputs of their tokens); how many tokens they have.

        Noise-contrastive estimation: tell each token from noise tokens drawn by their share, and its group from noise
        groups. Adam on mini-batches of tokens shuffled within a buffer of whole texts.
        """
        p = self.params
        rng = np.random.default_rng([p.seed + 1, turn, seed])
        heads = [_Head("out", "bias", self.share, p.noise), _Head("group", "group_bias", self.group_share, p.group_noise)]
        flat = self.packed()
        self.w, grad = self._views(flat), np.zeros_like(flat)
        found, adam, seen = self._views(grad), _Adam(flat), 0
        rate = p.rate * (1 - turn / p.rounds) + 1e-4
        for parts in _buffers(texts, p.buffer):
            lengths = np.array([len(x) for x in parts])
            ids = np.concatenate(parts)
            ctx = np.ascontiguousarray(self.contexts(ids, np.repeat(np.cumsum(lengths) - lengths, lengths)).T)
            seen += len(ids)
            for at in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // p.batch)):
                at = at[_order(ids.take(at), len(self.share))]
                self._gradient(ids.take(at), ctx.take(at, 0), heads, rng, found)
                adam.move(grad, rate)
        return seen

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of packed weights by name."""
        found, at = {}, 0
        for k, a in self.w.items():
            found[k] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
        return found

    def packed(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.w.values()])

    def unpack(self, flat: np.ndarray) -> None:
        self.w = self._views(flat.astype(np.float32))

    def _gradient(self, y: np.ndarray, ctx: np.ndarray, heads: list[_Head], rng: np.random.Generator, grad: dict[str, np.ndarray]) -> None:
        """Of all weights, into grad. y ascends; ctx has a row for each of it."""
        inp, mat = self.w["inp"], self.w["mat"].reshape(-1, self.params.dim)
        before = inp.take(ctx.ravel(), 0).reshape(len(y), -1)
        q = before @ mat
        dq = heads[0].gradient(q, y, self.w, rng, grad)
        dq += heads[1].gradient(q, y // self.width, self.w, rng, grad)
        np.matmul(before.T, dq, out=grad["mat"].reshape(mat.shape))
        at, back = ctx.ravel(), dq @ mat.T
        order = _order(at, len(inp))
        _sums(at.take(order), back.reshape(len(at), -1).take(order, 0), grad["inp"])

    def scorer(self):
        """(contexts, tokens) -> log10 probabilities, normalised over all outputs: within the group, times the group's."""
        tables = self.w["inp"] @ self.w["mat"]
        groups, group_bias = np.ascontiguousarray(self.w["group"].T), self.w["group_bias"]
        width, block = self.width, 16_384
        inner = [(np.ascontiguousarray(self.w["out"][lo : lo + width].T), self.w["bias"][lo : lo + width]) for lo in range(0, len(self.w["out"]), width)]

        def log_share(q: np.ndarray, vectors: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
            z = q @ vectors
            z += bias
            np.minimum(z, 80, out=z)
            true = z.ravel().take(np.arange(0, z.size, z.shape[1]) + at)
            np.exp(z, out=z)
            return true - np.log(z @ np.ones(z.shape[1], z.dtype))

        def score(ctx: np.ndarray, y: np.ndarray) -> np.ndarray:
            result = np.empty(len(y))
            for lo in range(0, len(y), block):
                own = y[lo : lo + block]
                of = own // width
                order = _order(of, len(inner))
                own, of = own[order], of[order]
                q = tables[0].take(ctx[0, lo : lo + block].take(order), 0)
                for t, c in zip(tables[1:], ctx[1:], strict=True):
                    q += t.take(c[lo : lo + block].take(order), 0)
                logs = log_share(q, groups, group_bias, of)
                first = np.nonzero(np.r_[True, of[1:] != of[:-1]])[0]
                for a, b in zip(first, [*first[1:], len(of)], strict=True):
                    logs[a:b] += log_share(q[a:b], *inner[of[a]], own[a:b] - of[a] * width)
                result[lo + order] = logs
            return result / np.log(10)

        return score


class _Head:
    """Vectors and biases that tell true places from noise drawn by their share."""

    def __init__(self, vectors: str, bias: str, share: np.ndarray, noise: int):
        self.vectors, self.bias, self.noise = vectors, bias, noise
        self.log_noise = (np.log(share) + np.log(noise)).astype(np.float32)
        self.upto = np.cumsum(share)

    def gradient(self, q: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray], rng: np.random.Generator, grad: dict[str, np.ndarray]) -> np.ndarray:
        """Of q; that of the head's own weights goes into grad by name. y ascends."""
        out, bias, n = w[self.vectors], w[self.bias], len(y)
        drawn = np.minimum(np.searchsorted(self.upto, rng.random(self.noise) * self.upto[-1], "right"), len(bias) - 1)
        noise, times = np.unique(drawn, return_counts=True)  # what is drawn again counts as often, and is looked at once
        shifted = bias - self.log_noise
        true, others = out.take(y, 0), out.take(noise, 0)
        of_true = np.einsum("ij,ij->i", q, true) + shifted.take(y)
        of_noise = q @ -others.T
        of_noise -= shifted.take(noise)
        d_true = (-1 / (1 + np.exp(np.clip(of_true, -30, 30)))).astype(np.float32) / np.float32(n)
        with np.errstate(over="ignore"):  # beyond the range of floats the quotient is 0, as it should be
            np.exp(of_noise, out=of_noise)
        of_noise += np.float32(1)
        d_noise = np.divide((times / n).astype(np.float32), of_noise, out=of_noise)
        _sums(y, d_true[:, None] * q, grad[self.vectors])
        grad[self.vectors][noise] += d_noise.T @ q
        grad[self.bias][:] = np.bincount(y, d_true, len(bias))
        grad[self.bias][noise] += np.ones(n, np.float32) @ d_noise
        true *= d_true[:, None]
        true += d_noise @ others
        return true


class _Adam:
    """Moves weights against gradients by Adam; the moments are kept without their constant factors 0.1 and 0.001."""

    def __init__(self, weights: np.ndarray, block: int = 16_384):
        self.parts = [(slice(lo, lo + block), weights[lo : lo + block], np.zeros_like(weights[lo : lo + block]), np.zeros_like(weights[lo : lo + block])) for lo in range(0, len(weights), block)]
        self.step = 0

    def move(self, grad: np.ndarray, rate: float) -> None:
        """Part by part, so that a part stays in the processor's cache. What is in grad is lost."""
        self.step += 1
        least = np.float32(1e-8 / 0.001**0.5)
        far = np.float32(rate * 0.1 / 0.001**0.5 * (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step))
        for at, w, m, v in self.parts:
            g = grad[at]
            m *= np.float32(0.9)
            m += g
            v *= np.float32(0.999)
            v += np.multiply(g, g, out=g)
            move = np.sqrt(v, out=g)
            move += least
            np.divide(m, move, out=move)
            move *= far
            w -= move


def _order(index: np.ndarray, n: int) -> np.ndarray:
    """What sorts numbers below n."""
    return np.argsort(index.astype(np.int16) if n < 1 << 15 else index, kind="stable")  # 16 bits are sorted by digits


def _sums(index: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Rows added up by index, which ascends, into out; 0 where it has none."""
    first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    pairs = np.complex64 if rows.shape[1] % 2 == 0 else rows.dtype  # two floats at a time: half the calls
    out[:] = 0
    out[index[first]] = np.add.reduceat(np.ascontiguousarray(rows).view(pairs), first, axis=0).view(rows.dtype)


def _buffers(texts: Iterator[np.ndarray], size: int) -> Iterator[list[np.ndarray]]:
    """Whole texts, together of about so many tokens."""
    parts, held = [], 0
    for x in texts:
        parts.append(x)
        held += len(x)
        if held >= size:
            yield parts
            parts, held = [], 0
    if parts:
        yield parts


class Encoder:
    """Tokens to outputs and to what is known of their counts."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, v = vocab, vocab
        self.place = {w: i for i, (w, _) in enumerate(v.common)}
        self.last = {s: len(v.words) + i for i, s in enumerate(v.suffixes)} | {END: 0}
        single = {w: i for i, w in enumerate(v.words)}
        rest = len(v.words) + len(v.suffixes)
        c = np.array([n for _, n in v.common], float)
        self.output = np.array([single.get(w, self.last.get(w[-2:], rest)) for w, _ in v.common], np.int32)
        self.base = np.log10((c + 0.5) / (v.total + 0.5 * (v.distinct + 1)))
        inside = np.maximum(self.output - len(v.words), 0)
        self.inner = np.where(self.output < len(v.words), 0.0, v.inner(c, inside)) if len(c) else np.zeros(0)
        self.rest = rest

    def outputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the common table (-1: not there), and outputs."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        out = self.output[at] if len(self.output) else np.zeros(len(at), np.int32)
        missing = np.nonzero(at < 0)[0]
        if len(missing):
            out[missing] = [self.of_rare(words[i]) for i in missing.tolist()]
        return at, out

    def of_rare(self, word: bytes) -> int:
        """Output of a word that isn't among the common ones: its class, as all single words are common. The end has its own."""
        return self.last.get(word[-2:], self.rest)


def _encoded(docs: DataFrame, vocab: Vocabulary, text: str, turns: int) -> DataFrame:
    """(turn, ids): the outputs of every text's tokens and its end, as 32-bit numbers; each task deals its texts out to the turns."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    token = uuid.uuid4().hex  # of this call: workers keep what it makes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, dealt = None, 0
        for batch in batches:
            encoder = encoder or once_per_worker(token, lambda: Encoder(shared.value))
            for lo in range(0, batch.num_rows, 256):
                lengths, places, words = distinct_tokens_of(batch.column(0).slice(lo, 256))
                ids = encoder.outputs(words)[1].astype("<i4").take(places)
                ends = np.concatenate([[0], np.cumsum(4 * lengths)]).astype(np.int32)
                turn = np.arange(dealt, dealt + len(lengths), dtype=np.int32) % turns
                dealt += len(lengths)
                rows = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(turn), rows], names=["turn", "ids"])

    return docs.select(text).mapInArrow(run, "turn int, ids binary")


def _round(ids: DataFrame, model: LogBilinear, turn: int, tasks: int) -> np.ndarray | None:
    """Weights after each task's pass over its texts from the model's weights on, averaged by tokens; null without texts.

    Tasks add up groups of tasks, then groups of groups, until a handful of sums is left for the driver.
    """
    shared = ids.sparkSession.sparkContext.broadcast(model)
    groups = max(1, isqrt(tasks))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        given = shared.value
        own = LogBilinear.__new__(LogBilinear)
        own.__dict__.update(given.__dict__ | {"w": {k: a.copy() for k, a in given.w.items()}})
        part = TaskContext.get().partitionId()
        n = own.fit((np.frombuffer(x.as_buffer(), "<i4") for b in batches for x in b.column(0)), turn, part)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part % groups], pa.int32()), pa.array([n], pa.int64()), pa.array([own.packed().tobytes()], pa.binary())], names=["g", "n", "w"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, total = 0, 0.0
        for batch in batches:
            for k, w in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, total = n + k, total + k * np.frombuffer(w.as_buffer(), np.float32).astype(float)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["g", "n", "w"])

    kind = "g int, n long, w binary"
    level = ids.coalesce(tasks).mapInArrow(fit, kind).repartition(groups, "g").mapInArrow(add, kind)
    while groups > 16:
        groups = -(-groups // 16)
        level = level.repartition(groups, F.col("g") % groups).mapInArrow(add, kind)
    sums = level.select("n", "w").collect()
    shared.unpersist()
    if not sums:
        return None
    return sum(r["n"] * np.frombuffer(r["w"], np.float32).astype(float) for r in sums) / sum(r["n"] for r in sums)


def train(docs: DataFrame, vocab: Vocabulary, params: LmParams = LmParams(), text: str = "text", key: str = "doc_id") -> LogBilinear:
    """Fit on all of docs: an average of the tasks' weights after each round."""
    ids = written(_encoded(docs, vocab, text, params.rounds), "lm-ids")
    model = LogBilinear(vocab.outputs, vocab.share(), params)
    again = min(params.rounds, max(1, -(-params.read_tokens // max(1, vocab.total))))  # rounds in which a text is read
    tasks = max(1, vocab.total * again // params.rounds // params.task_tokens)
    for turn in range(params.rounds):
        now = ids.where(F.pmod(F.col("turn") + turn, F.lit(params.rounds)) < again).select("ids")
        weights = _round(now, model, turn, tasks)
        if weights is not None:
            model.unpack(weights)
    return model


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: LogBilinear, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, n_known, train_tokens, base_score and score (log10, summed over tokens).

    Null text counts as empty, which still has its end. Repeated rows are scored each. Columns of docs with the new
    names are replaced.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = docs.select(F.col(text).alias("_text"), F.struct(*[c for c in docs.columns if c != text and c not in new]).alias("_row"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocab, model))
    fields = "part_tokens long, part_known long, part_base double, part_score double, rare array<struct<w:binary,k:int,tf:int>>"
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    token = uuid.uuid4().hex  # of this call: workers keep what it makes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        encoder, scorer = once_per_worker(token, lambda: (Encoder(vocab), model.scorer()))
        first_class = len(vocab.words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lengths, places, words = distinct_tokens_of(part.column(0))
                at, out = encoder.outputs(words)
                known, ids, begin = (at >= 0).take(places), out.take(places), np.cumsum(lengths) - lengths
                base, inner = (np.where(at >= 0, x.take(at, mode="clip") if len(x) else 0.0, 0.0).take(places) for x in (encoder.base, encoder.inner))
                total = np.add.reduceat(scorer(model.contexts(ids, np.repeat(begin, lengths)), ids) + inner, begin)
                # words of a text that are not among the common ones: the word, its class, how often the text has it
                texts = np.repeat(np.arange(len(lengths)), lengths)
                rare, tf = np.unique(texts[~known] * len(words) + places[~known], return_counts=True)
                which = rare % len(words)
                ends = np.searchsorted(rare // len(words), np.arange(len(lengths) + 1)).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array([words[i] for i in which.tolist()], pa.binary()), pa.array((out[which] - first_class).astype(np.int32)), pa.array(tf.astype(np.int32))], names=["w", "k", "tf"])
                sums = [lengths, np.add.reduceat(known.astype(np.int64), begin), np.add.reduceat(base, begin), total]
                columns = [*(pa.array(c, t) for c, t in zip(sums, types, strict=True)), pa.ListArray.from_arrays(pa.array(ends), structs)]
                yield pa.RecordBatch.from_arrays([part.column(1), *columns], names=["_row", *(f.split()[0] for f in fields.split(", "))])

    row_type = kept.schema["_row"].dataType.simpleString()
    scored = kept.mapInArrow(run, f"_row {row_type}, {fields}").withColumn("_rid", F.monotonically_increasing_id())
    scored = written(scored, "lm-scored")
    rare = scored.select("_rid", F.explode("rare").alias("r")).select("_rid", F.col("r.w").alias("word"), F.col("r.k").alias("k"), F.col("r.tf").alias("tf"))
    joined = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sizes = spark.createDataFrame([(k, n + 0.5 * (v + 1)) for k, (n, v) in enumerate(zip(vocab.class_tokens, vocab.class_distinct, strict=True))], "k int, size double")
    joined = joined.join(F.broadcast(sizes), "k", "left")
    base = F.log10((F.col("c") + 0.5) / F.lit(vocab.total + 0.5 * (vocab.distinct + 1)))
    inner = F.when(F.col("k") >= 0, F.log10((F.col("c") + 0.5) / F.col("size"))).otherwise(0.0)
    sums = joined.groupBy("_rid").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("_known"), F.sum(F.col("tf") * base).alias("_base"), F.sum(F.col("tf") * inner).alias("_inner"))
    out = scored.drop("rare").join(sums, "_rid", "left")
    some = lambda c, z: F.coalesce(c, F.lit(z))
    return out.select(
        "_row.*",
        F.col("part_tokens").alias("n_tokens"),
        (F.col("part_known") + some("_known", 0)).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("part_base") + some("_base", 0.0)).alias("base_score"),
        (F.col("part_score") + some("_inner", 0.0)).alias("score"),
    )


def learn_and_score(docs: DataFrame, training: Column, params: LmParams = LmParams(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Learn from the rows of docs where `training` holds, score all of them."""
    lean = docs.where(training).select(key, text)
    counts = written(count_tokens(lean, text), "lm-counts")
    vocab = vocabulary(counts, params)
    return score(docs, counts, vocab, train(lean, vocab, params, text, key), text)
