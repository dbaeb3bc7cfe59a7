"""Quality of documents by a linear-chain conditional random field over their lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import apart, slices, table, utf8

#: Labelled documents for training at most, and lines that each may have for it.
SAMPLE, LINES = 6000, 500
#: Of each feature: bounded by quantiles of lines in good documents and in bad ones.
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
BINS = 2 * len(QUANTILES) + 1
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
PLAIN = b" \t\r\x0b\x0c.,;:'\"()-?"
HIGH = bytes(range(128, 256))
FEATURES = 13


def line_features(text: bytes) -> np.ndarray:
    """One row a line: sizes, shares of kinds of bytes, words that occur again, repetition of the line, words like the one before."""
    lines, seen, out = text.split(b"\n"), set(), []
    for line in lines:
        n, words = len(line), line.split()
        m = len(words) or 1
        rest = line.translate(None, LOWER)
        upper = len(rest) - len(rest := rest.translate(None, UPPER))
        digits = len(rest) - len(rest := rest.translate(None, DIGITS))
        high = len(rest) - len(rest := rest.translate(None, HIGH))
        symbols = len(rest.translate(None, PLAIN))
        d = n or 1
        out.append((n, len(words), upper / d, digits / d, high / d, symbols / d, line.count(b"!") / m, line.count(b"|") / m, len(set(words)) / m, n / m, line[-1:] in b".!?" if n else False, line in seen, sum(map(eq, words, words[1:])) / m))
        seen.add(line)
    return np.array(out, np.float64)


@dataclass
class Model:
    edges: list[np.ndarray]  # bin edges of each feature
    own: np.ndarray  # FEATURES x BINS, for the line itself; before and after: for its neighbours
    before: np.ndarray
    after: np.ndarray
    start: np.ndarray  # 2
    step: np.ndarray  # 2 x 2, from x to
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def emissions(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of good by a line's own and its neighbours' features. first: whether a line begins a document."""
        k = np.arange(FEATURES)
        s = self.own[k, bins].sum(1) + self.bias
        s[1:] += np.where(first[1:], 0, self.before[k, bins[:-1]].sum(1))
        s[:-1] += np.where(first[1:], 0, self.after[k, bins[1:]].sum(1))
        return s


def _log_sum(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(x[..., 0], x[..., 1])


def marginals(emissions: np.ndarray, starts: np.ndarray, counts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many documents at once: P(good) of each line, and expected transitions (2 x 2, summed) with the expected first states."""
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    longest = int(counts[0])
    live = np.searchsorted(-counts, -np.arange(1, longest + 1), "right")  # documents with a line t
    score = np.zeros((len(emissions), 2))
    score[:, 1] = emissions
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[starts] = model.start + score[starts]
    for t in range(1, longest):
        at = starts[: live[t]] + t
        alpha[at] = _log_sum(np.swapaxes(alpha[at - 1][:, :, None] + model.step, 1, 2)) + score[at]
    for t in range(longest - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        beta[at] = _log_sum(model.step + (score[at + 1] + beta[at + 1])[:, None, :])
    z = np.empty(len(emissions))
    z[np.concatenate([np.arange(s, s + c) for s, c in zip(starts, counts, strict=True)])] = np.repeat(_log_sum(alpha[starts + counts - 1]), counts)
    good = np.exp(alpha[:, 1] + beta[:, 1] - z)
    follows = np.ones(len(emissions), bool)
    follows[starts] = False
    at = np.flatnonzero(follows)
    pair = np.exp(alpha[at - 1][:, :, None] + model.step + (score[at] + beta[at])[:, None, :] - z[at, None, None]).sum(0)
    return good, np.concatenate([pair.reshape(-1), (1 - good[starts]).sum(keepdims=True), good[starts].sum(keepdims=True)])


def aggregate(good: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Share of good by length, each line weighing its bytes and one more."""
    return np.add.reduceat(good * (sizes + 1), starts) / np.add.reduceat(sizes + 1, starts)


def fit(x: np.ndarray, counts: np.ndarray, label: np.ndarray, rounds: int = 4, steps: int = 120) -> Model:
    """Trains on documents' labels: all lines begin with their document's; then lines of bad documents that the model takes for good become so, as long as half of the document's length stays bad."""
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.zeros(len(x), bool)
    first[starts] = True
    edges = [np.unique([np.quantile(x[label[doc] == c, k], QUANTILES) for c in (0, 1)]) for k in range(FEATURES)]
    model = Model(edges, *(np.zeros((FEATURES, BINS)) for _ in range(3)), np.zeros(2), np.zeros((2, 2)), 0.0)
    bins = model.bins(x)
    k = np.arange(FEATURES)
    flat = bins + k * BINS
    y = label[doc].astype(np.float64)
    weight = 1 / max(1, len(x))
    shapes = [FEATURES * BINS] * 3 + [2, 4, 1]
    cuts = np.cumsum(shapes)[:-1]
    theta = np.zeros(sum(shapes))
    inner = ~first

    def unpack(theta: np.ndarray) -> None:
        own, before, after, start, step, bias = np.split(theta, cuts)
        model.own, model.before, model.after = (v.reshape(FEATURES, BINS) for v in (own, before, after))
        model.start, model.step, model.bias = start, step.reshape(2, 2), float(bias[0])

    def sums(g: np.ndarray) -> list[np.ndarray]:
        table = lambda of, g: np.bincount(flat[of].reshape(-1), np.repeat(g, FEATURES), FEATURES * BINS)
        at = np.flatnonzero(inner)
        return [table(np.arange(len(g)), g), table(at - 1, g[at]), table(at, g[at - 1])]

    for _ in range(rounds):
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        at = np.flatnonzero(inner)
        seen = np.bincount((y[at - 1] * 2 + y[at]).astype(int), minlength=4).astype(float)
        seen_first = np.array([(1 - y[starts]).sum(), y[starts].sum()])
        for i in range(1, steps + 1):
            unpack(theta)
            good, pairs = marginals(model.emissions(bins, first), starts, counts, model)
            g = y - good
            grad = np.concatenate([*sums(g), seen_first - pairs[4:], seen - pairs[:4], [g.sum()]]) * weight - 1e-3 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
        unpack(theta)
        good, _ = marginals(model.emissions(bins, first), starts, counts, model)
        y = np.where(label[doc] == 1, 1.0, (good > 0.5).astype(float))
        bad = (label == 0) & (np.add.reduceat((1 - y) * (x[:, 0] + 1), starts) * 2 < np.add.reduceat(x[:, 0] + 1, starts))
        y = np.where(bad[doc], 0.0, y)
    g = aggregate(good, x[:, 0], starts)
    a = np.array([1.0, 0.0])
    design = np.stack([_logit(g), np.ones_like(g)], 1)
    for _ in range(50):  # Newton steps of a logistic regression on the documents' labels
        p = _sigmoid(design @ a)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        a = a + np.linalg.solve(hessian, design.T @ (label - p) - 1e-2 * (a - [1.0, 0.0]))
    model.slope, model.shift = float(a[0]), float(a[1])
    return model


def _logit(g: np.ndarray) -> np.ndarray:
    g = np.clip(g, 1e-3, 1 - 1e-3)
    return np.log(g / (1 - g))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the `sample` labelled documents of least hash of doc_id at most, leaving out those with crc32(doc_id) mod 3 of 1.

    labels: doc_id, quality. Null ids, qualities and texts take no part, nor do texts of over LINES lines; of a doc_id with several texts the one of
    least hash does. Only the sample's line features reach the driver, SAMPLE x LINES lines at most.
    With one class or none, all documents get the score of that class, or 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).na.drop()
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(known), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).filter(F.regexp_count("text", F.lit("\n")) < LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            x = [line_features(t).astype(np.float32).tobytes() for t in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["doc_id", "quality", "x"])

    got = texts.mapInArrow(run, "doc_id long, quality int, x binary").toPandas().sort_values(["doc_id", "quality", "x"])
    label = got["quality"].values.astype(int)
    if len(set(label.tolist())) < 2:
        flat = Model([np.zeros(0)] * FEATURES, *(np.zeros((FEATURES, BINS)) for _ in range(3)), np.zeros(2), np.zeros((2, 2)), 0.0)
        flat.shift = 0.0 if not len(label) else 5.0 if label[0] else -5.0
        return flat
    rows = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in got["x"]]
    return fit(np.concatenate(rows).astype(np.float64), np.array([len(r) for r in rows]), label)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and quality_score, 0 to 1, in place of one of this name. A null text counts as empty, which is one empty line. Any length of text is scored whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, whole.num_columns - 1)):
            rows = [line_features(t).astype(np.float32).astype(np.float64) for t in utf8(batch.column(batch.num_columns - 1))]
            x, counts = np.concatenate(rows), np.array([len(r) for r in rows])
            starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
            first = np.zeros(len(x), bool)
            first[starts] = True
            good, _ = marginals(model.emissions(model.bins(x), first), starts, counts, model)
            score = _sigmoid(model.slope * _logit(aggregate(good, x[:, 0], starts)) + model.shift)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], "quality_score"])

    others = [c for c in docs.columns if c != "quality_score"]
    plain = docs.select(*[docs[f"`{c}`"] for c in others], docs["text"].alias(f"{apart(docs)}scored"))
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields[:-1], T.StructField("quality_score", T.DoubleType())]))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select(F.col("doc_id").cast("long"), "text").select("doc_id", "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
