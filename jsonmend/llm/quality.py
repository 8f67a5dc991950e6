"""Operator 7, quality by a linear-chain conditional random field over lines.

Each line gets dense features of its characters and words, and those of its
neighbours.  A two-state CRF (good, bad) is trained by maximum likelihood on a
bounded sample of labelled documents, every line carrying its document's label.
A document's raw quality is the length-weighted mean of its lines'
forward-backward marginals of being good; a logistic calibration on the same
sample turns it into the score.

Training reads every line of at most about ``PER_CLASS`` documents a label; the
lines' features lie in a file of the driver and are read in blocks.  Scoring
reads every line of every document.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonmend.llm.common import fold_bucket, fresh, read_table, release, small_batches, text_slices

#: Labelled documents of a class that training reads.
PER_CLASS = 1200
#: Lines whose features training holds in memory at once.
BLOCK = 65_536
#: Cells of a padded batch in the forward-backward pass.
_CELLS = 400_000

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _LOUD, _SIGN, _BAR, _WIDE = range(9)


def _classes() -> np.ndarray:
    """Byte classes; UTF-8 bytes above ASCII count as lower-case letters (lead bytes) or not at all."""
    out = np.full(256, _SIGN, dtype=np.int64)
    out[ord("A") : ord("Z") + 1] = _UPPER
    out[ord("a") : ord("z") + 1] = _LOWER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[[9, 11, 12, 13, 32]] = _SPACE
    out[[ord(c) for c in ".,;:'\"()-"]] = _STOP
    out[[ord(c) for c in "!?"]] = _LOUD
    out[[ord(c) for c in "|/\\<>{}[]"]] = _BAR
    out[128:] = _WIDE
    return out


_CLASS = _classes()
#: Features of one line before neighbours are added.
OWN = 16


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, their lengths, lines per text); a text has at least one line."""
    lines = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in lines], dtype=np.int64)
    flat = [x for part in lines for x in part]
    data = [x.encode("utf-8", "surrogatepass") + b"\n" for x in flat]
    lengths = np.array([len(d) for d in data], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    kinds = _CLASS[np.frombuffer(b"".join(data), dtype=np.uint8)]
    table = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(9)], axis=1).astype(np.float64)
    table[:, _SIGN] -= 1  # the line end
    size = np.maximum(lengths - 1, 1).astype(np.float64)
    letters = np.maximum(table[:, _UPPER] + table[:, _LOWER] + table[:, _WIDE], 1)
    words = [x.split() for x in flat]
    n_words = np.array([len(w) for w in words], dtype=np.float64)
    distinct = np.array([len(set(w)) for w in words], dtype=np.float64)
    again = np.array([sum(map(str.__eq__, w, w[1:])) for w in words], dtype=np.float64)
    some = np.maximum(n_words, 1)
    own = np.empty((len(flat), OWN))
    own[:, 0] = 1.0
    own[:, 1] = np.log1p(size) / 5
    own[:, 2] = table[:, _UPPER] / letters
    own[:, 3] = table[:, _DIGIT] / size
    own[:, 4] = table[:, _SPACE] / size
    own[:, 5] = table[:, _STOP] / size
    own[:, 6] = table[:, _LOUD] / some
    own[:, 7] = table[:, _SIGN] / some
    own[:, 8] = table[:, _BAR] / some
    own[:, 9] = letters / size
    own[:, 10] = np.minimum(size / some, 40) / 10
    own[:, 11] = 1 - distinct / some
    own[:, 12] = again / some
    own[:, 13] = lengths == 1
    own[:, 14] = n_words < 4
    own[:, 15] = np.array([x.rstrip().endswith((".", "!", "?", ":", '"')) for x in flat], dtype=np.float64)
    own[:, 6:9] = np.minimum(own[:, 6:9], 4)
    return own, size, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and the line after (zero at the ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends = np.cumsum(counts)
    before[ends - counts] = 0
    after[ends - 1] = 0
    return np.concatenate([own, before[:, 1:], after[:, 1:], before[:, :1], after[:, :1]], axis=1)


def _padded(emission: np.ndarray, counts: np.ndarray):
    """Batches of documents of like length: (document numbers, line numbers (docs, T), present)."""
    starts = np.cumsum(counts) - counts
    order = np.argsort(counts, kind="stable")
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * counts[order[b]] <= _CELLS:
            b += 1
        docs = order[a:b]
        steps = np.arange(counts[docs[-1]])
        yield docs, np.minimum(starts[docs][:, None] + steps, len(emission) - 1), steps < counts[docs][:, None]
        a = b


def _log_add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(x, y)


def forward_backward(emission: np.ndarray, present: np.ndarray, transition: np.ndarray, weight: np.ndarray | None = None):
    """(marginal of state 1, weighted expected transitions, log partition) of padded chains.

    ``emission`` (docs, T) is the score of state 1 over state 0; absent steps
    copy the state before them.
    """
    docs, steps = emission.shape
    score = np.zeros((docs, steps, 2))
    score[:, :, 1] = np.where(present, emission, 0)
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[:, 0] = score[:, 0]
    for t in range(1, steps):
        into = _log_add(alpha[:, t - 1, 0, None] + transition[0], alpha[:, t - 1, 1, None] + transition[1]) + score[:, t]
        alpha[:, t] = np.where(present[:, t, None], into, alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        ahead = score[:, t + 1] + beta[:, t + 1]
        back = _log_add(transition[:, 0] + ahead[:, 0, None], transition[:, 1] + ahead[:, 1, None])
        beta[:, t] = np.where(present[:, t + 1, None], back, beta[:, t + 1])
    log_z = _log_add(alpha[:, -1, 0], alpha[:, -1, 1])
    marginal = np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None])
    pairs = np.zeros((2, 2))
    if steps > 1 and weight is not None:
        for i in (0, 1):
            for j in (0, 1):
                p = np.exp(alpha[:, :-1, i] + transition[i, j] + score[:, 1:, j] + beta[:, 1:, j] - log_z[:, None])
                pairs[i, j] = (np.where(present[:, 1:], p, 0).sum(axis=1) * weight).sum()
    return marginal, pairs, log_z


@dataclass
class Model:
    """Feature scaling, emission weights, transitions, and the calibration (slope, offset)."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    slope: float = 6.0
    offset: float = -3.0

    def quality(self, texts: list[str]) -> np.ndarray:
        """Raw quality of each text."""
        own, size, counts = line_features(texts)
        emission = ((with_neighbours(own, counts) - self.mean) / self.spread) @ self.weights
        return self._aggregate(emission, size, counts)

    def _aggregate(self, emission: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.empty(len(counts))
        for docs, at, present in _padded(emission, counts):
            marginal, _, _ = forward_backward(emission[at], present, self.transition)
            length = np.where(present, size[at], 0)
            out[docs] = (marginal * length).sum(axis=1) / length.sum(axis=1)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.quality(texts) + self.offset, -30, 30)))


#: Without labels of both classes every document scores one half.
def neutral() -> Model:
    width = 3 * OWN
    return Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), 0.0, 0.0)


class _Lines:
    """Own features of all lines in a temporary file, as if ``with_neighbours`` and scaling had been applied."""

    #: Where ``with_neighbours`` puts the own features, those of the line before and of the line after.
    _COLUMNS = np.array([[*range(OWN)], [3 * OWN - 2, *range(OWN, 2 * OWN - 1)], [3 * OWN - 1, *range(2 * OWN - 1, 3 * OWN - 2)]])

    def __init__(self, texts: list[str]):
        self.file = tempfile.TemporaryFile()
        sizes, counts = [], []
        for a, b in text_slices(texts, 1_000_000):
            own, size, count = line_features(texts[a:b])
            self.file.write(own.tobytes())
            sizes.append(size)
            counts.append(count)
        self.file.flush()
        self.size, self.counts = np.concatenate(sizes), np.concatenate(counts)
        self.rows = len(self.size)
        self.own = np.memmap(self.file, np.float64, "r", shape=(self.rows, OWN))
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        # A line before the first or after the last of a document is all zeros.
        lost = [None, np.array(self.own[self.ends - 1]), np.array(self.own[self.starts])]
        total = sum(block.sum(axis=0) for _, block in self._blocks())
        self.mean, self.spread = np.empty(3 * OWN), np.empty(3 * OWN)
        for at, gone in zip(self._COLUMNS, lost, strict=True):
            mean = (total - (0 if gone is None else gone.sum(axis=0))) / self.rows
            square = sum(((block - mean) ** 2).sum(axis=0) for _, block in self._blocks())
            if gone is not None:
                square += len(gone) * mean**2 - ((gone - mean) ** 2).sum(axis=0)
            self.mean[at], self.spread[at] = mean, np.sqrt(np.maximum(square, 0) / self.rows)
        self.mean[0], self.spread = 0.0, np.where(self.spread < 1e-6, 1.0, self.spread)

    def _blocks(self):
        for a in range(0, self.rows, BLOCK):
            yield slice(a, a + BLOCK), np.array(self.own[a : a + BLOCK])

    def emission(self, weights: np.ndarray) -> np.ndarray:
        """The scaled features times ``weights``."""
        scaled = weights / self.spread
        part = np.empty((self.rows, 3))
        for at, block in self._blocks():
            part[at] = block @ scaled[self._COLUMNS].T
        out = part[:, 0] - self.mean @ scaled
        before, after = np.zeros(self.rows), np.zeros(self.rows)
        before[1:], after[:-1] = part[:-1, 1], part[1:, 2]
        before[self.starts], after[self.ends - 1] = 0, 0
        return out + before + after

    def gradient(self, error: np.ndarray) -> np.ndarray:
        """The transposed scaled features times ``error``."""
        part = np.zeros((self.rows, 3))
        part[:, 0] = error
        part[:-1, 1], part[1:, 2] = error[1:], error[:-1]
        part[self.ends - 1, 1], part[self.starts, 2] = 0, 0
        out = np.empty(3 * OWN)
        out[self._COLUMNS] = sum(block.T @ part[at] for at, block in self._blocks()).T
        return (out - self.mean * error.sum()) / self.spread


def fit(texts: list[str], labels: np.ndarray, rounds: int = 150) -> Model:
    """Maximum likelihood with a ridge, by Adam on the whole sample."""
    if len(set(labels.tolist())) < 2:
        return neutral()
    lines = _Lines(texts)
    size, counts = lines.size, lines.counts
    state = np.repeat(labels.astype(np.float64), counts)
    weight = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    per_line = np.repeat(weight, counts)
    batches = list(_padded(state, counts))
    width = 3 * OWN
    model = Model(lines.mean, lines.spread, np.zeros(width), np.zeros((2, 2)))
    theta = np.zeros(width + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        model.weights, model.transition = theta[:-4], theta[-4:].reshape(2, 2)
        emission = lines.emission(model.weights)
        grad, moves = 0.01 * theta * len(texts) / 10, np.zeros((2, 2))
        error = np.zeros(lines.rows)
        for docs, at, present in batches:
            marginal, pairs, _ = forward_backward(emission[at], present, model.transition, weight[docs])
            error[at[present]] = marginal[present]
            moves += pairs
            for side in (0, 1):
                own = labels[docs] == side
                moves[side, side] -= ((present.sum(axis=1) - 1) * weight[docs])[own].sum()
        grad[:-4] += lines.gradient((error - state) * per_line)
        grad[-4:] += moves.reshape(-1)
        grad /= len(texts)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.transition = theta[:-4].copy(), theta[-4:].reshape(2, 2).copy()
    raw = model._aggregate(lines.emission(model.weights), size, counts)
    slope, offset = 6.0, -3.0
    for _ in range(50):  # Newton steps of a ridged logistic regression
        p = 1 / (1 + np.exp(-np.clip(slope * raw + offset, -30, 30)))
        g = np.array([((p - labels) * raw).sum() + 0.1 * (slope - 6), (p - labels).sum() + 0.1 * (offset + 3)])
        q = p * (1 - p)
        h = np.array([[(q * raw * raw).sum() + 0.1, (q * raw).sum()], [(q * raw).sum(), q.sum() + 0.1]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, offset = slope - move[0], offset - move[1]
    model.slope, model.offset = float(slope), float(offset)
    return model


def train(docs: DataFrame, labels: DataFrame, learnable: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a hashed sample of the label rows where ``learnable`` holds.

    The sample has at most about ``PER_CLASS`` ids a label, so it can be sent to
    every task; the documents are only scanned.  Of rows that share an id one is
    read; an id with several labels counts once a label.
    """
    usable = labels.filter(learnable & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    sizes = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return neutral()
    draw = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, PER_CLASS / sizes[1]).otherwise(PER_CLASS / sizes[0])
    sample = usable.filter(draw < share).limit(4 * PER_CLASS)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(sample), "id")
    rows = own.groupBy("id", "label").agg(F.min("text").alias("text")).orderBy("id", "label").collect()
    return fit([r["text"] for r in rows], np.array([r["label"] for r in rows])) if rows else neutral()


def score_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` (replacing a column of that name), row by row.

    Null counts as the empty text, which is one empty line and gets a score too.
    """
    kept = [c for c in docs.columns if c != "quality_score"]
    small_batches(docs.sparkSession)
    own = fresh(docs, "__text")
    picked = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(own))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(width).to_pylist()
            parts = [shipped.value.scores(texts[a:b]) for a, b in text_slices(texts, 1_000_000)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(score, pa.float64())], [*kept, "quality_score"])
        release()

    return picked.mapInArrow(run, picked.drop(own).schema.add("quality_score", "double"))


#: Scores from here on count as good.
GOOD = 0.3


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels, fold_bucket("doc_id", 5) != 0)
    held_out = F.coalesce(fold_bucket("doc_id", 5) == 0, F.lit(False))
    found = score_quality(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= GOOD).cast("int").alias("predicted"))
