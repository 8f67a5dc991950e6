"""Operator 3, language identification with error-correcting output codes.

Every language gets a codeword; each bit is a binary classifier over hashed
byte n-grams of the lower-cased text (everything but letters counts as a
space).  A bit's weights are the log-odds of an n-gram under the languages with
that bit set against the others; its output is the document's mean log-odds,
centred and scaled so that the languages' own expectations lie beyond -1 and 1.
Decoding sums each codeword's weighted logistic loss over the bits and takes
the least; a small lead over the runner-up flags the document as ambiguous.

Training counts n-grams on a bounded hashed sample, ``PER_LANGUAGE`` labelled
documents a language; prediction reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonmend.llm.common import fold_bucket, fresh, read_table, release, small_batches, text_slices

#: Labelled documents a language that training looks at.
PER_LANGUAGE = 1500
#: Hashed n-gram features.
FEATURES = 1 << 15
#: Lead of the best codeword's loss, a bit, below which a document is ambiguous.
LEAD = 0.05
UNKNOWN = "und"

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_GAP = b"    "


def code_matrix(count: int, seed: int = 3) -> np.ndarray:
    """(languages, bits) of -1 and 1: exhaustive up to six languages, else the widest-spaced random code."""
    if count < 2:
        return np.ones((count, 0), dtype=np.int8)
    if count <= 6:
        bits = 2 ** (count - 1) - 1
        rows = [[1] * bits] + [[1 if (b >> (count - 1 - k)) & 1 else -1 for b in range(bits)] for k in range(1, count)]
        return np.array(rows, dtype=np.int8)
    rng, bits, best = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(count))), None
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(count, bits))
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2
        split = np.minimum((code > 0).sum(0), (code < 0).sum(0)).min()
        near = apart[~np.eye(count, dtype=bool)].min() if split else -1
        if best is None or near > best[0]:
            best = (near, code)
    return best[1]


def gram_slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all byte 3- and 4-grams, how many per text); a gram never spans two texts."""
    data = [b" " + t.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) for t in texts]
    lengths = np.array([len(d) for d in data], dtype=np.int64)
    whole = np.frombuffer(_GAP.join(data) + _GAP, dtype=np.uint8).astype(np.uint32)
    starts = np.cumsum(lengths + len(_GAP)) - lengths - len(_GAP)
    own = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    three = whole[own] << 16 | whole[own + 1] << 8 | whole[own + 2]
    four = three << 8 ^ whole[own + 3]
    slots = np.empty((len(own), 2), dtype=np.int64)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    slots[:, 0] = three * np.uint32(0x9E3779B1) >> shift
    slots[:, 1] = (four ^ four >> np.uint32(15)) * np.uint32(0x85EBCA77) >> shift
    return slots, lengths


@dataclass
class Model:
    """Languages, their codewords, and each bit's weights, centre, scale and importance."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    importance: np.ndarray

    @classmethod
    def from_counts(cls, languages: list[str], counts: np.ndarray) -> Model:
        code = code_matrix(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        plus, minus = (np.stack([share[code[:, b] == side].mean(axis=0) for b in range(code.shape[1])], axis=1) if code.shape[1] else np.zeros((FEATURES, 0)) for side in (1, -1))
        weights = np.clip(np.log(plus / minus), -4, 4)
        expected = share @ weights
        low = np.where(code > 0, expected, np.inf).min(axis=0, initial=np.inf)
        high = np.where(code < 0, expected, -np.inf).max(axis=0, initial=-np.inf)
        gap = np.maximum(low - high, 1e-3)
        return cls(languages, code, weights.astype(np.float32), (low + high) / 2, gap / 2, gap / gap.sum() if gap.size else gap)

    def losses(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): the weighted logistic loss of every codeword."""
        slots, lengths = gram_slots(texts)
        if not self.code.shape[1]:
            return np.zeros((len(texts), len(self.languages)))
        sums = self.weights[slots[:, 0]].astype(np.float64) + self.weights[slots[:, 1]]
        mean = np.add.reduceat(sums, np.cumsum(lengths) - lengths, axis=0) / (2 * lengths)[:, None]
        margin = (mean - self.centre) / self.scale
        return np.logaddexp(0, -3 * margin[:, None, :] * self.code[None]) @ self.importance

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, confidence, ambiguous) of each text; ``und`` without a letter."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        if not self.languages:
            return out
        lettered = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for a, b in text_slices([texts[k] for k in lettered], 200_000):
            loss = self.losses([texts[k] for k in lettered[a:b]])
            odds = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
            first = loss.argmin(axis=1)
            ranked = np.sort(loss, axis=1)
            lead = ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
            score = odds[np.arange(len(loss)), first] / odds.sum(axis=1)
            for k, f, s, gap in zip(lettered[a:b], first, score, lead, strict=True):
                out[k] = (self.languages[f], float(s), bool(gap < LEAD))
        return out


def train(docs: DataFrame, learnable: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Fit on rows where ``learnable`` holds and language and text are not null.

    About ``PER_LANGUAGE`` rows a language are drawn by a hash of id and text, so
    the same rows whatever their files and partitions.  A row with a null id is
    drawn by its text; no such row gives a model without languages.  One array
    of ``FEATURES`` counts a language reaches the driver.
    """
    rows = docs.filter(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model.from_counts([], np.zeros((0, FEATURES)))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, PER_LANGUAGE / n)))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), draw.alias("draw"))
    picked = picked.filter(F.col("draw") < F.element_at(share, F.col("lang"))).drop("draw").repartition(16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                slots, _ = gram_slots([text])
                totals.setdefault(lang, np.zeros(FEATURES))
                totals[lang] += np.bincount(slots.reshape(-1), minlength=FEATURES)
        release()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["lang", "counts"])

    def add(pdf):
        total = sum(np.frombuffer(c) for c in pdf["counts"])
        return pdf.iloc[:1].assign(counts=[total.tobytes()])

    parts = picked.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInPandas(add, "lang string, counts binary")
    found = sorted(parts.collect(), key=lambda r: r["lang"])  # one row of FEATURES numbers a language
    return Model.from_counts([r["lang"] for r in found], np.stack([np.frombuffer(r["counts"]) for r in found]) if found else np.zeros((0, FEATURES)))


#: Names of the columns that ``predict_language`` adds.
OUTPUTS = ("lang_pred", "lang_score", "lang_ambiguous")


def predict_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``OUTPUTS`` (replacing columns of those names), row by row.

    Null texts and texts without a letter get ``und``, score 0 and the flag; so
    does everything when no language was learned.  Extra columns pass through.
    """
    kept = [c for c in docs.columns if c not in OUTPUTS]
    small_batches(docs.sparkSession)
    own = fresh(docs, "__text")
    picked = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias(own))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                lang, score, flag = zip(*shipped.value.predict(part.column(width).to_pylist()), strict=True)
                added = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(flag, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *added], [*kept, *OUTPUTS])
        release()

    schema = picked.drop(own).schema.add("lang_pred", "string").add("lang_score", "double").add("lang_ambiguous", "boolean")
    return picked.mapInArrow(run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, fold_bucket("doc_id", 3) != 1)
    held_out = F.coalesce(fold_bucket("doc_id", 3) == 1, F.lit(False))
    found = predict_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
