"""Quality classifier: a factorisation machine over hashed words, structure and length.

A text's score is the logistic function of w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 -
sum_i v_if^2 x_i^2], which counts all pairwise products <v_i, v_j> x_i x_j in time linear in the
features that the text has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Recent, column, fresh, held, slices, staged

#: Buckets of hashed words.
BUCKETS = 1 << 15
#: Length of the vectors of pairwise interactions.
RANK = 8
#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 8_000
#: Bytes of their texts, at most: with the rows, what bounds the features that the driver gets.
FIT_BYTES = 64 << 20
#: Score from which a document is taken as good.
THRESHOLD = 0.7
_MARKS = (b"!", b"?", b"|", b"*", b"$", b"#", b"&", b"%", b"<", b">", b"{", b"}", b"=", b"/", b"@", b".", b",", b"_")
_UPPER, _DIGIT = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))
_HIGH, _BLANK = bytes(range(0x80, 0x100)), b" \t\n\r\x0b\x0c"
_LETTER = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + _HIGH
N_STATS = 15 + len(_MARKS)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Structure and length statistics; the buckets of the words; their weights (of norm 1)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    cased = raw.split()
    words = raw.lower().split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m, k = max(1, len(words)), max(1, len(lines))
    known = held("buckets", lambda: Recent(lambda word: zlib.crc32(word) % BUCKETS))
    buckets, counts = np.unique(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), return_counts=True)
    weights = np.log1p(counts)
    if len(weights):
        weights /= np.sqrt((weights**2).sum())
    gone = lambda kind: (len(raw) - len(raw.translate(None, kind))) / n
    lone = raw.translate(None, _LETTER + _DIGIT + _BLANK)
    stats = [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), len(raw) / m, len(words) / k,
        gone(_UPPER), gone(_DIGIT), gone(_HIGH), gone(_BLANK), len(lone) / n,
        len(set(words)) / m, len(set(lines)) / k, (counts.max() / m if len(counts) else 0.0),
        sum(map(bytes.__eq__, words, words[1:])) / m, sum(map(bytes.isupper, cased)) / m,
        *(lone.count(c) / m for c in _MARKS),
    ]
    return np.array(stats), buckets, weights


@dataclass
class FactorisationMachine:
    """Inputs 0 ... N_STATS - 1 are the scaled statistics, the rest the buckets of words."""

    mean: np.ndarray
    scale: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def inputs(self, stats: np.ndarray, buckets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dense = np.clip((stats - self.mean) / self.scale, -4, 4) / 2
        return np.concatenate([np.arange(N_STATS), buckets + N_STATS]), np.concatenate([dense, weights])

    def score(self, text: str | None) -> float:
        at, x = self.inputs(*features(text))
        vx = self.v[at] * x[:, None]
        z = self.w0 + self.w[at] @ x + 0.5 * ((vx.sum(0) ** 2).sum() - (vx**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
        """Adagrad on the logistic loss. Without rows every score is 0.5."""
        rng = np.random.default_rng(seed)
        size = N_STATS + BUCKETS
        stats = np.array([r[0] for r in rows]) if rows else np.zeros((1, N_STATS))
        model = cls(stats.mean(0), stats.std(0) + 1e-3, 0.0, np.zeros(size), rng.normal(0, 0.01, (size, RANK)))
        if not rows:
            model.v[:] = 0
            return model
        share = np.clip(labels.mean(), 0.01, 0.99)
        model.w0 = float(np.log(share / (1 - share)))
        made = [model.inputs(*r) for r in rows]
        g0, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(made))
            for start in range(0, len(order), batch):
                chosen = order[start : start + batch]
                at = np.concatenate([made[i][0] for i in chosen])
                x = np.concatenate([made[i][1] for i in chosen])
                lengths = np.array([len(made[i][0]) for i in chosen])
                begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                row = np.repeat(np.arange(len(chosen)), lengths)
                vx = model.v[at] * x[:, None]
                sums = np.add.reduceat(vx, begins)
                z = model.w0 + np.add.reduceat(model.w[at] * x, begins) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), begins))
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) / len(chosen)
                each = error[row]
                used, back = np.unique(at, return_inverse=True)
                dw = np.bincount(back, each * x, len(used)) + decay * model.w[used]
                dv = np.zeros((len(used), RANK))
                np.add.at(dv, back, (each * x)[:, None] * (sums[row] - vx))
                dv += decay * model.v[used]
                d0 = error.sum()
                g0 += d0**2
                gw[used] += dw**2
                gv[used] += dv**2
                model.w0 -= rate * d0 / np.sqrt(g0)
                model.w[used] -= rate * dw / np.sqrt(gw[used])
                model.v[used] -= rate * dv / np.sqrt(gv[used])
        return model


def held_out(doc_id="doc_id"):
    """Whether a document's label is kept from fitting: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> FactorisationMachine:
    """Fit the model on at most ``fit_rows`` labelled documents of ``fit_bytes`` that aren't held out.

    The rows are those of the smallest hash of doc_id, whatever the order of the tables, up to both
    bounds; each is read whole and counts ``2 * BUCKETS`` bytes at most, which no more features can
    come from. Rows without doc_id or quality are left out; of several labels of a document the
    smallest counts, and equal rows count once. Without any label each score is 0.5.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    found = staged(found.withColumn("text_hash", F.xxhash64("text")), "labelled")
    size = F.least(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(2 * BUCKETS)).alias("size")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_hash")]
    # Of fit_rows narrow rows at most, so one task may add them up.
    few = found.select("doc_id", "text_hash", size).distinct().orderBy(*order).limit(fit_rows)
    few = few.withColumn("upto", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= fit_bytes)
    found = found.join(F.broadcast(few.select("doc_id", "text_hash")), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            made = [features(t) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"), column(batch, "quality"),
                pa.array([r[0].astype("<f8").tobytes() for r in made], pa.binary()),
                pa.array([r[1].astype("<i4").tobytes() for r in made], pa.binary()),
                pa.array([r[2].astype("<f4").tobytes() for r in made], pa.binary()),
            ], names=["doc_id", "quality", "stats", "buckets", "weights"])

    rows = found.mapInArrow(extract, "doc_id long, quality int, stats binary, buckets binary, weights binary").orderBy("doc_id", "stats").limit(fit_rows).collect()
    data = [(np.frombuffer(r.stats, "<f8"), np.frombuffer(r.buckets, "<i4").astype(np.int64), np.frombuffer(r.weights, "<f4").astype(float)) for r in rows]
    return FactorisationMachine.fit(data, np.array([float(r.quality) for r in rows]))


def score_quality(docs: DataFrame, model: FactorisationMachine, score: str = "score", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the column ``score`` (double, 0 to 1, higher is better) of each whole text.

    Null is scored as the empty text. A column of that name is replaced; rows and other columns
    stay, or those in ``keep``. The model (a few MB, whatever the corpus) is broadcast; no shuffle.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != score]
    carried, = fresh(docs.withColumn(score, F.lit(0.0)), "scored_text")
    slim = docs.select(*names, F.col(text).alias(carried))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = slim.drop(carried).withColumn(score, F.lit(None).cast("double")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in slices(batches):
            scores = [fitted.score(t) for t in column(batch, carried).to_pylist()]
            kept = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != carried]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names=[*names, score])

    return slim.mapInArrow(run, schema)


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) of each document."""
    scored = score_quality(docs, fit_quality(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of ``docs`` that score ``threshold`` or more, with their columns."""
    score, = fresh(docs, "quality_score")
    return score_quality(docs, fit_quality(docs, labels), score).where(F.col(score) >= threshold).select(*docs.columns)
