"""Quality classification: random Fourier features of document statistics, ridge regression, isotonic calibration.

Features stand for a Gaussian kernel over standardised statistics of the text. Each task sums its share of the normal
equations, Spark adds the shares by matrix cell, and the driver solves one system of fixed size. Calibration pools
adjacent violators over a fixed number of score bins, so nothing that reaches the driver grows with the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops
from .shared import IdFilter, id_hash, materialize

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "newline": b"\n\r",
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+<=>@^_`~\\/",
    "quote": b"\"'()[]{}-",
}
FEATURES = (*_CLASSES, "space", "other", "log_bytes", "word_length", "word_spread", "repeat_next", "distinct_words", "capital_words", "line_length", "repeat_lines")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; an empty text has zeros."""
    n = np.diff(offsets).astype(float)
    size = np.maximum(n, 1)
    cols = []
    kind = np.zeros(256, dtype=np.uint8)
    for i, chars in enumerate(_CLASSES.values(), 1):
        kind[list(chars)] = i
    kinds = kind[data]
    for i in range(1, len(_CLASSES) + 1):
        cols.append(bytesops.per_text(kinds == i, offsets) / size)
    start, end, doc = bytesops.words(data, offsets)
    length = (end - start).astype(float)
    count = np.bincount(doc, minlength=len(n)).astype(float)
    total = np.maximum(count, 1)
    cols.append(1 - np.bincount(doc, weights=length, minlength=len(n)) / size * (n > 0))
    cols.append(bytesops.per_text(data >= 128, offsets) / size)
    cols.append(np.log1p(n))
    mean = np.bincount(doc, weights=length, minlength=len(n)) / total
    cols.append(np.minimum(mean, 100))
    cols.append(np.minimum(np.sqrt(np.maximum(np.bincount(doc, weights=length**2, minlength=len(n)) / total - mean**2, 0)), 100))
    prefix = bytesops.prefix_hash(data)
    h = bytesops.mix(bytesops.span_hash(prefix, start, end))
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) if len(h) > 1 else np.zeros(0, bool)
    cols.append(np.bincount(doc[1:], weights=same, minlength=len(n)) / total if len(h) > 1 else np.zeros(len(n)))
    cols.append(_distinct(doc, h, len(n)) / np.sqrt(total))
    first = data[start] if len(start) else np.zeros(0, np.uint8)
    cols.append(np.bincount(doc, weights=(first >= 65) & (first <= 90), minlength=len(n)) / total)
    lines = bytesops.per_text(kinds == list(_CLASSES).index("newline") + 1, offsets) + 1.0
    cols.append(np.log1p(n / lines))
    at = np.flatnonzero((data == 10))
    begin = np.unique(np.concatenate((offsets[:-1][n > 0], at[at + 1 < len(data)] + 1)))
    stop = np.concatenate((begin[1:], [len(data)])) if len(begin) else begin
    of = np.searchsorted(offsets, begin, side="right") - 1
    # without its end, so that the last line can repeat an earlier one
    stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10)) if len(begin) else stop
    lh = bytesops.span_hash(prefix, begin, stop) if len(begin) else np.zeros(0, np.uint64)
    cols.append(1 - _distinct(of, lh, len(n)) / np.maximum(np.bincount(of, minlength=len(n)), 1) * (n > 0))
    out = np.stack(cols, axis=1)
    out[n == 0] = 0
    return out


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Different hashes per text."""
    if not len(h):
        return np.zeros(n)
    seen = np.unique(bytesops.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    return np.bincount(doc[seen], minlength=n).astype(float)


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the text's statistics."""

    def work(batches):
        for batch in batches:
            for rows, data, offsets in bytesops.runs(batch):
                x = statistics(data, offsets).astype(np.float32)
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("id"), flat], ["id", "x"])

    id_type = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {id_type}, x array<float>")


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # statistics x features
    shift: np.ndarray
    coef: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.shift
        return np.concatenate((np.sqrt(2 / z.shape[1]) * np.cos(z), np.ones((len(z), 1))), axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.coef

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)


def isotonic(bins: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit: the centre and the mean of every pooled block."""
    blocks: list[list[float]] = []  # weighted centre, positives, count
    for b, p, n in zip(bins, positives, counts, strict=True):
        blocks.append([b * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            c, q, m = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c, blocks[-1][1] + q, blocks[-1][2] + m]
    return np.array([c / n for c, _, n in blocks]), np.array([p / n for _, p, n in blocks])


BIN = 1e-3


#: Parts of the labelled rows; each is scored for the calibration by a fit on the others.
PARTS = 4


def fit(train: DataFrame, *, features: int = 192, ridge: float = 1.0, width: float = 1.0, seed: int = 7) -> QualityModel:
    """Fit on rows (id, x, y). No rows: every score is 0.5.

    The normal equations are summed for each of PARTS parts of the rows, by hash of the id. The sum of all gives the
    coefficients; for the calibration each part's rows are scored by the sum of the other parts.
    """
    d = len(FEATURES)
    sums = train.agg(F.count("*"), *[F.sum(F.col("x")[i]) for i in range(d)], *[F.sum(F.col("x")[i].cast("double") * F.col("x")[i]) for i in range(d)]).first()
    n = sums[0]
    rng = np.random.default_rng(seed)
    weights, shift = rng.normal(size=(d, features)) / (width * np.sqrt(d)), rng.uniform(0, 2 * np.pi, features)
    if not n:
        return QualityModel(np.zeros(d), np.ones(d), weights, shift, np.zeros(features + 1), (np.zeros(1), np.full(1, 0.5)))
    mean = np.array(sums[1 : d + 1], dtype=float) / n
    var = np.array(sums[d + 1 :], dtype=float) / n - mean**2
    model = QualityModel(mean, np.sqrt(np.maximum(var, 1e-8)), weights, shift, np.zeros(features + 1), (np.zeros(1), np.zeros(1)))
    rows = train.select("x", "y", F.coalesce(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(PARTS)), F.lit(0)).cast("int").alias("part"))
    size = features + 2
    upper = np.triu_indices(size)

    def normal(batches):
        total = np.zeros((PARTS, size, size))
        for b in batches:
            if b.num_rows:
                z = np.concatenate((model.features(_matrix(b)), b.column("y").to_numpy()[:, None]), axis=1)
                part = b.column("part").to_numpy()
                for i in np.unique(part):
                    total[i] += z[part == i].T @ z[part == i]
        for i in np.flatnonzero(total.any(axis=(1, 2))):
            cells = np.arange(len(upper[0]), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), i, np.int32)), pa.array(cells), pa.array(total[i][upper])], ["part", "cell", "v"])

    cells = rows.mapInArrow(normal, "part int, cell int, v double").groupBy("part", "cell").agg(F.sum("v").alias("v")).toArrow()
    full = np.zeros((PARTS, size, size))
    at = cells.column("cell").to_numpy()
    full[cells.column("part").to_numpy(), upper[0][at], upper[1][at]] = cells.column("v").to_numpy()
    full = full + np.triu(full, 1).transpose(0, 2, 1)
    penalty = np.diag([ridge] * features + [1e-9])
    coef = ridge_solution(full.sum(axis=0), penalty)
    others = [replace(model, coef=ridge_solution(full.sum(axis=0) - part, penalty)) for part in full]

    def binned(batches):
        for b in batches:
            if b.num_rows:
                x, part = _matrix(b), b.column("part").to_numpy()
                raw = np.zeros(len(x))
                for i in np.unique(part):
                    raw[part == i] = others[i].raw(x[part == i])
                yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(raw, -1, 2) / BIN).astype(np.int32)), b.column("y")], ["bin", "y"])

    bins = rows.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("p"), F.count("*").alias("n")).orderBy("bin").collect()
    knots = isotonic(*(np.array([float(r[k]) for r in bins]) for k in ("bin", "p", "n")))
    return QualityModel(mean, model.scale, weights, shift, coef, ((knots[0] + 0.5) * BIN, knots[1]))


def ridge_solution(sums: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Coefficients from the summed products of features and label (the last column)."""
    return np.linalg.solve(sums[:-1, :-1] + penalty, sums[:-1, -1])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, folds: int, held_out_fold: int, **options) -> tuple[QualityModel, DataFrame]:
    """(model, statistics of all rows). See classify()."""
    stats = materialize(with_statistics(docs, id_col, text_col), "quality-statistics")
    known = _known(labels, id_col, label_col)
    return fit(stats.where(~_held(F.col("id"), folds, held_out_fold)).join(known, "id"), **options), stats


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).cast("double").alias("y"))


def _held(id_: Column, folds: int, held_out_fold: int) -> Column:
    return F.coalesce(id_hash(id_, folds) == held_out_fold, F.lit(False))


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out_fold: int = 1, **options
) -> DataFrame:
    """One row per input row: id, held_out, score in 0..1 and predicted (1 if score >= 0.5).

    Learns from every labelled row outside the held-out fold; the fold comes from the id alone. Null text is empty and
    scored like one; null labels teach nothing, and of several labels of an id the mean counts; a null id is never
    held out, has no label and is scored. Without any label every score is 0.5. Extra columns are ignored.
    """
    model, stats = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, held_out_fold=held_out_fold, **options)

    def score(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.score(_matrix(b)))], ["id", "score"])

    id_type = dict(docs.dtypes)[id_col]
    scored = stats.mapInArrow(score, f"id {id_type}, score double")
    return scored.select(
        F.col("id").alias(id_col), _held(F.col("id"), folds, held_out_fold).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out_fold: int = 1, **options
) -> DataFrame:
    """The rows of docs that classify() predicts as 1, with all their columns; they are judged where they stand.

    Only rows that have a label are read for the fit.
    """
    known = materialize(_known(labels, id_col, label_col).where(~_held(F.col("id"), folds, held_out_fold)), "quality-labels")
    labelled, _ = IdFilter(known.select("id")).split(docs.select(id_col, text_col), id_col)
    stats = materialize(with_statistics(labelled, id_col, text_col), "quality-statistics")
    model = fit(stats.join(known, "id"), **options)

    def keep(batches):
        for b in batches:
            for rows, data, offsets in bytesops.runs(b, text_col):
                yield rows.filter(pa.array(model.score(statistics(data, offsets).astype(np.float32).astype(float)) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
