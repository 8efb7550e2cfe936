"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk toward the pooled one and toward a multiple of the identity. A
score is the logistic of the difference of the two Gaussian log-densities plus log priors; the Mahalanobis forms use
Cholesky factors that are computed once and sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import bound_batches, materialize, prefilter, text_bytes
from ._text import BLOCK, BY_SPACE, blocks, words

STATISTICS = ("inner_upper", "digit", "mark", "odd_mark", "wide", "line", "word_length", "long_word", "new_word", "new_pair", "marked_word", "shout_word")
THRESHOLD = 0.3
POOL, RIDGE = 0.1, 0.02

_LOWER, _UPPER, _DIGIT, _MARK, _ODD, _WIDE, _NEWLINE, _BLANK = range(8)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _ODD, np.uint8)
    kinds[ord("a") : ord("z") + 1] = _LOWER
    kinds[ord("A") : ord("Z") + 1] = _UPPER
    kinds[ord("0") : ord("9") + 1] = _DIGIT
    kinds[128:] = _WIDE
    for c in ".,;:'\"()-?":
        kinds[ord(c)] = _MARK
    for c in "\n\r\x0b\x0c":
        kinds[ord(c)] = _NEWLINE
    for c in " \t":
        kinds[ord(c)] = _BLANK
    return kinds


_KINDS = _byte_kinds()


#: Typical shares that a short text is drawn toward, and the mass of that pull in bytes or words.
TYPICAL = {"inner_upper": 0.002, "digit": 0.001, "mark": 0.02, "odd_mark": 0.0005, "wide": 0.02, "line": 0.003, "long_word": 0.005, "marked_word": 0.002, "shout_word": 0.005}
PULL_BYTES, PULL_WORDS = 200.0, 40.0


def _log_odds(name: str, part: np.ndarray, whole: np.ndarray, pull: float) -> np.ndarray:
    share = (part + pull * TYPICAL[name]) / (whole + pull)
    return np.log(share / (1 - share))


def document_statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per document, from whole texts."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    kinds = _KINDS[data]
    doc_of = np.repeat(np.arange(n, dtype=np.int32), np.diff(offs))
    counts = np.bincount(doc_of * 8 + kinds, minlength=8 * n).reshape(n, 8).astype(float)
    h, begin, end, first = words(data, offs, BY_SPACE)
    n_words = np.diff(first).astype(float)
    length = (end - begin).astype(float)
    owner = np.repeat(np.arange(n), np.diff(first))
    odd = np.concatenate(([0], np.cumsum(kinds == _ODD)))
    upper = np.concatenate(([0], np.cumsum(kinds == _UPPER)))
    per_doc = lambda flags: np.bincount(owner[flags], minlength=n).astype(float)
    marked = per_doc(odd[end] > odd[begin])
    shout = per_doc((upper[end] - upper[begin]) * 2 > length)
    long_word = per_doc(length > 20)
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else h[:0]
    fresh, fresh_pair = np.zeros(n), np.zeros(n)
    for d in range(n):
        a, b = first[d], first[d + 1]
        if b > a:
            fresh[d] = len(np.unique(h[a:b]))
            fresh_pair[d] = len(np.unique(pair[a : b - 1]))
    pairs = np.maximum(n_words - 1, 0)
    inner = np.maximum(counts[:, _UPPER] - per_doc(upper[begin + 1] > upper[begin]), 0)
    by_byte = (("inner_upper", inner), ("digit", counts[:, _DIGIT]), ("mark", counts[:, _MARK]), ("odd_mark", counts[:, _ODD]), ("wide", counts[:, _WIDE]), ("line", counts[:, _NEWLINE]))
    by_word = (("marked_word", marked), ("shout_word", shout))
    out = np.column_stack(
        [
            *(_log_odds(name, part, size, PULL_BYTES) for name, part in by_byte),
            np.log((size - n_words + 5 * PULL_WORDS) / (n_words + PULL_WORDS)),
            _log_odds("long_word", long_word, n_words, PULL_WORDS),
            np.log((fresh + PULL_WORDS) / (n_words + PULL_WORDS)) + 0.15 * np.log(n_words + PULL_WORDS),
            np.log((fresh_pair + PULL_WORDS) / (pairs + PULL_WORDS)),
            *(_log_odds(name, part, n_words, PULL_WORDS) for name, part in by_word),
        ]
    )
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text = batch.column("_id"), batch.column("_body")
        for lo, hi, data, offs in blocks(text, BLOCK // 4):
            x = document_statistics(data, offs)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array(x[:, k]) for k in range(x.shape[1]))], ["_id", *STATISTICS])


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics of every whole text, one narrow row per document."""
    src = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("_body"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(_measure, ", ".join([f"_id {kind}", *(f"{s} double" for s in STATISTICS)]))


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse Cholesky factor of the covariance, and log prior - log determinant / 2."""

    means: np.ndarray
    whiten: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, between 0 and 1."""
        logs = [self.offsets[k] - 0.5 * np.square((x - self.means[k]) @ self.whiten[k].T).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: rows, sums and sums of products of the statistics, about 100 numbers however many rows there are."""
    d = len(STATISTICS)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        y = batch.column("_label").to_numpy(zero_copy_only=False)
        x = np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS])
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
    rows = [(k, i, total[k, i]) for k in (0, 1) for i in range(total.shape[1])]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows])], ["k", "i", "v"])


def fit(labelled: DataFrame, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    """Fit on all labelled rows (STATISTICS and _label 0 or 1). Only class moments reach the driver.

    A class without rows gets the pooled covariance and mean; without any labelled row every score is one half.
    """
    d = len(STATISTICS)
    sums = labelled.mapInArrow(_moments, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for row in sums:
        total[row.k, row.i] = row.v
    count = total[:, 0]
    if not count.sum():
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    everyone = total.sum(axis=0)
    means = np.stack([(total[k] if count[k] else everyone)[1 : 1 + d] / (count[k] or count.sum()) for k in (0, 1)])
    scatter = [total[k, 1 + d :].reshape(d, d) - count[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / count.sum()
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    whiten, offsets = [], []
    for k in (0, 1):
        own = scatter[k] / count[k] if count[k] else pooled
        weight = pool + (1 - pool) * d / (d + count[k])
        cov = (1 - weight) * own + weight * pooled
        cov = (1 - ridge) * cov + ridge * scale
        low = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(low))
        offsets.append(np.log((count[k] + 1) / (count.sum() + 2)) - np.log(np.diag(low)).sum())
    return Discriminant(means, np.stack(whiten), np.array(offsets))


def _scores(model: Discriminant) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(model.score(x))], ["_id", "score"])

    return run


def held_out(id_col: str, folds: int, fold: int) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.select(F.col(id_col).alias("_known"), F.col(label_col).cast("int").alias("_label")).where("_label IN (0, 1)").where(~held_out("_known", 5, 0))


def _labelled(table: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return table.join(_known(labels, id_col, label_col), F.col("_id") == F.col("_known")).drop("_known", "_id")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels are learnt from rows with crc32(id) mod 5 <> 0 only. Inputs of a score are the statistics of the whole text;
    a null or empty text is scored as a text without words. Labels that are neither 0 nor 1, or whose id is null or
    unknown, are ignored; a repeated label counts as often as it stands there. Other columns are not read. An empty
    table gives an empty result, and without labels every score is 0.5.
    """
    table = materialize(statistics_table(docs, id_col, text_col), "statistics")
    model = fit(_labelled(table, labels, id_col, label_col))
    kind = table.schema["_id"].dataType.simpleString()
    scored = table.mapInArrow(_scores(model), f"_id {kind}, score double")
    return scored.select(F.col("_id").alias(id_col), held_out("_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep_good(model: Discriminant, text_col: str, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole rows whose text scores at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.names.index(text_col)).fill_null("").cast(pa.binary())
            for lo, hi, data, offs in blocks(text, BLOCK // 4):
                good = model.score(document_statistics(data, offs)) >= threshold
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return run


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text the classifier predicts to be of class 0; columns as they were, no shuffle of rows.

    Rows are judged one by one, so repeated ids and null ids don't matter. Null and empty texts are scored as texts
    without words. An empty table stays empty; no column name of docs is in the way.
    """
    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body"))
    known = _known(labels, id_col, label_col)
    if narrow.schema["_id"].dataType == known.schema["_known"].dataType:
        narrow = prefilter(narrow, "_id", known, "_known")
    # merged at every size: a task that takes statistics and sums them up holds two Python workers, which stay for all later stages
    table = statistics_table(narrow, "_id", "_body").join(known.hint("merge"), F.col("_id") == F.col("_known")).drop("_known", "_id")
    model = fit(table)
    return docs.mapInArrow(_keep_good(model, text_col, threshold), docs.schema)
