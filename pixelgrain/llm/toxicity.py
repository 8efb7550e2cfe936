"""Toxicity from nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled documents (EXAMPLES rows at most, the documented bound) is the index. Terms are all of its
words; their document frequencies come from all documents. Words that stand more often beside one label than chance
would have it weigh more (by their distance from chance in standard deviations), no word weighs less than its TF-IDF
weight; without that, whole texts are near each other by topic and few words of toxicity don't count. Examples stand in blocks. Terms of few examples have posting
lists, which are summed for every query; for the frequent terms each block keeps its greatest weight, so the sum of a
query's products with these bounds what any example of the block can reach. Blocks are opened from the highest bound on
and only while the bound can still reach the k-th best example; the winners are summed again in a fixed order, so
neighbours are exact whatever is scored beside them. Their distance-weighted votes are calibrated by a logistic curve
that is fitted on the examples, each left out of its own vote.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import bound_batches, materialize, text_bytes
from ._text import BY_ALNUM, blocks, list_array, words
from .quality import held_out

THRESHOLD = 0.7
EXAMPLES = 12_000
NEIGHBOURS, EVIDENCE = 15, 3
#: Examples of a block, blocks that are opened first, queries that are scored together.
BLOCK_ROWS, FIRST_BLOCKS, QUERIES = 64, 4, 256
#: A term that stands in more than one in so many examples is frequent.
RARE = 32
#: Results of equal vectors that a task keeps.
KNOWN = 20_000
PRIOR_WEIGHT, NEAR = 0.5, 0.05
#: Power of a term's distance from chance, in standard deviations, by which its weight grows.
EMPHASIS = 1.5
#: Room for the rounding of single-precision sums.
SLACK = 1e-5


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each block, as 64-bit hashes."""
    for batch in batches:
        for _, _, data, offs in blocks(batch.column("_body")):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words(data, offs, BY_ALNUM)[0]).astype(np.int64))], ["term"])


def term_counts(terms: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places among the sorted terms, counts, end of each document) of the known words of whole texts."""
    h, _, _, first = words(data, offs, BY_ALNUM)
    order = np.argsort(h)  # look-ups in order stay near each other in memory
    ranked = h[order]
    place = np.searchsorted(terms, ranked)
    real = place < len(terms)
    real[real] = terms[place[real]] == ranked[real]
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))[order[real]]
    code, count = np.unique(doc * len(terms) + place[real], return_counts=True)
    doc = code // max(1, len(terms))
    return code - doc * len(terms), count, np.cumsum(np.bincount(doc, minlength=len(offs) - 1))


def _vectors(chosen: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Term vectors of the examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in blocks(batch.column("_body")):
                term, count, ends = term_counts(chosen.value, data, offs)
                sizes = np.diff(ends, prepend=0)
                columns = [batch.column(c).slice(lo, hi - lo) for c in ("_id", "_label")]
                yield pa.RecordBatch.from_arrays([*columns, list_array(term.astype(np.int32), sizes), list_array(count.astype(np.int32), sizes)], ["_id", "_label", "terms", "counts"])

    return run


def _frequencies(chosen: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents per term in a partition: a row per term, not one per document and term. Term -1 counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = chosen.value
        total, rows = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, offs in blocks(batch.column("_body")):
                total += np.bincount(term_counts(terms, data, offs)[0], minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], some)).astype(np.int32)), pa.array(np.concatenate(([rows], total[some])))], ["t", "n"])

    return run


def weigh(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF weights with damped counts."""
    w = (1 + np.log(counts)) * idf[terms]
    norm = np.sqrt(np.square(w).sum())
    return w / norm if norm > 0 else w


def emphasis(terms: np.ndarray, ends: np.ndarray, labels: np.ndarray, n_terms: int, power: float = EMPHASIS) -> np.ndarray:
    """Factor of each term, 1 at least: how far its count in examples of label 1 is from what chance gives, smoothed by 1."""
    label = np.repeat(labels, np.diff(ends, prepend=0))
    own, rate = np.bincount(terms[label == 1], minlength=n_terms), (labels == 1).mean() if len(labels) else 0.0
    fair = np.bincount(terms, minlength=n_terms) * rate
    return np.maximum(1.0, np.abs(own - fair) / np.sqrt(fair * (1 - rate) + 1)) ** power


@dataclass
class Examples:
    """Example vectors row by row: those of row k are from ends[k - 1] to ends[k]. Rows lie in the index's order.

    shares: rows of the labelled table that an example stands for.
    """

    ids: np.ndarray
    labels: np.ndarray
    shares: np.ndarray
    idf: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    ends: np.ndarray
    base: float = 0.5
    slope: float = 1.0
    offset: float = 0.0

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        weight = self.shares[rows] / (1 - np.minimum(cosines, 1) + NEAR)
        scale = self.shares.mean() / NEAR if len(self.shares) else 1.0
        return float(((weight * self.labels[rows]).sum() + PRIOR_WEIGHT * scale * NEAR * self.base) / (weight.sum() + PRIOR_WEIGHT * scale * NEAR))

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * _logit(vote) + self.offset, -30, 30))))


class BlockMaxIndex:
    """Posting lists of the rare terms, and for the frequent ones weights by example and the greatest of each block."""

    def __init__(self, examples: Examples) -> None:
        self.examples, n, m = examples, len(examples.ids), len(examples.idf)
        begin = np.concatenate(([0], examples.ends))
        row = np.repeat(np.arange(n), np.diff(begin))
        df = np.bincount(examples.terms, minlength=m)
        common = df * RARE > n
        self.lane = np.where(common, np.cumsum(common) - 1, -1)
        self.blocks = -(-n // BLOCK_ROWS)
        self.dense = np.zeros((self.blocks * BLOCK_ROWS, int(common.sum())), np.float32)
        own = common[examples.terms]
        self.dense[row[own], self.lane[examples.terms[own]]] = examples.weights[own]
        self.greatest = self.dense.reshape(self.blocks, BLOCK_ROWS, self.dense.shape[1]).max(axis=1) if n else np.zeros((0, 0), np.float32)
        rare = np.flatnonzero(~own)
        rare = rare[np.argsort(examples.terms[rare], kind="stable")]
        self.posting_row, self.posting_weight = row[rare].astype(np.int32), examples.weights[rare].astype(np.float32)
        self.start = np.concatenate(([0], np.cumsum(np.where(common, 0, df))))
        self.begin, self.query = begin, np.zeros(m)

    def _rare_sums(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        a, many = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.bincount(self.posting_row[at], self.posting_weight[at] * np.repeat(weights, many), len(self.dense))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights) rows and cosines of the k nearest examples with a cosine above 0.

        Ties of cosines, to 9 digits, go to the earlier row. without: a row that each query leaves out.
        """
        n, q = len(self.examples.ids), len(queries)
        if not n or not q:
            return [(np.zeros(0, np.int64), np.zeros(0))] * q
        wanted = np.zeros((q, self.dense.shape[1]), np.float32)
        total = np.empty((q, len(self.dense)), np.float32)
        for i, (terms, weights) in enumerate(queries):
            lane = self.lane[terms]
            wanted[i, lane[lane >= 0]] = weights[lane >= 0]
            total[i] = self._rare_sums(terms[lane < 0], weights[lane < 0])
        if without is not None:
            total[np.arange(q), without] = -2  # no sum of unit vectors makes up for it
        by_block = total.reshape(q, self.blocks, BLOCK_ROWS)
        bound = by_block.max(axis=2) + wanted @ self.greatest.T + SLACK
        first = min(FIRST_BLOCKS, self.blocks)
        best_blocks = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        done = np.zeros((q, self.blocks), bool)
        np.put_along_axis(done, best_blocks, True, axis=1)
        self._open(done, wanted, total)
        seen = by_block[np.arange(q)[:, None], best_blocks].reshape(q, -1)
        least = np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] >= k else np.zeros(q, np.float32)
        least = np.maximum(least - 2 * SLACK, 0)  # what the k-th best example reaches at least
        later = ~done & (bound >= least[:, None]) & (bound > 2 * SLACK)
        self._open(later, wanted, total)
        done |= later
        i, b, r = np.nonzero((by_block >= least[:, None, None]) & (by_block > 0) & done[:, :, None])
        rows, ends = b * BLOCK_ROWS + r, np.searchsorted(i, np.arange(q + 1))
        out = []
        for j, (terms, weights) in enumerate(queries):
            own = rows[ends[j] : ends[j + 1]]
            if len(own) > 2 * k:
                value = total[j, own]
                own = own[value >= np.partition(value, -k)[-k] - 2 * SLACK]
            out.append(self._exact(terms, weights, own, k))
        return out

    def _open(self, which: np.ndarray, wanted: np.ndarray, total: np.ndarray) -> None:
        """Add the frequent terms' products for some blocks of each query."""
        for b in np.flatnonzero(which.any(axis=0)).tolist():
            own = np.flatnonzero(which[:, b])
            rows = slice(b * BLOCK_ROWS, (b + 1) * BLOCK_ROWS)
            total[own, rows] += wanted[own] @ self.dense[rows].T

    def _exact(self, terms: np.ndarray, weights: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k of some rows by double-precision sums in the order of terms."""
        if not len(rows):
            return rows, np.zeros(0)
        many = self.begin[rows + 1] - self.begin[rows]
        at = np.repeat(self.begin[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())
        self.query[terms] = weights
        part = self.query[self.examples.terms[at]] * self.examples.weights[at]
        self.query[terms] = 0
        cosine = np.bincount(np.repeat(np.arange(len(rows)), many), part, len(rows))
        value = np.round(cosine, 9)
        order = np.lexsort((rows, -value))[:k]
        order = order[value[order] > 0]
        return rows[order], cosine[order]


def _logit(p: float | np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def gather(ids: np.ndarray, labels: np.ndarray, shares: np.ndarray, terms: np.ndarray, counts: np.ndarray, ends: np.ndarray, idf: np.ndarray, keys: np.ndarray) -> Examples:
    """Examples in the order of the smallest hash among their rarer words, then ids: alike texts fall into one block."""
    begin = np.concatenate(([0], ends))[:-1].astype(np.int64)
    df = np.bincount(terms, minlength=len(idf))
    mark = np.array([np.min(keys[t[df[t] * RARE <= len(ids)]], initial=np.uint64(2**64 - 1)) for t in (terms[a:b] for a, b in zip(begin.tolist(), ends.tolist(), strict=True))], np.uint64)
    order = np.lexsort((ids, mark))
    own = [(terms[begin[i] : ends[i]], counts[begin[i] : ends[i]]) for i in order.tolist()]
    weights = [weigh(t, c, idf) for t, c in own]
    none = [np.zeros(0, np.int64)]
    examples = Examples(
        ids[order], labels[order].astype(float), shares[order].astype(float), idf, np.concatenate([t for t, _ in own] or none).astype(np.int32), np.concatenate(weights or none).astype(float), np.cumsum([len(t) for t, _ in own], dtype=np.int64)
    )
    empty = np.diff(np.concatenate(([0], examples.ends))) == 0
    pool = empty if empty.any() else np.ones(len(ids), bool)
    total = examples.shares[pool].sum()
    examples.base = float((examples.shares[pool] * examples.labels[pool]).sum() / total) if total else 0.5
    return examples


def calibrate(votes: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """Logistic curve over the log odds of votes, by Newton steps with targets drawn in and a small ridge."""
    if not len(votes):
        return 1.0, 0.0
    x = np.column_stack((_logit(votes), np.ones(len(votes))))
    n1, n0 = (shares * labels).sum(), (shares * (1 - labels)).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (shares * (target - p)) - np.array([1e-3, 1e-3]) * (beta - [1.0, 0.0]) * shares.sum()
        hess = (x * (shares * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3 * shares.sum()
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


_indexes: dict[str, BlockMaxIndex] = {}


def worker_index(token: str, shared: object) -> BlockMaxIndex:
    """The index that a worker made from the examples, kept for its further tasks; only the one used last."""
    if token not in _indexes:
        _indexes.clear()
        _indexes[token] = BlockMaxIndex(shared.value)
    return _indexes[token]


def _own_votes(token: str, shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, vote) of the examples given by row, each left out of its own vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = worker_index(token, shared)
        own = index.examples
        for batch in batches:
            rows, votes = batch.column("id").to_numpy(), []
            for lo in range(0, len(rows), QUERIES):
                part = rows[lo : lo + QUERIES]
                vectors = [(own.terms[index.begin[r] : index.begin[r + 1]].astype(np.int64), own.weights[index.begin[r] : index.begin[r + 1]].astype(float)) for r in part.tolist()]
                votes += [own.vote(*found) if len(v[0]) else own.base for v, found in zip(vectors, index.nearest(vectors, without=part.tolist()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(votes, pa.float64())], ["row", "vote"])

    return run


def _score(chosen: object, token: str, shared: object, curve: tuple[float, float], id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("example_id", id_type), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = worker_index(token, shared)
        own = index.examples
        own.slope, own.offset = curve
        plain = (own.score(own.base), [])
        known: dict[bytes, tuple[float, list[dict]]] = {}

        def result(rows: np.ndarray, cosines: np.ndarray) -> tuple[float, list[dict]]:
            top = [{"example_id": own.ids[r].item(), "cosine": float(x), "toxic": int(own.labels[r])} for r, x in zip(rows[:EVIDENCE], cosines[:EVIDENCE], strict=True)]
            return own.score(own.vote(rows, cosines)), top

        for batch in batches:
            for lo, hi, data, offs in blocks(batch.column("_body")):
                term, count, ends = term_counts(chosen.value, data, offs)
                out: list[tuple[float, list[dict]] | None] = [plain] * (hi - lo)
                ask: dict[bytes, list[int]] = {}
                vectors: list[tuple[np.ndarray, np.ndarray]] = []
                for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                    if a < b:
                        seen = hashlib.blake2b(term[a:b].tobytes() + count[a:b].tobytes(), digest_size=16).digest()
                        if seen in known:
                            out[i] = known[seen]
                        elif seen in ask:
                            ask[seen].append(i)
                        else:
                            ask[seen] = [i]
                            vectors.append((term[a:b], weigh(term[a:b], count[a:b], own.idf)))
                if len(known) > KNOWN:
                    known.clear()
                keys = list(ask)
                for at in range(0, len(vectors), QUERIES):
                    for seen, found in zip(keys[at : at + QUERIES], index.nearest(vectors[at : at + QUERIES]), strict=True):
                        known[seen] = result(*found)
                        for i in ask[seen]:
                            out[i] = known[seen]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(lo, hi - lo), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], kind)], ["_id", "score", "evidence"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, examples: int = EXAMPLES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, evidence (nearest examples with cosines).

    Labels are learnt only from rows with crc32(id) mod 3 <> 1; of each class the examples/2 rows with the smallest
    hashed ids are the index, weighted for the rows they stand for. Scores read whole texts and nothing else. Texts
    without a word of the examples, empty and null ones too, get the calibrated rate of such examples and no evidence.
    Labels other than 0 and 1 and null or unknown ids are ignored; of a repeated labelled id one label and one text
    count. Equal texts get equal scores, and of examples at the same distance those first in the index come first. An
    empty table gives an empty result; without labels every score is 0.5. Other columns are not read. A very long text is
    read alone.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    context = spark.sparkContext
    src = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("_body"))
    known = labels.select(F.col(id_col).alias("_known"), F.col(label_col).cast("int").alias("_label")).where("_label IN (0, 1) AND _known IS NOT NULL").where(~held_out("_known", 3, 1))
    known = known.groupBy("_known").agg(F.min("_label").alias("_label"))
    totals = {r._label: r["count"] for r in known.groupBy("_label").count().collect()}
    picked = [known.where(F.col("_label") == y).orderBy(F.xxhash64("_known"), "_known").limit(examples // 2) for y in (0, 1)]
    sample = materialize(picked[0].unionByName(picked[1]), "examples")
    texts = materialize(src.join(F.broadcast(sample), F.col("_id") == F.col("_known")).groupBy("_id", "_label").agg(F.min("_body").alias("_body")), "example-texts")
    found = texts.select("_body").mapInArrow(_words, "term long").distinct().toArrow().column("term").to_numpy()
    terms = np.sort(found.astype(np.int64).view(np.uint64))
    chosen = context.broadcast(terms)
    seen = src.select("_body").mapInArrow(_frequencies(chosen), "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    place, n_docs = seen.column("t").to_numpy(), seen.column("n").to_numpy()
    frequency = np.zeros(len(terms))
    frequency[place[place >= 0]] = n_docs[place >= 0]
    idf = np.log((n_docs[place < 0].sum() + 1) / (frequency + 1)) + 1
    id_name = src.schema["_id"].dataType.simpleString()
    rows = texts.mapInArrow(_vectors(chosen), f"_id {id_name}, _label int, terms array<int>, counts array<int>").toArrow().combine_chunks()
    own = [rows.column(c).combine_chunks() for c in ("_id", "_label", "terms", "counts")]
    n = {y: min(totals.get(y, 0), examples // 2) for y in (0, 1)}
    y = own[1].to_numpy(zero_copy_only=False)
    shares = np.array([totals.get(k, 0) / max(1, n[k]) for k in (0, 1)])[y] if len(y) else np.zeros(0)
    flat, ends = own[2].flatten().to_numpy().astype(np.int64), (own[2].offsets.to_numpy()[1:] - own[2].offsets.to_numpy()[0]).astype(np.int64)
    weight = idf * emphasis(flat, ends, y, len(terms))
    index = gather(own[0].to_numpy(zero_copy_only=False), y, shares, flat, own[3].flatten().to_numpy(), ends, weight, terms)
    token, shared = uuid.uuid4().hex, context.broadcast(index)
    votes = spark.range(0, len(y), 1, max(1, -(-len(y) // 1000))).mapInArrow(_own_votes(token, shared), "row long, vote double").orderBy("row").toArrow().column("vote").to_numpy()
    curve = calibrate(votes, index.labels, index.shares)
    scored = src.mapInArrow(_score(chosen, token, shared, curve, own[0].type), f"_id {id_name}, score double, evidence array<struct<example_id: {id_name}, cosine: double, toxic: int>>")
    return scored.select(F.col("_id").alias(id_col), held_out("_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
