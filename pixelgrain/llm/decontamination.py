"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the tokens of each window and ignore the rest, so a seed survives substituted words. Seeds of
benchmark items are joined with the seeds of every position of every document inside the task that reads the document;
around each hit the item is laid over the document on the same diagonal and the overlap is counted with a price for
each substituted word. Items are taken in blocks of bounded size, one pass over the documents per block, so what is
sent to the tasks has a fixed bound however large the benchmark is, and documents are never shuffled. Items that are
shorter than a window are looked up whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import bound_batches, text_bytes
from ._text import BY_ALNUM, blocks, grams, mix, words

#: Masks of weight 5 over windows of 8 tokens; 1 is compared, 0 ignored.
MASKS = ("11010011", "10110101", "11100101", "10011011")
SPAN = 8
#: Share of an item's tokens that a document must hold, in tolerant runs, to count as contaminated.
COVERAGE = 0.6
#: A run gains 1 for a kept token and loses this for a substituted one; it ends where the loss since its best point passes DROP.
PRICE, DROP = 1.5, 6.0
MIN_RUN = 5
#: Text of the items of one block; its index takes some 14 times as much in a worker.
BLOCK_BYTES = 4 << 20
#: Bits per seed of the filter before the look-up, and its greatest size (8 MB).
BITS_PER_SEED, MOST_BITS = 16, 26
#: Pairs of equal seeds that are laid out at once.
PAIRS = 1 << 20

_U = np.uint64
_LANES = mix(np.arange(7001, 7001 + SPAN, dtype=_U)) | _U(1)


def seeds(h: np.ndarray) -> list[np.ndarray]:
    """For each mask the seed of every window of token hashes."""
    n = len(h) - SPAN + 1
    if n <= 0:
        return [np.zeros(0, _U) for _ in MASKS]
    out = []
    for k, mask in enumerate(MASKS):
        total = np.full(n, k + 1, _U)
        for i, keep in enumerate(mask):
            if keep == "1":
                total += h[i : i + n] * _LANES[i]
        out.append(mix(total))
    return out


@dataclass(frozen=True)
class Index:
    """Items of a block: token hashes of all of them, and their seeds in sorted order with item and position.

    short: (length, sorted hashes, items) of the items below SPAN tokens.
    """

    ids: list[int]
    tokens: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    position: np.ndarray
    filter: np.ndarray
    short: list[tuple[int, np.ndarray, np.ndarray]]


def build_index(ids: list[int], texts: list[bytes]) -> Index:
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    h, _, _, first = words(np.frombuffer(b"".join(texts), np.uint8), offs, BY_ALNUM)
    tokens = [h[a:b].copy() for a, b in zip(first[:-1], first[1:], strict=True)]
    parts = [(s, k, len(s)) for k, t in enumerate(tokens) for s in seeds(t)]
    seed = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, _U)
    item = np.concatenate([np.full(n, k, np.int32) for _, k, n in parts]) if parts else np.zeros(0, np.int32)
    position = np.concatenate([np.arange(n, dtype=np.int32) for _, _, n in parts]) if parts else np.zeros(0, np.int32)
    order = np.argsort(seed, kind="stable")
    bits = min(MOST_BITS, max(16, (BITS_PER_SEED * len(seed)).bit_length()))
    slot = np.unique(seed >> _U(64 - bits))
    hit = np.zeros(1 << bits >> 3, np.uint8)
    np.bitwise_or.at(hit, (slot >> _U(3)).astype(np.int64), (1 << (slot & _U(7)).astype(np.int64)).astype(np.uint8))
    short = []
    for n in range(1, SPAN):
        own = np.array([k for k, t in enumerate(tokens) if len(t) == n], np.int64)
        if len(own):
            whole = np.concatenate([grams(tokens[k], n) for k in own])
            by_hash = np.argsort(whole, kind="stable")
            short.append((n, whole[by_hash], own[by_hash]))
    return Index(ids, tokens, seed[order], item[order], position[order], hit, short)


def tolerant_runs(same: np.ndarray) -> np.ndarray:
    """Kept tokens of the tolerant runs of a diagonal: where a run's gain is at least MIN_RUN."""
    covered = np.zeros(len(same), bool)
    total, best, start, best_end = 0.0, 0.0, 0, 0
    for i, equal in enumerate([*same.tolist(), None]):
        if equal is None or (not equal and (total - PRICE < 0 or total - PRICE < best - DROP)):
            if best >= MIN_RUN:
                covered[start:best_end] |= same[start:best_end]
            total, best, start, best_end = 0.0, 0.0, i + 1, i + 1
        elif equal:
            total += 1
            if total > best:
                best, best_end = total, i + 1
        else:
            total -= PRICE
    return covered


def hits(index: Index, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, diagonal, equal seeds on it) of a block's token hashes, sorted; pairs are laid out in parts."""
    longest = max(map(len, index.tokens), default=0)
    width = len(h) + longest + 1
    shift = _U(64 - (8 * len(index.filter)).bit_length() + 1)
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for own in seeds(h) if len(index.seed) else []:
        slot = (own >> shift).astype(np.int64)
        at = np.flatnonzero((index.filter[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
        doc = np.searchsorted(first, at, "right") - 1
        inside = at + SPAN <= first[doc + 1]
        at, doc = at[inside], doc[inside]
        low, high = np.searchsorted(index.seed, own[at], "left"), np.searchsorted(index.seed, own[at], "right")
        some = high > low
        at, doc, low, many = at[some], doc[some], low[some], (high - low)[some]
        ends, lo = np.cumsum(many), 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            m = many[lo:hi]
            row = np.repeat(np.arange(lo, hi), m)
            entry = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m) + low[row]
            code = (doc[row] * len(index.ids) + index.item[entry]) * width + at[row] - index.position[entry] + longest
            new, n = np.unique(code, return_counts=True)
            codes, place = np.unique(np.concatenate((codes, new)), return_inverse=True)
            counts = np.bincount(place, np.concatenate((counts, n)), len(codes)).astype(np.int64)
            lo = hi
    pair = codes // width
    return pair // max(1, len(index.ids)), pair % max(1, len(index.ids)), codes % width - longest, counts


def find(index: Index, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, item, covered tokens, first and end token in the document) for a block's token hashes.

    Diagonals with the most equal seeds come first; when the item is covered whole, no other can add to it.
    """
    docs, items, diagonals, counts = hits(index, h, first)
    out: list[tuple[int, int, int, int, int]] = []
    if not len(docs):
        return find_short(index, h, first)
    head = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (items[1:] != items[:-1]))))
    for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(docs)], strict=True):
        doc, item = int(docs[lo]), int(items[lo])
        tokens, covered, begin, end = index.tokens[item], np.zeros(len(index.tokens[item]), bool), None, 0
        for d in diagonals[lo:hi][np.lexsort((diagonals[lo:hi], -counts[lo:hi]))].tolist():
            a, b = max(d, int(first[doc])), min(d + len(tokens), int(first[doc + 1]))
            own = tolerant_runs(h[a:b] == tokens[a - d : b - d])
            where = np.flatnonzero(own)
            if len(where):
                covered[a - d : b - d] |= own
                begin = min(begin if begin is not None else a + where[0], a + where[0])
                end = max(end, a + where[-1] + 1)
                if covered.all():
                    break
        if begin is not None:
            out.append((doc, item, int(covered.sum()), int(begin - first[doc]), int(end - first[doc])))
    return out + find_short(index, h, first)


def find_short(index: Index, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Items below SPAN tokens that stand in a document as they are; from the first to the last place."""
    places: dict[tuple[int, int], tuple[int, int, int]] = {}
    for n, whole, items in index.short:
        own = grams(h, n)
        low, high = np.searchsorted(whole, own, "left"), np.searchsorted(whole, own, "right")
        at = np.flatnonzero(high > low)
        doc = np.searchsorted(first, at, "right") - 1
        inside = at + n <= first[doc + 1]
        for a, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
            for item in items[low[a] : high[a]].tolist():
                begin = places[d, item][1] if (d, item) in places else int(a - first[d])
                places[d, item] = (n, begin, int(a + n - first[d]))
    return [(d, item, *place) for (d, item), place in places.items()]


def _search(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            ids = batch.column("_id")
            for lo, _, data, offs in blocks(batch.column("_body")):
                h, _, _, first = words(data, offs, BY_ALNUM)
                rows = [(lo + d, index.ids[k], len(index.tokens[k]), n, a, b) for d, k, n, a, b in find(index, h, first)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "item_id", "item_tokens", "covered_tokens", "first_token", "end_token"])

    return run


def _keep_clean(shared: object, text_col: str, coverage: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole rows that hold no item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            text = batch.column(batch.schema.names.index(text_col)).fill_null("").cast(pa.binary())
            for lo, hi, data, offs in blocks(text):
                h, _, _, first = words(data, offs, BY_ALNUM)
                clean = np.ones(hi - lo, bool)
                clean[[d for d, k, n, _, _ in find(index, h, first) if n >= coverage * len(index.tokens[k])]] = False
                yield batch.slice(lo, hi - lo).filter(pa.array(clean))

    return run


def _indexes(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int) -> Iterator[object]:
    """A broadcast index per block of items. The driver holds one block at a time beside Spark's own copies on disk."""
    items = benchmark.select(F.col(item_col).cast("long").alias("_item"), text_bytes(item_text_col).alias("_body")).where("_item IS NOT NULL AND length(_body) > 0")
    size = items.agg(F.coalesce(F.sum(F.length("_body")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_bytes))
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("_item", "_body"), F.lit(n_blocks)) == k).orderBy("_item", "_body").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(build_index([r._item for r in rows], [bytes(r._body) for r in rows]))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, item_id, item_tokens, covered_tokens, first_token, end_token, coverage) of contaminated documents.

    Tokens are runs of ASCII letters, digits and bytes beyond ASCII, A-Z folded. A document is reported with an item
    when tolerant runs hold at least that share of the item's tokens. Items of fewer than 8 tokens
    have no window and are found only as they are, all of their tokens in a row. Null or empty texts and null item ids
    match nothing; a null doc_id is reported as null. Repeated rows are reported each, repeated items once per row. A very
    long text is searched alone and as a whole; words that it repeats cost time by their pairs with an item's, in parts
    of bounded size. Other columns are not read; an empty table on either side gives an empty result.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("_body"))
    schema = f"doc_id {src.schema['_id'].dataType.simpleString()}, item_id long, item_tokens long, covered_tokens long, first_token long, end_token long"
    found = [src.mapInArrow(_search(index), schema) for index in _indexes(benchmark, item_col, item_text_col, block_bytes)]
    share = F.col("covered_tokens") / F.col("item_tokens")
    out = reduce(DataFrame.unionByName, found).withColumn("coverage", share).where(F.col("covered_tokens") >= coverage * F.col("item_tokens"))
    return out.withColumnRenamed("doc_id", id_col).withColumnRenamed("item_id", item_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold a benchmark item; columns as they were, no shuffle.

    Rows are judged one by one, so repeated and null ids don't matter; null and empty texts stay. An empty table on
    either side leaves docs as they are; no column name of docs is in the way.
    """
    bound_batches(docs.sparkSession)
    for index in _indexes(benchmark, item_col, item_text_col, block_bytes):
        docs = docs.mapInArrow(_keep_clean(index, text_col, coverage), docs.schema)
    return docs
