"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at minimiser positions: of the 43 grams of 8 words in a window of 50 words the smallest hashed one,
the leftmost on ties. A passage of 50 words or more keeps the same suffixes wherever it stands, and at least 30 words to
the right of a kept position or 29 around it lie inside the passage. Suffixes whose 30 (or 29) words occur once are dropped
with the help of a bitmap. The others are sorted over the cluster. Suffixes with equal keys are compared at every split of
50 words into those to the left and those to the right of the kept position, by the hash of the whole window, so what two
documents share is found whichever words stand around it and whatever else is nearer in sorted order. Windows that follow
each other extend a match to the left and to the right; the union of the windows is the whole match however long it is.

A key's suffixes are compared where they meet in sorted order. Of keys that reach over the end of a partition, or that have
too many rows to hold, each piece decides the windows that several of its documents share; it hands on one row for each
such window and the windows that a single document of the piece has. These are compared between pieces in a second
shuffle, so no key is bound to a task and a common passage travels once per piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import bound_batches, discard, materialize, text_bytes
from ._text import BLOCK, SPACES, blocks, byte_table, grams, list_array, mix, words

GRAM, MIN_WORDS = 8, 50
WINDOW = MIN_WORDS - GRAM + 1
#: A key's words: those from the kept position on, or from SIDE words before it where the window holds as many.
SIDE = 21
RIGHT_KEY, LEFT_KEY = MIN_WORDS - SIDE + 1, SIDE + GRAM
#: Bits for each repeated key, and the bounds of the bitmap whose size follows from that; a full bitmap only drops less.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
#: Windows of one key that a task holds for comparison.
HELD_WINDOWS = 1 << 20
_TABLE = byte_table(SPACES, lower=False)
_U = np.uint64


def _leftmost(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value of each run of width values, the leftmost on ties; by doubling."""
    best = np.arange(len(g))
    pick = lambda a, b: np.where(g[a] <= g[b], a, b)
    span = 1
    while span * 2 <= width:
        best = pick(best[:-span], best[span:])
        span *= 2
    return pick(best[: len(best) - (width - span)], best[width - span :]) if width > span else best


def kept_suffixes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first window, end window) of the kept suffixes of a block: windows that follow each other and have the same key.

    Windows are numbered by their first word. Of a kept position the windows with at most 20 words before it are one
    entry, those with more another.
    """
    none = np.zeros(0, np.int64)
    if len(h) < MIN_WORDS:
        return np.zeros(0, _U), none, none
    place = _leftmost(grams(h, GRAM), WINDOW)
    start = np.arange(len(place))
    inside = start + MIN_WORDS <= first[np.searchsorted(first, start, "right")]
    start, place = start[inside], place[inside]
    if not len(start):
        return np.zeros(0, _U), none, none
    far = place - start >= SIDE
    fresh = np.flatnonzero(np.concatenate(([True], (start[1:] != start[:-1] + 1) | (place[1:] != place[:-1]) | (far[1:] != far[:-1]))))
    fresh = np.union1d(fresh, np.searchsorted(start, first[:-1][np.isin(first[:-1], start)]))
    stop = np.append(start[fresh[1:] - 1] + 1, start[-1] + 1)
    key = np.empty(len(fresh), _U)
    at, left = place[fresh], far[fresh]
    right_grams, left_grams = grams(h, RIGHT_KEY), grams(h, LEFT_KEY)
    key[~left] = right_grams[at[~left]]
    key[left] = mix(left_grams[at[left] - SIDE])
    return key, start[fresh], stop


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offs in blocks(batch.column("_body")):
            h, _, _, first = words(data, offs, _TABLE)
            key, n = np.unique(kept_suffixes(h, first)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], ["key", "n"])


def repeated_key_bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the keys (key, n) that occur more than once, packed; MOST_BITS / 64 words at most reach the driver."""
    again = materialize(keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "keys")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * again.count()).bit_length()))
    slot = f"shiftrightunsigned(key, {64 - bits.bit_length() + 1})"
    packed = again.select(F.expr(f"cast({slot} div 64 as int)").alias("word"), F.expr(f"shiftleft(1L, cast({slot} % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    discard(again)
    out = np.zeros(bits // 64, np.int64)
    out[packed.column("word").to_numpy()] = packed.column("bits").to_numpy()
    return out.astype("<i8").view(np.uint8)


_ROW = "key long, doc long, start int, windows array<long>"


def _suffixes(bitmap: object):
    """Kept suffixes whose key may occur again, with the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        shift = _U(64 - (8 * len(bits)).bit_length() + 1)
        for batch in batches:
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            for lo, _, data, offs in blocks(batch.column("_body"), BLOCK // 2):
                h, _, _, first = words(data, offs, _TABLE)
                key, start, stop = kept_suffixes(h, first)
                place = (key >> shift).astype(np.int64)
                hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
                key, start, stop = key[hit], start[hit], stop[hit]
                doc = np.searchsorted(first, start, "right") - 1
                many = stop - start
                at = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
                window = grams(h, MIN_WORDS)[at].astype(np.int64) if len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(ids[lo + doc], pa.int64()), pa.array((start - first[doc]).astype(np.int32)), list_array(window, many)], ["key", "doc", "start", "windows"])

    return run


#: Spans (doc, start, stop), and what pieces of a key hand on: a window with the least and greatest document of the piece,
#: and where it starts if that is one document.
_FOUND = "doc long, start int, stop int, window long, low long, high long"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, start, number of windows of each row, all windows)."""
    lists = batch.column("windows")
    return batch.column("key").to_numpy(), batch.column("doc").to_numpy(), batch.column("start").to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy()


def shared_windows(doc: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Which windows occur in more than one document: neighbours in sorted order are compared."""
    order = np.lexsort((doc, window))
    w, d = window[order], doc[order]
    head = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(w)))
    several = d[head] != d[head + size - 1]
    out = np.zeros(len(w), bool)
    out[order] = np.repeat(several, size)
    return out


def _spans(rows: tuple, mark: np.ndarray) -> pa.RecordBatch:
    """Marked windows as spans: those of a row that follow each other are one."""
    _, doc, start, many, _ = rows
    row = np.repeat(np.arange(len(doc)), many)
    at = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
    row, at = row[mark], at[mark]
    head = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1))) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(row))[: len(first)] - 1
    nothing = pa.nulls(len(first), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(doc[row[first]]), pa.array(at[first].astype(np.int32)), pa.array((at[last] + MIN_WORDS).astype(np.int32)), nothing, nothing, nothing], _NAMES)


def _piece(rows: tuple) -> Iterator[pa.RecordBatch]:
    """A piece of a key that other partitions or batches have rows of too."""
    _, doc, start, many, window = rows
    own = np.repeat(doc, many)
    mark = shared_windows(own, window)
    yield _spans(rows, mark)
    at = (np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum()))[~mark]
    yield pa.RecordBatch.from_arrays([pa.array(own[~mark]), pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.int32()), pa.array(window[~mark]), pa.array(own[~mark]), pa.array(own[~mark])], _NAMES)
    order = np.lexsort((own[mark], window[mark]))
    w, d = window[mark][order], own[mark][order]
    head = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, np.int64)
    none = pa.nulls(len(head), pa.int32())
    yield pa.RecordBatch.from_arrays([pa.nulls(len(head), pa.int64()), none, none, pa.array(w[head]), pa.array(d[head]), pa.array(d[np.append(head[1:], len(w))[: len(head)] - 1])], _NAMES)


def _part(rows: tuple, lo: int, hi: int) -> tuple:
    key, doc, start, many, window = rows
    ends = np.concatenate(([0], np.cumsum(many)))
    return key[lo:hi], doc[lo:hi], start[lo:hi], many[lo:hi], window[ends[lo] : ends[hi]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. Keys that begin and end inside the partition are decided, the others handed on."""
    held: tuple | None = None
    undecided = None  # a key whose rows are handed on: the partition's first one, or one with too many rows
    for batch in batches:
        if not batch.num_rows:
            continue
        now = _rows(batch)
        if undecided is None:
            undecided = now[0][0]
        rows = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
        skip = int(np.searchsorted(rows[0], undecided, "right")) if rows[0][0] == undecided else 0
        if skip:
            yield from _piece(_part(rows, 0, skip))
        last = max(skip, int(np.searchsorted(rows[0], rows[0][-1], "left")))
        whole = _part(rows, skip, last)
        if len(whole[0]):
            yield _spans(whole, shared_windows(np.repeat(whole[1], whole[3]), whole[4]))
        held = _part(rows, last, len(rows[0]))
        if len(held[4]) > HELD_WINDOWS:
            undecided = held[0][0]
            yield from _piece(held)
            held = None
        elif not len(held[0]):
            held = None
    if held is not None:
        yield from _piece(held)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, totals = [], []
        for spans in batch.column("_spans").to_pylist():
            merged: list[list[int]] = []
            for a, b in sorted((s["start"], s["stop"]) for s in spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            lists.append([{"first_word": a, "end_word": b} for a, b in merged])
            totals.append(sum(b - a for a, b in merged))
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(totals, pa.int64()), pa.array(lists, kind)], ["doc", "repeated_words", "spans"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that shares a passage of 50 words or more with another: doc_id, repeated_words, spans.

    Words are runs outside white space, compared as they are. Spans are the word ranges that are covered by windows of 50
    words which stand in another document too, merged and sorted. Null or empty texts, texts under 50 words and rows
    with a null id have no spans; rows that repeat an id count as one document and so don't match each other, nor does a
    passage that one document repeats. A very long text is read alone. Other columns are not read; an empty table gives
    an empty result. Windows are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_body")).where("_id IS NOT NULL")
    bitmap = spark.sparkContext.broadcast(repeated_key_bitmap(src.select("_body").mapInArrow(_keys, "key long, n long")))
    suffixes = materialize(src.mapInArrow(_suffixes(bitmap), _ROW), "suffixes")
    order = ["key", "doc", "start"]
    found = materialize(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compare, _FOUND), "spans")
    discard(suffixes)
    pieces = found.where("stop IS NULL")
    several = pieces.groupBy("window").agg(F.min("low").alias("_low"), F.max("high").alias("_high")).where("_low < _high").select(F.col("window").alias("_w"))
    late = pieces.where("doc IS NOT NULL").join(several.hint("merge"), F.col("window") == F.col("_w")).select("doc", "start", (F.col("start") + MIN_WORDS).alias("stop"))
    spans = found.where("stop IS NOT NULL").select("doc", "start", "stop").unionByName(late)
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    out = by_doc.mapInArrow(_merge, "doc long, repeated_words long, spans array<struct<first_word: int, end_word: int>>")
    return out.withColumnRenamed("doc", id_col)
