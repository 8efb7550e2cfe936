"""Cross-entropy difference of two matched bigram models.

The target model is counted over the documents of interest, the background model over all documents; both have the
same order, smoothing, total mass and one vocabulary: every word of all documents. A word's probability comes from all
pairs of two words, smoothed toward words and these toward uniform. A document's score is the mean over its tokens of
target loss minus background loss: the lower, the more it reads like the target.

Pairs of the CORE most frequent words are counted in a table of fixed size that tasks hold. Every other token is sent,
with the words before and behind it, to the task that owns its word; that task has all places of the word, so it
counts words and pairs whole and sends back the losses of the places, added up by document. The tables grow with the
input in number, not in size: a word beyond the core has at most one in CORE + 1 of all tokens.

With a number as core, words are put into classes instead: the most frequent ones that many, all others in one class
more; a word's probability is then that of its class after the class before it times its own within its class, and
words below a least count are one unknown word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import bound_batches, discard, materialize, prefilter, text_bytes
from ._text import BY_ALNUM, blocks, column_buffers, list_array, mix, words

#: Words whose pairs tasks count themselves; the others are counted where they are sent. Only the way differs, not the result.
CORE = 1023
#: Words beyond the core that tasks hold, at most; rarer ones are joined. Only the way differs, not the result.
HEAD = 1 << 18
#: With classes, a word must stand so often to belong to the vocabulary.
LEAST_COUNT = 2
#: Bits of the filter over the joined words; a full filter only drops less before the join.
FILTER_BITS = 1 << 25
#: Weight of the unigram model in words, for both models alike.
BACKOFF = 8.0
_HELD = 1 << 20
#: Tokens that a task sends at once, that a task owns, and rows that are sent at once (numbered in 16 bits).
CHUNK_TOKENS, OWNED_TOKENS, CHUNK_ROWS = 1 << 19, 1 << 19, 1 << 15
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of word hashes, gathered over several blocks before they are sent."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        if not held:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        word, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return word, np.bincount(at, np.concatenate([n for _, n in held]), len(word)).astype(np.int64)

    for batch in batches:
        for _, _, data, offs in blocks(batch.column("_body")):
            held.append(np.unique(words(data, offs, BY_ALNUM)[0], return_counts=True))
            if sum(len(w) for w, _ in held) > _HELD:
                held[:] = [merged()]
                if len(held[0][0]) > _HELD // 2:
                    yield _pairs(*held.pop())
    yield _pairs(*merged())


def _pairs(word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(n)], ["word", "n"])


@dataclass(frozen=True)
class Shared:
    """What tasks hold. Losses are rows of (target, background).

    outer: loss within the class of words beyond the core for each word of the head; unknown: for the unknown word.
    filter: packed bits of the hashes of words that are joined.
    """

    core: np.ndarray
    tables: tuple[np.ndarray, np.ndarray]
    head: np.ndarray
    unknown: tuple[float, float]
    outer: tuple[np.ndarray, np.ndarray]
    filter: np.ndarray


def find_words(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of hashes among sorted known ones; -1 for others."""
    if not len(known):
        return np.full(len(h), -1)
    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[place] == h, place, -1)


def _codes(vocab: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """previous * size + current class for each token; size - 1 is the class beyond the core, row size the start of a text."""
    size = len(vocab) + 1
    place = find_words(vocab, h)
    now = np.where(place >= 0, place, size - 1)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    start = first[:-1][first[:-1] < first[1:]]
    before[start] = size
    return before * size + now


def _bigrams(vocab: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocab) + 1
        total = np.zeros((size + 1) * size, np.int64)
        for batch in batches:
            for _, _, data, offs in blocks(batch.column("_body")):
                h, _, _, first = words(data, offs, BY_ALNUM)
                if len(h):
                    np.add.at(total, _codes(vocab, h, first), 1)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    return run


def bigram_counts(docs: DataFrame, vocab: np.ndarray) -> np.ndarray:
    """Counts over all rows of docs (_body): one row per previous word, the last for the start of a text."""
    width = len(vocab) + 1
    cells = docs.select("_body").mapInArrow(_bigrams(vocab), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((width + 1) * width)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return counts.reshape(width + 1, width)


def losses(counts: np.ndarray, backoff: float = BACKOFF) -> np.ndarray:
    """-log probability of each (previous, current) cell, smoothed toward unigrams and these toward uniform."""
    size = counts.shape[1]
    unigram = (counts.sum(axis=0) + 1) / (counts.sum() + size)
    return -np.log((counts + backoff * unigram) / (counts.sum(axis=1, keepdims=True) + backoff))


def _slot(word: np.ndarray) -> np.ndarray:
    return (word >> _U(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


_SCORED = "text_key long, n_tokens long, target_sum double, background_sum double, words array<long>, counts array<int>"


def _score(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of losses, with every word that the task doesn't know counted as unknown, and the words to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Shared = shared.value
        for batch in batches:
            for lo, hi, data, offs in blocks(batch.column("_body")):
                h, _, _, first = words(data, offs, BY_ALNUM)
                code = _codes(model.core, h, first) if len(h) else np.zeros(0, np.int64)
                outside = np.flatnonzero(code % (len(model.core) + 1) == len(model.core))
                place = find_words(model.head, h[outside])
                sums = []
                for k in (0, 1):
                    loss = model.tables[k][code].astype(float)
                    loss[outside] += np.where(place >= 0, model.outer[k][place], model.unknown[k])
                    total = np.concatenate(([0.0], np.cumsum(loss)))
                    sums.append(total[first[1:]] - total[first[:-1]])
                rest = outside[place < 0]
                slot = _slot(h[rest])
                rest = rest[(model.filter[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0]
                doc = np.searchsorted(first, rest, "right") - 1
                order = np.lexsort((h[rest], doc))
                d, w = doc[order], h[rest][order]
                new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])))) if len(d) else np.zeros(0, np.int64)
                sizes = np.bincount(d[new], minlength=hi - lo)
                keys = [int.from_bytes(hashlib.blake2b(data[a:b], digest_size=8).digest(), "little", signed=True) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(lo, hi - lo), pa.array(keys, pa.int64()), pa.array(np.diff(first)), pa.array(sums[0]), pa.array(sums[1]), list_array(w[new].astype(np.int64), sizes), list_array(np.diff(np.append(new, len(d))).astype(np.int32), sizes)],
                    ["_id", *(c.split()[0] for c in _SCORED.split(", "))],
                )

    return run


def word_table(docs: DataFrame, target: DataFrame, least: int = LEAST_COUNT) -> tuple[DataFrame, int, int]:
    """((word, n, m): counts of the vocabulary in all documents and in the target, tokens of all, tokens of the target)."""
    counted = lambda df, name: df.select("_body").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias(name))
    everything = materialize(counted(docs, "n"), "words")
    wanted = materialize(counted(target, "m").withColumnRenamed("word", "_w"), "target-words")
    total, mass = (df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for df, c in ((everything, "n"), (wanted, "m")))
    table = everything.where(F.col("n") >= least).join(wanted, F.col("word") == F.col("_w"), "left").select("word", "n", F.coalesce("m", F.lit(0)).alias("m"))
    out = materialize(table, "vocabulary")
    discard(everything)
    discard(wanted)
    return out, total, mass


@dataclass(frozen=True)
class Pairs:
    """What tasks hold for the model of all pairs. Tuples are (target, background), counts are scaled to one mass.

    tables: by word before (core, beyond, start) and word (core, beyond), what a token's loss has from counts of core words.
    single: probability of each core word by itself; factor: scale of counts; whole: denominator of a single word.
    """

    core: np.ndarray
    tables: tuple[np.ndarray, np.ndarray]
    single: tuple[np.ndarray, np.ndarray]
    factor: tuple[float, float]
    whole: tuple[float, float]
    parts: int


def _pair_tables(counts: np.ndarray, whole: float) -> tuple[np.ndarray, np.ndarray]:
    """(table, single): the log of the mass behind a core word or a start; less that of the pair if both words are core."""
    size = counts.shape[1]
    single = (counts.sum(axis=0)[:-1] + 1) / whole
    table = np.repeat(np.log(counts.sum(axis=1, keepdims=True) + BACKOFF), size, axis=1)
    table[:, :-1] -= np.log(counts[:, :-1] + BACKOFF * single)
    table[size - 1] = 0
    return table.astype(np.float32).ravel(), single


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values, one for each run of values between cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(array: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values of all runs, length of each run)."""
    offs, data = column_buffers(array)
    return np.frombuffer(data[offs[0] : offs[-1]].tobytes(), kind), np.diff(offs) // np.dtype(kind).itemsize


_PLACES = "part int, chunk long, target boolean, word binary, before binary, before_word binary, behind binary, row binary, asked long"
_LOSSES = "chunk long, answered long, row binary, target_sum binary, background_sum binary, asked long"


def _rows_type(kind: str) -> str:
    return f"ids array<{kind}>, n_tokens array<long>, target_own array<double>, background_own array<double>"


def _send(shared: object, target: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places of words beyond the core by the part that owns the word, and one row of the documents of each chunk.

    A place has the word, the word before it (number in the core, beyond with its hash, or start), the one behind it
    (number in the core, beyond or none) and the document's number in the chunk. Places in the target are only counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Pairs = shared.value
        size = len(model.core) + 1
        held: list[tuple[np.ndarray, ...]] = []
        rows: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        seen = [0, 0, 0]  # tokens and rows held, chunks sent

        def chunk(kind: pa.DataType) -> pa.RecordBatch:
            word, before, behind, row = (np.concatenate(x) for x in list(zip(*held, strict=True))[:4])
            before_word = np.zeros(len(word), _U)
            before_word[before == size - 1] = np.concatenate([x[4] for x in held])
            part = ((word >> _U(32)) * _U(model.parts) >> _U(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            word, before, behind, row, before_word, part = (x[order] for x in (word, before, behind, row, before_word, part))
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            cuts = np.append(starts, len(part))
            beyond = np.concatenate(([0], np.cumsum(before == size - 1)))
            # the same rows in the same order get the same number; in another order, after a lost task, another one
            digest = hashlib.blake2b(np.array([TaskContext.get().partitionId(), seen[2]]).tobytes(), digest_size=8)
            for x in (word, row, *(np.ascontiguousarray(r[k]) for r in rows for k in (1, 2))):
                digest.update(x)
            number = int.from_bytes(digest.digest(), "little", signed=True)
            own = 0 if target else 1
            cuts, parts = (np.append(cuts, cuts[-1]), np.append(part[starts], number % model.parts)) if own else (cuts, part[starts])
            n = len(parts)
            lists = [pa.nulls(n, pa.list_(t)) for t in (kind, pa.int64(), pa.float64(), pa.float64())]
            if own:
                total = sum(len(r[0]) for r in rows)
                ends = pa.array(np.append(np.zeros(n, np.int32), total).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.concat_arrays([r[0] for r in rows]), *(pa.array(np.concatenate([r[k] for r in rows])) for k in (1, 2, 3)))]
            values = [_packed(word, cuts), _packed(before.astype(np.uint16), cuts), _packed(before_word[before == size - 1], beyond[cuts]), _packed(behind.astype(np.uint16), cuts), _packed(row.astype(np.uint16), cuts)]
            asked = pa.array([None] * (n - own) + [len(word)] * own, pa.int64())
            names = [c.split()[0] for c in (_PLACES + ", " + _rows_type("x")).split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(np.full(n, number)), pa.array(np.full(n, target)), *values, asked, *lists], names)

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS // 2):
                piece = batch.slice(at, CHUNK_ROWS // 2)
                for lo, hi, data, offs in blocks(piece.column("_body")):
                    h, _, _, first = words(data, offs, BY_ALNUM)
                    code = _codes(model.core, h, first) if len(h) else np.zeros(0, np.int64)
                    before, now = np.divmod(code, size)
                    behind = np.append(now[1:], 0)
                    behind[first[1:][first[1:] > first[:-1]] - 1] = size
                    place = np.flatnonzero(now == size - 1)
                    row = np.searchsorted(first, place, "right") - 1 + seen[1]
                    held.append((h[place], before[place], behind[place], row, h[place[before[place] == size - 1] - 1]))
                    if not target:
                        sums = []
                        for k in (0, 1):
                            total = np.concatenate(([0.0], np.cumsum(model.tables[k][code], dtype=float)))
                            sums.append(total[first[1:]] - total[first[:-1]])
                        rows.append((piece.column("_id").slice(lo, hi - lo), np.diff(first), *sums))
                    seen[0] += len(place)
                    seen[1] += hi - lo
                    if seen[0] >= CHUNK_TOKENS or seen[1] >= CHUNK_ROWS:
                        yield chunk(batch.column("_id").type)
                        held.clear()
                        rows.clear()
                        seen[:] = [0, 0, seen[2] + 1]
        if held:
            yield chunk(batch.column("_id").type)

    return run


def _answer(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Losses of the places of whole words, added up by document. Rows about documents pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Pairs = shared.value
        size = len(model.core) + 1
        names = [c.split()[0] for c in (_LOSSES + ", " + _rows_type("x")).split(", ")]
        held: list[tuple[np.ndarray, ...]] = []
        lists: list[pa.DataType] = []
        for batch in batches:
            lists = [batch.schema.field(c).type for c in names[6:]]
            word, counts = _unpacked(batch.column("word"), np.uint64)
            before = _unpacked(batch.column("before"), np.uint16)[0]
            prior = before.astype(_U)
            prior[before == size - 1] = _unpacked(batch.column("before_word"), np.uint64)[0]
            held.append((word, prior, *(_unpacked(batch.column(c), np.uint16)[0] for c in ("behind", "row")), counts, batch.column("chunk").to_numpy(), batch.column("target").to_numpy(zero_copy_only=False).astype(bool)))
            about = batch.filter(batch.column("asked").is_valid())
            if about.num_rows:
                n = about.num_rows
                none = pa.array([b""] * n, pa.binary())
                yield pa.RecordBatch.from_arrays([about.column("chunk"), pa.array(np.zeros(n, np.int64)), none, none, none, *(about.column(c) for c in names[5:])], names)
        if not held:
            return
        word, prior, behind, row, counts, chunk, target = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        live = ~np.repeat(target, counts)
        own = np.unique(word, return_inverse=True)[1]
        pair = np.unique(mix(own.astype(_U) * _ODD + prior), return_inverse=True)[1]
        near = np.flatnonzero(behind < size - 1)
        follow = np.unique(own[near] * size + behind[near], return_inverse=True)[1]
        goes_on = behind < size
        del word, prior
        near_live = live[near]
        answer = near[near_live] if len(near) else near
        sums = []
        for k, wanted in enumerate((~live, live)):
            f = model.factor[k]
            count = lambda at, who, f=f: np.bincount(at[who], minlength=int(at.max()) + 1 if len(at) else 0) * f
            single = (count(own, wanted) + 1) / model.whole[k]
            loss = np.where(goes_on, np.log(count(own, wanted & goes_on) + BACKOFF)[own], 0.0)
            loss -= np.log(count(pair, wanted)[pair] + BACKOFF * single[own])
            after = count(follow, wanted[near])[follow[near_live]]
            loss[answer] -= np.log(after + BACKOFF * model.single[k][behind[answer]])
            sums.append(loss[live])
        run_of = np.repeat(np.arange(len(counts)), counts)[live]
        row = row[live]
        new = np.flatnonzero((np.diff(run_of, prepend=-1) != 0) | (np.diff(row.astype(np.int64), prepend=-1) != 0))
        runs = np.flatnonzero(~target & (counts > 0))
        cuts = np.append(np.searchsorted(run_of[new], runs), len(new))
        packed = [_packed(row[new], cuts), *(_packed((np.add.reduceat(s, new) if len(new) else s).astype(np.float32), cuts) for s in sums)]
        n = len(runs)
        yield pa.RecordBatch.from_arrays([pa.array(chunk[runs]), pa.array(counts[runs]), *packed, pa.nulls(n, pa.int64()), *(pa.nulls(n, t) for t in lists)], names)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each document from the answers to its chunk; every place must have been answered."""
    sums: dict[int, np.ndarray] = {}
    answered: dict[int, int] = {}
    about: dict[int, tuple[int, list[pa.Array]]] = {}
    for batch in batches:
        rows, counts = _unpacked(batch.column("row"), np.uint16)
        losses = [_unpacked(batch.column(c), np.float32)[0] for c in ("target_sum", "background_sum")]
        asked = batch.column("asked").to_pylist()
        at = np.concatenate(([0], np.cumsum(counts))).tolist()
        for i, (number, n) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("answered").to_pylist(), strict=True)):
            total = sums.setdefault(number, np.zeros((2, 1 << 16)))
            answered[number] = answered.get(number, 0) + n
            for k in (0, 1):
                total[k, rows[at[i] : at[i + 1]]] += losses[k][at[i] : at[i + 1]]
            if asked[i] is not None:
                about[number] = asked[i], [batch.column(c)[i].values for c in ("ids", "n_tokens", "target_own", "background_own")]
    for number, total in sums.items():
        asked, (ids, n_tokens, *own) = about.get(number, (-1, [None] * 4))
        if asked != answered[number]:
            raise RuntimeError("a lost task was repeated with its rows in another order: run again on a table that was written before")
        yield pa.RecordBatch.from_arrays([ids, n_tokens, *(pa.array(o.to_numpy() + total[k, : len(ids)]) for k, o in enumerate(own))], ["_id", "n_tokens", "target_sum", "background_sum"])


def pair_losses(src: DataFrame, target: DataFrame, core: int = CORE) -> DataFrame:
    """(_id, n_tokens, target_sum, background_sum) of each row of src (_id, _body), from all words and all pairs of words."""
    spark = src.sparkSession
    kind = src.schema["_id"].dataType.simpleString()
    everything = materialize(src.select("_body").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    inner = np.sort(everything.orderBy(F.col("n").desc(), "word").limit(core).toArrow().column("word").to_numpy().view(_U))
    vocabulary = everything.count()
    discard(everything)
    target = materialize(target, "target")
    counts = [bigram_counts(target, inner), bigram_counts(src, inner)]
    mass = [c.sum() for c in counts]
    factor = (1.0, float(mass[0] / mass[1]) if mass[0] else 1.0)
    whole = tuple(float(m * f + vocabulary + 1) for m, f in zip(mass, factor, strict=True))
    tables, single = zip(*(_pair_tables(c * f, w) for c, f, w in zip(counts, factor, whole, strict=True)), strict=True)
    beyond = sum(int(c[:, -1].sum()) for c in counts)
    parts = max(1, -(-beyond // OWNED_TOKENS))
    model = spark.sparkContext.broadcast(Pairs(inner, tables, single, factor, whole, parts))
    sent = f"{_PLACES}, {_rows_type(kind)}"
    places = src.mapInArrow(_send(model, False), sent).unionAll(target.select(F.lit(None).cast(kind).alias("_id"), "_body").mapInArrow(_send(model, True), sent))
    answers = places.repartitionById(parts, "part").mapInArrow(_answer(model), f"{_LOSSES}, {_rows_type(kind)}")
    out = materialize(answers.repartition("chunk").mapInArrow(_gather, f"_id {kind}, n_tokens long, target_sum double, background_sum double"), "scored")
    discard(target)
    return out


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", core: int | None = None, head: int = HEAD, least: int = LEAST_COUNT) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, target_loss, background_loss, score (their difference), whole texts.

    target_ids: a table whose id_col names the target documents; repeats, nulls and unknown ids count for nothing.
    Tokens are runs of ASCII letters, digits and bytes beyond ASCII, A-Z folded. Every word and every pair of words
    counts. A number as core asks for classes: that many words of their own, one class of the others; of words with
    equal counts at the core's edge those with the smaller hash are in it, words below least are one unknown word, and
    tasks hold head words of the others. Texts without tokens, empty and null ones too, get zero losses and score 0.
    Repeated rows are counted and scored each. With no target document the target model is the uniform one. Other
    columns are not read; an empty table gives an empty result; a very long text is read alone.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    src = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("_body"))
    kind = src.schema["_id"].dataType.simpleString()
    wanted = target_ids.select(F.col(id_col).alias("_want")).where("_want IS NOT NULL").distinct()
    # an inner join, since a semi-join would be moved below the bitmap and shuffle every text; merged at every size alike
    target = prefilter(src, "_id", wanted, "_want").join(wanted.hint("merge"), F.col("_id") == F.col("_want")).select("_body")
    if core is None:
        own = pair_losses(src, target)
        mean = lambda name: F.when(F.col("n_tokens") > 0, F.col(name) / F.col("n_tokens")).otherwise(F.lit(0.0))
        out = own.select(F.col("_id").alias(id_col), "n_tokens", mean("target_sum").alias("target_loss"), mean("background_sum").alias("background_loss"))
        return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
    table, total, mass = word_table(src, target, least)
    ratio = mass / total if mass else 1.0
    own = table.orderBy(F.col("n").desc(), "word").limit(core).toArrow()
    inner = np.sort(own.column("word").to_numpy().view(_U))
    outer = table.join(F.broadcast(spark.createDataFrame([(int(w),) for w in inner.view(np.int64)], "_core long")), F.col("word") == F.col("_core"), "left_anti")
    sizes = sorted(((r.n, r["count"]) for r in outer.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().collect()), reverse=True)
    edge, held = 1 << 62, 0
    for n, count in sizes:
        if held + count > head:
            break
        edge, held = n, held + count
    often = outer.where(F.col("n") >= edge).orderBy("word").toArrow()
    rare = outer.where(F.col("n") < edge)
    sums = [sum(own.column(c).to_pylist()) for c in ("n", "m")]
    mass_beyond = ((mass - sums[1]), (total - sums[0]) * ratio)
    items = sum(c for _, c in sizes) + 1
    beyond = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    counts_unknown = (mass - beyond[1], (total - beyond[0]) * ratio)
    loss = lambda count, k: np.log(mass_beyond[k] + items) - np.log(np.asarray(count, float) + 1)
    unknown = tuple(float(loss(counts_unknown[k], k)) for k in (0, 1))
    order = np.argsort(often.column("word").to_numpy().view(_U), kind="stable")
    head_words = often.column("word").to_numpy().view(_U)[order]
    head_losses = tuple(loss(often.column(c).to_numpy()[order] * f, k).astype(np.float32) if len(order) else np.zeros(1, np.float32) for k, (c, f) in enumerate((("m", 1.0), ("n", ratio))))
    slot = f"shiftrightunsigned(word, {64 - FILTER_BITS.bit_length() + 1})"
    packed = rare.select(F.expr(f"cast({slot} div 64 as int)").alias("w"), F.expr(f"shiftleft(1L, cast({slot} % 64 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[packed.column("w").to_numpy()] = packed.column("bits").to_numpy()
    wanted_counts, all_counts = bigram_counts(target, inner), bigram_counts(src, inner) * ratio
    tables = tuple(losses(c).astype(np.float32).ravel() for c in (wanted_counts, all_counts))
    model = spark.sparkContext.broadcast(Shared(inner, tables, head_words, unknown, head_losses, bits.astype("<i8").view(np.uint8)))
    scored = materialize(src.mapInArrow(_score(model), f"_id {kind}, {_SCORED}"), "scored")
    places = scored.where(F.size("words") > 0).select("text_key", F.explode(F.arrays_zip("words", "counts")).alias("_p")).select("text_key", F.col("_p.words").alias("_word"), F.col("_p.counts").alias("_k"))
    step = [F.lit(unknown[k] - float(np.log(mass_beyond[k] + items))) for k in (0, 1)]  # loss of a word minus that of the unknown one
    gains = places.join(rare, F.col("_word") == F.col("word")).select("text_key", (F.col("_k") * (-F.log(F.col("m") + 1.0) - step[0])).alias("a"), (F.col("_k") * (-F.log(F.col("n") * F.lit(ratio) + 1.0) - step[1])).alias("b"), F.lit(0).alias("rows"))
    # rows with equal texts have one key and bring the same words each: their sums are shared out among them
    texts = scored.where(F.size("words") > 0).select("text_key", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1).alias("rows"))
    late = gains.unionByName(texts).groupBy("text_key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("rows").alias("rows")).select(F.col("text_key").alias("_t"), (F.col("a") / F.col("rows")).alias("_a"), (F.col("b") / F.col("rows")).alias("_b"))
    joined = scored.join(late, F.col("text_key") == F.col("_t"), "left")
    mean = lambda own, more: F.when(F.col("n_tokens") > 0, (F.col(own) + F.coalesce(F.col(more), F.lit(0.0))) / F.col("n_tokens")).otherwise(F.lit(0.0))
    out = joined.select(F.col("_id").alias(id_col), "n_tokens", mean("target_sum", "_a").alias("target_loss"), mean("background_sum", "_b").alias("background_loss"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
