"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

SuperMinHash gives every element a random permutation of the signature's slots; the slot that the permutation visits
at step j gets the rank j plus a fraction, so the slots of one element are correlated and the estimate varies less than
with independent hashes. Once every slot of a document holds a value of a lower step, later steps can't change it and
the work stops: about one step for a long text, as many as there are slots for a one-word text. Steps run over all
elements of a block of documents at once.

Documents with the same shingle set are one class and take part once. A band's bucket is never expanded into all of
its pairs. Its members are verified against its smallest member, against its most central one (the one that shares the
most buckets) and against their two neighbours in the order of the following bands, a fixed number of pairs per row
however large the bucket is. Copies of one text are linked through its hubs, copies of a copy through their neighbours.
Members that are still in different components are then all compared with each other: in small buckets pair by pair,
in large ones in tiles of two blocks of members, whose intersections are counted by matrix products over the shingles
that stand in both blocks. So every pair that shares a bucket is compared or already in one component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import bound_batches, discard, materialize, prefilter, text_bytes, without_rows
from ._text import BLOCK, blocks, list_array, mix, shingle_sets, words
from .components import UnionFind, connected_components

SLOTS, BANDS, SHINGLE = 128, 32, 5
PERCENT = 75
#: Members verified beside one copy of a hub's text; larger hubs get more copies, on other tasks.
HUB_ROWS = 256
#: Buckets of up to so many members are compared pair by pair where links leave them in several components.
SMALL_BUCKET = 16
#: Members and shingles of a block of a larger bucket (a longer text is more); every two blocks are compared in a task.
TILE_ROWS, TILE_SHINGLES = 4096, 1 << 19
#: Members of a block that are multiplied at once, shingles that are, and single matches that are counted at once.
PART, LANES, MATCHES = 512, 4096, 1 << 22

_U = np.uint64
_STEP = mix(np.arange(5001, 5001 + 256, dtype=_U))


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures of sets of 64-bit hashes, one row each; rows of empty sets hold the largest value everywhere."""
    n = len(sets)
    sig = np.full(n * slots, ~_U(0), _U)
    sizes = np.array([len(s) for s in sets], np.int64)
    x = np.concatenate(sets) if n else np.zeros(0, _U)
    base = np.repeat(np.arange(n, dtype=np.int64) * slots, sizes)
    perm = None
    for j in range(slots):
        if not len(x):
            break
        r = mix(x ^ _STEP[j])
        pick = j + ((r & _U(0xFFFFFFFF)) * _U(slots - j) >> _U(32)).astype(np.int64)
        value = (r >> _U(32)) | _U(j << 32)
        if j == 0:
            slot, first = pick, pick
        else:
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1))
                rows = np.arange(len(x))
                perm[rows, first] = 0
                perm[:, 0] = first
            rows = np.arange(len(x))
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(sig, base + slot, value)
        open_docs = (sig.reshape(n, slots).max(axis=1) >> _U(32)) > _U(j)
        keep = open_docs[base // slots]
        if not keep.all():
            x, base = x[keep], base[keep]
            first = first[keep] if perm is None else first
            perm = perm[keep] if perm is not None else None
    return sig.reshape(n, slots)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band; equal keys of a band mean equal slots."""
    n, slots = sig.shape
    rows = slots // bands
    lanes = mix(np.arange(9001, 9001 + slots, dtype=_U)).reshape(bands, rows) | _U(1)
    mixed = mix(sig[:, : bands * rows]).reshape(n, bands, rows)
    return mix((mixed * lanes).sum(axis=2, dtype=_U) + mix(np.arange(301, 301 + bands, dtype=_U)))


def _sketches(shingle: int, slots: int, bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column("_id"), batch.column("_body")
            for lo, hi, data, offs in blocks(text, BLOCK // 2):
                h, _, _, first = words(data, offs)
                sets = shingle_sets(h, first, shingle)
                keys = band_keys(super_minhash(sets, slots), bands).astype(np.int64)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), list_array(keys.ravel(), np.full(hi - lo, bands))],
                    ["_id", "_n", "_set", "_bands"],
                )

    return run


def _verified(shingle: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted: a hub's text, then the texts to compare with it. Only the hub's set is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, salt, hub_set = None, None, None
        for batch in batches:
            a, b, hubs, salts = [], [], batch.column("_hub").to_pylist(), batch.column("_salt").to_pylist()
            ids, heads = batch.column("_id").to_pylist(), batch.column("_member").to_pylist()
            for lo, hi, data, offs in blocks(batch.column("_body")):
                h, _, _, first = words(data, offs)
                sets = shingle_sets(h, first, shingle)
                for i in range(lo, hi):
                    s = sets[i - lo]
                    if not heads[i]:
                        hub, salt, hub_set = hubs[i], salts[i], s
                    elif hubs[i] == hub and salts[i] == salt:
                        both = len(np.intersect1d(hub_set, s, assume_unique=True))
                        if both and 100 * both >= percent * (len(hub_set) + len(s) - both):
                            a.append(hub)
                            b.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verify_pairs(docs: DataFrame, pairs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Pairs (hub, member) of ids whose full shingle sets are similar enough, as (a, b). docs: _id, _body.

    A hub with many members is salted: each HUB_ROWS of them get a copy of its text, so neither a hot hub nor a long
    text lands in one task.
    """
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("_count")).select(F.col("hub").alias("_h"), F.ceil(F.col("_count") / HUB_ROWS).cast("int").alias("_salts"))
    members = pairs.join(sizes, F.col("hub") == F.col("_h")).select(F.col("member").alias("_want"), F.col("hub").alias("_hub"), F.pmod(F.xxhash64("member"), F.col("_salts")).cast("int").alias("_salt"), F.lit(1).alias("_member"))
    hubs = sizes.select(F.col("_h").alias("_want"), F.col("_h").alias("_hub"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.lit(0).alias("_member"))
    wanted = materialize(members.unionByName(hubs), "wanted")
    rows = prefilter(docs, "_id", wanted, "_want").join(wanted, F.col("_id") == F.col("_want")).select("_hub", "_salt", "_member", "_id", "_body")
    dealt = rows.repartition("_hub", "_salt").sortWithinPartitions("_hub", "_salt", "_member")
    links = materialize(dealt.mapInArrow(_verified(shingle, percent), "a long, b long"), "links")
    discard(wanted)
    return links


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of one bucket that follow each other, directly or with one row between, in sorted order."""
    key, cls = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key, cls = np.concatenate((key[-2:], batch.column("key").to_numpy())), np.concatenate((cls[-2:], batch.column("_class").to_numpy()))
        for gap in (1, 2):
            same = key[gap:] == key[:-gap]
            a, b = cls[gap:][same], cls[:-gap][same]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["hub", "member"])


def candidate_pairs(buckets: DataFrame) -> DataFrame:
    """(hub, member) pairs of buckets (key, _class, order): a fixed number per row."""
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("_size"), F.min("_class").alias("_lead")).select(F.col("key").alias("_k"), "_size", "_lead")
    rows = materialize(buckets.join(sizes, F.col("key") == F.col("_k")).select("key", "_class", "_size", "_lead"), "sized")
    weight = rows.groupBy("_class").agg(F.sum("_size").alias("_weight")).select(F.col("_class").alias("_c"), "_weight")
    central = rows.join(weight, F.col("_class") == F.col("_c")).groupBy("key").agg(F.max(F.struct("_weight", (-F.col("_class")).alias("_minus"))).alias("_best")).select(F.col("key").alias("_k"), (-F.col("_best._minus")).alias("hub"))
    stars = rows.select(F.col("_lead").alias("hub"), F.col("_class").alias("member"))
    stars = stars.unionByName(rows.join(central, F.col("key") == F.col("_k")).select("hub", F.col("_class").alias("member")))
    order = ["key", "order", "_class"]
    beside = buckets.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "_class").mapInArrow(_neighbours, "hub long, member long")
    pairs = stars.unionByName(beside).where("hub <> member")
    return materialize(pairs.groupBy("hub", "member").agg(F.lit(1).alias("_x")).select("hub", "member"), "pairs")


def small_bucket_pairs(buckets: DataFrame, labels: DataFrame, most: int = SMALL_BUCKET) -> DataFrame:
    """Pairs of different components within buckets of at most so many members."""
    named = buckets.join(labels, F.col("_class") == F.col("node"), "left").select("key", "_class", F.coalesce("component", "_class").alias("comp"))
    open_ = named.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count(F.lit(1)).alias("_size")).where(f"_low < _high AND _size BETWEEN 3 AND {most}").select(F.col("key").alias("_k"))
    rows = named.join(open_, F.col("key") == F.col("_k"), "left_semi")
    lists = rows.groupBy("key").agg(F.collect_list(F.struct("_class", "comp")).alias("_m"))
    pair = F.expr("explode(flatten(transform(_m, a -> transform(filter(_m, b -> a._class < b._class AND a.comp <> b.comp), b -> struct(a._class AS hub, b._class AS member)))))")
    return materialize(lists.select(pair.alias("_p")).select("_p.*").groupBy("hub", "member").agg(F.lit(1).alias("_x")).select("hub", "member"), "pairs")


def _overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n_a: int, n_b: int) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, each given as (codes, rows): n_a x n_b.

    Codes that many sets hold go through matrix products, the others are counted match by match.
    """
    out = np.zeros(n_a * n_b, np.float32)
    (code_a, row_a), (code_b, row_b) = a, b
    sides = []
    both = np.intersect1d(code_a, code_b)
    for code, row in (a, b):
        at = np.searchsorted(both, code)
        real = at < len(both)
        real[real] = both[at[real]] == code[real]
        sides.append((at[real], row[real]))
    (at_a, row_a), (at_b, row_b) = sides
    f_a, f_b = np.bincount(at_a, minlength=len(both)), np.bincount(at_b, minlength=len(both))
    common = 64 * f_a * f_b >= n_a * n_b
    place = np.where(common, np.cumsum(common) - 1, -1)
    for lo in range(0, int(common.sum()), LANES):
        dense = []
        for at, row, n in ((at_a, row_a, n_a), (at_b, row_b, n_b)):
            lane = place[at] - lo
            own = (lane >= 0) & (lane < LANES) & common[at]
            m = np.zeros((n, LANES if lo + LANES < common.sum() else int(common.sum()) - lo), np.float32)
            m[row[own], lane[own]] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).ravel()
    rare_a, rare_b = ~common[at_a], ~common[at_b]
    at_a, row_a, at_b, row_b = at_a[rare_a], row_a[rare_a], at_b[rare_b], row_b[rare_b]
    order = np.argsort(at_b, kind="stable")
    at_b, row_b = at_b[order], row_b[order]
    begin = np.searchsorted(at_b, at_a)
    many = np.searchsorted(at_b, at_a, "right") - begin
    ends = np.cumsum(many)
    lo = 0
    while lo < len(at_a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MATCHES, "right")))
        m = many[lo:hi]
        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        cell = np.repeat(row_a[lo:hi], m) * n_b + row_b[np.repeat(begin[lo:hi], m) + inner]
        out += np.bincount(cell, minlength=n_a * n_b).astype(np.float32)
        lo = hi
    return out.reshape(n_a, n_b)


def _tile_links(ids: np.ndarray, comps: np.ndarray, blocks_: np.ndarray, sets: list[np.ndarray], crossed: bool, percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, as many as join what can be joined.

    In a tile of two blocks only members of different blocks are compared, in a tile of one block all of them.
    """
    order = np.lexsort((comps, blocks_))
    ids, comps, blocks_, sets = ids[order], comps[order], blocks_[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets], np.int64)
    _, codes, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    rows = np.repeat(np.arange(len(sets)), sizes)

    def part(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        code, row = codes[ends[lo] : ends[hi]], rows[ends[lo] : ends[hi]] - lo
        return code[count[code] > 1], row[count[code] > 1]

    split = int(np.searchsorted(blocks_, blocks_[0], "right")) if crossed else len(ids)
    parts = [(lo, min(lo + PART, split)) for lo in range(0, split, PART)]
    others = [(lo, min(lo + PART, len(ids))) for lo in range(split, len(ids), PART)] if crossed else parts
    joined, links = UnionFind(), []
    for a, b in parts:
        for c, d in others:
            if not crossed and c < a or comps[a:b].min() == comps[a:b].max() == comps[c:d].min() == comps[c:d].max():
                continue
            both = _overlaps(part(a, b), part(c, d), b - a, d - c).astype(np.int64)
            near = (both > 0) & (100 * both >= percent * (sizes[a:b, None] + sizes[None, c:d] - both)) & (comps[a:b, None] != comps[None, c:d])
            for i, j in np.argwhere(near).tolist():
                x, y = int(comps[a + i]), int(comps[c + j])
                if joined.find(x) != joined.find(y):
                    joined.union(x, y)
                    links.append((int(ids[a + i]), int(ids[c + j])))
    return links


def _tiled(shingle: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, sets = None, [], []

        def finished() -> pa.RecordBatch:
            ids, comps, own = (np.array([h[k] for h in held], np.int64) for k in range(3))
            links = _tile_links(ids, comps, own, sets, tile[1] != tile[2], percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        for batch in batches:
            tiles = list(zip(*(batch.column(k).to_pylist() for k in ("_tile", "_i", "_j")), strict=True))
            members = list(zip(*(batch.column(k).to_pylist() for k in ("_id", "_comp", "_block")), strict=True))
            for lo, hi, data, offs in blocks(batch.column("_body")):
                h, _, _, first = words(data, offs)
                for i, s in zip(range(lo, hi), shingle_sets(h, first, shingle), strict=True):
                    if tiles[i] != tile:
                        if held:
                            yield finished()
                        tile, held, sets = tiles[i], [], []
                    held.append(members[i])
                    sets.append(s)
        if held:
            yield finished()

    return run


def large_bucket_links(docs: DataFrame, buckets: DataFrame, sizes: DataFrame, labels: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, least: int = SMALL_BUCKET + 1, rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) between different components within buckets of at least so many members: all pairs are compared.

    docs: _id, _body; sizes: _id, _n. Members are dealt to blocks by their hashed ids and a task compares two blocks.
    """
    named = buckets.join(labels, F.col("_class") == F.col("node"), "left").select("key", "_class", F.coalesce("component", "_class").alias("comp"))
    lengths = sizes.groupBy("_id").agg(F.sum("_n").alias("_n")).select(F.col("_id").alias("_own"), "_n")
    named = materialize(named.join(lengths, F.col("_class") == F.col("_own")).select("key", "_class", "comp", "_n"), "named")
    deal = F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum("_n") / TILE_SHINGLES)).cast("int")
    open_ = named.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count(F.lit(1)).alias("_size"), deal.alias("_deal")).where(f"_low < _high AND _size >= {least}").select(F.col("key").alias("_k"), "_deal")
    dealt = named.join(open_, F.col("key") == F.col("_k")).withColumn("_block", F.pmod(F.xxhash64("_class"), F.col("_deal")).cast("int"))
    tiles = F.explode(F.expr("transform(sequence(0, _deal - 1), k -> struct(least(k, _block) AS i, greatest(k, _block) AS j))"))
    wanted = materialize(dealt.select(F.col("_class").alias("_want"), F.col("key").alias("_tile"), F.col("comp").alias("_comp"), "_block", tiles.alias("_t")).select("_want", "_tile", "_comp", "_block", F.col("_t.i").alias("_i"), F.col("_t.j").alias("_j")), "wanted")
    discard(named)
    texts = prefilter(docs, "_id", wanted, "_want").join(wanted, F.col("_id") == F.col("_want")).select("_tile", "_i", "_j", "_id", "_comp", "_block", "_body")
    order = ["_tile", "_i", "_j"]
    links = materialize(texts.repartition(*order).sortWithinPartitions(*order).mapInArrow(_tiled(shingle, percent), "a long, b long"), "links")
    discard(wanted)
    return links


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` after folding A-Z; a set is the distinct shingles of that many words,
    or the whole sequence of a shorter text. Documents with 100 * intersection >= percent * union are linked;
    component_id is the smallest id that links reach. Null or empty texts have an empty set and stand alone. Rows with
    a null id come out with a null component and are not kept. Rows that repeat an id share its component; of a
    repeated id with different texts every text may link. Other columns of docs are not read. Shingles are 64-bit
    hashes. A pair at exactly 75 % is missed by all 32 bands with probability 5e-6; pairs that share a band are all
    compared unless other links join them already.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_body"))
    sketches = materialize(src.mapInArrow(_sketches(shingle, slots, bands), "_id long, _n long, _set binary, _bands array<long>"), "sketches")
    classes = sketches.where("_n > 0 AND _id IS NOT NULL").groupBy("_set").agg(F.min("_id").alias("_class")).select(F.col("_set").alias("_s"), "_class")
    members = materialize(
        sketches.where("_n > 0 AND _id IS NOT NULL").join(classes, F.col("_set") == F.col("_s")).select("_id", "_n", "_class", F.when(F.col("_id") == F.col("_class"), F.col("_bands")).alias("_bands"))
        .unionByName(sketches.where("_n = 0 OR _id IS NULL").select("_id", "_n", F.col("_id").alias("_class"), F.lit(None).cast("array<long>").alias("_bands"))),
        "members",
    )
    discard(sketches)
    wheel = F.expr(f"transform(_bands, (k, i) -> struct(k AS key, array(_bands[(i + 1) % {bands}], _bands[(i + 2) % {bands}]) AS order))")
    keys = members.where("_bands IS NOT NULL").select("_class", F.explode(wheel).alias("_b")).select("_class", "_b.key", "_b.order")
    shared = keys.groupBy("key").agg(F.min("_class").alias("_low"), F.max("_class").alias("_high")).where("_low < _high").select(F.col("key").alias("_k"))
    shared = materialize(shared, "shared")
    buckets = materialize(prefilter(keys, "key", shared, "_k", 1 << 24).join(shared, F.col("key") == F.col("_k"), "left_semi"), "buckets")
    discard(shared)
    bodies = src.where("_id IS NOT NULL")
    links = verify_pairs(bodies, candidate_pairs(buckets), shingle, percent)
    labels = materialize(connected_components(links), "labels")
    rest = small_bucket_pairs(buckets, labels)
    more = links.limit(0) if rest.isEmpty() else verify_pairs(bodies, rest, shingle, percent)
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = materialize(connected_components(links), "labels")
    rest = large_bucket_links(bodies, buckets, members.select("_id", "_n"), labels, shingle, percent)
    if not rest.isEmpty():
        labels = materialize(connected_components(links.unionByName(rest)), "labels")
    out = members.join(labels, F.col("_class") == F.col("node"), "left")
    component = F.coalesce(F.col("component"), F.col("_class"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group, the one with the smallest id; columns as they were.

    Rows that repeat an id stay or go together: they stay if one of them does. Rows with a null id, null or empty texts
    stay. An empty table stays empty; no column name of docs is in the way.
    """
    groups = near_groups(docs, id_col, text_col).where(F.col(id_col).isNotNull())
    gone = groups.groupBy(id_col).agg(F.max("kept").alias("_kept")).where(~F.col("_kept")).select(id_col)
    return without_rows(docs, gone, [F.col(f"`{id_col}`").cast("long")])
