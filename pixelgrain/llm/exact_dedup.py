"""Exact dedup by content-defined chunk recipes.

A text is normalised (every character of ``[\\x20\\x09-\\x0D]`` deleted) and cut where a rolling hash of the last bytes
matches a mask, so equal texts give equal chunk lists wherever they stand. Chunks are deduplicated to verified
identifiers: each distinct chunk body travels through one shuffle and is compared under its digest. Documents are then
compared by their ordered identifier lists alone, some 16 bytes per chunk instead of the text. If two bodies ever share
a digest, documents with such a chunk are compared by their whole normalised text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import bound_batches, materialize, text_bytes, without_rows
from ._text import SPACES, mix

MIN_CHUNK, MASK_BITS, MAX_CHUNK = 512, 11, 16384
_GEAR = mix(np.arange(7, 263, dtype=np.uint64)).astype(np.uint32)
_SEEN_BYTES = 24 << 20


def cut_points(body: bytes) -> list[int]:
    """Ends of the chunks of a normalised text: at content-defined places at least MIN_CHUNK apart, at most MAX_CHUNK."""
    n = len(body)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _GEAR[np.frombuffer(body, np.uint8)]
    span = 1
    while span < 32:  # doubling: after each pass h covers twice as many bytes; older bytes have left the 32 bits by then
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    ends, last = [], 0
    for p in (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist():
        while p - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if p - last >= MIN_CHUNK:
            ends.append(p)
            last = p
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if n > last:
        ends.append(n)
    return ends


def chunks(body: bytes, digest_bytes: int) -> Iterator[tuple[bytes, bytes]]:
    start = 0
    for end in cut_points(body):
        part = body[start:end]
        yield hashlib.blake2b(part, digest_size=digest_bytes).digest(), part
        start = end


def _recipes(digest_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, lists = [], []
            for raw in batch.column("_body"):
                body = raw.as_py().translate(None, SPACES)
                shas.append(hashlib.sha256(body).hexdigest())
                lists.append(b"".join(d for d, _ in chunks(body, digest_bytes)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_length"), pa.array(shas, pa.string()), pa.array(lists, pa.binary())], ["_id", "_length", "_sha", "_recipe"])

    return run


def _bodies(digest_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of the texts; a chunk that this task sent lately, and that is byte for byte the same, is not sent again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            digests, bodies = [], []
            for raw in batch.column("_body"):
                for digest, part in chunks(raw.as_py().translate(None, SPACES), digest_bytes):
                    if seen.get(digest) == part:
                        continue
                    if held > _SEEN_BYTES:
                        seen.clear()
                        held = 0
                    seen[digest] = part
                    held += len(part) + 120
                    digests.append(digest)
                    bodies.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], ["_digest", "_chunk"])

    return run


def ambiguous_digests(docs: DataFrame, text_col: str = "text", digest_bytes: int = 16) -> DataFrame:
    """Digests that stand for more than one chunk body. One exchange by digest; both aggregates use it."""
    bodies = docs.select(text_bytes(text_col).alias("_body")).mapInArrow(_bodies(digest_bytes), "_digest binary, _chunk binary")
    one_each = bodies.repartition("_digest").groupBy("_digest", "_chunk").agg(F.lit(1).alias("_one"))
    return one_each.groupBy("_digest").count().where("count > 1").select("_digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are those that are identical without white space. Of a group the row with the most code points of the
    original text, then the smallest id stays; a null id comes after all others. Null texts count as empty, and all empty
    texts are one group. Rows that are alike in id, length and normalised text share their fate. A very long text is cut
    into chunks like any other. Other columns of docs are not read, whatever their names. An empty table gives an empty
    result.
    """
    return _groups(docs, id_col, text_col, digest_bytes).drop("_length")


def _groups(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int = 16) -> DataFrame:
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("long").alias("_length"), text_bytes(text_col).alias("_body"))
    id_type = src.schema["_id"].dataType.simpleString()
    recipes = materialize(src.mapInArrow(_recipes(digest_bytes), f"_id {id_type}, _length long, _sha string, _recipe binary"), "recipes")
    ambiguous = materialize(ambiguous_digests(docs, text_col, digest_bytes), "ambiguous")
    keyed = recipes.withColumn("_text", F.lit(None).cast("binary"))
    if not ambiguous.isEmpty():
        keyed = _by_whole_text(docs, recipes, ambiguous, text_col, digest_bytes)
    best = keyed.groupBy("_recipe", "_text").agg(F.min(F.struct((-F.col("_length")).alias("_minus"), F.col("_id").isNull().alias("_none"), F.col("_id").alias("_first"))).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    best = best.select(F.col("_recipe").alias("_r"), F.col("_text").alias("_t"), F.col("_best._first").alias("keep_id"), (-F.col("_best._minus")).alias("_most"), "group_size")
    same = (F.col("_recipe") == F.col("_r")) & F.col("_text").eqNullSafe(F.col("_t"))
    kept = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_length") == F.col("_most"))
    return keyed.join(best, same).select(F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("_sha").alias("text_sha256"), "_length")


def _by_whole_text(docs: DataFrame, recipes: DataFrame, ambiguous: DataFrame, text_col: str, digest_bytes: int) -> DataFrame:
    """recipes with the normalised text beside those lists that hold an ambiguous digest."""
    n = digest_bytes
    parts = F.expr(f"transform(filter(sequence(0, cast(length(_recipe) div {n} as int)), i -> i * {n} < length(_recipe)), i -> substring(_recipe, i * {n} + 1, {n}))")
    marked = recipes.select("_sha", F.explode(parts).alias("_digest")).join(ambiguous, "_digest", "left_semi").select("_sha").distinct()
    texts = docs.select(_normal(text_col).alias("_text")).withColumn("_own", F.sha2("_text", 256))
    texts = texts.join(marked, F.col("_own") == F.col("_sha"), "left_semi").groupBy("_own", "_text").agg(F.lit(1).alias("_one")).select("_own", "_text")
    plain = recipes.join(marked, "_sha", "left_anti").withColumn("_text", F.lit(None).cast("binary"))
    return plain.unionByName(recipes.join(texts, F.col("_sha") == F.col("_own")).drop("_own"))


def _normal(text_col: str) -> F.Column:
    return F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), SPACES.decode(), "").cast("binary")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops, columns as they were; of rows that it can't tell apart one stays.

    Rows go by id, length and normalised text, so rows that repeat an id with another text are judged by their own. Null
    and empty texts are copies of each other. An empty table stays empty; no column name of docs is in the way.
    """
    groups = materialize(_groups(docs, id_col, text_col).select(F.col(id_col).alias("_i"), F.col("_length").alias("_l"), F.col("text_sha256").alias("_s"), "kept"), "groups")
    per_key = groups.groupBy("_i", "_l", "_s").agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    again = materialize(per_key.where("_kept AND _n > 1").select("_i", "_l", "_s"), "again")
    gone = per_key.where("NOT _kept OR _n > 1").select("_i", "_l", "_s")
    keys = [F.col(f"`{id_col}`"), F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).cast("long"), F.sha2(_normal(text_col), 256)]
    once = without_rows(docs, gone, keys)
    if again.isEmpty():
        return once
    names = [f"_key_{k}_{uuid.uuid4().hex[:8]}" for k in range(3)]
    rows = docs.withColumns(dict(zip(names, keys, strict=True)))
    same = F.col(names[0]).eqNullSafe(F.col("_i")) & (F.col(names[1]) == F.col("_l")) & (F.col(names[2]) == F.col("_s"))
    return once.unionAll(rows.join(again.toDF("_i", "_l", "_s"), same, "left_semi").dropDuplicates(names).select(*(F.col(f"`{c}`") for c in docs.columns)))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), g AS (
  SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
