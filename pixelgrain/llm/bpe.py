"""BPE encoding and decoding with forced-boundary splitting.

Merges only ever build tokens of the vocabulary, so a byte pair that stands inside no token is never joined: it marks a
certain cut. Words are cut at all such pairs, the fragments are encoded independently (each distinct one once while it
stays in a bounded cache), and the results are put together again. Only the last fragment of a word carries the
end-of-word mark: its last byte is spelt by a letter of its own, so one model without marks serves all fragments.
Normalising and word splitting follow the tokenizer file; texts outside plain Latin letters use the library's own
normaliser and splitter.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from ._base import bound_batches
from ._text import column_buffers, list_array

#: Words that a worker remembers, some 200 bytes each, and those that are encoded at once, some 2 KB each meanwhile.
CACHED_WORDS, LEARNT_WORDS = 120_000, 4096
RUN_BYTES = 1 << 18

#: Latin letters that fold one to one and that NFC leaves alone, white space and printable ASCII: the fast path's range.
_LETTERS = "a-zß-öø-įı-ž"
_OTHER = re.compile("[^\t-\r -~À-ÖØ-öø-įı-ňŊ-ž]")
_WORD = re.compile(f"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTERS}0-9]+")

#: The normaliser and the splitter that the fast path stands for.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that spell the last byte of a word begin here (a private-use area, which byte letters never reach).
_LAST = 0xE000


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte: printable ones stand for themselves, others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Index(dict):
    """Number of each word in order of its first look-up; new words are noted for learning."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Store:
    """Sequences one after the other, taken out many at once."""

    def __init__(self, kind: type) -> None:
        self.data, self.ends = np.zeros(0, kind), np.zeros(1, np.int64)

    def extend(self, items: list) -> None:
        sizes = np.fromiter(map(len, items), np.int64, len(items))
        self.data = np.concatenate((self.data, np.fromiter(chain.from_iterable(items), self.data.dtype, int(sizes.sum()))))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the sequences in order, end of each of them)."""
        starts = self.ends[numbers]
        sizes = self.ends[numbers + 1] - starts
        ends = np.cumsum(sizes)
        return self.data[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


def check_kind(body: dict) -> None:
    """Refuse tokenizer files whose rules are not those of the fast path."""
    model = body["model"]
    steps = [s.get("type") for s in (body.get("normalizer") or {}).get("normalizers", [])]
    split = (body.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if model.get("type", "BPE") != "BPE" or not plain or not model.get("end_of_word_suffix") or steps != NORMALIZER or split[0].get("pattern", {}).get("Regex") != WORDS or [s.get("type") for s in split] != ["Split", "ByteLevel"] or body.get("decoder"):
        raise ValueError("not a lower-case byte-level BPE file with word ends")


class Codec:
    """Encoder and decoder for a tokenizer file of the word-end BPE kind, given as its JSON text."""

    def __init__(self, spec: str) -> None:
        body = json.loads(spec)
        check_kind(body)
        model = body.pop("model")
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        added = body.get("added_tokens") or []
        self.rules = Tokenizer.from_str(json.dumps(body | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.model = Tokenizer(BPE({self._spelt(t): i for t, i in vocab.items()}, [(self._spelt(a), self._spelt(b)) for a, b in merges]))
        self.joined = self._joined_pairs(vocab)
        self.spelling = dict(enumerate(self.letters))
        self.last_letter = {c: chr(_LAST + b) for c, b in self.byte_of.items()}
        self.letters_of = Store(np.uint8)  # spelling of each id, with the space that decoding puts behind it
        names = {i: t for t, i in [*vocab.items(), *((t["content"], t["id"]) for t in added)]}
        self.letters_of.extend([f"{names.get(i, '')} ".encode() for i in range(max(names) + 1)])
        self.special = {t["content"]: t["id"] for t in added}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._forget()

    def _spelt(self, token: str) -> str:
        bare = token.removesuffix(self.suffix)
        return bare[:-1] + chr(_LAST + self.byte_of[bare[-1]]) if bare != token else token

    def _joined_pairs(self, vocab: dict[str, int]) -> np.ndarray:
        joined = np.zeros((256, 256), bool)
        for token in vocab:
            own = [self.byte_of[c] for c in token.removesuffix(self.suffix) if c in self.byte_of]
            joined[own[:-1], own[1:]] = True
        return joined

    def _forget(self) -> None:
        self.index, self.ids = Index(), Store(np.int32)
        for text, i in self.special.items():
            self.index["\0" + text] = len(self.index)
            self.ids.extend([[i]])

    def fragments(self, words: list[str]) -> tuple[list[str], dict[int, list[str]]]:
        """(words in byte letters, fragments between forced cuts of those words that have any).

        The pairs of all words are looked up at once.
        """
        raw = [w.encode() for w in words]
        spelt = [w if w.isascii() and w.isprintable() and " " not in w else r.decode("latin-1").translate(self.spelling) for w, r in zip(words, raw, strict=True)]
        codes = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        apart = ~self.joined[codes[:-1], codes[1:]]
        apart[ends[:-1] - 1] = False
        where = np.flatnonzero(apart) + 1
        owner = np.searchsorted(ends, where, "right")
        cuts: dict[int, list[int]] = {}
        for k, at in zip(owner.tolist(), (where - (ends[owner] - [len(raw[k]) for k in owner.tolist()])).tolist(), strict=True):
            cuts.setdefault(k, []).append(at)
        return spelt, {k: [spelt[k][a:b] for a, b in zip([0, *at], [*at, len(spelt[k])], strict=True)] for k, at in cuts.items()}

    def words(self, text: str) -> list[str]:
        """Normalised words in order; the keys of the cache."""
        pieces = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
        out: list[str] = []
        for k, piece in enumerate(pieces):
            if k % 2:
                out.append("\0" + piece)
            elif _OTHER.search(piece):
                normal = self.rules.normalizer.normalize_str(piece)
                out += [bytes(self.byte_of[c] for c in w).decode() for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(normal)]
            elif piece:
                out += _WORD.findall(piece.lower())
        return out

    def learn(self, new: list[str]) -> None:
        """Encode words that the cache lacks."""
        tails, cut = self.fragments(new)
        for k, parts in cut.items():
            tails[k] = parts[-1]
        heads = list({f for parts in cut.values() for f in parts[:-1]})
        ends = [t[:-1] + self.last_letter[t[-1]] for t in tails]
        gc.disable()  # a great many small objects without cycles
        try:
            done = [e.ids for e in self.model.encode_batch_fast(heads + ends, add_special_tokens=False)]
            inner, last = dict(zip(heads, done, strict=False)), done[len(heads) :]
            for k, parts in cut.items():
                last[k] = [i for f in parts[:-1] for i in inner[f]] + last[k]
            self.ids.extend(last)
        finally:
            gc.enable()

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(ids of all texts, number of ids of each text, decoded texts)."""
        if len(self.index) > CACHED_WORDS:
            self._forget()
        look = self.index.__getitem__
        own = [np.fromiter(map(look, words), np.int64, len(words)) for words in map(self.words, texts)]
        new, self.index.new = self.index.new, []
        for k in range(0, len(new), LEARNT_WORDS):
            self.learn(new[k : k + LEARNT_WORDS])
        numbers = np.concatenate(own)
        last = np.cumsum([len(x) for x in own])
        ids, ends = self.ids.take(numbers)
        stop = np.concatenate(([0], ends))[last]
        letters, ends = self.letters_of.take(ids)
        stops = np.concatenate(([0], ends))[stop].tolist()
        spelt = letters.tobytes()
        return ids, np.diff(stop, prepend=0), [spelt[a : max(a, b - 1)] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


_codecs: dict[bytes, Codec] = {}


def worker_codec(spec: str) -> Codec:
    """The codec of a file, kept by the worker that runs many tasks with it; only the one used last.

    A function of the module and not part of the task's closure, which would carry a copy of the dictionary. A task has
    one core, so the library's own threads would only add memory.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    own = hashlib.sha256(spec.encode()).digest()
    if own not in _codecs:
        _codecs.clear()
        _codecs[own] = Codec(spec)
    return _codecs[own]


def _encode(spec: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """spec: broadcast of the file's JSON text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(spec.value)
        for batch in batches:
            texts = batch.column("_text")
            offs, _ = column_buffers(texts)
            lo, n = 0, len(texts)
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + RUN_BYTES, "right")) - 1)
                ids, counts, decoded = codec.run(texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(lo, hi - lo), list_array(ids, counts), pa.array(decoded, pa.binary()).cast(pa.string())], ["_id", "ids", "decoded"])
                lo = hi

    return run


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids array<int>, decoded string; whole texts.

    The tokenizer file is read on the driver and broadcast (its size is that of the vocabulary); files whose rules are
    not those of this codec are refused. Null texts count as empty and give no ids, and a text of white space decodes to
    an empty one. Strings of special tokens inside a text become their ids, as in the library. Null or repeated ids pass
    through row by row; other columns of docs are not read; an empty table gives an empty result. A very long text is
    encoded alone.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    check_kind(json.loads(spec))
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(_encode(docs.sparkSession.sparkContext.broadcast(spec)), f"_id {kind}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode's result."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
