"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are split into special tokens and words; the distinct words of a slice of
a partition are laid out in one symbol array with links to the neighbours. An
index maps each mergeable pair to all its positions. The ranks that occur are
applied in ascending order, each to all its positions at once; a merge only
touches the lists of the pairs left and right of it. Documents are then read
off as sequences of their words' ids.

The vocabulary (a tokenizers JSON file, a few MB whatever the input) is read by
the driver and broadcast. A slice holds about ``SLICE_CHARS`` characters of
whole texts, which bounds a worker's memory, as texts reach it in batches of bounded
bytes; a longer text is a slice of its own.

Defined results: a null text counts as empty and gives no ids; a repeated row is
encoded as often as it occurs; an empty table gives an empty result; all other
columns are passed through unread.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_batches
from .words import decimal_table, decimals, releasing

SLICE_CHARS = 3_000_000

# Fixed value: the pattern that byte-level vocabularies of this kind split words by.
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def _byte_chars() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary: printable bytes themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, before = spec["model"], spec["pre_tokenizer"]
        if (model["type"], before["type"], spec["normalizer"]) != ("BPE", "ByteLevel", None) or before["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that strip or match single words are not supported")
        vocab, byte_of = model["vocab"], _byte_chars()
        self.size = max([*vocab.values(), *(t["id"] for t in added)]) + 1
        self.tokens = [b""] * self.size
        for token, i in vocab.items():
            self.tokens[i] = bytes(byte_of[c] for c in token)
        self.specials = {t["content"]: t["id"] for t in added}
        for content, i in self.specials.items():
            self.tokens[i] = content.encode()
        self.byte_ids = np.array([vocab[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = self.left.astype(np.int64) * self.size + self.right
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        ids = self.byte_ids.astype(np.int64)
        self.byte_pairs = self.ranks((ids[:, None] * self.size + ids[None, :]).ravel())

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair key, -1 where no merge has it."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.by_key[at], -1)


def _by_rank(ranks: np.ndarray, places: np.ndarray) -> Iterable[tuple[int, np.ndarray]]:
    order = np.argsort(ranks, kind="stable")
    ranks, places = ranks[order], places[order]
    cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
    return zip(ranks[np.r_[0, cuts]].tolist(), np.split(places, cuts), strict=True)


def encode_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and the place where each word begins (one more at the end)."""
    if not words:
        return np.empty(0, np.int32), np.zeros(1, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    total = len(data) + len(words) + 1  # a border before each word and at the end
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(words) + 1), sizes)
    raw = np.full(total, -1, np.int32)
    raw[at] = data
    symbols = np.full(total, -1, np.int32)
    symbols[at] = vocab.byte_ids[data]
    place = np.int32 if total < 2**31 - 1 else np.int64
    after, before = np.arange(1, total + 1, dtype=place), np.arange(-1, total - 1, dtype=place)
    inner = np.flatnonzero((raw[:-1] >= 0) & (raw[1:] >= 0))
    ranks = vocab.byte_pairs[raw[inner] * 256 + raw[inner + 1]]
    inner, ranks = inner[ranks >= 0], ranks[ranks >= 0]
    where: dict[int, list[np.ndarray]] = {}
    if len(inner):
        where = {r: [p] for r, p in _by_rank(ranks, inner)}
    active = sorted(where)
    while active:
        rank = heapq.heappop(active)
        places = np.unique(np.concatenate(where.pop(rank)))
        a, b, new = int(vocab.left[rank]), int(vocab.right[rank]), int(vocab.merged[rank])
        places = places[symbols[places] == a]
        seconds = after[places]
        still = symbols[seconds] == b
        places, seconds = places[still], seconds[still]
        if a == b and len(places) > 1:  # in a run of one symbol every other position begins a pair
            count = np.arange(len(places))
            first = np.r_[True, places[1:] != seconds[:-1]]
            even = (count - np.maximum.accumulate(np.where(first, count, 0))) % 2 == 0
            places, seconds = places[even], seconds[even]
        if not len(places):
            continue
        beyond = after[seconds]
        symbols[places], symbols[seconds] = new, -2
        after[places], before[beyond] = beyond, places
        ahead = before[places]
        found = np.concatenate([symbols[ahead].astype(np.int64) * vocab.size + new,
                                new * vocab.size + symbols[beyond].astype(np.int64)])
        whole = np.concatenate([symbols[ahead] >= 0, symbols[beyond] >= 0])
        spots = np.concatenate([ahead, places])[whole]
        ranks = vocab.ranks(found[whole])
        spots, ranks = spots[ranks >= 0], ranks[ranks >= 0]
        if len(spots):
            for r, p in _by_rank(ranks, spots):
                if r in where:
                    where[r].append(p)
                else:
                    where[r] = [p]
                    heapq.heappush(active, r)
    borders = np.flatnonzero(symbols == -1)
    alive = symbols >= 0
    starts = np.cumsum(alive)[borders]
    return symbols[alive], starts


class Encoder:
    """Encodes slices of texts; holds nothing between slices but the vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.words = vocab, regex.compile(WORDS)
        names = sorted(map(regex.escape, vocab.specials), key=len, reverse=True)
        self.specials = regex.compile(f"({'|'.join(names)})") if names else None

    def _split(self, text: str) -> list[str]:
        if self.specials is None or not self.specials.search(text):
            return self.words.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.specials.split(text)):
            out += [part] if i % 2 else self.words.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        number: dict[str, int] = defaultdict(itertools.count().__next__)
        docs = [np.fromiter(map(number.__getitem__, self._split(t)), np.int32) for t in texts]
        special = {number[s]: i for s, i in self.vocab.specials.items() if s in number}
        ids, starts = encode_words(self.vocab, [b"" if n in special else w.encode() for w, n in number.items()])
        lengths = np.diff(starts)
        out = []
        for doc in docs:
            each = lengths[doc]
            ends = np.cumsum(each)
            n = int(ends[-1]) if len(ends) else 0
            flat = ids[np.repeat(starts[doc] - ends + each, each) + np.arange(n)]
            for word, i in special.items():  # a special token has no symbols of its own
                flat = np.insert(flat, (ends - each)[doc == word], i) if (doc == word).any() else flat
            out.append(flat)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.vocab.tokens.__getitem__, ids)).decode("utf-8", "replace")


def _slices(batches: Iterable[pa.Array], chars: int) -> Iterator[list[str]]:
    """A slice goes on over batches: its size doesn't depend on theirs."""
    part: list[str] = []
    size = 0
    for texts in batches:
        for value in texts:
            text = value.as_py() or ""
            part.append(text)
            size += len(text)
            if size >= chars:
                yield part
                part, size = [], 0
    if part:
        yield part


def _ids_array(docs: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(docs) + 1, np.int32)
    np.cumsum([len(d) for d in docs], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *docs]), pa.int32()))


def _vocabulary(spark: SparkSession, path: str):
    """The file is read once by the driver: executors need no copy of it."""
    bounded_batches(spark)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_and_decode(spark: SparkSession, text: Column, path: str, slice_chars: int = SLICE_CHARS) -> Column:
    """struct<ids: array<int>, decoded: string> of a text column."""
    vocabulary = _vocabulary(spark, path)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    @releasing
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary(vocabulary.value))
        for part in _slices(batches, slice_chars):  # handed on slice by slice
            docs = encoder.encode(part)
            decoded = pa.array([encoder.decode(d.tolist()) for d in docs], pa.string())
            yield pa.StructArray.from_arrays([_ids_array(docs), decoded], ["ids", "decoded"])

    return both(text)


def digests(spark: SparkSession, text: Column, path: str, with_ids: bool = False, slice_chars: int = SLICE_CHARS) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256, ids> of a text column; ids are null unless asked for.

    Ids are digested (in decimal, joined by commas) and decoded where they are made: neither the decoded text nor
    a text form of the ids goes back to the JVM.
    """
    vocabulary = _vocabulary(spark, path)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,ids:array<int>>")
    @releasing
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary(vocabulary.value))
        table = decimal_table(encoder.vocab.size)
        for part in _slices(batches, slice_chars):
            docs = encoder.encode(part)
            ids = pa.nulls(len(docs), pa.list_(pa.int32())) if not with_ids else _ids_array(docs)
            yield pa.StructArray.from_arrays([
                pa.array([len(d) for d in docs], pa.int64()),
                pa.array([hashlib.sha256(decimals(d, np.full(len(d), 44, np.uint8), table)[:-1]).hexdigest() for d in docs]),
                pa.array([hashlib.sha256(encoder.decode(d.tolist()).encode()).hexdigest() for d in docs]),
                ids], ["n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return of(text)


def encode(spark: SparkSession, text: Column, path: str, slice_chars: int = SLICE_CHARS) -> Column:
    """array<int> of a text column."""
    vocabulary = _vocabulary(spark, path)

    @F.arrow_udf("array<int>")
    @releasing
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary(vocabulary.value))
        for part in _slices(batches, slice_chars):
            yield _ids_array(encoder.encode(part))

    return ids_of(text)


def decode(spark: SparkSession, ids: Column, path: str) -> Column:
    """string of a column of ids; null ids count as none."""
    vocabulary = _vocabulary(spark, path)

    @F.arrow_udf("string")
    @releasing
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary(vocabulary.value))
        for rows in batches:
            yield pa.array([encoder.decode(r.as_py() or []) for r in rows], pa.string())

    return text_of(ids)
