"""Cross-tokenizer alignment by lockstep vectorised merging.

Every text is encoded by two tokenizers over the same bytes (a space, then the
text): A, a byte-level BPE file, and B, a sentencepiece model with byte fallback.
Byte offsets where tokens of both end cut the text into groups; the A and B tokens
of one group are linked. For a slice of documents one NumPy state vector holds an A
and a B pointer for each lane; every step compares the ends below all pointers at
once, advances the shorter side (both where they agree), emits the cuts that were
met and the links of their groups, and drops the lanes that are done. Lanes are
documents; a long document is several lanes, cut at places where both tokenizers
end a token (probed from every ``LANE``-th A token on).

Corpus counts: each slice gives its distinct id pairs once with the number of its
documents that hold them, so the shuffle carries pairs a slice, not links. Summed
counts and each A id's highest come back to the slices, which hold the pairs of
each document as codes into the slice's list; documents and counts of a slice meet
in one group of bounded size.

A group of more than ``DENSE`` links is linked by its distinct ids and how often
each pair occurs, so a text without common ends makes no more rows than it has
pairs of ids.

Both vocabularies (a few MB whatever the input) are read by the driver and
broadcast. A slice is about ``SLICE_CHARS`` characters of whole texts; a longer text
is a slice of its own.

Defined results: null and empty texts, and texts whose bytes one tokenizer doesn't
give back, have no tokens and all zeros; strings of special tokens are plain text; a
repeated row counts as a document of its own; null ids pass through; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import stored
from .bpe import Encoder, Vocabulary
from .words import decimal_table, decimals, releasing

SLICE_CHARS = 16_000_000  # documents whose pairs are counted together
CHUNK_CHARS = 2_000_000  # documents merged in lockstep
LANE = 512  # A tokens between two places where a long document may be cut into lanes
DENSE = 4096  # links of a group from which on its distinct ids are paired

#: Fixed value: the pattern by which byte-level files of this kind split text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of blanks from here on go to the encoder of this package: the pattern's lookahead overflows a stack there.
LONG_BLANKS = re.compile(r"\s{20000}")


class Side:
    """One tokenizer: ids of texts, and the bytes and decimal digits of its ids."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        self.bytes_of = pieces
        self.lengths = np.fromiter(map(len, pieces), np.int64, self.size)

    def spells(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.bytes_of.__getitem__, ids)) == raw


class ByteLevel(Side):
    """A byte-level BPE file whose merges are ordered by id; special tokens are plain text."""

    def __init__(self, file: str):
        vocab = Vocabulary(file)
        if (np.diff(vocab.merged) <= 0).any():
            raise ValueError("merges in the order of their ids are needed")
        super().__init__(vocab.tokens)
        ranks = {t: i for i, t in enumerate(vocab.tokens) if t and i not in vocab.specials.values()}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Encoder(vocab)
        self.slow.specials = None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.slow.encode([" " + t])[0].tolist() if len(t) >= 20000 and LONG_BLANKS.search(t)
                else self.fast.encode_ordinary(" " + t) for t in texts]


class Pieces(Side):
    """A sentencepiece model that puts a space before the text."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode()
                          for i, n in enumerate(names)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


def _lanes(ends_a: np.ndarray, ends_b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first A, first B, end A) token of every lane; all start and end where both sides end a token."""
    sizes = np.diff(bounds_a)
    inner = np.maximum(sizes // LANE - 1, 0)
    doc = np.repeat(np.arange(len(sizes)), inner)
    nth = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner) + 1
    probe = bounds_a[doc] + nth * LANE  # the token whose end is tried, up to LANE places on
    found = np.zeros(len(probe), bool)
    for _ in range(LANE):
        open_ = np.flatnonzero(~found)
        if not len(open_):
            break
        want = ends_a[probe[open_]]
        hit = ends_b[np.minimum(np.searchsorted(ends_b, want), len(ends_b) - 1)] == want
        found[open_[hit]] = True
        probe[open_[~hit]] += 1
    cuts = probe[found] + 1
    first_a = np.sort(np.concatenate([bounds_a[:-1][sizes > 0], cuts]))
    before = np.r_[0, ends_a][first_a]
    first_b = np.searchsorted(ends_b, before, side="right")
    return first_a, first_b, np.r_[first_a[1:], len(ends_a)]


def _paired(a0: np.ndarray, na: np.ndarray, b0: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A place, B place) of all links of groups of na tokens from a0 and nb tokens from b0."""
    n = na * nb
    if len(n) and n.max() == 1:
        return a0, b0
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(nb, n)
    return np.repeat(a0, n) + nth // wide, np.repeat(b0, n) + nth % wide


def merge(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, bounds_a: np.ndarray,
          bounds_b: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
    """Lockstep merge of all documents: (cuts in A, cuts in B, A places, keys, times) of groups' ends and of links.

    Ends run on over all documents, whose two sides hold the same bytes. A key is A id * base + B id; the A
    place of a link tells its document.
    """
    i, j, stop = (x.copy() for x in _lanes(ends_a, ends_b, bounds_a, bounds_b))
    group_a, group_b = i.copy(), j.copy()
    cuts_a, cuts_b, places, keys, times = [], [], [], [], []
    while len(i):
        a, b = ends_a[i], ends_b[j]
        met = a == b
        if met.any():
            a0, b0, a1, b1 = group_a[met], group_b[met], i[met] + 1, j[met] + 1
            cuts_a.append(a1 - 1)
            cuts_b.append(b1 - 1)
            na, nb = a1 - a0, b1 - b0
            dense = na * nb > DENSE
            for k in np.flatnonzero(dense).tolist():
                x, nx = np.unique(ids_a[a0[k] : a1[k]], return_counts=True)
                y, ny = np.unique(ids_b[b0[k] : b1[k]], return_counts=True)
                keys.append((x.astype(np.int64)[:, None] * base + y).ravel())
                times.append(np.outer(nx, ny).ravel())
                places.append(np.full(len(x) * len(y), a0[k]))
            if dense.any():
                a0, b0, na, nb = (v[~dense] for v in (a0, b0, na, nb))
            x, y = _paired(a0, na, b0, nb)
            keys.append(ids_a[x].astype(np.int64) * base + ids_b[y])
            times.append(np.ones(len(x), np.int64))
            places.append(x)
        on_a, on_b = a <= b, b <= a
        i = i + on_a
        j = j + on_b
        group_a, group_b = np.where(met, i, group_a), np.where(met, j, group_b)
        open_ = i < stop
        if not open_.all():
            i, j, stop, group_a, group_b = (v[open_] for v in (i, j, stop, group_a, group_b))
    whole = [np.concatenate([np.empty(0, np.int64), *x]) for x in (cuts_a, cuts_b, places, keys, times)]
    return np.sort(whole[0]), np.sort(whole[1]), *whole[2:]


def group_strings(ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, bounds_a: np.ndarray,
                  digits: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document."""
    sizes_a, sizes_b = np.diff(np.r_[-1, cuts_a]), np.diff(np.r_[-1, cuts_b])
    n = len(ids_a) + len(ids_b)
    at_a = np.arange(len(ids_a)) + np.repeat(np.cumsum(sizes_b) - sizes_b, sizes_a)
    at_b = np.arange(len(ids_b)) + np.repeat(np.cumsum(sizes_a), sizes_b)
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[at_a], ids[at_b] = ids_a, ids_b
    mark[at_a[cuts_a]], mark[at_b[cuts_b]] = ord("|"), ord(";")
    data, length = decimals(ids, mark, digits), digits[1]
    # every document ends a group on both sides, so its tokens are one run
    ends = np.r_[0, np.cumsum(length[ids] + 1)]
    last_group = np.searchsorted(cuts_a, bounds_a[1:] - 1)  # the group that ends a document
    to = np.cumsum(sizes_a + sizes_b)
    out, begin = [], 0
    for k in range(len(bounds_a) - 1):
        if bounds_a[k] == bounds_a[k + 1]:
            out.append(b"")
            continue
        end = int(ends[to[last_group[k]]])
        out.append(data[begin : end - 1])
        begin = end
    return out


class Aligner:
    """Aligns chunks of documents; holds nothing between them but the vocabularies."""

    def __init__(self, file: str, model: bytes):
        self.a, self.b = ByteLevel(file), Pieces(model)
        self.digits = decimal_table(max(self.a.size, self.b.size))

    def align(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """((n_a, n_b, n_groups, n_links, groups) of each text; document, key and occurrences of its distinct id pairs)."""
        a, b = [], []
        for text, x, y in zip(texts, self.a.encode(texts), self.b.encode(texts), strict=True):
            raw = (" " + text).encode()
            fits = text != "" and self.a.spells(x, raw) and self.b.spells(y, raw)
            a.append(x if fits else [])
            b.append(y if fits else [])
        bounds_a, bounds_b = (np.cumsum([0, *map(len, x)]) for x in (a, b))
        ids_a, ids_b = (np.fromiter((i for d in x for i in d), np.int32, int(n[-1])) for x, n in ((a, bounds_a), (b, bounds_b)))
        ends_a, ends_b = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b])
        if not len(ids_a):
            none = np.empty(0, np.int64)
            return [(0, 0, 0, 0, b"")] * len(texts), none, none, none
        cuts_a, cuts_b, places, keys, times = merge(ids_a, ids_b, ends_a, ends_b, bounds_a, bounds_b, self.b.size)
        doc = np.searchsorted(bounds_a, places, side="right") - 1
        n_groups = np.diff(np.searchsorted(cuts_a, bounds_a))
        n_links = np.bincount(doc, times, len(texts)).astype(np.int64)
        strings = group_strings(ids_a, ids_b, cuts_a, cuts_b, bounds_a, self.digits)
        pair = doc * (self.a.size * self.b.size) + keys
        order = np.argsort(pair, kind="stable")
        pair, times = pair[order], times[order]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        times = np.add.reduceat(times, first)
        doc, keys = pair[first] // (self.a.size * self.b.size), pair[first] % (self.a.size * self.b.size)
        rows = list(zip(map(len, a), map(len, b), n_groups.tolist(), n_links.tolist(), strings, strict=True))
        return rows, doc, keys, times


class _Slice:
    """Documents whose pairs are counted together."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.chars = 0

    def add(self, aligner: Aligner, ids: list, texts: list[str]) -> None:
        rows, doc, keys, times = aligner.align(texts)
        for i, (n_a, n_b, n_groups, n_links, groups) in zip(ids, rows, strict=True):
            self.rows.append({"id": i, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
                              "groups_sha256": hashlib.sha256(groups).hexdigest() if n_a else ""})
        self.keys.append(keys)
        self.times.append(times)
        self.sizes.append(np.bincount(doc, minlength=len(texts)))
        self.chars += sum(map(len, texts))

    def batches(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([np.empty(0, np.int64), *self.keys])
        pairs, codes = np.unique(keys, return_inverse=True)
        holders = np.bincount(codes, minlength=len(pairs))
        bounds = np.r_[0, np.cumsum(np.concatenate([np.empty(0, np.int64), *self.sizes]))].astype(np.int32)

        def lists(values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, pa.int32()))

        columns = {n: [r[n] for r in self.rows] for n in ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        columns |= {"codes": lists(codes), "times": lists(np.minimum(np.concatenate([np.empty(0, np.int64), *self.times]), 2**31 - 1))}
        out = self._filled(columns, len(self.rows), number, schema)
        for k in range(0, len(self.rows), 1000):
            yield out.slice(k, 1000)
        for k in range(0, len(pairs), 100_000):
            part = slice(k, k + 100_000)
            n = len(pairs[part])
            yield self._filled({"pair": pairs[part], "code": np.arange(k, k + n, dtype=np.int32), "holders": holders[part]}, n, number, schema)

    @staticmethod
    def _filled(columns: dict, n: int, number: int, schema: pa.Schema) -> pa.RecordBatch:
        columns = columns | {"slice": np.full(n, number, np.int64)}
        return pa.RecordBatch.from_arrays([
            pa.nulls(n, f.type) if f.name not in columns else columns[f.name] if isinstance(columns[f.name], pa.Array)
            else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def align_tokens(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text",
                 slice_chars: int = SLICE_CHARS, chunk_chars: int = CHUNK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of the alignment of two tokenizers.

    documents: id, n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose corpus count is the highest of
    their A id), count_sum (of corpus counts over links). pairs: a, b, n (documents that hold the link), best.
    """
    spark = docs.sparkSession
    with open(byte_file, encoding="utf-8") as f, open(piece_file, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_field = rows.schema["id"]

    def with_id(columns: str) -> StructType:
        out = StructType([id_field])
        for field in StructType.fromDDL(columns).fields:
            out = out.add(field)
        return out

    slice_schema = with_id(f"{RESULT}, slice bigint, codes array<int>, times array<int>, pair bigint, code int, holders bigint")
    slice_arrow = to_arrow_schema(slice_schema)

    @releasing
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value)
        number = TaskContext.get().partitionId() << 32
        now, ids, texts, chars = _Slice(), [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("id"), batch.column("text"), strict=True):
                ids.append(i.as_py())
                texts.append(t.as_py() or "")
                chars += len(texts[-1])
                if chars >= chunk_chars or len(texts) >= 20_000:
                    now.add(aligner, ids, texts)
                    ids, texts, chars = [], [], 0
                    if now.chars >= slice_chars or len(now.rows) >= 200_000:
                        yield from now.batches(number, slice_arrow)
                        now, number = _Slice(), number + 1
        now.add(aligner, ids, texts)
        yield from now.batches(number, slice_arrow)

    slices = stored(rows.mapInArrow(aligned, slice_schema))
    wide = sentencepiece.SentencePieceProcessor(model_file=piece_file).get_piece_size()
    listed = slices.where(F.col("pair").isNotNull()).select("slice", "pair", "code", "holders")
    counted = listed.groupBy("pair").agg(F.sum("holders").alias("n"))
    counted = stored(counted.select("pair", F.floor(F.col("pair") / wide).cast("int").alias("a"), "n"))
    most = counted.groupBy("a").agg(F.max("n").alias("most"))  # as many rows as A has ids
    pairs = counted.join(F.broadcast(most), "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))
    known = (listed.select(F.col("slice").alias("of"), "pair", "code").join(pairs.select("pair", "n", "best"), "pair")
             .select("of", "code", "n", "best"))
    result_schema = with_id(f"{RESULT}, n_best bigint, count_sum bigint")
    result_arrow = to_arrow_schema(result_schema)

    def scored(documents: pa.Table, counts: pa.Table) -> pa.Table:
        n, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
        code = counts.column("code").to_numpy()
        n[code], best[code] = counts.column("n").to_numpy(), counts.column("best").to_numpy().astype(np.int64)
        documents = documents.combine_chunks()
        codes, times = documents.column("codes"), documents.column("times")
        bounds = np.r_[0, np.cumsum(pa.compute.list_value_length(codes).to_numpy())].astype(np.int64)
        at, often = (np.asarray(pa.compute.list_flatten(x)).astype(np.int64) for x in (codes, times))
        sums = [np.r_[0, np.cumsum(often * v[at])] for v in (best, n)]
        out = [pa.array((s[bounds[1:]] - s[bounds[:-1]])) for s in sums]
        keep = [documents.column(f.name).combine_chunks() if isinstance(documents.column(f.name), pa.ChunkedArray) else documents.column(f.name)
                for f in result_arrow if f.name not in ("n_best", "count_sum")]
        return pa.Table.from_arrays([*keep, *out], schema=result_arrow)

    of_slice = slices.where(F.col("codes").isNotNull()).select("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slice", "codes", "times")
    documents = of_slice.groupBy("slice").cogroup(known.groupBy("of")).applyInArrow(scored, result_schema)
    return documents, pairs.select("a", (F.col("pair") % wide).cast("int").alias("b"), "n", "best")
